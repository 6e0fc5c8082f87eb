"""Classifiers and clean-up for column names. Names live in the schema, so
this is the one place where plain Python strings are the right tool."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def col(name: str) -> Column:
    """Column by its literal name, whatever characters it holds."""
    return F.col(quoted(name))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _has_word(name: str, words: Iterable[str]) -> bool:
    return any(word in name.lower() for word in words)


def is_identifier_name(name: str) -> bool:
    return re.search("|".join(K.IDENTIFIER_PATTERNS), name.strip().lower()) is not None


def is_metric_name(name: str) -> bool:
    return _has_word(name, K.METRIC_WORDS)


def is_average_name(name: str) -> bool:
    return _has_word(name, K.AVERAGE_WORDS)


def is_date_name(name: str) -> bool:
    return _has_word(name, K.DATE_WORDS)


def is_geo_name(name: str) -> bool:
    return _has_word(name, K.GEO_WORDS)


def is_class_target_name(name: str) -> bool:
    return _has_word(name, K.CLASS_TARGET_WORDS)


def name_in(column: Column, names: Iterable[str]) -> Column:
    """True where a result row's column name is one of `names`."""
    names = list(names)
    return column.isin(names) if names else F.lit(False)


def collapse_spaces(name: str) -> str:
    return " ".join(str(name).split())


def unique_names(names: Iterable[str]) -> list[str]:
    """Clean headers and number repeats `_1, _2, ...`, ignoring case.

    A generated name never clashes with another header, since Spark resolves
    names without regard to case.
    """
    cleaned = [collapse_spaces(n) or "column" for n in names]
    originals = {n.lower() for n in cleaned}
    used: set[str] = set()
    repeats: dict[str, int] = {}
    result = []
    for name in cleaned:
        candidate = name
        while candidate.lower() in used or (
            candidate != name and candidate.lower() in originals
        ):
            repeats[name.lower()] = repeats.get(name.lower(), 0) + 1
            candidate = f"{name}_{repeats[name.lower()]}"
        used.add(candidate.lower())
        result.append(candidate)
    return result
