"""Token ids of whole texts, as the tokenizers library gives them.

Texts of well-known characters are encoded by the same merges as ranks, which is faster;
`ranked` says when that is the same. Where the tokenizer drops white space, texts are taken
together: each distinct stretch between white space is encoded once and its ids are
gathered. Other texts go one by one, with the ids of recent words kept in a cache of bounded
size; what is not surely a plain word goes through the library as it is.
"""

from __future__ import annotations

import functools
import json
import os
import re
import sys
from array import array
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import chain, count

import numpy as np
import pyarrow as pa

from .common import Recent

#: Letters beside ASCII that every tokenizer's rules take as letters.
LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Marks that are neither letters nor numbers; the apostrophe has rules of its own.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Entries of one generation; a worker process holds two.
KEPT_CHUNKS = 420_000


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable bytes
    stand for themselves, the others are numbered on from 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


#: Stands for the end of a word; no clear text has it.
END = "\x01"
#: How byte-level tokenizers cut words, with the space before them or without.
SPACED_WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BARE_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts of characters that every library puts in the same classes (letters beyond ASCII
#: that have one small form), and their words as `BARE_WORDS` cuts them, in small letters.
CLEAR = re.compile("[\t\n\r -~À-ÖØ-öø-įıĲ-ňŊ-ž]*")
BARE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-įıĲ-ňŊ-ž]+|[0-9]|[^\\sa-z0-9ß-öø-įıĲ-ňŊ-ž]+")
#: Characters of the texts that are encoded together.
TOGETHER = 6_000_000


def _merged(token: bytes, rank: dict[tuple[bytes, bytes], int]) -> bool:
    """Whether a token's own bytes merge to it."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), 1 << 31))
        if (parts[best], parts[best + 1]) not in rank:
            return False
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return True


def ranked(model: dict, special: Sequence[str]):
    """The merges of a byte-level vocabulary as ranks of byte strings; None where that may differ.

    Ranks merge neighbours by the bytes they make, a list of merges by the two themselves.
    They agree if ids follow the order of merges and every token's bytes, taken alone,
    merge to it: then no other two neighbours with these bytes can be left over. The end
    of a word, where the vocabulary marks it, is a byte of its own that merges first.
    """
    byte_of = {c: b for b, c in _byte_letters().items()}
    suffix = model.get("end_of_word_suffix") or ""

    def raw(token: str) -> bytes:
        ends = bool(suffix) and token.endswith(suffix)
        body = token[: len(token) - len(suffix)] if ends else token
        return bytes(byte_of[c] for c in body) + (END.encode() if ends else b"")

    vocab = {t: i for t, i in model["vocab"].items() if t not in set(special)}
    if model.get("dropout") or any(c not in byte_of for t in vocab for c in t.removesuffix(suffix)):
        return None
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ranks = {raw(t): i for t, i in vocab.items()}
    singles = len(vocab) - len(pairs)
    if len(ranks) != len(vocab) or [vocab.get(x + y) for x, y in pairs] != list(range(singles, len(vocab))):
        return None
    order = {(raw(x), raw(y)): i for i, (x, y) in enumerate(pairs, 256)}
    if suffix:
        order |= {(bytes([b]), END.encode()): b for b in range(256)}
    expected = {bytes([b]) for b in range(256)} | ({bytes([b]) + END.encode() for b in range(256)} if suffix else set())
    if {t for t, i in ranks.items() if i < singles} != expected or not all(_merged(t, order) for t in ranks):
        return None
    import tiktoken

    return tiktoken.Encoding("ranked", pat_str=f"[^{END}]+{END}" if suffix else SPACED_WORDS, mergeable_ranks=ranks, special_tokens={})


class WordEncoder:
    """`encode(text)` gives the ids as little-endian unsigned 32-bit integers.

    Two kinds of file are cut into words here: byte-level ones whose words carry the
    space before them, and those that drop white space and mark word ends. Any other
    kind is encoded as a whole by the library.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if array("I").itemsize != 4 or sys.byteorder != "little":
            raise RuntimeError("ids are kept as little-endian 32-bit integers")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, norm, model = spec.get("pre_tokenizer") or {}, spec.get("normalizer"), spec["model"]
        self.ending = model.get("end_of_word_suffix") or ""
        parts = [p.get("type") for p in pre.get("pretokenizers", [])]
        self.spaced = (
            pre.get("type") == "ByteLevel" and norm is None and not self.ending
            and pre.get("use_regex") and not pre.get("add_prefix_space")
        )
        dropping = bool(self.ending) and parts == ["Split", "ByteLevel"] and bool(norm)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.by_word = bool(self.spaced or dropping) and not model.get("dropout")
        self.table = _byte_letters()
        self.before = " " if self.spaced else ""
        splits = [p["pattern"].get("Regex") for p in pre.get("pretokenizers", []) if p.get("type") == "Split"]
        norms = [n.get("type") for n in (norm or {}).get("normalizers", [])]
        known = self.spaced or (splits == [BARE_WORDS] and norms == ["NFC", "Replace", "Lowercase"])
        self.ranked = ranked(model, self.special) if self.by_word and known else None
        if self.ranked and self.ending:
            self.ends = np.array([self.ranked.decode_single_token_bytes(i).endswith(END.encode()) for i in range(self.ranked.n_vocab)])
        self.inner = Recent(self._inner, KEPT_CHUNKS)
        self.heads = Recent(self._head, KEPT_CHUNKS // 8) if self.spaced else self.inner
        self.marks = Recent(self._whole, 10_000)

    def _whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        """Letters, with the space before them where the tokenizer keeps it."""
        if self.ending:
            word = word.lower()
        if word.isascii():
            shown = "\u0120" + word[1:] if word[0] == " " else word
        else:
            shown = word.encode().decode("latin-1").translate(self.table)
        # The model itself marks the word's end.
        return array("I", [t.id for t in self.library.model.tokenize(shown)]).tobytes()

    def _inner(self, chunk: str) -> bytes:
        """A chunk after a space."""
        return self._chunk(chunk, self.before, self.inner)

    def _head(self, chunk: str) -> bytes:
        """A chunk at the start of a line."""
        return self._chunk(chunk, "", self.heads)

    def _chunk(self, chunk: str, before: str, known: Recent) -> bytes:
        """A run of characters other than white space: a word, marks around a word, or whatever else."""
        if chunk.isalpha() if chunk.isascii() else LATIN.fullmatch(chunk):
            return self._word(before + chunk)
        core = chunk.rstrip(MARKS)
        letters = core.lstrip(MARKS)
        if letters == chunk or any(x in chunk for x in self.special):
            return self._whole(before + chunk)
        if letters and not (letters.isalpha() if letters.isascii() else LATIN.fullmatch(letters)):
            return self._whole(before + chunk)
        if not letters:
            return self.marks[before + chunk]
        ahead, behind = core[: len(core) - len(letters)], chunk[len(core) :]
        ids = self.marks[before + ahead] + self.heads[letters] if ahead else known[letters]
        return ids + self.marks[behind] if behind else ids

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.by_word:
            return self._whole(text)
        chunks = text.split()
        if " ".join(chunks) != text.replace("\n", " "):
            return self._whole(text)  # runs of white space, tabs and the like
        if not self.spaced:
            return b"".join(map(self.inner.__getitem__, chunks))
        out, get = [], self.inner.__getitem__
        for i, line in enumerate(text.split("\n")):
            chunks = line.split(" ")
            if i:
                out.append(self.marks["\n"])
            out.append(self.heads[chunks[0]])
            del chunks[0]
            out += map(get, chunks)
        return b"".join(out)


    def _chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all stretches without white space in a row, and how many each has."""
        words = [BARE.findall(c) for c in chunks]
        if not words:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        ids = np.array(self.ranked.encode_ordinary("".join([w + END for w in chain.from_iterable(words)])), np.uint32)
        ends = np.flatnonzero(self.ends[ids])[np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) - 1]
        return ids, np.diff(ends, prepend=-1)

    def _together(self, texts: list[str]) -> list[bytes]:
        cut = [t.lower().split() for t in texts]
        place: defaultdict[str, int] = defaultdict(count().__next__)
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        at = np.fromiter(map(place.__getitem__, chain.from_iterable(cut)), np.int64, int(sizes.sum()))
        ids, counts = self._chunks(list(place))
        first, each = (np.cumsum(counts) - counts)[at], counts[at]
        ends = np.cumsum(each)
        where = np.repeat(first - (ends - each), each)
        where += np.arange(len(where))
        whole = ids[where].astype("<u4").tobytes()
        stops = (4 * np.r_[0, ends][np.cumsum(sizes)]).tolist()
        return [whole[s:e] for s, e in zip([0, *stops], stops, strict=False)]

    def encode_all(self, texts: Sequence[str]) -> list[bytes]:
        """`encode` of each text."""
        clear = [bool(self.ranked and CLEAR.fullmatch(t)) and not any(x in t for x in self.special) for t in texts]
        if self.spaced:
            fast = self.ranked and self.ranked.encode_ordinary
            return [array("I", fast(t)).tobytes() if c else self.encode(t) for t, c in zip(texts, clear, strict=True)]
        found = iter(self._together([t for t, c in zip(texts, clear, strict=True) if c]))
        return [next(found) if c else self.encode(t) for t, c in zip(texts, clear, strict=True)]

    def encode_column(self, texts: pa.Array) -> Iterator[tuple[int, bytes]]:
        """Number and ids of each text, in order, some millions of characters at a time."""
        held, first, size = [], 0, 0
        for i, text in enumerate(texts):
            held.append(text.as_py())
            size += len(held[-1])
            if size >= TOGETHER or i == len(texts) - 1:
                yield from enumerate(self.encode_all(held), first)
                held, first, size = [], i + 1, 0


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    """One encoder for each file and worker process."""
    return WordEncoder(path)
