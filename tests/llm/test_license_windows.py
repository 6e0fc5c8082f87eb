"""License windows against the alignment of every window."""

import random

from autolens.llm import licenses as L


def found(words):
    return L.scan("", [(p, w) for p, w in enumerate(words) if w in L.SEEDS], words)


def test_repeated_seeds_do_not_end_a_stretch():
    text = (
        "Redistribution and use in source and binary forms, of the source code, with or without modification, are permitted "
        "provided that the following conditions are met"
    )
    assert [(name, share) for name, share, _, _ in found(L.words_of(text))] == [("BSD", 21 / 25)]


def test_edited_passages_are_found_as_by_aligning_every_window():
    rng = random.Random(12)
    reached = 0
    for _ in range(250):
        name, template = L.WORDS[rng.randrange(len(L.WORDS))]
        passage = list(template)
        for _ in range(rng.randint(0, len(template) // 4)):
            at = rng.randrange(len(passage))
            kind = rng.randrange(3)
            if kind == 0 and len(passage) > 1:
                del passage[at]
            else:
                passage[at : at + (kind == 1)] = [rng.choice([*template, "other"])]
        words = [f"wa{rng.randrange(50)}" for _ in range(20)] + passage + [f"wa{rng.randrange(50)}" for _ in range(20)]
        pairs = L.align(passage, template)
        share = len(pairs) / max(len(template), pairs[-1][0] + 1 - pairs[0][0]) if pairs else 0
        got = [s for n, s, _, _ in found(words) if n == name]
        if share >= L.COVERAGE:
            reached += 1
            assert got and max(got) >= L.COVERAGE, (name, passage)
    assert reached > 100
