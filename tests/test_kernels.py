"""Kernels against plain forms: blocks of difflib, counted n-grams, the whole table of the weighted LCS."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from draftlens.functions import kernels as N


def reordered(rnd, words, length):
    """A text of so many words, and the same with its first part moved and words replaced or left out."""
    a = [str(rnd.randrange(words)) for _ in range(length)]
    cut = rnd.randrange(length + 1)
    return a, [rnd.choice([x, x, x, "z"]) if rnd.random() < 0.2 else x for x in a[cut:] + a[:cut] if rnd.random() > 0.05]


@pytest.mark.parametrize("pairs", [0, 1, 64])
def test_blocks_are_those_of_difflib(monkeypatch, pairs):
    monkeypatch.setattr(N, "RUN_PAIRS", pairs)
    rnd = random.Random(pairs)
    for _ in range(300):
        a, b = reordered(rnd, rnd.choice([1, 2, 5, 50]), rnd.randrange(90))
        want = [tuple(m) for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()[:-1]]
        assert N.matching_blocks(a, b) == want
        h, r = " the ".join(a), " Of, ".join(b)
        assert N.edit_totals(h, r) == N.edit_ops(h, r)[:3]


def test_long_texts_are_not_searched_place_by_place(monkeypatch):
    """Reordered text: what is left between listed runs is a small part of all pairs of places."""
    seen = []
    search = N._longest_run
    monkeypatch.setattr(N, "_longest_run", lambda a, where, alo, ahi, blo, bhi: seen.append((ahi - alo) * (bhi - blo)) or search(a, where, alo, ahi, blo, bhi))
    a, b = reordered(random.Random(3), 300, 4000)
    N.matching_blocks(a, b)
    assert sum(seen) < len(a) * len(b) / 20


def test_signs_that_turn_into_letters():
    for text in ("aKb İx", "Äa B", "plain Text 9"):
        assert N._lower_tokens(text) == [t.lower() for t in N._WORD.findall(text)]


def test_grams_of_many_pairs(monkeypatch):
    rnd = random.Random(5)
    pairs = [reordered(rnd, 4, rnd.randrange(30)) for _ in range(40)] + [([], ["a"]), ([], [])]
    want = [N.shared_grams(a, b) for a, b in pairs]
    for tokens in (1, 100, 1 << 18):
        monkeypatch.setattr(N, "GRAM_TOKENS", tokens)
        assert N.shared_grams_of(pairs).tolist() == want
    assert N.shared_grams_of([]).shape == (0, 4)


def test_weighted_lcs_with_listed_places(monkeypatch):
    rnd = random.Random(6)
    pairs = [reordered(rnd, 6, rnd.randrange(40)) for _ in range(40)]
    listed = N.weighted_lcs(pairs)
    x, y = np.array([[0], [1]], np.int32), np.array([[1], [-2]], np.int32)
    places, bounds = N._equal_places(x, y)
    assert places.tolist() == [2] and bounds[3:5] == [0, 1]
    monkeypatch.setattr(N, "WLCS_PLACES", -1)
    assert N.weighted_lcs(pairs) == listed
