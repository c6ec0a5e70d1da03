"""Arrow kernels for what columns cannot express: LCS, diffs, greedy matching.

Each works on one row's texts; Spark partitions and moves the rows.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from difflib import SequenceMatcher
from itertools import accumulate, chain
from math import erfc

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from draftlens.sources.wordlists import STOPWORDS

WLCS_POWER = 1.2

COUNTS_TYPE = T.StructType().add("h_tokens", "long").add("r_tokens", "long").add("matched", "long")
OP_TYPE = T.StructType().add("op", "string").add("tokens", "integer").add("text", "string")
EDITS_TYPE = T.StructType(list(COUNTS_TYPE.fields)).add("ops", T.ArrayType(OP_TYPE))
MATCH_TYPE = T.ArrayType(T.StructType().add("published", "integer").add("generated", "integer"))


def lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence, one bit per token of ``a``."""
    if not a or not b:
        return 0
    where: dict[str, int] = defaultdict(int)
    for i, token in enumerate(a):
        where[token] |= 1 << i
    full = (1 << len(a)) - 1
    row = full
    for token in b:
        hit = row & where.get(token, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


# Cells held per diagonal when pairs are filled side by side, and equal tokens of
# a group up to which their places are listed before it is filled.
WLCS_CELLS = 1 << 14
WLCS_PLACES = 1 << 20


def weighted_lcs(pairs: list[tuple[list[str], list[str]]], power: float = WLCS_POWER) -> list[float]:
    """Lin's weighted LCS of each pair, with weight k**power for a run of k matches.

    Pairs of like size are filled together, one anti-diagonal at a time. Cells
    beyond a pair's own corner hold padding, which no cell inside depends on.
    """
    out = [0.0] * len(pairs)
    todo = []
    for i, (a, b) in enumerate(pairs):
        if a == b:
            out[i] = float(len(a) ** power)
        elif a and b:
            todo.append((max(len(a), len(b)), min(len(a), len(b)), i))
    todo.sort()
    group: list[tuple[int, int, int]] = []
    for item in todo + [(0, 0, -1)]:
        width = max([g[1] for g in group] + [item[1]])
        full = group and (
            item[2] < 0 or (len(group) + 1) * width > WLCS_CELLS or item[0] > 1.2 * group[0][0] + 8
        )
        if full:
            members = [g[2] for g in group]
            for i, score in zip(members, _fill_together([pairs[i] for i in members], power)):
                out[i] = score
            group = []
        group.append(item)
    return out


def _equal_places(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, list[int]] | None:
    """Flat places of equal tokens by diagonal, and where each diagonal's begin; None if they are many.

    ``x`` and ``y`` hold a column for each pair; codes below zero are padding.
    """
    n, wide = x.shape
    name = lambda t: np.where(t < 0, -1, t.astype(np.int64) * wide + np.arange(wide)).ravel()
    left, right = name(x), name(y)
    order = np.argsort(right, kind="stable")
    right = right[order]
    first = np.searchsorted(right, left, "left")
    count = np.where(left < 0, 0, np.searchsorted(right, left, "right") - first)
    total = int(count.sum())
    if total > WLCS_PLACES or n + len(y) > 65_000:
        return None
    row = np.repeat(np.arange(len(left)), count)
    other = order[np.arange(total) + np.repeat(first - (np.cumsum(count) - count), count)]
    # Table row i + 1 and column j + 1 lie on diagonal i + j + 2.
    diagonal = (row // wide + other // wide + 2).astype(np.uint16)
    by = np.argsort(diagonal, kind="stable")
    return (row + wide)[by], np.searchsorted(diagonal[by], np.arange(n + len(y) + 2)).tolist()


def _fill_together(pairs: list[tuple[list[str], list[str]]], power: float) -> list[float]:
    sides = [(a, b) if len(a) <= len(b) else (b, a) for a, b in pairs]
    n = max(len(a) for a, _ in sides)
    m = max(len(b) for _, b in sides)
    wide = len(sides)
    # One column per pair, so the part of a diagonal in use is one flat block.
    x = np.full((n, wide), -1, np.int32)
    y = np.full((m, wide), -2, np.int32)
    ends: dict[int, list[int]] = defaultdict(list)
    for col, (a, b) in enumerate(sides):
        codes: dict[str, int] = {}
        x[: len(a), col] = [codes.setdefault(t, len(codes)) for t in a]
        y[: len(b), col] = [codes.setdefault(t, len(codes)) for t in b]
        ends[len(a) + len(b)].append(col)
    listed = _equal_places(x, y)
    x, y = x.ravel(), y[::-1].ravel()
    weight = np.arange(n + 2, dtype=np.float64) ** power
    gain = weight[1:] - weight[:-1]
    # Row i of a diagonal is table row i; row 0 and column 0 of the table hold
    # zeros. Scores rotate through three buffers, runs of matches likewise.
    score2, score1, score = (np.zeros((n + 1) * wide) for _ in range(3))
    run2, run1, run = (np.zeros((n + 1) * wide, np.int32) for _ in range(3))
    old2, old1, old = (np.empty(0, np.int64) for _ in range(3))
    out = [0.0] * wide
    for d in range(2, max(ends) + 1):
        lo, hi = max(1, d - m), min(n, d - 1)
        # Row i meets column d - i; y is reversed, so both run upwards.
        at, size, other = lo * wide, (hi - lo + 1) * wide, (m - d + lo) * wide
        np.maximum(score1[at - wide : at - wide + size], score1[at : at + size], out=score[at : at + size])
        run[old] = 0
        if listed is not None:
            old = listed[0][listed[1][d] : listed[1][d + 1]]
        else:
            old = np.flatnonzero(x[at - wide : at - wide + size] == y[other : other + size]) + at
        if len(old):
            before = old - wide
            k = run2[before]
            score[old] = score2[before] + gain[k]
            run[old] = k + 1
        for col in ends.get(d, ()):
            out[col] = float(score[len(sides[col][0]) * wide + col])
        score2, score1, score = score1, score, score2
        run2, run1, run = run1, run, run2
        old2, old1, old = old1, old, old2
    return out


def _words(texts: pd.Series) -> list[list[str]]:
    return [(t or "").split() for t in texts]


def shared_grams(a: list[str], b: list[str], orders=(1, 2, 3, 4)) -> list[int]:
    """Clipped n-gram matches of two token lists, for each order."""
    out = []
    for n in orders:
        left, right = (Counter(zip(*[t[i:] for i in range(n)])) for t in (a, b))
        if len(left) > len(right):
            left, right = right, left
        out.append(sum(min(c, right[g]) for g, c in left.items() if g in right))
    return out


# Tokens of the pairs whose n-grams are counted in one go.
GRAM_TOKENS = 1 << 18


def shared_grams_of(pairs: list[tuple[list[str], list[str]]], orders: int = 4) -> np.ndarray:
    """Clipped matches of 1- to n-grams, one row for each pair, many pairs at a time."""
    out, begin, held = np.zeros((len(pairs), orders), np.int64), 0, 0
    for k, (a, b) in enumerate(pairs):
        held += len(a) + len(b)
        if held >= GRAM_TOKENS or k == len(pairs) - 1:
            out[begin : k + 1] = _count_together(pairs[begin : k + 1], orders)
            begin, held = k + 1, 0
    return out


def _count_together(pairs: list[tuple[list[str], list[str]]], orders: int) -> np.ndarray:
    texts = [t for pair in pairs for t in pair]
    size = np.array([len(t) for t in texts])
    text = np.repeat(np.arange(len(texts)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(text))  # tokens from here to the text's end
    words, names = pd.factorize(np.array(list(chain.from_iterable(texts)), dtype=object))
    out = np.zeros((len(pairs), orders), np.int64)
    gram = text // 2  # a gram belongs to its pair; each order adds a word to it
    for n in range(orders):
        at = np.flatnonzero(left > n)
        ids, found = pd.factorize(gram[at] * (len(names) + 1) + words[at + n])
        gram = np.zeros(len(text), np.int64)
        gram[at] = ids
        here, mine = np.zeros(len(found), np.int64), text[at]
        here[ids] = mine // 2
        second = np.bincount(ids, weights=mine % 2, minlength=len(found)).astype(np.int64)
        shared = np.minimum(np.bincount(ids, minlength=len(found)) - second, second)
        out[:, n] = np.bincount(here, weights=shared, minlength=len(pairs))
    return out


@F.pandas_udf(T.ArrayType(T.LongType()))
def gram_matches(hyp: pd.Series, ref: pd.Series) -> pd.Series:
    """Clipped 1- to 4-gram matches of two space-separated token texts."""
    return pd.Series(list(shared_grams_of(list(zip(_words(hyp), _words(ref))))))


@F.pandas_udf(T.LongType())
def lcs_score(hyp: pd.Series, ref: pd.Series) -> pd.Series:
    """LCS length of two space-separated token texts."""
    return pd.Series([lcs_length(a, b) for a, b in zip(_words(hyp), _words(ref))])


@F.pandas_udf(T.DoubleType())
def wlcs_score(hyp: pd.Series, ref: pd.Series) -> pd.Series:
    """Weighted LCS of two space-separated token texts."""
    return pd.Series(weighted_lcs(list(zip(_words(hyp), _words(ref)))))


_WORD = re.compile("[A-Za-z0-9]+")
_PIECES = re.compile("([A-Za-z0-9]+)")
_STOP = frozenset(STOPWORDS)

# Tokens of the shortest run that is listed ahead, and listed pairs of places for each token at most.
RUN, RUN_PAIRS = 4, 64


def _gram_ids(both: np.ndarray, size: int) -> np.ndarray:
    """A number for the run of ``size`` tokens (a power of two) at each place, equal for equal runs."""
    n, most = 1, int(both.max()) + 1
    while n < size:
        both = both[:-n] * most + both[n:]
        n, most = 2 * n, most * most
        if most >= 1 << 31:
            both = np.unique(both, return_inverse=True)[1]
            most = len(both)
    return both


def _shared_runs(a: np.ndarray, b: np.ndarray, below: int) -> tuple[int, list[tuple[int, int, int]]]:
    """All maximal runs (place in a, place in b, length) of a least length that both lists share.

    That length is the first power of two whose pairs of places are few for the
    lists' size. If none under ``below`` is, it is 1 and no run is listed.
    """
    size, both = RUN, np.concatenate([a, b])
    while size < below and size <= min(len(a), len(b)):
        ids = _gram_ids(both, size)
        left, right = ids[: len(a) - size + 1], ids[len(a) :]
        order = np.argsort(right, kind="stable")
        right = right[order]
        first = np.searchsorted(right, left, "left")
        count = np.searchsorted(right, left, "right") - first
        total = int(count.sum())
        if total <= RUN_PAIRS * len(both):
            break
        size *= 2
    else:
        return (RUN, []) if size == RUN < below else (1, [])
    if not total:
        return size, []
    i = np.repeat(np.arange(len(left)), count)
    j = order[np.arange(total) + np.repeat(first - (np.cumsum(count) - count), count)]
    by = np.argsort(i - j, kind="stable")
    i, j = i[by], j[by]
    begin = np.flatnonzero(np.concatenate([[True], (np.diff(i) != 1) | (np.diff(j) != 1)]))
    length = np.diff(begin, append=total) + size - 1
    return size, list(zip(i[begin].tolist(), j[begin].tolist(), length.tolist()))


def _longest_run(a: list[int], where: dict[int, list[int]], alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
    """The longest run within the bounds: minus its length and its places, the first of equals."""
    best, before = (0, 0, 0), {}
    for i in range(alo, ahi):
        now = {}
        if places := where.get(a[i]):
            for k in range(bisect_left(places, blo), len(places)):
                j = places[k]
                if j >= bhi:
                    break
                n = now[j] = before.get(j - 1, 0) + 1
                if n > -best[0]:
                    best = (-n, i - n + 1, j - n + 1)
        before = now
    return best


def matching_blocks(h: list[str], r: list[str]) -> list[tuple[int, int, int]]:
    """The blocks of ``SequenceMatcher(None, h, r, autojunk=False)``, without its empty last one.

    The longest run first, then those before and after it. Runs of some length are
    listed once and clipped from step to step; only what is left between them is
    searched place by place.
    """
    if h == r:
        return [(0, 0, len(h))] if h else []
    codes: dict[str, int] = {}
    a, b = ([codes.setdefault(t, len(codes)) for t in text] for text in (h, r))
    x, y = np.array(a, np.int64), np.array(b, np.int64)
    where: dict[int, list[int]] = {}
    found, todo = [], [(0, len(a), 0, len(b), *_shared_runs(x, y, len(a) + 1))]
    while todo:
        alo, ahi, blo, bhi, least, runs = todo.pop()
        best, inside = (0, 0, 0), []
        for i, j, n in runs:
            cut = max(alo - i, blo - j, 0)
            n = min(n, ahi - i, bhi - j) - cut
            if n >= least:
                inside.append((i + cut, j + cut, n))
                best = min(best, (-n, i + cut, j + cut))
        if not inside and least > RUN:  # shorter runs may be few in this part
            least, runs = _shared_runs(x[alo:ahi], y[blo:bhi], least)
            if runs:
                todo.append((alo, ahi, blo, bhi, least, [(i + alo, j + blo, n) for i, j, n in runs]))
                continue
        if not inside and not set(a[alo:ahi]).isdisjoint(b[blo:bhi]):
            if not where:
                for j, t in enumerate(b):
                    where.setdefault(t, []).append(j)
            best = _longest_run(a, where, alo, ahi, blo, bhi)
        n, i, j = -best[0], best[1], best[2]
        if n:
            found.append((i, j, n))
            if alo < i and blo < j:
                todo.append((alo, i, blo, j, least, inside))
            if i + n < ahi and j + n < bhi:
                todo.append((i + n, ahi, j + n, bhi, least, inside))
    out: list[tuple[int, int, int]] = []
    for i, j, n in sorted(found):
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            i, j, n = out[-1][0], out[-1][1], out.pop()[2] + n
        out.append((i, j, n))
    return out


def _blocks(h: list[str], r: list[str], skip_popular: bool) -> list[tuple[int, int, int]]:
    if skip_popular:
        return [tuple(b) for b in SequenceMatcher(None, h, r).get_matching_blocks()[:-1]]
    return matching_blocks(h, r)


def _lower_tokens(text: str) -> list[str]:
    if "\u0130" in text or "\u212a" in text:  # the only signs that turn into a-z
        return [t.lower() for t in _WORD.findall(text)]
    return _WORD.findall(text.lower())


def _spans(text: str) -> tuple[list[str], list[int]]:
    """Tokens in lower case, and the places where they begin and end by turns."""
    pieces = _PIECES.split(text)
    return [t.lower() for t in pieces[1::2]], list(accumulate(map(len, pieces)))


def edit_totals(hypothesis: str, reference: str) -> tuple[int, int, int]:
    """The counts of ``edit_ops`` alone."""
    h, r = _lower_tokens(hypothesis), _lower_tokens(reference)
    runs = ((i, n) for i, _, n in matching_blocks(h, r))
    return len(h), len(r), sum(n for i, n in runs if not _STOP.issuperset(h[i : i + n]))


def edit_ops(hypothesis: str, reference: str, skip_popular: bool = False) -> tuple[int, int, int, list[dict]]:
    """Token counts, matched tokens with content, and the edits in order.

    Long and short texts are treated alike. ``skip_popular`` leaves out of the
    matching what makes up over a hundredth of a text of 200 tokens or more, which
    is faster on long texts and matches less.

    Ops are ``keep`` (a shared run with a content word), ``shared`` (only stop
    words), ``delete`` and ``insert``; each has its token count and the original
    text between its first and last token.
    """
    (h, h_at), (r, r_at) = _spans(hypothesis), _spans(reference)
    matched, ops = 0, []

    def add(op, text, at, lo, hi):
        if hi > lo:
            ops.append({"op": op, "tokens": hi - lo, "text": text[at[2 * lo] : at[2 * hi - 1]]})

    i = j = 0
    for block in [*_blocks(h, r, skip_popular), (len(h), len(r), 0)]:
        add("delete", hypothesis, h_at, i, block[0])
        add("insert", reference, r_at, j, block[1])
        i, j = block[0] + block[2], block[1] + block[2]
        content = not _STOP.issuperset(h[block[0] : i])
        matched += block[2] if content else 0
        add("keep" if content else "shared", reference, r_at, block[1], j)
    return len(h), len(r), matched, ops


@F.pandas_udf(EDITS_TYPE)
def edit_scores(hyp: pd.Series, ref: pd.Series) -> pd.DataFrame:
    rows = [edit_ops(h or "", r or "") for h, r in zip(hyp, ref)]
    return pd.DataFrame(rows, columns=["h_tokens", "r_tokens", "matched", "ops"])


# Exploding a result makes Spark infer a filter on it. Unless the kernel counts
# as nondeterministic, that filter and a second run of the kernel move below the
# exchange that spreads the texts.
edit_scores = edit_scores.asNondeterministic()


@F.pandas_udf(COUNTS_TYPE)
def edit_counts(hyp: pd.Series, ref: pd.Series) -> pd.DataFrame:
    rows = [edit_totals(h or "", r or "") for h, r in zip(hyp, ref)]
    return pd.DataFrame(rows, columns=["h_tokens", "r_tokens", "matched"])


def _grams(sentence: str, size: int) -> frozenset[str]:
    words = sentence.split()
    return frozenset(" ".join(words[i : i + size]) for i in range(0, len(words), size))


def greedy_matches(published: list[str], generated: list[str], size: int = 3) -> list[tuple[int, int]]:
    """For each published sentence the unused generated one sharing most chunks.

    Ties go to the lowest index. Generated sentences with equal chunk sets are
    interchangeable, so they wait in one queue, and only queues that share a
    chunk are visited.
    """
    queues: dict[frozenset[str], list[int]] = {}
    for i, sentence in enumerate(generated):
        queues.setdefault(_grams(sentence, size), []).append(i)
    holders: dict[str, set[frozenset[str]]] = defaultdict(set)
    for grams in queues:
        for gram in grams:
            holders[gram].add(grams)
    for queue in queues.values():
        heapq.heapify(queue)
    found = []
    for i, sentence in enumerate(published):
        shared: dict[frozenset[str], int] = defaultdict(int)
        for gram in _grams(sentence, size):
            for grams in holders.get(gram, ()):
                shared[grams] += 1
        if not shared:
            continue
        best = max(shared, key=lambda g: (shared[g], -queues[g][0]))
        found.append((i, heapq.heappop(queues[best])))
        if not queues[best]:
            for gram in best:
                holders[gram].discard(best)
    return found


@F.pandas_udf(MATCH_TYPE)
def match_sentences(published: pd.Series, generated: pd.Series) -> pd.Series:
    return pd.Series(
        [
            [{"published": a, "generated": b} for a, b in greedy_matches(list(p), list(g))]
            if p is not None and g is not None
            else None
            for p, g in zip(published, generated)
        ]
    )


match_sentences = match_sentences.asNondeterministic()


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function, after Lentz."""
    tiny = 1e-300
    guard = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c = np.ones_like(x)
    d = 1.0 / guard(1.0 - (a + b) * x / (a + 1.0))
    out = d.copy()
    for i in range(1, 400):
        even = i * (b - i) * x / ((a + 2 * i - 1) * (a + 2 * i))
        odd = -(a + i) * (a + b + i) * x / ((a + 2 * i) * (a + 2 * i + 1))
        for term in (even, odd):
            d = 1.0 / guard(1.0 + term * d)
            c = guard(1.0 + term / c)
            out = out * d * c
    return out


def _half_step(a: np.ndarray) -> np.ndarray:
    """log of gamma(a + 1/2) / gamma(a), without a difference of large numbers.

    Up to 30 by the recurrence gamma(a + 1) = a gamma(a), beyond by the series in
    1 / a that follows from Stirling's.
    """
    steps = np.where(a > 0, np.ceil(np.maximum(0.0, 30.0 - a)), 0.0)
    out = np.where(a > 0, 0.0, np.nan)
    for k in range(int(steps.max(initial=0.0))):
        on = k < steps
        out = out - np.where(on, np.log1p(0.5 / np.where(on, a + k, 1.0)), 0.0)
    v = 1.0 / np.where(a > 0, a + steps, 1.0)
    return out - 0.5 * np.log(v) + v * (-1 / 8 + v * v * (1 / 192 + v * v * (-1 / 640 + v * v * (17 / 14336 - v * v * 31 / 18432))))


def pearson_p(r: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two-sided p-value of a Pearson correlation over n pairs."""
    a = np.asarray(n, dtype=np.float64) / 2.0 - 1.0
    with np.errstate(all="ignore"):
        y = np.clip(np.asarray(r, dtype=np.float64) ** 2, 0.0, 1.0)
        x = 1.0 - y
        b = np.full_like(a, 0.5)
        front = np.exp(_half_step(a) - 0.5 * np.log(np.pi) + a * np.log1p(-y) + b * np.log(y))
        low = front * _beta_fraction(a, b, x) / a
        high = 1.0 - front * _beta_fraction(b, a, y) / b
        p = np.where(x < (a + 1.0) / (a + b + 2.0), low, high)
        # For many pairs, where y is tiny: Wallace's normal form, exact to the inverse square of n.
        z = np.sqrt(-2.0 * a * np.log1p(-y)) * (16.0 * a + 1.0) / (16.0 * a + 3.0)
        p = np.where(a > 1e5, np.array([erfc(v) for v in z / np.sqrt(2.0)]), p)
    p = np.where(y == 1.0, 0.0, np.where(y == 0.0, 1.0, p))
    # Two points always lie on a line, so they say nothing.
    return np.where(np.asarray(n) == 2, 1.0, np.clip(p, 0.0, 1.0))


@F.pandas_udf(T.DoubleType())
def pearson_p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    p = pearson_p(r.to_numpy(np.float64), n.to_numpy(np.float64))
    return pd.Series(p).where(r.notna() & (n >= 2))
