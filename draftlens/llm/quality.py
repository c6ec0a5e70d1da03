"""Quality classifier by importance resampling.

Texts are bags of hashed word and punctuation unigrams and bigrams. Two smoothed
models, of labelled good texts and of all texts, give each document a log ratio of
likelihoods. With Gumbel noise added, the k largest keys are a sample of k documents
drawn without replacement in proportion to their importance.

The n-grams of one text are not independent, so the plain ratio of a long text grows
with its length: a slight difference, such as a language that the labelled texts hold
a little less of, would outweigh any sign of junk. Every text is therefore read as if
SPAN neutral n-grams stood beside its own, and counts as SPAN n-grams of the average
of both. One formula serves all lengths.

The number of hash buckets grows with the root of the corpus, as the number of its
frequent n-grams does, and the weight of the prior with the good texts that are seen.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlens.llm import common as C
from draftlens.llm import rolling as R

#: Hash buckets of the n-gram models, at least and at most; between, twice the root of the number of n-grams.
BUCKETS, MOST = 1 << 13, 1 << 20

#: Tokens that the good model starts from: so many, and so many for each token of good text.
PRIOR, SHARE = 1_500_000, 4

#: At most so many labelled rows of either kind, lowest id hash first, are read to fit.
LABELLED = 20_000

#: Neutral n-grams beside those of a text, and n-grams that it counts as.
SPAN = 500

#: Bytes of whole texts whose n-grams are listed at a time. A byte takes about 60 while they
#: are, and a worker keeps 16 a byte of its largest piece for all stages after this one.
PIECE = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
KIND = np.full(256, 2, np.uint8)  # 0: white space, 1: letters, digits and non-ASCII, 2: the rest
KIND[[9, 10, 11, 12, 13, 32]] = 0
KIND[48:58] = KIND[65:91] = KIND[97:123] = KIND[128:] = 1


def buckets(docs: DataFrame, text_col: str) -> int:
    """Buckets for a corpus: from its bytes, about three an n-gram."""
    size = docs.agg(F.sum(F.octet_length(docs[text_col]))).first()[0] or 0
    return int(min(MOST, max(BUCKETS, 2 * np.sqrt(size / 3))))


def features(raw: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each unigram and bigram, and the text it is in."""
    kind = KIND[raw]
    new = np.ones(len(raw) + 1, bool)
    new[1:-1] = kind[1:] != kind[:-1]
    new[off] = True
    begin = np.flatnonzero(new[:-1])
    end = np.append(begin[1:], len(raw))
    solid = kind[begin] > 0
    begin, end = begin[solid], end[solid]
    doc = np.searchsorted(off, begin, "right") - 1
    one = R.word_hashes(LOWER[raw], begin, end)
    both = doc[1:] == doc[:-1]
    two = R.mix(one[:-1] * np.uint64(3) + one[1:])[both]
    two[(one[1:] == one[:-1])[both]] = 0  # any token said twice is one bigram
    return (np.concatenate([one, two]) % np.uint64(n)).astype(np.int64), np.concatenate([doc, doc[:-1][both]])


def _counts(docs: DataFrame, id_col: str, text_col: str, good: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts over good and over all texts: one small row set per task."""

    def count(batches):
        total = np.zeros((2, size), np.int64)
        for b in batches:
            raw, off = C.texts(b.column(1))
            ident = b.column(0).fill_null(C.LAST_ID).to_numpy()
            chosen = np.isin(ident, good)
            for i, j in C.pieces(off, PIECE):
                bucket, doc = features(raw[off[i]:off[j]], off[i:j + 1] - off[i], size)
                total[1] += np.bincount(bucket, minlength=size)
                total[0] += np.bincount(bucket[chosen[doc + i]], minlength=size)
        some = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0][some]), pa.array(total[1][some])], ["bucket", "good", "raw"])

    rows = docs.select(docs[id_col].cast("long"), docs[text_col]).mapInArrow(count, "bucket long, good long, raw long")
    out = np.zeros((2, size), np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("good"), F.sum("raw")).collect():  # as many rows as buckets
        out[:, r[0]] = r[1], r[2]
    return out[0], out[1]


def _labelled(labels: DataFrame, quality: int) -> np.ndarray:
    rows = labels.where((F.col("quality") == quality) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long")).distinct()
    return np.array([r[0] for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED).collect()], np.int64)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Log ratio of each bucket: good model over raw model.

    The good model starts from PRIOR tokens and SHARE times as many as it sees, spread as
    the raw model is, so that a bucket of which little is known tells nothing.
    """
    size = buckets(docs, text_col)
    good, raw = _counts(docs, id_col, text_col, _labelled(labels, 1), size)
    if not good.any():
        return np.zeros(size)
    share, known = (raw + 1) / (raw.sum() + size), PRIOR + SHARE * good.sum()
    return np.log((good + known * share) / (good.sum() + known)) - np.log(share)


def scored(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns, and importance: the log ratio of the whole text, counted as SPAN n-grams (0 without words)."""
    docs = docs.drop("importance")
    at = docs.columns.index(text_col)

    def score(batches):
        for b in batches:
            raw, off = C.texts(b.column(at))
            for i, j in C.pieces(off, PIECE):
                bucket, doc = features(raw[off[i]:off[j]], off[i:j + 1] - off[i], len(weights))
                n = np.bincount(doc, minlength=j - i)
                out = np.bincount(doc, weights[bucket], j - i) * (SPAN / (n + SPAN))
                yield pa.RecordBatch.from_arrays([*b.slice(i, j - i).columns, pa.array(out)], [*b.schema.names, "importance"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(score, schema + ", importance double")


def gumbel(ident, seed: int) -> F.Column:
    """Noise fixed by id: reruns agree."""
    u = (F.shiftrightunsigned(F.xxhash64(ident, F.lit(seed)), 11) + F.lit(0.5)) / F.lit(2.0**53)
    return -F.log(-F.log(u))


def kth_largest(rows: DataFrame, column: str, k: int) -> float | None:
    """The exact k-th largest of a column; none if there are fewer rows.

    Each step deals the values that may still be it to 257 bins by size, counts the
    bins and goes on with the one that holds it, until that holds one value.
    """
    value = F.col(column)
    rows = rows.where(value.isNotNull())
    bounds = rows.agg(F.count(value), F.min(value), F.max(value)).first()
    if k <= 0 or bounds[0] < k:
        return None
    low, high = bounds[1], bounds[2]
    while low < high:
        span = F.lit(high - low)
        bins = rows.where(value.between(low, high)).groupBy(F.floor((value - low) / span * 256).alias("bin"))
        counts = bins.agg(F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
        for b in sorted(counts.collect(), reverse=True):  # at most 257 rows
            if k <= b.n:
                low, high = b.low, b.high
                break
            k -= b.n
    return low


def select(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = -2.0,
           seed: int = 17) -> DataFrame:
    """Every row with importance, key (importance plus noise) and kept (among the k largest keys).

    k is the number of documents whose importance is at least ``least``: all but
    those that the raw model explains clearly better than the good one. Rows that
    tie with the k-th key are kept too. A text without words (null, empty) has
    importance 0. Noise goes by id, so repeated rows agree; null ids share theirs.
    Without good labels both models would be compared unfitted, so nothing is
    rejected then. Columns named importance, key or kept are replaced, others stay.
    """
    docs = docs.drop("importance", "key", "kept")
    weights = fit(docs, labels, id_col, text_col)
    rows = scored(docs, weights, id_col, text_col).withColumn("key", F.col("importance") + gumbel(F.col(id_col), seed))
    keys = C.save(rows.select("importance", "key"))
    k = keys.where(F.col("importance") >= least).count()
    cut = kth_largest(keys, "key", k)
    C.drop(keys)
    return rows.withColumn("kept", F.lit(False) if cut is None else F.col("key") >= cut)
