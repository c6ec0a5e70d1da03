"""Substring dedup by fixed-block anchors.

Every text is cut into non-overlapping blocks of half a window; their hashes are
the index. All rolling block-length windows of all texts probe it. A repeat of a
whole window always holds one aligned block of its earlier copy, so windows
without a hit are done. Hits are extended to whole windows, windows to maximal
repeats, and each word covered by a window that also starts earlier goes.

Work is dealt in slices of documents, whose number follows the bytes of all texts,
and buckets of hashes, as many as shuffle partitions. A slice sends each distinct hash once, however often it
occurs, so a passage that a third of all rows hold costs a bucket one entry per
slice. The texts are shuffled once; the three passes read the same exchange.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlens.llm import common as C
from draftlens.llm import rolling as R

PIECE = 1 << 20


def sliced(docs: DataFrame, id_col: str, text_col: str, n: int, carry: tuple[str, ...] = (), by_text: bool = False) -> DataFrame:
    """doc_id, order key (ident, tie), text and slice; null ids come last, by text.

    ``by_text`` deals rows of one id by their texts, where they need not stand together.
    """
    rest = [F.struct(*carry).alias("rest")] if carry else []
    ident, text = docs[id_col].cast("long"), docs[text_col]
    out = docs.select(ident.alias("doc_id"), F.coalesce(ident, F.lit(C.LAST_ID)).alias("ident"),
                      F.when(ident.isNull(), F.xxhash64(text)).otherwise(F.lit(0).cast("long")).alias("tie"),
                      text.alias("text"), *rest)
    return out.withColumn("slice", F.pmod(F.xxhash64("ident", "tie", *["text"] * by_text), F.lit(n)).cast("int"))


def ordered(rows: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """Rows of a slice in document order, and the rank of each document."""
    ident, tie = (rows.column(c).to_numpy() for c in ("ident", "tie"))
    whole = np.zeros(len(ident), np.uint64)
    if len(np.unique(ident)) < len(ident):
        whole = np.array([xxhash.xxh64_intdigest(x.as_py() or "") for x in rows.column("text")], np.uint64)
    order = np.lexsort((whole, tie, ident))
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in (ident, tie, whole)])
    return rows.take(pa.array(order)), np.cumsum(new) - 1


def _windows(raw, off, block, window):
    """Per piece of whole texts: first text, words, and hashes of both lengths."""
    for a, b in C.pieces(off, PIECE):
        begin, end, doc = R.words(raw[off[a]:off[b]], off[a:b + 1] - off[a])
        values = R.word_hashes(raw[off[a]:off[b]], begin, end)
        yield a, begin + off[a], end + off[a], doc + a, values


def _starts(doc: np.ndarray, length: int) -> np.ndarray:
    """Indices of words at which a window of this length fits into its text."""
    n = len(doc) - length + 1
    return np.flatnonzero(doc[:n] == doc[length - 1:]) if n > 0 else np.zeros(0, np.int64)


def _block_keys(values, doc, block, n_buckets):
    at = _starts(doc, block)
    bucket, low = C.buckets(R.Ranges(values, 1)(at, at + block), n_buckets)
    return at, (bucket.astype(np.uint64) << np.uint64(32)) | low


def _window_keys(values, at, window, n_buckets):
    bucket, _ = C.buckets(R.Ranges(values, 1)(at, at + window), n_buckets)
    return bucket, R.Ranges(values, 0)(at, at + window)


def _by_bucket(bucket: np.ndarray):
    """Begin and end of each bucket's entries in sorted order."""
    first = C.runs(bucket)[0]
    return zip(first, np.append(first, len(bucket))[1:], strict=True)


SENT = "bucket int, slice int, blob binary"


def _sent(bucket, slice_, blobs) -> pa.Table:
    return pa.table({"bucket": pa.array(bucket, pa.int32()), "slice": pa.array(slice_, pa.int32()), "blob": pa.array(blobs, pa.binary())})


def maximal_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20,
                    n_slices: int | None = None, n_buckets: int | None = None) -> DataFrame:
    """Remove words inside windows that also start earlier.

    One row per input row: doc_id, n_words, n_removed, spans (word ranges removed,
    maximal), kept (the other words joined by one blank). A null or empty text has
    no words. Rows that agree in id and text count as one document and get the same
    result; rows that share only the id are ordered by text hash. Rows without an id
    come after all others, in order of their text's hash. Other columns are ignored.
    """
    width = C.partitions(docs.sparkSession)
    n_slices, n_buckets = n_slices or C.slices(docs, text_col), n_buckets or width
    block = (window + 1) // 2
    rows = sliced(docs, id_col, text_col, n_slices)

    def probe(table: pa.Table) -> pa.Table:
        raw, off = C.texts(table.column("text"))
        keys, marks = [], []
        for a, _, _, doc, values in _windows(raw, off, block, window):
            at, key = _block_keys(values, doc, block, n_buckets)
            first = np.searchsorted(doc, doc[at])
            keys.append(key)
            marks.append((at - first) % block == 0)
        if not keys:
            return _sent([], [], [])
        keys, marks = np.concatenate(keys), np.concatenate(marks)
        keys = (keys << np.uint64(1)) | ~marks  # an aligned block sorts first
        keys.sort()
        keys = keys[C.runs(keys >> np.uint64(1))[0]]
        marks, keys = (keys & np.uint64(1)) == 0, keys >> np.uint64(1)
        low = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        bucket = (keys >> np.uint64(32)).astype(np.int32)
        cuts = list(_by_bucket(bucket))
        me = table.column("slice")[0].as_py()
        return _sent([bucket[i] for i, _ in cuts], [me] * len(cuts), [C.pack(C.deltas(low[i:j]), marks[i:j]) for i, j in cuts])

    def match(table: pa.Table) -> pa.Table:
        """Hashes that more than one slice holds, one of them as a block."""
        lows, marks, owner = [], [], []
        slices = table.column("slice").to_numpy()
        for k, blob in enumerate(table.column("blob")):
            low, mark = C.unpack(blob.as_py(), "u4", "u1")
            lows.append(C.undeltas(low))
            marks.append(mark)
            owner.append(np.full(len(low), k, np.int32))
        low, mark, owner = map(np.concatenate, (lows, marks, owner))
        order = np.argsort(low)
        first, run = C.runs(low[order])
        hot = (np.diff(np.append(first, len(low))) > 1) & np.maximum.reduceat(mark[order], first).astype(bool)
        return _answers(table, slices, low, owner, np.sort(order[hot[run]]))

    def _answers(table, slices, low, owner, chosen):
        bucket = table.column("bucket")[0].as_py()
        low, owner = low[chosen], owner[chosen]
        cuts = list(_by_bucket(owner))
        return _sent([bucket] * len(cuts), [slices[owner[i]] for i, _ in cuts], [C.pack(C.deltas(low[i:j])) for i, j in cuts])

    def extend(docs_: pa.Table, answers: pa.Table) -> pa.Table:
        """Whole windows around the hits, each distinct one once with its first document."""
        if not docs_.num_rows or not answers.num_rows:
            return _sent([], [], [])
        docs_, _ = ordered(docs_)
        raw, off = C.texts(docs_.column("text"))
        hot = np.sort(np.concatenate([
            (np.uint64(b.as_py()) << np.uint64(32)) | C.undeltas(C.unpack(x.as_py(), "u4")[0])
            for b, x in zip(answers.column("bucket"), answers.column("blob"), strict=True)]))
        found = []
        for a, _, _, doc, values in _windows(raw, off, block, window):
            at, key = _block_keys(values, doc, block, n_buckets)
            hit = np.zeros(len(doc) + 1, np.int32)
            hit[at + 1] = _in(key, hot)
            hit = np.cumsum(hit)
            at = _starts(doc, window)
            at = at[hit[at + window - block + 1] > hit[at]]
            found.append((*_window_keys(values, at, window, n_buckets), doc[at]))
        bucket, value, doc = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(bucket):
            return _sent([], [], [])
        order = np.lexsort((doc, value, bucket))
        bucket, value, doc = bucket[order], value[order], doc[order]
        new = np.ones(len(order), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (value[1:] != value[:-1])
        bucket, value, doc = bucket[new], value[new], doc[new]
        ident, tie = docs_.column("ident").to_numpy()[doc], docs_.column("tie").to_numpy()[doc]
        cuts = list(_by_bucket(bucket))
        me = docs_.column("slice")[0].as_py()
        return _sent([bucket[i] for i, _ in cuts], [me] * len(cuts),
                     [C.pack(C.deltas(value[i:j]), ident[i:j], tie[i:j]) for i, j in cuts])

    def earliest(table: pa.Table) -> pa.Table:
        """For each slice, the windows that start earlier in another slice."""
        values, idents, ties, owner = [], [], [], []
        for k, blob in enumerate(table.column("blob")):
            value, ident, tie = C.unpack(blob.as_py(), "u8", "i8", "i8")
            values.append(C.undeltas(value))
            idents.append(ident)
            ties.append(tie)
            owner.append(np.full(len(value), k, np.int32))
        value, ident, tie, owner = map(np.concatenate, (values, idents, ties, owner))
        order = np.lexsort((tie, ident, value))
        first, _ = C.runs(value[order])
        late = np.ones(len(order), bool)
        late[first] = False
        return _answers(table, table.column("slice").to_numpy(), value, owner, np.sort(order[late]))

    def remove(docs_: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs_.num_rows:
            return pa.table({k: pa.array([], t) for k, t in OUT.items()})
        docs_, rank = ordered(docs_)
        raw, off = C.texts(docs_.column("text"))
        late = [(np.full(len(v), b.as_py(), np.int32), v) for b, x in zip(answers.column("bucket"), answers.column("blob"), strict=True)
                for v in [C.undeltas(C.unpack(x.as_py(), "u8")[0])]]
        late_bucket = np.concatenate([np.zeros(0, np.int32), *(x[0] for x in late)])
        late_value = np.concatenate([np.zeros(0, np.uint64), *(x[1] for x in late)])
        order = np.argsort(late_value)
        late_bucket, late_value = late_bucket[order], late_value[order]
        parts, ats, buckets, values_, shift = [], [], [], [], 0
        for a, begin, end, doc, values in _windows(raw, off, block, window):
            at = _starts(doc, window)
            bucket, value = _window_keys(values, at, window, n_buckets)
            parts.append((begin, end, doc))
            ats.append(at + shift)
            buckets.append(bucket)
            values_.append(value)
            shift += len(doc)
        begin, end, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
        at, bucket, value = map(np.concatenate, (ats, buckets, values_))
        gone = np.zeros(len(at), bool)
        if len(late_value):
            where = np.minimum(np.searchsorted(late_value, value), len(late_value) - 1)
            gone = (late_value[where] == value) & (late_bucket[where] == bucket)
        gone |= _later(value, rank[doc[at]], at - np.searchsorted(doc, doc[at]))
        cover = np.zeros(len(doc) + 1, np.int32)
        np.add.at(cover, at[gone], 1)
        np.add.at(cover, at[gone] + window, -1)
        keep = np.cumsum(cover)[:-1] == 0
        return _kept(docs_, raw, begin, end, doc, keep)

    hits = rows.groupBy("slice").applyInArrow(probe, SENT).groupBy("bucket").applyInArrow(match, SENT)
    found = rows.groupBy("slice").cogroup(hits.groupBy("slice")).applyInArrow(extend, SENT)
    late = found.groupBy("bucket").applyInArrow(earliest, SENT)
    schema = "doc_id long, n_words long, n_removed long, spans array<struct<begin:long,end:long>>, kept string"
    return rows.groupBy("slice").cogroup(late.groupBy("slice")).applyInArrow(remove, schema)


OUT = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(),
       "spans": pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), "kept": pa.string()}


def _in(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def _later(value: np.ndarray, rank: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Windows that also start earlier among these, which are in document order."""
    order = np.argsort(value)
    first, run = C.runs(value[order])
    if not len(first):
        return np.zeros(0, bool)
    origin = np.minimum.reduceat(order, first)[run]
    out = np.empty(len(value), bool)
    out[order] = (rank[order] != rank[origin]) | (pos[order] != pos[origin])
    return out


def joined(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, doc: np.ndarray, n: int) -> pa.Array:
    """The words of each of n texts, joined by one blank."""
    size = end - begin + 1
    stop = np.cumsum(size)
    total = int(stop[-1]) if len(stop) else 0
    source = np.arange(total) + np.repeat(begin - (stop - size), size)
    last = np.zeros(total, bool)
    last[stop - 1] = True
    source[last] = 0
    out = raw[source] if total else np.zeros(0, np.uint8)
    out[last] = 32
    counts = np.bincount(doc, size, n).astype(np.int64) if len(doc) else np.zeros(n, np.int64)
    tail = np.zeros(total, bool)  # no blank after a text's last word
    ends = np.cumsum(counts)
    tail[ends[counts > 0] - 1] = True
    out = out[~tail]
    off = np.zeros(n + 1, np.int64)
    off[1:] = np.cumsum(counts - (counts > 0))
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(off.tobytes()), pa.py_buffer(out.tobytes()))


def _kept(docs_: pa.Table, raw, begin, end, doc, keep) -> pa.Table:
    n = docs_.num_rows
    words = np.bincount(doc, minlength=n)
    removed = np.bincount(doc[~keep], minlength=n)
    first = np.cumsum(words) - words
    gone = np.flatnonzero(~keep)
    head = np.ones(len(gone), bool)
    head[1:] = (gone[1:] != gone[:-1] + 1) | (doc[gone[1:]] != doc[gone[:-1]])
    lo = gone[head]
    hi = gone[np.append(np.flatnonzero(head)[1:] - 1, len(gone) - 1)] + 1 if len(gone) else lo
    owner = doc[lo]
    off = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
    items = pa.StructArray.from_arrays([pa.array(lo - first[owner], pa.int64()), pa.array(hi - first[owner], pa.int64())], ["begin", "end"])
    text = joined(raw, begin[keep], end[keep], doc[keep], n)
    return pa.table({"doc_id": docs_.column("doc_id"), "n_words": pa.array(words, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
                     "spans": pa.ListArray.from_arrays(pa.array(off), items), "kept": text.cast(pa.string())})
