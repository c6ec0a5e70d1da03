"""Repeated byte strings by prefix-free parsing.

Rolling-hash triggers (local minima of the hash of eight bytes) cut every text
into phrases. Triggers depend on nearby bytes only, so equal strings are parsed
alike wherever they stand. Each trigger owns the strings of the given length for
which it is the first trigger that their bytes fix; all of these share one core.
The dictionary holds each distinct phrase context (core and what its strings reach
beyond it) once. Sorted core by core, it says which parts of the parse can repeat:

* a core that occurs once: none of its strings repeats;
* a context that occurs more than once: all of its strings repeat;
* else, at the ends of repeats only, the context's strings are sorted one by one.

The order is one of fingerprints, in ranges dealt to tasks, in place of one global
lexical suffix order, which a hot prefix would keep from being split; whether a
string has an equal neighbour is the same in both. Work is dealt in slices of
documents and buckets of fingerprints; a slice sends each distinct one once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlens.llm import common as C
from draftlens.llm import rolling as R
from draftlens.llm.substring_dedup import PIECE, SENT, _by_bucket, _sent, ordered, sliced

GRAM = 8

#: What a context is told: its strings all repeat, and they are to be sorted singly.
REPEATS, SINGLY = 1, 2


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over values[i:i + width], for each i that has them."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    last = pick.identity if pick.identity is not None else values[-1]
    block = np.concatenate([values, np.full(-len(values) % width, last, values.dtype)]).reshape(-1, width)
    ahead = pick.accumulate(block, axis=1).ravel()
    back = pick.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[:n], ahead[width - 1:width - 1 + n])


def reach(length: int) -> int:
    """Positions in which at least one trigger lies, so that each string fixes one."""
    return max(1, (length - GRAM + 3) // 3)


def triggers(raw: np.ndarray, span: int) -> np.ndarray:
    """Positions whose gram's hash is the least of some ``span`` ones in a row."""
    n = len(raw) - GRAM + 1
    if n < span:
        return np.zeros(0, np.int64)
    gram = np.zeros(n, np.uint64)
    for k in range(GRAM):
        gram |= raw[k:k + n].astype(np.uint64) << np.uint64(8 * k)
    h = (R.mix(gram) >> np.uint64(32)).astype(np.uint32)
    least = _slide(h, span, np.minimum)
    pad = np.zeros(span - 1, np.uint32)
    return np.flatnonzero(_slide(np.concatenate([pad, least, pad]), span, np.maximum) == h)


class Parse:
    """Triggers of whole texts: the strings lo..hi that each owns, cores, contexts."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, length: int, n_buckets: int):
        span = reach(length)
        at = triggers(raw, span)
        doc = np.searchsorted(off, at, "right") - 1
        begin, end = off[doc], off[doc + 1]
        before = np.full(len(at), -(length + span), np.int64)
        before[1:] = np.where(doc[1:] == doc[:-1], at[:-1], before[1:])
        lo = np.maximum(before - span + 2, begin)
        hi = np.minimum(at - span + 1, end - length)
        own = lo <= hi
        self.lo, self.hi, at = lo[own], hi[own], at[own]
        self.sums = [R.Ranges(R.BYTE[k][raw], k) for k in (0, 1)]
        self.length = length
        bucket, low = C.buckets(self.sums[1](at - span + 1, at - 2 * span + 2 + length), n_buckets)
        self.core = (bucket.astype(np.uint64) << np.uint64(32)) | low
        self.context = self.sums[0](self.lo, self.hi + length)

    def strings(self, which: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, bucket and value of each string that the chosen triggers own."""
        size = self.hi[which] - self.lo[which] + 1
        at = np.arange(size.sum()) + np.repeat(self.lo[which] - (np.cumsum(size) - size), size)
        bucket, _ = C.buckets(self.sums[1](at, at + self.length), n_buckets)
        return at, bucket, self.sums[0](at, at + self.length)


def _distinct(bucket: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of one row of each distinct key in sorted order; whether it had more."""
    order = np.lexsort((*keys[::-1], bucket))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in (bucket, *keys)])
    first = np.flatnonzero(new)
    return order[first], np.diff(np.append(first, len(order))) > 1


def _gather(table: pa.Table, *types: str) -> tuple[np.ndarray, ...]:
    """All entries of a bucket's blobs, with the row that each came in."""
    parts = [C.unpack(b.as_py(), *types) for b in table.column("blob")]
    owner = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    return owner, *(np.concatenate(x) for x in zip(*([C.undeltas(p[0]), *p[1:]] for p in parts), strict=True))


def _answer(table: pa.Table, owner: np.ndarray, *columns: np.ndarray) -> pa.Table:
    bucket, slices = table.column("bucket")[0].as_py(), table.column("slice").to_numpy()
    cuts = list(_by_bucket(owner))
    return _sent([bucket] * len(cuts), [slices[owner[i]] for i, _ in cuts],
                 [C.pack(C.deltas(columns[0][i:j]), *(c[i:j] for c in columns[1:])) for i, j in cuts])


KIND = "kind int, " + SENT


def _told(answers: pa.Table, kind: int, *types: str) -> list[np.ndarray]:
    """What a slice was told, all buckets together: bucket, columns."""
    parts = [(b.as_py(), C.unpack(x.as_py(), *types)) for k, b, x in
             zip(*(answers.column(c) for c in ("kind", "bucket", "blob")), strict=True) if k.as_py() == kind]
    bucket = np.repeat(np.array([b for b, _ in parts], np.int32), [len(p[0]) for _, p in parts])
    if not parts:
        return [bucket, *(np.zeros(0, t) for t in types)]
    return [bucket, *(np.concatenate(x) for x in zip(*([C.undeltas(p[0]), *p[1:]] for _, p in parts), strict=True))]


def _look_up(bucket, value, known_bucket, known_value) -> np.ndarray:
    """Index of each (bucket, value) among the known ones, or -1."""
    if not len(known_value):
        return np.full(len(value), -1)
    order = np.argsort(known_value)
    where = order[np.minimum(np.searchsorted(known_value, value, sorter=order), len(order) - 1)]
    return np.where((known_value[where] == value) & (known_bucket[where] == bucket), where, -1)


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200,
                   carry: tuple[str, ...] = (), as_text: bool = False,
                   n_slices: int | None = None, n_buckets: int | None = None) -> DataFrame:
    """Remove bytes inside strings of ``length`` bytes that start more than once.

    One row per input row: doc_id, n_bytes, n_removed, spans (byte ranges removed,
    maximal), kept (the other bytes, end to end). A null or empty text has no bytes.
    Repeated rows are separate documents, so their strings repeat; ids play no part
    but to deal the rows, and may be null or repeated. Other columns are ignored,
    but for those in ``carry``, which come back as the struct ``rest``. With
    ``as_text``, kept is text: what is left of a character cut in part goes too, and
    a null text stays null.
    """
    width = C.partitions(docs.sparkSession)
    n_slices, n_buckets = n_slices or C.slices(docs, text_col), n_buckets or max(1, width // 2)
    rows = sliced(docs, id_col, text_col, n_slices, carry, by_text=True)

    def parsed(table: pa.Table):
        raw, off = C.texts(table.column("text"))
        for a, b in C.pieces(off, PIECE):
            yield off[a], Parse(raw[off[a]:off[b]], off[a:b + 1] - off[a], length, n_buckets)

    def phrases(table: pa.Table) -> pa.Table:
        found = [(p.core, p.context) for _, p in parsed(table)]
        if not found:
            return _sent([], [], [])
        core, context = (np.concatenate(x) for x in zip(*found, strict=True))
        one, more = _distinct(core, context)
        core, context = core[one], context[one]
        low, bucket = (core & np.uint64(0xFFFFFFFF)).astype(np.uint32), (core >> np.uint64(32)).astype(np.int32)
        cuts = list(_by_bucket(bucket))
        me = table.column("slice")[0].as_py()
        return _sent([bucket[i] for i, _ in cuts], [me] * len(cuts),
                     [C.pack(C.deltas(low[i:j]), context[i:j], more[i:j]) for i, j in cuts])

    def dictionary(table: pa.Table) -> pa.Table:
        """Contexts whose core occurs more than once, and what is known of each."""
        owner, core, context, more = _gather(table, "u4", "u8", "u1")
        order = np.lexsort((owner, context, core))
        core_first, core_run = C.runs(core[order])
        new = np.ones(len(order), bool)
        c, x = core[order], context[order]
        new[1:] = (c[1:] != c[:-1]) | (x[1:] != x[:-1])
        first, run = np.flatnonzero(new), np.cumsum(new) - 1
        often = (np.diff(np.append(first, len(order))) > 1) | np.maximum.reduceat(more[order], first).astype(bool)
        kinds = np.add.reduceat(new.astype(np.int64), core_first)[core_run]  # distinct contexts of the core
        state = np.where(often[run], REPEATS, 0) | np.where((kinds > 1) & new, SINGLY, 0)
        chosen = state > 0
        back = np.sort(order[chosen])
        full = np.zeros(len(order), np.uint8)
        full[order] = state
        return _answer(table, owner[back], core[back], context[back], full[back])

    def states(p: Parse, told) -> np.ndarray:
        bucket, low, context, state = told
        known = (bucket.astype(np.uint64) << np.uint64(32)) | low
        where = _look_up(p.core, p.context, known, context)
        return np.where(where >= 0, state[where] if len(state) else 0, 0)

    def singly(docs_: pa.Table, answers: pa.Table) -> pa.Table:
        told = _told(answers, 0, "u4", "u8", "u1")
        if not docs_.num_rows or not len(told[0]):
            return _sent([], [], [])
        found = []
        for _, p in parsed(ordered(docs_)[0]):
            found.append(p.strings(np.flatnonzero(states(p, told) & SINGLY), n_buckets)[1:])
        bucket, value = (np.concatenate(x) for x in zip(*found, strict=True))
        one, more = _distinct(bucket, value)
        bucket, value = bucket[one], value[one]
        cuts = list(_by_bucket(bucket))
        me = docs_.column("slice")[0].as_py()
        return _sent([bucket[i] for i, _ in cuts], [me] * len(cuts), [C.pack(C.deltas(value[i:j]), more[i:j]) for i, j in cuts])

    def neighbours(table: pa.Table) -> pa.Table:
        """Strings that have an equal neighbour in sorted order."""
        owner, value, more = _gather(table, "u8", "u1")
        order = np.argsort(value)
        first, run = C.runs(value[order])
        often = (np.diff(np.append(first, len(order))) > 1) | np.maximum.reduceat(more[order], first).astype(bool)
        back = np.sort(order[often[run]])
        return _answer(table, owner[back], value[back])

    def remove(docs_: pa.Table, answers: pa.Table) -> pa.Table:
        docs_, _ = ordered(docs_)
        raw, off = C.texts(docs_.column("text"))
        told, strings = _told(answers, 0, "u4", "u8", "u1"), _told(answers, 1, "u8")
        cover = np.zeros(len(raw) + 1, np.int32)
        for base, p in parsed(docs_):
            state = states(p, told)
            whole = (state & REPEATS) > 0
            np.add.at(cover, p.lo[whole] + base, 1)
            np.add.at(cover, p.hi[whole] + length + base, -1)
            at, bucket, value = p.strings(np.flatnonzero((state > 0) & ~whole), n_buckets)
            at = at[_look_up(bucket, value, *strings) >= 0] + base
            np.add.at(cover, at, 1)
            np.add.at(cover, at + length, -1)
        gone = np.cumsum(cover[:-1]) > 0
        out = _kept(docs_, raw, off, gone, as_text)
        return out.append_column("rest", docs_.column("rest")) if carry else out

    sent = rows.groupBy("slice").applyInArrow(phrases, SENT)
    known = sent.groupBy("bucket").applyInArrow(dictionary, SENT).select(F.lit(0).alias("kind"), "*")
    found = rows.groupBy("slice").cogroup(known.groupBy("slice")).applyInArrow(singly, SENT)
    same = found.groupBy("bucket").applyInArrow(neighbours, SENT).select(F.lit(1).alias("kind"), "*")
    schema = "doc_id long, n_bytes long, n_removed long, spans array<struct<begin:long,end:long>>, kept " + ("string" if as_text else "binary")
    if carry:
        schema += f", rest {rows.schema['rest'].dataType.simpleString()}"
    return rows.groupBy("slice").cogroup(known.unionAll(same).groupBy("slice")).applyInArrow(remove, schema)


def _kept(docs_: pa.Table, raw: np.ndarray, off: np.ndarray, gone: np.ndarray, as_text: bool) -> pa.Table:
    n = docs_.num_rows
    at = np.flatnonzero(gone)
    cut = np.zeros(len(raw) + 1, bool)
    cut[off] = True
    head = np.ones(len(at), bool)
    head[1:] = (at[1:] != at[:-1] + 1) | cut[at[1:]]
    lo = at[head]
    hi = at[np.append(np.flatnonzero(head)[1:] - 1, len(at) - 1)] + 1 if len(at) else lo
    owner = np.searchsorted(off, lo, "right") - 1
    spans = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
    items = pa.StructArray.from_arrays([pa.array(lo - off[owner], pa.int64()), pa.array(hi - off[owner], pa.int64())], ["begin", "end"])
    size = np.diff(off)
    removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[off])
    if as_text and gone.any():
        heads = np.flatnonzero((raw & 0xC0) != 0x80)
        gone = np.repeat(np.logical_or.reduceat(gone, heads), np.diff(np.append(heads, len(raw))))
    stays = np.concatenate([[0], np.cumsum(~gone)])[off]
    buffers = [None, pa.py_buffer(stays.astype(np.int64).tobytes()), pa.py_buffer(raw[~gone].tobytes())]
    if as_text:
        kept = pa.LargeStringArray.from_buffers(n, buffers[1], buffers[2])
        kept = pc.if_else(docs_.column("text").combine_chunks().is_null(), None, kept).cast(pa.string())
    else:
        kept = pa.Array.from_buffers(pa.large_binary(), n, buffers).cast(pa.binary())
    return pa.table({"doc_id": docs_.column("doc_id"), "n_bytes": pa.array(size, pa.int64()),
                     "n_removed": pa.array(removed, pa.int64()),
                     "spans": pa.ListArray.from_arrays(pa.array(spans), items), "kept": kept})
