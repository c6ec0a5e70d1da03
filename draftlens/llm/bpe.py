"""Byte-level BPE encoding and decoding in numpy.

Texts are split by the tokenizer's pattern. Distinct pieces are laid out by length
in padded matrices of token ids. In each round every unfinished row merges its
leftmost pair of least rank; pairs are looked up in a hash table, and the rows are
compacted. A worker remembers a bounded number of pieces. The rank file is read on
the driver once (its size is the vocabulary's, not the data's) and broadcast.
"""

from __future__ import annotations

import base64
import heapq
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame


NONE = np.int32(2**31 - 1)

#: Pieces longer than this many bytes are merged with a heap, by the same rule.
LONG = 1024

#: Pieces that a worker remembers.
REMEMBERED = 100_000

#: Characters of texts that are split at a time.
GROUP = 1 << 20


class Vocabulary:
    """Ranks of byte strings; an id is a rank."""

    def __init__(self, ranks: bytes, pattern: str):
        self.split, self.steps = regex.compile(pattern).findall, regex.compile(pattern).finditer
        tokens = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.single = np.array([tokens[bytes([b])] for b in range(256)], np.int32)
        keys, values = [], []
        for token, rank in tokens.items():
            for k in range(1, len(token)):
                a, b = tokens.get(token[:k]), tokens.get(token[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        self.pairs = dict(zip(keys, values, strict=True))
        self._fill(np.array(keys, np.int64), np.array(values, np.int32))
        by_id = [b""] * (max(tokens.values()) + 1)
        for token, rank in tokens.items():
            by_id[rank] = token
        self.size = np.array([len(t) for t in by_id], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.known: dict[str, bytes] = {}

    def _slot(self, keys):
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _fill(self, keys, values):
        self.bits = max(4, int(len(keys)).bit_length() + 2)
        self.key, self.value = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        left, step = np.arange(len(keys)), 0
        while len(left):
            slot = (self._slot(keys[left]) + step) & ((1 << self.bits) - 1)
            free = self.key[slot] < 0
            _, one = np.unique(slot[free], return_index=True)
            take = np.flatnonzero(free)[one]
            self.key[slot[take]], self.value[slot[take]] = keys[left[take]], values[left[take]]
            left = np.delete(left, take)
            step += 1
        self.probes = step

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Id of the merged pair, or NONE; a negative b is padding."""
        key = (a.astype(np.int64) << 32) | b.astype(np.int64)
        out = np.full(key.shape, NONE, np.int32)
        left = np.flatnonzero(b.ravel() >= 0)
        flat, out_flat = key.ravel(), out.ravel()
        slot = self._slot(flat[left])
        for _ in range(self.probes):
            have = self.key[slot]
            hit = have == flat[left]
            out_flat[left[hit]] = self.value[slot[hit]]
            on = ~hit & (have >= 0)
            if not on.any():
                break
            left, slot = left[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out_flat.reshape(key.shape)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as little-endian 32-bit numbers."""
        out: list[bytes] = [b""] * len(pieces)
        size = np.array([len(p) for p in pieces])
        for i in np.flatnonzero(size > LONG):
            out[i] = self._heap(pieces[i])
        low = 0
        for high in (1, 2, 4, 6, 8, 12, 16, 24, 32, 64, 128, 256, 512, LONG):
            rows = np.flatnonzero((size > low) & (size <= high))
            low = high
            step = max(1, (1 << 18) // high)
            for k in range(0, len(rows), step):
                self._matrix(pieces, rows[k:k + step], size, high, out)
        return out

    def _matrix(self, pieces, rows, size, width, out):
        n = size[rows]
        raw = np.frombuffer(b"".join([pieces[i] for i in rows]), np.uint8)
        ids = np.full((len(rows), width), -1, np.int32)
        ids[np.arange(width) < n[:, None]] = self.single[raw]
        n = n.copy()
        rank = self.rank(ids[:, :-1], ids[:, 1:]) if width > 1 else np.full((len(rows), 1), NONE, np.int32)
        column = np.arange(width)
        while True:
            at = rank.argmin(axis=1)
            least = rank[np.arange(len(at)), at]
            done = least == NONE
            if done.any():
                for i in np.flatnonzero(done):
                    out[rows[i]] = ids[i, :n[i]].tobytes()
                on = ~done
                ids, rank, n, rows, at, least = ids[on], rank[on], n[on], rows[on], at[on], least[on]
                if not len(rows):
                    return
                most = int(n.max())
                if most < ids.shape[1] - 3:
                    ids, rank = ids[:, :most], rank[:, :max(1, most - 1)]
                    column = np.arange(most)
            every = np.arange(len(rows))
            source = np.minimum(column + (column > at[:, None]), len(column) - 1)
            last = ids.shape[1] - 1
            ids = np.take_along_axis(ids, source, axis=1)
            ids[:, last] = -1
            ids[every, at] = least
            n -= 1
            source = np.minimum(column[:-1] + (column[:-1] > at[:, None]), len(column) - 2)
            rank = np.take_along_axis(rank, source, axis=1)
            rank[:, -1] = NONE
            after = np.minimum(at + 1, last)
            rank[every, np.minimum(at, last - 1)] = np.where(at < last, self.rank(ids[every, at], np.where(at < last, ids[every, after], -1)), NONE)
            on = at > 0
            rank[every[on], at[on] - 1] = self.rank(ids[every[on], at[on] - 1], ids[every[on], at[on]])

    def _heap(self, piece: bytes) -> bytes:
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n, pairs = len(ids), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or pairs.get(ids[i] << 32 | ids[j]) != r:
                continue
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := pairs.get(ids[i] << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := pairs.get(ids[h] << 32 | ids[i])) is not None:
                heapq.heappush(heap, (r, h))
        return np.array([x for x in ids if x >= 0], np.int32).tobytes()

    def _learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(pieces)
        if new:
            self.known.update(zip(new, self.merge([p.encode() for p in new]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit numbers; many are learned at once."""
        out, k = [], 0
        while k < len(texts):
            parts, chars = [], 0
            while k + len(parts) < len(texts) and chars < GROUP and len(t := texts[k + len(parts)]) < GROUP:
                parts.append(self.split(t))
                chars += len(t)
            if parts:
                self._learn(set().union(*parts))
                out.extend(b"".join(map(self.known.__getitem__, p)) for p in parts)
                k += len(parts)
            else:
                out.append(b"".join(self._in_steps(texts[k])))
                k += 1
        return out

    def _in_steps(self, text: str):
        found = self.steps(text)
        while part := [m[0] for m in islice(found, 1 << 18)]:
            self._learn(set(part))
            yield b"".join(map(self.known.__getitem__, part))

    def decode(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        return self.bytes[np.arange(total) + np.repeat(self.begin[ids] - (stop - size), size)]


def _vocabulary(spark, path: str, pattern: str):
    with open(path, "rb") as file:
        sent = spark.sparkContext.broadcast((file.read(), pattern))

    def get() -> Vocabulary:
        name = (path, pattern)
        if name not in _MADE:
            _MADE[name] = Vocabulary(*sent.value)
        return _MADE[name]

    return get


_MADE: dict[tuple[str, str], Vocabulary] = {}


def _with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, values], [*batch.schema.names, name])


def _types(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """Every row with the token ids (array of int) of its whole text in place of the text.

    With ``decoded_col``, also the bytes that these ids decode to. A null or empty
    text has no ids. Strings that look like special tokens are ordinary text. Rows,
    repeated ones too, are encoded each on its own; other columns pass through, but
    for those named like a result, which are replaced.
    """
    docs = docs.drop(*[c for c in (out_col, decoded_col) if c and c != text_col])
    get, at = _vocabulary(docs.sparkSession, path, pattern), docs.columns.index(text_col)
    rest = docs.drop(text_col)

    def run(batches):
        vocabulary = get()
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                b = whole.slice(k, 512)
                ids = vocabulary.encode([t or "" for t in b.column(at).to_pylist()])
                off = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                made = [pa.ListArray.from_arrays(pa.array(off), pa.array(np.frombuffer(b"".join(ids), np.int32)))]
                if decoded_col:
                    made.append(pa.array([vocabulary.decode(np.frombuffer(x, np.int32)).tobytes() for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays([c for j, c in enumerate(b.columns) if j != at] + made, names)

    names = [*rest.columns, out_col, *([decoded_col] if decoded_col else [])]
    schema = [_types(rest)] * bool(rest.columns) + [f"`{out_col}` array<int>"] + [f"`{decoded_col}` binary"] * bool(decoded_col)
    return docs.mapInArrow(run, ", ".join(schema))


def decode(rows: DataFrame, path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Every row with the bytes that its ids stand for; null ids give none."""
    rows = rows.drop(out_col)
    get, at = _vocabulary(rows.sparkSession, path, pattern), rows.columns.index(ids_col)

    def run(batches):
        vocabulary = get()
        for b in batches:
            made = [b"" if x.values is None else vocabulary.decode(x.values.to_numpy()).tobytes() for x in b.column(at)]
            yield _with_column(b, out_col, pa.array(made, pa.binary()))

    return rows.mapInArrow(run, _types(rows) + f", `{out_col}` binary")
