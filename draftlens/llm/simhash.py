"""SimHash near-dedup with pivot distance tables.

A text's fingerprint has, for each of 64 bits, the majority over the hashes of its
word shingles. Equal fingerprints are one node. Distances from a node to a table
of reference fingerprints (pivots) are computed once per task; by the triangle
inequality a pair whose distances to some pivot differ by more than the limit can
be discarded, and what survives is verified bit by bit.

A pivot coordinate of a random fingerprint varies by about four bits, so one pivot
discards under half of all pairs: a table alone would leave a quadratic job. The
pairs it judges are therefore those that agree on three of seven bit blocks. Any
two fingerprints within four bits do, so this loses no link. Within a block the
links are searched breadth first among the nodes not yet reached, so that a dense
group of near copies costs about its size, and only the links that join something
are passed on, never all pairs of a group.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlens.llm import common as C

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SEED = 42
N_PIVOTS = 16
PIVOTS = np.random.Generator(np.random.PCG64(11)).integers(0, 2**64 - 1, N_PIVOTS, dtype=np.uint64)

#: Members of one block that one task compares; more are dealt in pairs of parts.
PART = 1 << 16


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Majority of the shingles' hash bits; zero if there is no word."""
    parts = (text or "").encode().translate(LOWER).split()
    if not parts:
        return 0
    line = b" ".join(parts)
    size = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    end = np.cumsum(size) - 1
    begin = end - size + 1
    if len(parts) >= shingle:
        begin, end = begin[:len(parts) - shingle + 1], end[shingle - 1:]
    else:
        begin, end = begin[:1], end[-1:]
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, np.int64), len(begin)
    for k in range(0, n, 1 << 16):
        pairs = zip(begin[k:k + (1 << 16)].tolist(), end[k:k + (1 << 16)].tolist(), strict=True)
        h = np.array([digest(line[a:b], SEED) for a, b in pairs], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """doc_id, row (a hash of all columns) and fp (64 bits as a signed long) of every row."""

    def batch(rows):
        for b in rows:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp, pa.int64())], ["doc_id", "row", "fp"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), C.row_hash(docs).alias("row"), docs[text_col].alias("text"))
    return rows.mapInArrow(batch, "doc_id long, row long, fp long")


def _masks(distance: int) -> list[int]:
    """Bit masks, one of which two fingerprints within the distance agree on."""
    n, keep = distance + 3, 3
    edge = np.linspace(0, 64, n + 1).astype(int)
    blocks = [((1 << int(b - a)) - 1) << int(a) for a, b in zip(edge[:-1], edge[1:], strict=True)]
    return [sum(x) for x in combinations(blocks, keep)]


def _close(fp, table, i, js, distance):
    """Which of js are within the distance of i: pivots first, then bits."""
    left = js[(np.abs(table[js] - table[i]) <= distance).all(axis=1)]
    return left[np.bitwise_count(fp[left] ^ fp[i]) <= distance]


def _spanning(fp: np.ndarray, table: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect all members of one block that links connect."""
    left = np.arange(len(fp))
    links, queue = [], []
    while len(left):
        if not queue:
            queue, left = [left[0]], left[1:]
        i = queue.pop()
        near = _close(fp, table, i, left, distance)
        if len(near):
            links.extend((i, j) for j in near)
            queue.extend(near)
            left = left[~np.isin(left, near)]
    return links


def links(nodes: DataFrame, distance: int = 4) -> DataFrame:
    """Links (a, b) of distinct fingerprints that connect what the limit connects."""
    masks = F.array(*[F.lit(m if m < 2**63 else m - 2**64) for m in _masks(distance)])
    keyed = nodes.select("fp", F.posexplode(masks).alias("mask", "bits"))
    keyed = keyed.select("fp", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("bits"))).alias("key"))
    # A block too large for one task: each pair of its parts is a block of its own.
    big = keyed.groupBy("key").count().where(F.col("count") > PART)
    big = big.select("key", F.ceil(F.col("count") / PART).cast("int").alias("parts"))
    keyed = keyed.join(big, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    keyed = keyed.select("key", "fp", part.alias("p"), other.alias("q"))
    keyed = keyed.select("key", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"), "fp")

    def blocks(batches):
        rest = None
        for b in batches:
            new = pa.Table.from_batches([b])
            rest = new if rest is None else pa.concat_tables([rest, new])
            if rest.num_rows >= 200_000:
                key = _block(rest)
                whole = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
                if whole:
                    yield from search(rest.slice(0, whole))
                    rest = rest.slice(whole)
        if rest is not None and rest.num_rows:
            yield from search(rest)

    def _block(t):
        return t.column("key").to_numpy() * np.int64(1000003) + t.column("p").to_numpy() * np.int64(40503) + t.column("q").to_numpy()

    def search(t):
        fp, key = t.column("fp").to_numpy().view(np.uint64), _block(t)
        table = np.stack([np.bitwise_count(fp ^ p) for p in PIVOTS], axis=1).astype(np.int8)
        first, _ = C.runs(key)
        size = np.diff(np.append(first, len(key)))
        a, b = [], []
        for lag in range(1, 8):  # small blocks: each pair of rows at once
            at = np.repeat(first[(size > lag) & (size <= 8)], size[(size > lag) & (size <= 8)] - lag)
            at = at + _ramp(size[(size > lag) & (size <= 8)] - lag)
            at = at[(np.abs(table[at] - table[at + lag]) <= distance).all(axis=1)]
            at = at[np.bitwise_count(fp[at] ^ fp[at + lag]) <= distance]
            a.append(fp[at])
            b.append(fp[at + lag])
        for i, n in zip(first[size > 8], size[size > 8], strict=True):
            for x, y in _spanning(fp[i:i + n], table[i:i + n], distance):
                a.append(fp[i + x:i + x + 1])
                b.append(fp[i + y:i + y + 1])
        a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    dealt = keyed.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "fp")
    return dealt.mapInArrow(blocks, "a long, b long").distinct()


def _ramp(sizes: np.ndarray) -> np.ndarray:
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, shingle: int = 4) -> DataFrame:
    """Group texts whose fingerprints are linked, directly or through others.

    One row per input row: doc_id, row (a hash of its columns), fp, component_id
    (smallest id of the component), root (a fingerprint that names the component).
    Texts without words (null, empty, blanks) have fingerprint zero and are linked
    like any other. Repeated rows and repeated ids are fine. Rows without an id join
    components but never name one; a component of such rows only has a null id.
    Other columns are ignored.
    """
    prints = C.save(fingerprints(docs, id_col, text_col, shingle))
    named = _rooted(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), distance)
    whole = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(whole, "root").select("fp", "component_id", "root")
    return prints.join(named, "fp").select("doc_id", "row", "fp", "component_id", "root")


def _rooted(nodes: DataFrame, distance: int) -> DataFrame:
    """(fp, low) of distinct fingerprints, with the root of each one's component."""
    roots = C.components(links(nodes.select("fp"), distance))
    return nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, shingle: int = 4) -> DataFrame:
    """One (doc_id, row) of each component of ``near_duplicates``: the smallest id, null last, then row.

    Copies are reduced to one row for each fingerprint before any join, so that no
    join meets the rows of a hot fingerprint.
    """
    prints = C.save(fingerprints(docs, id_col, text_col, shingle))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    nodes = C.save(prints.groupBy("fp").agg(F.min(first).alias("low")))
    low = _rooted(nodes, distance).groupBy("root").agg(F.min("low").alias("low"))
    return low.select("low.doc_id", "low.row")


def hex_print(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
