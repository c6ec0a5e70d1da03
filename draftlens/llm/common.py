"""Helpers of the operators: shared folder, sizes, packed blobs, components."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from draftlens.session import shared_dir

#: White space of the word contracts: blank and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
GAP = " \t\n\x0b\x0c\r"

#: Order of rows without an id: after all others.
LAST_ID = 2**63 - 1


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """The session's shuffle width; slices and buckets are multiples of it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of texts that a slice is meant to hold.
SLICE = 32 << 20


def slices(docs: DataFrame, text_col: str, size: int = SLICE) -> int:
    """Slices for a corpus: by its bytes, and a few for each shuffle partition at least."""
    total = docs.agg(F.sum(F.octet_length(docs[text_col]))).first()[0] or 0
    return max(4 * partitions(docs.sparkSession), -(-total // size))


def save(df: DataFrame) -> DataFrame:
    """Cut the lineage: written to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(saved: DataFrame) -> None:
    """Remove what ``save`` wrote, once nothing reads it any more."""
    spark = saved.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in saved.inputFiles()}:
        if "/llm-" not in file:
            continue
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def word_count(text) -> F.Column:
    """Number of words of a text; null has none."""
    marks = F.translate(F.regexp_replace(text, WORD, "x"), GAP, "")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def row_hash(docs: DataFrame) -> F.Column:
    """One hash of all columns of a row."""
    return F.xxhash64(*[docs[c] for c in docs.columns])


# Packed columns: byte planes under zstd, so that sorted numbers shrink.


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length as one compressed blob."""
    n = len(arrays[0])
    planes = b"".join(
        np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(n, a.itemsize).T).tobytes() for a in arrays)
    body = pa.compress(planes, codec="zstd", asbytes=True)
    return n.to_bytes(4, "little") + body


def unpack(blob: bytes, *types: str) -> list[np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    sizes = [np.dtype(t).itemsize for t in types]
    raw = np.frombuffer(pa.decompress(blob[4:], decompressed_size=n * sum(sizes), codec="zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for t, size in zip(types, sizes, strict=True):
        out.append(np.ascontiguousarray(raw[at:at + n * size].reshape(size, n).T).view(t).ravel())
        at += n * size
    return out


def deltas(sorted_values: np.ndarray) -> np.ndarray:
    return np.diff(sorted_values, prepend=sorted_values.dtype.type(0))


def undeltas(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=steps.dtype)


def buckets(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket number and the next 32 bits of 64-bit hashes; keeps their order."""
    low, shift, n = np.uint64(0xFFFFFFFF), np.uint64(32), np.uint64(n)
    p = (h >> shift) * n + (((h & low) * n) >> shift)
    return (p >> shift).astype(np.int32), (p & low).astype(np.uint32)


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index of each run of equal values, and the run each value is in."""
    new = np.empty(len(sorted_values), bool)
    if len(new):
        new[0] = True
        np.not_equal(sorted_values[1:], sorted_values[:-1], out=new[1:])
    return np.flatnonzero(new), np.cumsum(new) - 1


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and where each begins (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def pieces(off: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Ranges of whole texts of about ``size`` bytes."""
    out, i, n = [], 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        out.append((i, j))
        i = j
    return out


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): (node, root), root the smallest node.

    Alternates large-star and small-star steps until the edges stay the same;
    each round is written to the shared folder. Nodes without an edge to another
    node are left out. No component is gathered in one place.
    """
    old = save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = old.union(old.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(low.select("a", F.col("m").alias("b")))
        small = small.where("a <> b").distinct()
        watch = Observation()
        new = save(small.observe(watch, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")))
        now = (watch.get["n"], watch.get["h"])
        drop(old)
        old = new
        if now == seen:
            break
        seen = now
    return old.select(F.col("a").alias("node"), F.col("b").alias("root"))
