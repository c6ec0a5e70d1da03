"""A table kept up to date by micro-batches: few files, safe to repeat after a crash.

Rows lie in ``bucket=B/batch_id=N`` by a hash of their key. A micro-batch reads only
the buckets its keys fall in and writes each of them anew, so a bucket has one valid
version, whatever the length of the history. A commit mark is written last. Readers
take the newest committed version of each bucket; a batch that runs again starts from
the versions before it and overwrites its own.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from draftlens.sources import files

BUCKETS = 32


class KeyedTable:
    """``keys`` deal the rows to buckets; ``schema`` is that of the rows."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: T.StructType | str, buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def commits(self) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in files.children(self.spark, f"{self.path}/commits") if n.startswith("batch=") and "." not in n)

    def note(self, before: int | None = None) -> dict:
        """What the newest commit (before a batch) noted."""
        done = [n for n in self.commits() if before is None or n < before]
        return json.loads(files.read_text(self.spark, f"{self.path}/commits/batch={done[-1]}")) if done else {}

    def versions(self, before: int | None = None) -> dict[int, int]:
        """Bucket to the batch that holds its valid rows."""
        done = {n for n in self.commits() if before is None or n < before}
        out = {}
        for name in files.children(self.spark, f"{self.path}/data"):
            if name.startswith("bucket="):
                mine = [int(v.split("=")[1]) for v in files.children(self.spark, f"{self.path}/data/{name}") if v.startswith("batch_id=")]
                if valid := [n for n in mine if n in done]:
                    out[int(name.split("=")[1])] = max(valid)
        return out

    def read(self, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """Valid rows, of given buckets or of all."""
        found = {b: n for b, n in self.versions(before).items() if buckets is None or b in buckets}
        if not found:
            return self.spark.createDataFrame([], self.schema)
        folders = [files.literal(f"{self.path}/data/bucket={b}/batch_id={n}") for b, n in sorted(found.items())]
        return self.spark.read.schema(self.schema).parquet(*folders)

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that rows fall in, as many as there are buckets at most."""
        return sorted(r[0] for r in rows.select(self.bucket().alias("bucket")).distinct().collect())

    def write(self, batch_id: int, rows: DataFrame, buckets: list[int], note: dict | None = None) -> None:
        """Make ``rows`` the whole contents of the given buckets, then commit."""
        old = self.versions(batch_id)
        for b in buckets:  # what a run of this batch that did not end has left
            files.remove(self.spark, f"{self.path}/data/bucket={b}/batch_id={batch_id}")
        out = rows.select(*self.schema.fieldNames()).withColumn("bucket", self.bucket())
        # A bucket without rows gets a version, too: an empty file of its own.
        out.repartition(self.buckets, "bucket").withColumn("batch_id", F.lit(batch_id)).write.partitionBy("bucket", "batch_id").mode("append").parquet(f"{self.path}/data")
        filled = set(files.children(self.spark, f"{self.path}/data"))
        for b in buckets:
            if f"batch_id={batch_id}" not in (files.children(self.spark, f"{self.path}/data/bucket={b}") if f"bucket={b}" in filled else []) and b in old:
                self.spark.createDataFrame([], self.schema).coalesce(1).write.parquet(f"{self.path}/data/bucket={b}/batch_id={batch_id}")
        files.write_text(self.spark, f"{self.path}/commits/batch={batch_id}", json.dumps(note or {}))
        # This batch may run once more, so the version before it stays; older ones go.
        for b in buckets:
            for v in files.children(self.spark, f"{self.path}/data/bucket={b}"):
                n = int(v.split("=")[1]) if v.startswith("batch_id=") else batch_id
                if n < batch_id and n != old.get(b):
                    files.remove(self.spark, f"{self.path}/data/bucket={b}/{v}")
        needed = {*self.versions().values(), *old.values(), *self.commits()[-2:]}
        for n in self.commits():
            if n not in needed:
                files.remove(self.spark, f"{self.path}/commits/batch={n}")
