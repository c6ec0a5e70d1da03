"""Select, insert, update and delete as whole-table Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftlens.functions.values import eq_all
from draftlens.sources import files

# What an inserted registry row holds unless told otherwise.
MODEL_DEFAULTS = {"type": "scene_entry", "status": "inactive", "quota": -1}


def scan_all(df: DataFrame, columns: list[str] | None = None, where: dict | None = None) -> DataFrame:
    """Chosen columns of the rows that meet all equalities."""
    kept = df.where(eq_all(where)) if where else df
    return kept.select(*columns) if columns else kept


def scan_one(df: DataFrame, columns: list[str] | None = None, where: dict | None = None,
             key: str = "id") -> DataFrame:
    """As ``scan_all``, the one row with the lowest key."""
    kept = (df.where(eq_all(where)) if where else df).orderBy(key).limit(1)
    return kept.select(*columns) if columns else kept


def insert(df: DataFrame, new: DataFrame, defaults: dict | None = None) -> DataFrame:
    """The table with new rows; columns not given take their default or NULL."""
    filled = new
    for field in df.schema.fields:
        if field.name not in new.columns:
            value = (defaults or {}).get(field.name)
            filled = filled.withColumn(field.name, F.lit(value).cast(field.dataType))
        else:
            filled = filled.withColumn(field.name, F.col(field.name).cast(field.dataType))
    return df.unionByName(filled.select(*df.columns))


def update(df: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """The table with changed fields. Only columns present in ``changes`` are set,
    and there only where a value is given.
    """
    fields = [c for c in changes.columns if c != key]
    renamed = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in fields])
    joined = df.join(renamed, key, "left")
    return joined.select(*[
        F.coalesce(f"_new_{c}", c).cast(df.schema[c].dataType).alias(c) if c in fields else F.col(c)
        for c in df.columns
    ])


def upsert(df: DataFrame, changes: DataFrame, key: str = "id", defaults: dict | None = None) -> DataFrame:
    """Update rows that exist, insert the others."""
    fresh = changes.join(df.select(key), key, "left_anti")
    return insert(update(df, changes, key), fresh, defaults)


def delete(df: DataFrame, where: dict | None = None, keys: DataFrame | None = None) -> DataFrame:
    """The table without rows that meet all equalities, or without given keys."""
    if keys is not None:
        return df.join(keys, keys.columns, "left_anti")
    if not where:
        raise ValueError("refusing to delete every row")
    return df.where(~eq_all(where))


def stored_increments(spark: SparkSession, path: str) -> DataFrame | None:
    """What all increments have stored; None before the first."""
    parts = [n for n in files.children(spark, path) if n.startswith("increment=")]
    return spark.read.parquet(*[files.literal(f"{path}/{n}") for n in parts]) if parts else None


def write_increment(scored: DataFrame, path: str, increment: str, key: str = "suggestion_id") -> None:
    """Store the scores of suggestions that have none yet, under the increment's name.

    A repeat of an increment replaces what it wrote, and rows that another increment
    holds are left out, so nothing is ever stored twice.
    """
    spark = scored.sparkSession
    others = [n for n in files.children(spark, path) if n.startswith("increment=") and n != f"increment={increment}"]
    if others:
        held = spark.read.parquet(*[files.literal(f"{path}/{n}") for n in others]).select(key)
        scored = scored.join(held, key, "left_anti")
    scored.write.mode("overwrite").parquet(f"{path}/increment={increment}")
