"""Join and ranking helpers that hold up under skewed keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP_SALTS = 64


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join on keys that may be null; null equals null. Keeps the left's key columns."""
    tagged = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    # New attributes, also where both sides come from one table.
    tagged = tagged.select(*[F.col(c).alias(c) for c in tagged.columns])
    on = [left[k].eqNullSafe(tagged[f"_right_{k}"]) for k in keys]
    joined = left.join(tagged, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_right_{k}" for k in keys])


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The keys and order columns of each key's first row.

    A plain aggregate: partial results per task, so a hot key costs one row per
    task in the shuffle. Joining back on keys *and* order columns spreads the
    rows of a hot key again.
    """
    first = F.min(F.struct(*order)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, *[f"_first.{c}" for c in order])


def top_per_group(df: DataFrame, group: str, order: str, limit: int) -> DataFrame:
    """The first ``limit`` rows of each group.

    Ranked within salted parts of a group first, so that no task sorts a whole
    hot group; the second ranking sees at most ``limit`` rows from each part.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(TOP_SALTS)))
    part = Window.partitionBy(group, "_salt").orderBy(order)
    whole = Window.partitionBy(group).orderBy(order)
    return (
        salted.withColumn("_rank", F.row_number().over(part))
        .where(F.col("_rank") <= limit)
        .withColumn("rank", F.row_number().over(whole))
        .where(F.col("rank") <= limit)
        .drop("_salt", "_rank")
    )


def rank_by_hash(df: DataFrame, group: str, hash_col: str, digits: int = 3) -> DataFrame:
    """0-based rank of each row within its group, in order of a hex hash.

    The leading hex digits cut a group into even parts. Counts per part give
    each part its offset, and rows are ranked inside their part only.
    """
    parts = df.withColumn("_part", F.left(F.col(hash_col), F.lit(digits)))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parts.groupBy(group, "_part")
        .agg(F.count("*").alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(group, "_part").orderBy(hash_col)
    return (
        parts.withColumn("_row", F.row_number().over(inside) - 1)
        .join(offsets, [group, "_part"])
        .withColumn("rank", F.col("_offset") + F.col("_row"))
        .drop("_part", "_offset", "_row")
    )


#: Bytes of texts in a task, tasks for each shuffle partition, and rows below which a
#: task's share of a cost class is dealt by rank instead of by hash.
TASK_BYTES, TASKS, FEW = 32 << 20, 4, 8
#: Rows that are ranked and broadcast at most (16 bytes each); beyond, hashes deal them.
MOST_RANKED = 500_000


def _tasks(df: DataFrame, bytes_sum: int, task_bytes: int) -> int:
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(TASKS * width, -(-bytes_sum // task_bytes))


def dealt(df: DataFrame, size: Column, key: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Rows spread by Spark's own hash of a key over tasks of bounded bytes.

    For rows whose cost follows their bytes and that are joined by the key next: that
    join finds them in place, whichever way it is planned, so they move once.
    """
    bytes_sum = df.agg(F.sum(size)).first()[0] or 0
    return df.repartition(_tasks(df, bytes_sum, task_bytes), key)


def packed(df: DataFrame, cost: Column, size: Column, key: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Rows spread over tasks of like cost.

    One pass sums cost and bytes by powers of two of the cost (at most 64 classes, the
    only thing the driver sees). A class gets tasks by its share of the cost or of
    the bytes, whichever asks for more, and its rows, which cost about the same,
    are dealt evenly: by hash where they are many, by rank where they are few, so that
    no two costly rows share a task while another is empty. The number of tasks
    follows the bytes, and is a few for each shuffle partition at least.
    """
    rows = df.withColumn("_class", F.floor(F.log2(F.greatest(cost, F.lit(1.0)))).cast("int"))
    facts = rows.select("_class", cost.alias("c"), size.alias("b")).groupBy("_class").agg(F.count("*").alias("n"), F.sum("c").alias("c"), F.sum("b").alias("b")).collect()
    cost_sum, bytes_sum = max(1.0, sum(r["c"] for r in facts)), max(1, sum(r["b"] for r in facts))
    tasks = _tasks(df, bytes_sum, task_bytes)
    first, begin, share, ranked = 0, F.lit(0), F.lit(1), []
    for r in sorted(facts, key=lambda r: r["_class"]):
        n = max(1, min(r["n"], round(tasks * max(r["c"] / cost_sum, r["b"] / bytes_sum))))
        here = F.col("_class") == r["_class"]
        begin, share = F.when(here, first).otherwise(begin), F.when(here, n).otherwise(share)
        if r["n"] < FEW * n:
            ranked.append(r["_class"])
        first += n
    place = F.pmod(F.xxhash64(key), share)
    # Narrow keys of known number, at most FEW for each task, so they may be broadcast.
    if 0 < sum(r["n"] for r in facts if r["_class"] in ranked) <= MOST_RANKED:
        few = rows.where(F.col("_class").isin(*ranked)).select(key, "_class")
        few = few.withColumn("_nth", F.row_number().over(Window.partitionBy("_class").orderBy(key))).select(key, "_nth")
        rows = rows.join(F.broadcast(few.dropDuplicates([key])), key, "left")
        place = F.when(F.col("_nth").isNotNull(), F.col("_nth") % share).otherwise(place)
    spread = rows.withColumn("_task", (begin + place).cast("int"))
    return spread.repartitionById(max(1, first), "_task").select(*df.columns)
