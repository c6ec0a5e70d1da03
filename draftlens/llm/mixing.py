"""Mixing sources to target weights.

Each document gets a hash-random key. Keys are uniform, so equal ranges of them
are equal shares: within a source, documents are dealt to fixed key ranges, sorted
there, and prefix sums of sizes follow from the ranges' totals and the sums within
each. A hot source is thus spread over all its ranges. Each source is cut at its
exact budget; a budget above the source's size repeats it in whole epochs first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftlens.llm.common import WORD, row_hash, save, word_count

#: Times that a source may be repeated.
EPOCHS = 3

#: Hex digits of the key that name its range: 4096 ranges a source.
DIGITS = 3


def targets(sources: DataFrame, weight: Column) -> DataFrame:
    """Share the sources' total by weight, none above EPOCHS times its size.

    Filling in order of size over weight: the level at which what the full ones
    leave is shared by the weights of the others is the largest that fits.
    """
    all_ = Window.partitionBy(F.lit(0))
    row = sources.withColumn("weight", weight).withColumn("total", F.sum("source_size").over(all_))
    row = row.withColumn("full", EPOCHS * F.col("source_size")).withColumn("ratio", F.col("full") / F.col("weight"))
    upto = all_.orderBy("ratio", "src").rowsBetween(Window.unboundedPreceding, -1)
    since = all_.orderBy("ratio", "src").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    row = row.withColumn("level", (F.col("total") - F.coalesce(F.sum("full").over(upto), F.lit(0))) / F.sum("weight").over(since))
    row = row.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(all_))
    return row.withColumn("target", F.least(F.col("full").cast("double"), F.col("level") * F.col("weight")))


def by_code_point() -> Column:
    """Weights 1, 2, 3, repeating, over sources by code point, null last."""
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last()))
    return ((rank - 1) % 3 + 1).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weight: Column | None = None, seed: str = "mix", rows_too: bool = False) -> DataFrame:
    """What the mix takes of every document, in words.

    One row per input row: doc_id, source, size, source_size, target (its source's),
    taken (repeats counted); with ``rows_too``, also row (a hash of its columns). A
    null text has size 0 and is not taken; a text of any length counts whole. A null
    source is a source. Rows tie only if id and size agree, and then either may be
    cut; a row without an id goes by the hash of its columns. Other columns are
    ignored, whatever their names.
    """
    name = F.coalesce(docs[id_col].cast("string"), F.concat(F.lit("row:"), row_hash(docs).cast("string")))
    key = F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary"))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[source_col].alias("source"),
                       F.coalesce(F.concat(F.lit("="), docs[source_col]), F.lit("")).alias("src"),
                       word_count(docs[text_col]).alias("size"), row_hash(docs).alias("row") if rows_too else F.lit(0).alias("row"), key.alias("key"))
    # Saved narrow, so that texts are read and their words counted once.
    rows = save(rows.withColumn("part", F.substring("key", 1, DIGITS)))
    parts = rows.groupBy("src", "part").agg(F.sum("size").alias("n"), F.first("source", True).alias("source"))
    sources = parts.groupBy("src").agg(F.sum("n").alias("source_size"), F.first("source", True).alias("source"))
    sources = targets(sources, by_code_point() if weight is None else weight)
    goal = F.floor(F.col("target") + 0.5)
    sources = sources.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0))
    sources = sources.withColumn("rest", goal - F.col("epochs") * F.col("source_size")).drop("source")
    before = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.drop("source").withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    parts = parts.join(sources, "src").select("src", "part", "base", "source_size", "target", "epochs", "rest")
    within = Window.partitionBy("src", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0))).join(parts, ["src", "part"])
    cut = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("base") - F.col("ahead")))
    taken = (F.col("epochs") * F.col("size") + cut).cast("long").alias("taken")
    return out.select("doc_id", "source", "size", "source_size", "target", taken, *(["row"] if rows_too else []))


def apply(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of ``docs``, which has doc_id, text and source.

    A document comes once for each whole copy taken; of a cut copy come its first
    words, joined by blanks. Rows that agree in all columns share what is taken of
    them. Documents of which nothing is taken (texts without words among them) go.
    """
    plan = mix(docs, rows_too=True).groupBy("row", "size").agg(F.sum("taken").alias("all"), F.count(F.lit(1)).alias("n")).where(F.col("all") > 0)
    # The document is one value beside the columns made here, so names cannot clash.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), row_hash(docs).alias("row")).join(plan, "row")
    rows = rows.withColumn("j", F.row_number().over(Window.partitionBy("row").orderBy("size")))
    share = F.floor(F.col("all") * F.col("j") / F.col("n")) - F.floor(F.col("all") * (F.col("j") - 1) / F.col("n"))
    rows = rows.select("doc", "size", share.alias("taken")).where("taken > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    left, text = F.col("taken") - (F.col("copy") - 1) * F.col("size"), F.col("doc")["text"]
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), F.lit(1), left.cast("int")), " ")
    text = F.when(left < F.col("size"), cut).otherwise(text).alias("text")
    return rows.select(*[text if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])
