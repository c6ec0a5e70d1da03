"""A corpus pipeline over documents: each stage works on what the one before kept.

Stages, in order: reject low quality, keep one document of each near-duplicate
group, remove repeated byte strings, mix sources to weights, encode. Each stage's
rows are written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from draftlens.llm import bpe, mixing, quality, simhash
from draftlens.llm.common import row_hash, save, table
from draftlens.llm.queries import RANKS
from draftlens.llm.repeated_bytes import repeated_bytes

#: Some stages have no SQL form; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def plain(docs: DataFrame) -> DataFrame:
    """Documents whose other columns have names that no stage uses; ``named`` undoes it."""
    return docs.toDF(*[c if c in ("doc_id", "text", "source") else f"column_{k}" for k, c in enumerate(docs.columns)])


def named(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*plain(docs).columns).toDF(*docs.columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps. Null and empty texts are kept."""
    rows = quality.select(plain(docs), table(spark, sf_dir, "labels"))
    return named(rows.where("kept"), docs)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the smallest id.

    Of several rows with that id the one whose columns hash lowest stays. Rows
    without an id are kept only where no row of their group has one.
    """
    docs_ = plain(docs)
    chosen = simhash.representatives(docs_).select("row")
    rows = docs_.withColumn("row", row_hash(docs_)).join(chosen, "row", "left_semi")
    nth = F.row_number().over(Window.partitionBy("row").orderBy("doc_id"))
    return named(rows.withColumn("nth", nth).where("nth = 1"), docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated strings; what is left of a character at a cut goes too."""
    docs_ = plain(docs)
    others = tuple(c for c in docs_.columns if c not in ("doc_id", "text"))
    rows = repeated_bytes(docs_, carry=others, as_text=True)
    return named(rows.select("doc_id", F.col("kept").alias("text"), *[F.col("rest")[c].alias(c) for c in others]), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them."""
    return named(mixing.apply(plain(docs)), docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document; texts are what the ids decode to."""
    import public_tokenizers

    name = (public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    rows = bpe.encode(docs.select("doc_id", "source", "text"), *name, decoded_col="decoded")
    return rows.select("doc_id", "source", F.col("decoded").cast("string").alias("text"), F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", keep_one),
    ("suffix-array dedup", cut_repeats),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
