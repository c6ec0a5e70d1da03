"""Word lists: stop words for scoring and excluded games."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The stop words that edit scores are defined over.
STOPWORDS = tuple(
    """
    a about after again all an and any are around as at away back be been before
    but by can could d did didn do don down even eyes face for from get go going
    good had hand has have he head her here him his how i if in into is it just
    know like little ll look looked m made make man me more much my need no not now
    of off on one only or other out over people re right s said see she so some
    something still t than that the their them then there they think this through
    time to too two up was way we well were what when where who will with word would
    you your
    """.split()
)

# Games left out of the reports unless the caller passes another list.
EXCLUDED_GAMES = ("g3", "g11", "g29")


def load_word_list(spark: SparkSession, path: str) -> DataFrame:
    """One distinct, stripped word per line of a text file."""
    return (
        spark.read.text(path)
        .select(F.trim("value").alias("word"))
        .where(F.length("word") > 0)
        .distinct()
    )
