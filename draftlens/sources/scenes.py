"""Nested exports built from conversations, and readers and writers for JSON.

Each turn is a scene entry; an export holds the turns of a conversation once.
"""

from __future__ import annotations

import gzip
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _null(kind: str = "string"):
    return F.lit(None).cast(kind)


def scene_entries(conversations: DataFrame) -> DataFrame:
    """One row per turn with its entry as JSON text (explicit nulls)."""
    role, turn, conv = F.col("role"), F.col("turn"), F.col("conv_id")
    card = lambda name: F.struct(
        F.concat(F.lit("card-"), turn.cast("string")).alias("card_id"), F.lit(name).alias("name"),
        F.lit("obstacle").alias("namespace"), F.lit("Obstacle").alias("pretty_namespace"),
        F.lit(0).alias("polarity"), F.concat(F.lit(f"about {name} "), role).alias("description"),
        F.lit("all is well").alias("success_stakes"), _null().alias("failure_stakes"),
        F.lit(False).alias("is_deleted"), F.lit(False).alias("is_wild"), F.lit(1).alias("stack_size"))
    no_cards = F.array().cast("array<struct<card_id:string>>")
    stack = F.to_json(F.array(F.struct(F.concat(F.lit("c"), turn.cast("string")).alias("card_id"),
                                       (turn + 1).cast("int").alias("stack_size"))))
    entry = F.struct(
        F.concat(F.lit("u"), conv.cast("string")).alias("user_pid"),
        turn.cast("string").alias("seq_id"),
        F.when(role == "user", "move").when(role == "assistant", "addition").otherwise("whisper").alias("format"),
        F.initcap(role).alias("pretty_format"),
        F.when(role == "user", F.when(conv % 8 == 1, "9").otherwise("1")).otherwise(
            F.when(role == "system", "2")).alias("character_seq_id"),
        F.when(role == "user", "character:1").when(role == "assistant", "narrator").otherwise("director").alias("role"),
        F.col("text").alias("description"),
        F.when(F.length("text") % 5 == 0, "some day")
        .when(turn % 2 == 0, F.concat(F.lit("2024-1-"), (turn + 1).cast("string"), F.lit(" 3:4:5 UTC")))
        .otherwise(F.concat(F.lit("2024-01-0"), (turn + 1).cast("string"), F.lit("T03:04:05"))).alias("created_at"),
        _null().alias("image"),
        F.struct(
            F.when(turn == 0, F.parse_json(stack)).otherwise(F.parse_json(F.lit('"unchanged"'))).alias("pre"),
            F.when(turn % 3 == 0, F.parse_json(stack)).otherwise(F.parse_json(F.lit('"unchanged"'))).alias("post"),
        ).alias("hand_context"),
        no_cards.alias("challenge_cards"),
        F.when(role != "system", card("gate")).alias("target_challenge_card"),
        F.when(conv % 6 == 0, F.array().cast("array<struct<card_id:string,name:string,namespace:string,"
               "pretty_namespace:string,polarity:int,description:string,success_stakes:string,"
               "failure_stakes:string,is_deleted:boolean,is_wild:boolean,stack_size:int>>"))
        .otherwise(F.array(card("key"), card("rope"))).alias("cards_played_on_challenge"),
        _null("int").alias("challenge_completion_polarity"),
        _null().alias("place_card"),
        no_cards.alias("cards_for_pickup"),
        no_cards.alias("autotexts"),
        (role == "assistant").alias("author_is_narrator_when_published"),
        _null("boolean").alias("redacted"),
    )
    return conversations.select(
        "conv_id", "turn", F.concat(F.lit("c"), conv.cast("string")).alias("game_pid"),
        F.floor(turn / 4).cast("int").alias("scene"),
        F.to_json(entry, {"ignoreNullFields": "false"}).alias("entry"),
    )


def story_exports(conversations: DataFrame) -> DataFrame:
    """One export for each conversation: its turns in order, in scenes of their own.

    A turn is written once. An export is one value, so a conversation's turns meet
    in one row.
    """
    told = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("told"))
    scene = lambda t: F.struct(F.array(F.struct(t["turn"].cast("string").alias("seq_id"), t["text"].alias("description"))).alias("entries"))
    person = lambda n, name: F.struct(F.lit(n).alias("character_seq_id"), F.lit(name).alias("name"),
                                      F.concat(F.lit(f"{name} of c"), F.col("conv_id").cast("string")).alias("description"))
    story = F.struct(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("game_pid"),
        F.lit("2024-01-09T00:00:00").alias("exported_at"),
        F.transform("told", scene).alias("scenes"),
        F.array(person("1", "Ada"), person("2", "Ben"), person("1", "Cyd")).alias("characters"),
    )
    return told.select(story["game_pid"].alias("game_pid"), F.to_json(story, {"ignoreNullFields": "false"}).alias("story"))


def judged_entries(conversations: DataFrame) -> DataFrame:
    """A suggestion for each turn: its game, how many scenes it saw, and the entry.

    What a suggestion saw is named by game and position, not copied.
    """
    seen = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return scene_entries(conversations).withColumn("position", seen).select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("suggestion_id"),
        F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("model_name"),
        "game_pid", "position", F.col("entry").alias("generated"), F.col("entry").alias("finalized"))


def read_story_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Story exports, one per file or one per line; .gz and .deflate files are decoded.

    Keeps the raw text beside a variant, which is NULL when the text is not JSON.
    """
    raw = spark.read.text(path, wholetext=not lines).withColumnRenamed("value", "raw")
    return raw.select("raw", F.try_parse_json("raw").alias("story"))


@F.pandas_udf(T.StringType())
def _inflate(body: pd.Series, encoding: pd.Series) -> pd.Series:
    def text(b, kind):
        if b is None:
            return None
        try:
            return (gzip.decompress(b) if kind == "gzip" else zlib.decompress(b) if kind == "deflate" else b).decode()
        except (OSError, EOFError, zlib.error, UnicodeDecodeError):
            return None

    return pd.Series([text(b, k) for b, k in zip(body, encoding, strict=True)], dtype="object")


def decode_bodies(requests: DataFrame, body: str = "body", encoding: str = "encoding") -> DataFrame:
    """Story uploads as they were sent: the body as text and as a variant.

    ``encoding`` is gzip, deflate or anything else for plain. Bodies that cannot be
    decoded have a NULL text, those that are no JSON a NULL story.
    """
    read = requests.withColumn("raw", _inflate(F.col(body), F.col(encoding)))
    return read.withColumn("story", F.try_parse_json("raw"))
