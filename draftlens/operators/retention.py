"""Which story exports to keep, and one story per content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlens.functions.values import parse_exported_at


def latest_export_by_game(story: DataFrame) -> DataFrame:
    """The newest export of each game (a row for stories without a game too)."""
    return story.groupBy("game_pid").agg(F.max(parse_exported_at(F.col("exported_at"))).alias("latest"))


def stories_to_delete(story: DataFrame, suggestion: DataFrame) -> DataFrame:
    """Unused exports older than the newest of their game.

    Stories without a game and ties of the newest export stay. Unused ones are
    found first, on the evenly spread story hash; the join to the newest export
    per game then has one small row per game, and AQE splits a hot game.
    """
    unused = story.join(suggestion.select(F.col("story_hash").alias("hash")), "hash", "left_anti")
    latest = latest_export_by_game(story).where("game_pid IS NOT NULL AND latest IS NOT NULL")
    exported = parse_exported_at(F.col("exported_at"))
    return unused.join(latest, "game_pid").where(exported < F.col("latest")).select("id", "hash", "game_pid", "exported_at")


def retained_stories(story: DataFrame, suggestion: DataFrame) -> DataFrame:
    """The stories left after the cleanup; run daily for retention."""
    return story.join(stories_to_delete(story, suggestion).select("id"), "id", "left_anti")


def story_dedup(uploads: DataFrame) -> DataFrame:
    """One story per content hash; the first upload wins.

    A failed story is tried again by its next upload, so the accepted upload is
    the first that did not fail. One aggregate, partial per task: a group of
    copies costs one row per task.
    """
    ok = F.min(F.when(~F.col("failed"), F.col("upload_id")))
    return uploads.groupBy("hash").agg(
        F.min("upload_id").alias("first_upload"), ok.alias("accepted_upload"),
        F.count("*").alias("uploads"),
        F.when(ok.isNull(), "failed").otherwise("ready").alias("status"),
    )


def lookup_story_status(requested: DataFrame, story: DataFrame) -> DataFrame:
    """Status of each requested hash; NULL when unknown."""
    return requested.join(story.select("hash", "status"), "hash", "left")
