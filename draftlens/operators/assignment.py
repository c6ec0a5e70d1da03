"""Monthly quotas, least-loaded model choice and reassignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from draftlens.functions.values import month_floor
from draftlens.operators.joins import rank_by_hash

AS_OF = "2024-02-15"
#: Turns that a model lists at once.
BLOCK = 4096


def monthly_totals(model, assignment, suggestion, as_of: str = AS_OF, model_id: int | None = None) -> DataFrame:
    """Suggestions of each model, or of one, since the start of the month of ``as_of``.

    Missing suggestions count as made on ``as_of``. So a model whose only
    suggestions are older has no row, and on the first of a month a model
    without suggestions has none either.
    Work is summed per model before the registry is joined, so the large join is
    on the story hash and no key with many rows is shuffled.
    """
    if model_id is not None:
        model, assignment = model.where(F.col("id") == model_id), assignment.where(F.col("model_id") == model_id)
    today = F.lit(as_of).cast("date").cast("timestamp")
    start = month_floor(today)
    made = suggestion.select("story_hash", "ts", F.lit(1).alias("made"))
    work = assignment.join(made, "story_hash", "left").select(
        "model_id", (F.coalesce("ts", today) > start).alias("passes"), F.coalesce("made", F.lit(0)).alias("made"))
    per_model = work.groupBy("model_id").agg(
        F.count_if("passes").alias("passing"), F.sum(F.when(F.col("passes"), F.col("made")).otherwise(0)).alias("n"))
    rows = model.select(F.col("id").alias("model_id")).join(per_model, "model_id", "left")
    idle = F.col("passing").isNull() & (today > start)
    return rows.where(idle | (F.col("passing") > 0)).select(
        "model_id", F.coalesce("n", F.lit(0)).cast("long").alias("suggestion_count"))


def story_totals(model, assignment, suggestion, as_of: str = AS_OF, strict: bool = True) -> DataFrame:
    """Assigned stories of each model that is active and under its quota.

    A model without a monthly row has no count, and a quota cannot be shown to
    hold: it is left out. ``strict=False`` reads the missing count as 0.
    """
    totals = monthly_totals(model, assignment, suggestion, as_of)
    load = assignment.groupBy("model_id").agg(F.count("story_hash").alias("story_count"))
    used = F.col("suggestion_count") if strict else F.coalesce("suggestion_count", F.lit(0))
    return (
        model.where(F.col("status") == "active")
        .withColumnRenamed("id", "model_id")
        .join(totals, "model_id", "left")
        .where((F.col("quota") < 0) | (used < F.col("quota")))
        .join(load, "model_id", "left")
        .select(F.col("model_id").alias("id"), "url", "name", "type", "status",
                F.coalesce("story_count", F.lit(0)).cast("long").alias("story_count"))
    )


def min_counts(totals: DataFrame) -> DataFrame:
    return totals.groupBy("type").agg(F.min("story_count").alias("min_count"))


def select_models(totals: DataFrame) -> DataFrame:
    """The least-loaded eligible model of each type; the lowest id wins a tie."""
    best = F.min_by(F.struct("id", "url", "name", "status", "story_count"),
                    F.struct("story_count", "id")).alias("best")
    return totals.groupBy("type").agg(best).select("type", "best.*")


def quota_violations(model, assignment, suggestion, as_of: str = AS_OF,
                     unlimited_negative: bool = True) -> DataFrame:
    """Models that hold stories but are inactive or past their monthly quota.

    ``unlimited_negative=False`` keeps the literal test, where a quota of -1 is
    always exceeded.
    """
    totals = monthly_totals(model, assignment, suggestion, as_of)
    held = assignment.groupBy("model_id").agg(F.count("*").alias("stories"))
    over = F.coalesce("suggestion_count", F.lit(0)) > F.col("quota")
    if unlimited_negative:
        over = over & (F.col("quota") >= 0)
    rows = model.withColumnRenamed("id", "model_id").join(held, "model_id").join(totals, "model_id", "left")
    reason = F.when(F.col("status") == "inactive", "inactive").when(over, "quota")
    return rows.select("model_id", "name", "type", "quota",
                       F.coalesce("suggestion_count", F.lit(0)).cast("long").alias("suggestion_count"),
                       "stories", reason.alias("reason")).where("reason IS NOT NULL")


def _turns(totals: DataFrame, moved: DataFrame) -> DataFrame:
    """Which model takes which turn of its type: (type, turn, new_model_id), turns from 0.

    Stories fill the emptiest models first, as water finds its level. A type with M
    stories to place and loads l1 <= l2 <= ... fills the first w models, w the last
    one with w * lw - (l1 + ... + lw) <= M, in whole rounds and a rest. A model of
    load l is level with k others while the level is at l, so the turn of its
    round r (levels l + r) follows from prefix sums; every model lists its own turns.
    """
    order = Window.partitionBy("type").orderBy("story_count", "id")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    # The registry has one row per model; a type's models are ranked in one task.
    eligible = totals.select("type", "id", "story_count").withColumn("nth", F.row_number().over(order)).withColumn("load", F.sum("story_count").over(upto))
    below = F.col("nth") * F.col("story_count") - F.col("load")
    need = moved.groupBy("type").agg(F.count(F.lit(1)).alias("stories"))
    filled = eligible.withColumn("below", below).join(need, "type").where("below < stories")
    whole = filled.groupBy("type").agg(F.max("nth").alias("width"), F.max_by("load", "nth").alias("held"), F.first("stories").alias("stories"))
    level = F.floor((F.col("held") + F.col("stories")) / F.col("width"))
    whole = whole.withColumn("level", level).withColumn("rest", F.col("held") + F.col("stories") - F.col("level") * F.col("width")).drop("held", "width")
    # Within a level, models take turns by id among those that have reached it.
    rows = filled.select("type", "id", "story_count").join(whole, "type")
    rows = rows.withColumn("at_end", F.row_number().over(Window.partitionBy("type").orderBy("id")))
    takes = (F.col("level") - F.col("story_count") + F.when(F.col("at_end") <= F.col("rest"), 1).otherwise(0)).cast("long")
    rows = rows.withColumn("takes", takes).where("takes > 0").withColumn("block", F.expr(f"explode(sequence(0L, takes - 1, {BLOCK}L))"))
    rows = rows.withColumn("round", F.explode(F.sequence(F.col("story_count") + F.col("block"), F.col("story_count") + F.least(F.col("block") + BLOCK, F.col("takes")) - 1)))
    # Turns before a round: w * r less the loads of the w models that are in it; all but the rest before the last.
    before = F.count(F.lit(1)) * F.col("round") - F.sum("story_count")
    rounds = rows.groupBy("type", "round").agg(before.alias("before"), F.first("level").alias("level"), F.first("rest").alias("rest"), F.first("stories").alias("stories"))
    rounds = rounds.select("type", "round", F.when(F.col("round") == F.col("level"), F.col("stories") - F.col("rest")).otherwise(F.col("before")).alias("first"))
    place = F.row_number().over(Window.partitionBy("type", "round").orderBy("id")) - 1
    turns = rows.withColumn("place", place).join(rounds, ["type", "round"])
    return turns.select("type", (F.col("first") + F.col("place")).alias("rank"), F.col("id").alias("new_model_id"))


def reassign_stories(model, assignment, suggestion, as_of: str = AS_OF, strict: bool = True) -> DataFrame:
    """Move the stories of violating models to eligible ones of the same type.

    Equal to moving one story after another, in order of story hash, each to the
    model that is least loaded at that moment (lowest id on a tie). A story of a
    type without eligible models gets no new model. Stories and turns are numbered
    alike within a type and meet in one join on type and number.
    """
    bad = quota_violations(model, assignment, suggestion, as_of).select("model_id", "type", "reason")
    moved = assignment.join(bad, "model_id")
    key = F.md5(F.concat_ws(":", "story_hash", F.col("model_id").cast("string")))
    ranked = rank_by_hash(moved.withColumn("_key", key), "type", "_key").drop("_key")
    turns = _turns(story_totals(model, assignment, suggestion, as_of, strict), moved)
    return ranked.join(turns, ["type", "rank"], "left").select(
        "story_hash", "type", F.col("model_id").alias("old_model_id"), "reason", "new_model_id")
