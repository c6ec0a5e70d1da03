"""Create-once, finalize-once and rate-once rules over event logs.

Outcomes of the rows of a hot key never need that key's rows together: the
first row is found by a partial aggregate and matched back on key *and* row id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlens.functions.values import uuid_norm
from draftlens.operators.joins import first_per_key, null_safe
from draftlens.operators.reports import FEEDBACK_TYPES, RATING_TYPES

# The answers on offer for ratings; comments are free text.
SCALE = ("1", "2", "3", "4", "5")
CHOICES = {t: SCALE for t in RATING_TYPES}
SUGGESTION_KEY = ["story_hash", "context_hash", "type"]


def lookup_by_uuid(requested: DataFrame, suggestion: DataFrame) -> DataFrame:
    """Suggestions by id, written with or without dashes."""
    wanted = requested.select("requested", uuid_norm(F.col("requested")).alias("uuid"))
    return wanted.join(suggestion, "uuid", "left")


def _with_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    first = first_per_key(rows, keys, order).withColumn("is_first", F.lit(True))
    # Keys may be null and are then equal; the row id makes the order unique.
    marked = null_safe(rows, first, keys + order)
    return marked.withColumn("is_first", F.coalesce("is_first", F.lit(False)))


def suggestion_get_or_create(requests: DataFrame, suggestion: DataFrame) -> DataFrame:
    """Outcome of each request for a suggestion.

    ``rejected``: the context already has text. Otherwise the first request of a
    (story, context, type) is ``created``, or ``retried`` when the stored
    suggestion failed; all others find it ``existing``. Null key columns are equal.
    """
    blank = F.coalesce(F.length("description"), F.lit(0)) == 0
    asked = _with_first(requests.where(blank), SUGGESTION_KEY, ["ts", "request_id"])
    stored = suggestion.select(*SUGGESTION_KEY, F.col("status").alias("stored"))
    first = null_safe(asked.where("is_first"), stored, SUGGESTION_KEY).select(
        "request_id",
        F.when(F.col("stored").isNull(), "created").when(F.col("stored") == "failed", "retried")
        .otherwise("existing").alias("outcome"))
    later = asked.where(~F.col("is_first")).select("request_id", F.lit("existing").alias("outcome"))
    refused = requests.where(~blank).select("request_id", F.lit("rejected").alias("outcome"))
    return first.unionByName(later).unionByName(refused)


def suggestion_gate(requests: DataFrame, story: DataFrame) -> DataFrame:
    """A suggestion needs a known story that is ready."""
    known = story.select(F.col("hash").alias("story_hash"), F.col("status").alias("story_status"))
    reason = F.when(F.col("story_status").isNull(), "unknown story").when(
        F.col("story_status") != "ready", "story not ready")
    return requests.join(known, "story_hash", "left").select(
        "request_id", "story_hash", "story_status", reason.alias("reject_reason"))


def finalize_once(events: DataFrame, suggestion: DataFrame) -> DataFrame:
    """The first finalization of a suggestion is kept; unknown and later ones are not."""
    marked = _with_first(events, ["uuid"], ["ts", "event_id"])
    known = suggestion.select("uuid", F.lit(True).alias("known"))
    outcome = F.when(F.col("known").isNull(), "unknown suggestion").when(
        F.col("is_first"), "finalized").otherwise("finalized twice")
    return marked.join(known, "uuid", "left").select("event_id", "uuid", "entry", outcome.alias("outcome"))


def feedback_gate(batches: DataFrame, suggestion: DataFrame) -> DataFrame:
    """Feedback needs a known suggestion that is done."""
    known = suggestion.select(F.col("uuid").alias("suggestion_id"), F.col("status").alias("suggestion_status"))
    reason = F.when(F.col("suggestion_status").isNull(), "unknown suggestion").when(
        F.col("suggestion_status") != "done", "suggestion not done")
    return batches.join(known, "suggestion_id", "left").select(
        "batch_id", "suggestion_id", reason.alias("reject_reason"))


def feedback_batches(rows: DataFrame, required=(), choices=CHOICES) -> DataFrame:
    """One row per submission: its types as a bit mask and whether it is valid."""
    has = lambda t: F.bool_or(F.col("type") == t)
    bad = reduce(lambda acc, t: acc | ((F.col("type") == t) & ~F.col("response").isin(*choices[t])),
                 choices, F.lit(False))
    bit = reduce(lambda acc, i: acc.when(F.col("type") == FEEDBACK_TYPES[i], F.lit(1 << i)),
                 range(1, len(FEEDBACK_TYPES)), F.when(F.col("type") == FEEDBACK_TYPES[0], F.lit(1)))
    missing = reduce(lambda acc, t: F.concat(acc, F.when(has(t), F.array().cast("array<string>"))
                                             .otherwise(F.array(F.lit(t)))),
                     required, F.array().cast("array<string>"))
    return rows.groupBy("batch_id", "suggestion_id", "ts").agg(
        F.bit_or(bit.otherwise(F.lit(0))).alias("mask"),
        F.count("*").alias("answers"),
        (F.count("type") > F.bit_count(F.bit_or(bit.otherwise(F.lit(0))))).alias("repeated"),
        F.count_if(bad).alias("bad_answers"),
        F.array_join(missing, ",").alias("missing"),
    )


def feedback_validate(rows: DataFrame, required=(), choices=CHOICES) -> DataFrame:
    """Whether each submission has the required types and allowed answers."""
    reason = F.when(F.col("missing") != "", F.concat(F.lit("missing "), "missing")).when(
        F.col("bad_answers") > 0, "invalid response")
    return feedback_batches(rows, required, choices).select(
        "batch_id", "suggestion_id", "answers", reason.alias("reject_reason"))


def _accepted(firsts: Column) -> Column:
    """Fold the first batch of each mask, oldest first; keep those that fit."""
    start = F.struct(F.lit(0).alias("taken"), F.array().cast("array<bigint>").alias("batches"))
    step = lambda acc, b: F.when(
        acc["taken"].bitwiseAND(b["mask"]) == 0,
        F.struct(acc["taken"].bitwiseOR(b["mask"]).alias("taken"),
                 F.concat(acc["batches"], F.array(b["batch_id"])).alias("batches")),
    ).otherwise(acc)
    return F.aggregate(F.array_sort(firsts), start, step)["batches"]


def feedback_once(rows: DataFrame, required=(), choices=CHOICES) -> DataFrame:
    """One answer per (suggestion, type); a submission stands or falls as a whole.

    Among submissions with the same set of types only the oldest can ever fit,
    since taken types stay taken. So at most 31 candidates per suggestion decide,
    whatever the number of submissions.
    """
    batches = feedback_batches(rows, required, choices)
    valid = (F.col("missing") == "") & (F.col("bad_answers") == 0) & ~F.col("repeated")
    firsts = batches.where(valid).groupBy("suggestion_id", "mask").agg(
        F.min(F.struct("ts", "batch_id")).alias("b"))
    accepted = firsts.groupBy("suggestion_id").agg(
        F.collect_list(F.struct("b.ts", "b.batch_id", "mask")).alias("firsts")
    ).select(F.explode(_accepted(F.col("firsts"))).alias("batch_id"), F.lit(True).alias("accepted"))
    reason = (
        F.when(F.col("missing") != "", F.concat(F.lit("missing "), "missing"))
        .when(F.col("bad_answers") > 0, "invalid response")
        .when(F.col("repeated") | F.col("accepted").isNull(), "more than once")
    )
    return batches.join(accepted, "batch_id", "left").select(
        "batch_id", "suggestion_id", "answers", reason.alias("reject_reason"))


def status_latest(events: DataFrame, key: str = "uuid", states=("pending", "executing", "done", "failed")) -> DataFrame:
    """The last known state of each key; other states are ignored."""
    return events.where(F.col("status").isin(*states)).groupBy(key).agg(
        F.max_by("status", F.struct("ts", "event_id")).alias("status"),
        F.max("ts").alias("ts"), F.count("*").alias("changes"))


def story_ready_rollup(outcomes: DataFrame) -> DataFrame:
    """A story is ready only if every model preprocessed it."""
    return outcomes.groupBy("story_hash").agg(
        F.when(F.bool_and("completed"), "ready").otherwise("failed").alias("status"),
        F.count("*").alias("models"))
