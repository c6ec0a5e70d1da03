"""Queries: lifecycle rules over event logs, in batch and as streams."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from draftlens.functions.values import iso_text
from draftlens.operators import lifecycle as L
from draftlens.plans.registry import query, sql_list
from draftlens.plans.relational import DEDUP, DELETED
from draftlens.session import scratch_path
from draftlens.sources import files
from draftlens.streaming import jobs as J
from draftlens.streaming import rules as S

KEY = "story_hash, context_hash, type"

GET_OR_CREATE = f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY {KEY}, coalesce(length(description), 0) = 0 ORDER BY ts, request_id) AS rn FROM request_log)
SELECT r.request_id, CASE WHEN coalesce(length(r.description), 0) > 0 THEN 'rejected' WHEN rn > 1 THEN 'existing'
  WHEN s.uuid IS NULL THEN 'created' WHEN s.status = 'failed' THEN 'retried' ELSE 'existing' END AS outcome
FROM r LEFT JOIN suggestion s ON s.story_hash IS NOT DISTINCT FROM r.story_hash AND s.context_hash IS NOT DISTINCT FROM r.context_hash AND s.type IS NOT DISTINCT FROM r.type
"""


@query("suggestion_get_or_create", GET_OR_CREATE, "request_log suggestion")
def _(t):
    return L.suggestion_get_or_create(t.request_log, t.suggestion)


@query("suggestion_gate", """
SELECT r.request_id, r.story_hash, st.status AS story_status,
  CASE WHEN st.status IS NULL THEN 'unknown story' WHEN st.status <> 'ready' THEN 'story not ready' END AS reject_reason
FROM request_log r LEFT JOIN story st ON st.hash = r.story_hash
""", "request_log story")
def _(t):
    return L.suggestion_gate(t.request_log, t.story)


FINALIZE = """
SELECT e.event_id, e.uuid, e.entry, CASE WHEN s.uuid IS NULL THEN 'unknown suggestion'
  WHEN row_number() OVER (PARTITION BY e.uuid ORDER BY e.ts, e.event_id) = 1 THEN 'finalized' ELSE 'finalized twice' END AS outcome
FROM finalize_log e LEFT JOIN suggestion s ON s.uuid = e.uuid
"""


@query("finalize_once", FINALIZE, "finalize_log suggestion")
def _(t):
    return L.finalize_once(t.finalize_log, t.suggestion)


@query("feedback_gate", """
SELECT b.batch_id, b.suggestion_id, CASE WHEN s.uuid IS NULL THEN 'unknown suggestion' WHEN s.status <> 'done' THEN 'suggestion not done' END AS reject_reason
FROM (SELECT DISTINCT batch_id, suggestion_id FROM feedback_log) b LEFT JOIN suggestion s ON s.uuid = b.suggestion_id
""", "feedback_log suggestion")
def _(t):
    return L.feedback_gate(t.feedback_log.select("batch_id", "suggestion_id").distinct(), t.suggestion)


BATCHES = """
b AS (SELECT batch_id, suggestion_id, ts, count(*) AS answers, count(DISTINCT type) AS kinds,
    count(*) FILTER (type <> 'comments' AND response NOT IN ('1','2','3','4','5')) AS bad,
    count(*) FILTER (type = 'fluency') AS fluency, list(DISTINCT type) AS types FROM feedback_log GROUP BY ALL)
"""


@query("feedback_validate", f"""
WITH {BATCHES} SELECT batch_id, suggestion_id, answers, CASE WHEN fluency = 0 THEN 'missing fluency' WHEN bad > 0 THEN 'invalid response' END AS reject_reason FROM b
""", "feedback_log")
def _(t):
    return L.feedback_validate(t.feedback_log, required=("fluency",))


FEEDBACK_ONCE = f"""
WITH RECURSIVE {BATCHES},
v AS (SELECT *, row_number() OVER (PARTITION BY suggestion_id ORDER BY ts, batch_id) AS rn FROM b WHERE bad = 0 AND answers = kinds),
walk AS (
  SELECT suggestion_id, batch_id, rn, true AS fits, types AS taken FROM v WHERE rn = 1
  UNION ALL
  SELECT v.suggestion_id, v.batch_id, v.rn, NOT list_has_any(w.taken, v.types),
    CASE WHEN list_has_any(w.taken, v.types) THEN w.taken ELSE list_concat(w.taken, v.types) END
  FROM walk w JOIN v ON v.suggestion_id = w.suggestion_id AND v.rn = w.rn + 1)
SELECT b.batch_id, b.suggestion_id, b.answers, CASE WHEN bad > 0 THEN 'invalid response'
  WHEN answers <> kinds OR NOT fits THEN 'more than once' END AS reject_reason
FROM b LEFT JOIN walk ON walk.batch_id = b.batch_id
"""


@query("feedback_once", FEEDBACK_ONCE, "feedback_log")
def _(t):
    return L.feedback_once(t.feedback_log)


STATES = sql_list(("pending", "executing", "done", "failed"))
LATEST = f"""
SELECT uuid, arg_max(status, {{'ts': ts, 'event_id': event_id}}) AS status, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ts, count(*) AS changes
FROM status_log WHERE status IN ({STATES}) GROUP BY uuid
"""


@query("status_latest", LATEST, "status_log")
def _(t):
    return L.status_latest(t.status_log).withColumn("ts", iso_text(F.col("ts")))


@query("story_ready_rollup", """
SELECT story_hash, CASE WHEN bool_and(completed) THEN 'ready' ELSE 'failed' END AS status, count(*) AS models FROM preprocess_log GROUP BY story_hash
""", "preprocess_log")
def _(t):
    return L.story_ready_rollup(t.preprocess_log)


# --- streams --------------------------------------------------------------
# Each lays a log out in several slices, written by many tasks; as each has come, the
# job runs over the files at hand (availableNow), a slice in a micro-batch. Each
# query returns what its job wrote.

SLICES, BUCKETS = 4, 4
KEY_BUCKETS = 12  # for tables of a key for nearly every row


def scattered(key: str):
    """Files that have nothing to do with time."""
    return F.pmod(F.col(key) * 7 + F.floor(F.col(key) / 10), F.lit(SLICES))


def sql_scattered(key: str) -> str:
    return f"(({key} * 7 + {key} // 10) % {SLICES})"


def arriving(t, rows, label: str, part, start, closing=None):
    """Run ``start(stream)`` as each slice of a log comes; ``closing`` ends the log.

    The rows are made once, dealt to folders by slice; no task gets a whole slice.
    """
    folder, dealt = scratch_path(t.spark, label), scratch_path(t.spark, label + "-slices")
    rows.withColumn("slice", part).write.partitionBy("slice").parquet(dealt)
    come = lambda: start(J.read_log(t.spark, rows.schema, folder, None)).awaitTermination()
    for k in range(SLICES):
        if files.exists(t.spark, f"{dealt}/slice={k}"):
            t.spark.read.schema(rows.schema).parquet(files.literal(f"{dealt}/slice={k}")).write.mode("append").parquet(folder)
            come()
    for _ in range(2 if closing is not None else 0):  # the second gives a batch in which all that waits is decided
        S.closing_row(t.spark, rows.schema, closing).coalesce(1).write.mode("append").parquet(folder)
        come()


def shuffled_days(rows, key: str, delay: timedelta):
    """Files in order of time, but for rows that come later by up to the delay."""
    at = F.unix_seconds(F.col("ts").cast("timestamp")) + F.pmod(F.col(key) * 7919, F.lit(int(delay.total_seconds() * 0.9)))
    low, high = rows.agg(F.min(at), F.max(at)).first()
    return F.least(F.floor((at - F.lit(low or 0)) * SLICES / F.lit(max(1, (high or 0) - (low or 0)))), F.lit(SLICES - 1))


def places(t, label):
    return scratch_path(t.spark, label), scratch_path(t.spark, label + "-state")


@query("stream_story_dedup", DEDUP, "upload_log")
def _(t):
    target, state = places(t, "dedup")
    arriving(t, t.upload_log, "uploads", scattered("upload_id"), lambda uploads: J.story_dedup(uploads, target, state, BUCKETS))
    rows = J.current(t.spark, target, ["hash"], J.UPLOADS)
    return rows.withColumn("status", F.when(F.col("accepted_upload").isNull(), "failed").otherwise("ready"))


@query("stream_first_upload", f"""
WITH r AS (SELECT *, {sql_scattered("upload_id")} AS part FROM upload_log)
SELECT upload_id, hash, CASE WHEN failed THEN 'failed'
  WHEN row_number() OVER (PARTITION BY hash, failed ORDER BY part, upload_id) = 1 THEN 'accepted' ELSE 'repeat' END AS outcome FROM r
""", "upload_log")
def _(t):
    """What became of each upload as it came; a failed one leaves its content open."""
    target, state = places(t, "first-upload")
    arriving(t, t.upload_log, "uploads", scattered("upload_id"),
             lambda uploads: J.first_wins(uploads, ["hash"], ["upload_id"], target, state, ok=~F.col("failed"), buckets=BUCKETS))
    return J.outcomes(t.spark, target).select("upload_id", "hash", "outcome")


HALF = timedelta(days=15)


@query("stream_drop_repeats", f"""
WITH r AS (SELECT event_id, ts, md5(props) AS hash, {sql_scattered("event_id")} AS part FROM events),
m AS (SELECT part, max(max(ts)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL {HALF.days} DAY AS mark FROM r GROUP BY part),
l AS (SELECT r.*, coalesce(ts < mark, false) AS late FROM r JOIN m USING (part))
SELECT hash, count(*) FILTER (late) AS late, CAST(bool_or(NOT late) AS BIGINT) AS accepted,
       count(*) FILTER (NOT late) - CAST(bool_or(NOT late) AS BIGINT) AS repeats FROM l GROUP BY hash
""")
def _(t):
    """Files out of order, so that rows come late: none is lost."""
    target, state = places(t, "repeats")
    rows = t.raw("events").select("event_id", "ts", F.md5("props").alias("hash"))
    arriving(t, rows, "repeat-log", scattered("event_id"),
             lambda events: J.drop_repeats(events, ["hash"], "ts", target, state, delay=HALF, buckets=BUCKETS))
    of = lambda kind: F.count_if(F.col("outcome") == kind)
    return J.outcomes(t.spark, target).groupBy("hash").agg(of("late").alias("late"), of("accepted").alias("accepted"), of("repeat").alias("repeats"))


DAY = timedelta(days=1)
LAST = "2999-01-01"


@query("stream_get_or_create", GET_OR_CREATE, "request_log suggestion")
def _(t):
    """One outcome for every request; the stored table is the state to begin with."""
    target, state = places(t, "created")
    log = t.request_log.withColumn("ts", F.col("ts").cast("timestamp"))
    arriving(t, log, "requests", shuffled_days(log, "request_id", DAY),
             lambda requests: S.get_or_create(requests, t.suggestion, target, state, delay=DAY, buckets=KEY_BUCKETS), LAST)
    return S.said(t.spark, target, S.ASKED)


@query("stream_feedback_once", FEEDBACK_ONCE, "feedback_log")
def _(t):
    """Whole submissions, decided in order of time."""
    target, state = places(t, "answers")
    log = t.feedback_log.groupBy("batch_id", "suggestion_id", F.col("ts").cast("timestamp").alias("ts")).agg(
        F.sort_array(F.collect_list(F.struct("type", "response"))).alias("answers"))  # a submission has a handful of answers
    arriving(t, log, "submissions", shuffled_days(log, "batch_id", DAY),
             lambda rows: S.feedback_once(rows, target, state, delay=DAY, buckets=KEY_BUCKETS), LAST)
    return S.said(t.spark, target, S.SAID).withColumn("answers", F.col("answers").cast("long"))


@query("stream_finalize_once", f"""
SELECT e.event_id, e.uuid, e.entry, CASE WHEN s.uuid IS NULL THEN 'unknown suggestion'
  WHEN row_number() OVER (PARTITION BY e.uuid ORDER BY {sql_scattered("e.event_id")}, e.ts, e.event_id) = 1 THEN 'finalized' ELSE 'finalized twice' END AS outcome
FROM finalize_log e LEFT JOIN suggestion s ON s.uuid = e.uuid
""", "finalize_log suggestion")
def _(t):
    """In order of arrival; unknown suggestions and second finalizations keep their row."""
    target, state = places(t, "final")
    known = t.suggestion.select("uuid", F.lit(True).alias("known"))
    arriving(t, t.finalize_log, "finalizations", scattered("event_id"), lambda log: J.first_wins(
        log.join(known, "uuid", "left"), ["uuid"], ["ts", "event_id"], target, state, ok=F.col("known"), buckets=BUCKETS))
    name = F.when(F.col("outcome") == "accepted", "finalized").when(F.col("outcome") == "failed", "unknown suggestion").otherwise("finalized twice")
    return J.outcomes(t.spark, target).select("event_id", "uuid", "entry", name.alias("outcome"))


@query("stream_status_latest", LATEST, "status_log")
def _(t):
    target, state = places(t, "status")
    arriving(t, t.status_log, "changes", scattered("event_id"), lambda log: J.status_latest(log, target, state, buckets=BUCKETS))
    return J.current(t.spark, target, ["uuid"], J.STATUS).select("uuid", "status", iso_text(F.col("ts")).alias("ts"), "changes")


@query("stream_monthly_totals", """
SELECT a.model_id, strftime(date_trunc('month', s.ts), '%Y-%m') AS month, count(*) AS suggestion_count
FROM suggestion s JOIN assignment a ON a.story_hash = s.story_hash GROUP BY ALL
""", "suggestion assignment")
def _(t):
    """Months close as time goes on; open and closed ones add up to the whole."""
    target, state = places(t, "monthly")
    log = t.suggestion.select("id", "story_hash", F.col("ts").cast("timestamp").alias("ts"))
    arriving(t, log, "made", shuffled_days(log, "id", DAY),
             lambda made: J.monthly_totals(made, t.assignment, target, state, delay=DAY, buckets=BUCKETS))
    totals = J.months(t.spark, target).groupBy("model_id", "month").agg(F.sum("suggestion_count").alias("suggestion_count"))
    return totals.withColumn("month", F.date_format("month", "yyyy-MM"))


@query("stream_latest_export", """
SELECT concat('g', user_id) AS game_pid, strftime(max(date_trunc('second', ts)), '%Y-%m-%d %H:%M:%S') AS latest FROM events GROUP BY user_id
""")
def _(t):
    target, state = places(t, "exports")
    log = t.raw("events").select("event_id", F.concat(F.lit("g"), F.col("user_id").cast("string")).alias("game_pid"),
                                 F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("exported_at"))
    arriving(t, log, "export-log", scattered("event_id"), lambda exports: J.latest_export(exports, target, state, BUCKETS))
    return J.current(t.spark, target, ["game_pid"], J.EXPORTS).withColumn("latest", iso_text(F.col("latest")))


@query("stream_retention", DELETED, "story suggestion")
def _(t):
    """The cleanup, kept up to date over exports and uses in any order."""
    target, state = places(t, "retention")
    exports = t.story.select(F.lit("export").alias("kind"), "id", "hash", "game_pid", "exported_at")
    none = F.lit(None).cast("string")
    uses = t.suggestion.select(F.lit("use").alias("kind"), F.col("id"), F.col("story_hash").alias("hash"), none.alias("game_pid"), none.alias("exported_at"))
    log = exports.unionByName(uses)
    arriving(t, log, "retention-log", F.pmod(F.xxhash64("kind", "id"), F.lit(SLICES)), lambda events: J.retention(events, target, state, BUCKETS))
    return J.deletions(t.spark, target).select("id", "hash", "game_pid", "exported_at")
