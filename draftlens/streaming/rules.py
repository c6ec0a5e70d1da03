"""Rules that need every event of a key in order of time.

A row is decided once the watermark has passed its time, so files may come out of
order by as much as the delay; the outcomes are those of the batch rules over the
whole log. Rows that come later still are refused as ``late``.

Each micro-batch is a few joins over all its keys. Two keyed tables lie in the query's
checkpoint folder: what is taken, of which a batch reads and writes the buckets that
its keys fall in, and the rows that wait, which the delay bounds.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from draftlens.operators.joins import null_safe
from draftlens.operators.lifecycle import CHOICES, SUGGESTION_KEY
from draftlens.operators.reports import FEEDBACK_TYPES
from draftlens.sources import files
from draftlens.streaming.jobs import DELAY, Watermark, fields, run
from draftlens.streaming.keyed import BUCKETS, KeyedTable

MICROSECOND = timedelta(microseconds=1)


def said(spark: SparkSession, target: str, schema: str) -> DataFrame:
    """All outcomes that a job has written."""
    rows = spark.read.schema(schema).parquet(files.literal(target))
    return rows.select(*rows.columns[:-1])  # the last one is the micro-batch


def closing_row(spark: SparkSession, schema, at: str) -> DataFrame:
    """A row without keys that moves the watermark: what a log's last file may end with."""
    time = {"ts": F.lit(at).cast("timestamp")}
    return spark.range(1).select(*[time.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


ITEM = ["at", "id", "mask", "answers"]


def _fold(keep: int | None) -> Column:
    """Due items of a key, oldest first: an item is accepted if nothing of its mask is taken.

    Taken bits are forgotten ``keep`` microseconds after the last item was accepted, if that is given.
    """
    start = F.struct(F.col("taken"), F.col("until"), F.array().cast("array<struct<at:bigint,id:bigint,mask:int,answers:int>>").alias("won"))

    def step(acc, item):
        taken = acc["taken"] if keep is None else F.when(item["at"] >= acc["until"], 0).otherwise(acc["taken"])
        until = acc["until"] if keep is None else F.greatest(acc["until"], item["at"] + F.lit(keep))
        return F.when(taken.bitwiseAND(item["mask"]) == 0, F.struct(
            taken.bitwiseOR(item["mask"]).alias("taken"), until.alias("until"), F.concat(acc["won"], F.array(item)).alias("won"))).otherwise(
            F.struct(taken.alias("taken"), acc["until"].alias("until"), acc["won"].alias("won")))

    return F.aggregate(F.array_sort("items"), start, step)


def _in_order(events: DataFrame, keys: list[str], outcome: Callable[[DataFrame], DataFrame], target: str, state: str, delay: timedelta,
              keep: timedelta | None = None, stored: DataFrame | None = None, buckets: int = BUCKETS, trigger: dict | None = None) -> StreamingQuery:
    """Accept items (keys, ts, id, mask, answers) by key in order of time, as long as their bits are free.

    Rows with ``refused`` keep that outcome, those without an id only move the watermark.
    ``stored`` is what is taken before the first batch: keys, taken and failed.
    ``outcome`` gets one row for each item that is decided, with ``said``: accepted, again, late or
    what ``refused`` holds, and ``failed`` of its key.

    An item that waits with the mask of an older one can never be accepted: either
    that one takes its bits, or they are taken already. So one waits for each key and mask.
    Only where bits are forgotten does that not hold, and all items of the delay wait.
    """
    spark = events.sparkSession
    named = fields(events, keys)
    taken = KeyedTable(spark, f"{state}/taken", keys, f"{named}, taken int, until long, failed boolean", buckets)
    waiting = KeyedTable(spark, f"{state}/waiting", keys, f"{named}, at long, id long, mask int, answers int", buckets)
    begin = None if stored is None else stored.withColumn("until", F.lit(0).cast("long")).select(*taken.schema.fieldNames())
    kept = None if keep is None else keep // MICROSECOND

    def write(batch: DataFrame, batch_id: int) -> None:
        mark = Watermark(taken, batch_id, delay)
        passed = None if mark.at is None else (mark.at - datetime(1970, 1, 1)) // MICROSECOND
        is_past = F.lit(False) if passed is None else F.col("at") <= F.lit(passed)
        open_ = batch.where("refused IS NULL")
        rows = open_.where("id IS NOT NULL").withColumn("at", F.unix_micros("ts")).select(*keys, *ITEM)
        items = rows.where(~is_past).withColumn("n", F.lit(1).cast("long")).unionByName(waiting.read(batch_id).withColumn("n", F.lit(1).cast("long")))
        items = items.groupBy(*keys, *ITEM).agg(F.sum("n").alias("n")).persist()
        if begin is not None and not [n for n in taken.commits() if n < batch_id]:
            touched, old = list(range(buckets)), begin
        else:
            touched = sorted({*taken.touched(items), *([] if keep is None else [batch_id % buckets])})
            old = taken.read(batch_id, touched)
        held = null_safe(items, old, keys).withColumns({"taken": F.coalesce("taken", F.lit(0)), "until": F.coalesce("until", F.lit(0).cast("long"))})
        if keep is None:
            first = items.groupBy(*keys, "mask").agg(F.min(F.struct("at", "id", "answers")).alias("f")).select(*keys, "f.at", "f.id", "mask", "f.answers", F.lit(True).alias("can"))
            held = null_safe(held, first, [*keys, *ITEM]).withColumn("can", F.col("can").isNotNull() & (F.col("taken").bitwiseAND(F.col("mask")) == 0))
        else:
            held = held.withColumn("can", F.lit(True))
        held = held.withColumn("due", F.col("can") & is_past).persist()
        due = held.where("due").groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("taken", "until", "failed")], F.collect_list(F.struct(*ITEM)).alias("items"))
        due = due.select(*keys, "failed", _fold(kept).alias("now")).persist()
        won = due.select(*keys, F.inline("now.won")).withColumn("won", F.lit(True))
        again = lambda n: F.array_repeat(F.lit("again"), F.col("n").cast("int") - n)
        each = F.when(F.col("won"), F.concat(F.array(F.lit("accepted")), again(1))).when(F.col("can") & ~F.col("due"), again(1)).otherwise(again(0))
        decided = null_safe(held, won, [*keys, *ITEM]).select(*keys, "id", "answers", F.coalesce("failed", F.lit(False)).alias("failed"), F.explode(each).alias("said"))
        other = lambda df, name: df.select(*keys, "id", "answers", F.lit(False).alias("failed"), name.alias("said"))
        decided = decided.unionByName(other(rows.where(is_past), F.lit("late"))).unionByName(other(batch.where("refused IS NOT NULL AND id IS NOT NULL"), F.col("refused")))
        outcome(decided).write.mode("overwrite").parquet(f"{target}/micro={batch_id}")
        waiting.write(batch_id, held.where("can AND NOT due").select(*keys, *ITEM), list(range(buckets)))
        new = due.select(*keys, "now.taken", "now.until", "failed", F.lit(1).alias("_new"))
        both = old.withColumn("_new", F.lit(0)).unionByName(new).groupBy(*keys).agg(F.max(F.struct("_new", "taken", "until", "failed")).alias("s"))
        both = both.select(*keys, "s.taken", "s.until", "s.failed")
        if keep is not None and passed is not None:
            both = both.where(F.col("until") > F.lit(passed))
        taken.write(batch_id, both, touched, mark.note(open_, "ts"))
        for df in (items, held, due):
            df.unpersist()

    return run(events, write, state, trigger)


# --- one answer per suggestion and type --------------------------------------

SUBMISSIONS = "batch_id long, suggestion_id string, ts timestamp, answers array<struct<type:string,response:string>>"
SAID = "batch_id long, suggestion_id string, answers int, reject_reason string"


def feedback_once(submissions: DataFrame, target: str, state: str, required=(), choices=CHOICES, delay: timedelta = DELAY,
                  keep: timedelta | None = None, buckets: int = BUCKETS, trigger: dict | None = None) -> StreamingQuery:
    """One answer per (suggestion, type); a submission stands or falls as a whole.

    Input: one row per submission (batch_id, suggestion_id, ts, answers). Output: every
    submission with its reject reason (null: accepted), that of the batch rule,
    ``late`` or ``no time``. Taken types are forgotten ``keep`` after the last one was accepted,
    never by default. A row without a batch id is a heartbeat and gives no output.
    """
    typed = F.col("answers")
    bit = lambda t: sum((F.when(t == name, 1 << i).otherwise(0) for i, name in enumerate(FEEDBACK_TYPES)), F.lit(0))
    mask = F.aggregate(typed, F.lit(0), lambda m, a: m.bitwiseOR(bit(a["type"])))
    bad = F.exists(typed, lambda a: F.coalesce(sum((((a["type"] == t) & ~a["response"].isin(*choices[t])).cast("int") for t in choices), F.lit(0)) > 0, F.lit(False)))
    missing = F.array_join(F.array_except(F.array(*map(F.lit, required)).cast("array<string>"), F.transform(typed, lambda a: a["type"])), ",")
    named = F.size(F.filter(typed, lambda a: a["type"].isNotNull()))
    none = F.lit(1 << len(FEEDBACK_TYPES))  # a submission without any type is one of a kind, too
    reason = (F.when(F.col("ts").isNull(), "no time").when(missing != "", F.concat(F.lit("missing "), missing)).when(bad, "invalid response")
              .when(named > F.bit_count(mask), "more than once"))
    rows = submissions.select("suggestion_id", "ts", F.col("batch_id").alias("id"), F.when(mask == 0, none).otherwise(mask).alias("mask"),
                              F.size(typed).alias("answers"), F.when(F.col("batch_id").isNotNull(), reason).alias("refused"))
    name = F.when(F.col("said") == "again", "more than once").when(F.col("said") != "accepted", F.col("said")).alias("reject_reason")
    outcome = lambda decided: decided.select(F.col("id").alias("batch_id"), "suggestion_id", "answers", name)
    return _in_order(rows, ["suggestion_id"], outcome, target, state, delay, keep, buckets=buckets, trigger=trigger)


# --- one suggestion per story, context and type ------------------------------

ASKED = "request_id long, outcome string"


def get_or_create(requests: DataFrame, suggestion: DataFrame, target: str, state: str, delay: timedelta = DELAY,
                  buckets: int = BUCKETS, trigger: dict | None = None) -> StreamingQuery:
    """One outcome for every request (request_id, ts, key, description), from the stored table on.

    The first request of a (story, context, type) is ``created``, or ``retried`` where
    the stored suggestion failed; all others find it ``existing``; a context that
    already has text is ``rejected``; a request older than the watermark is ``late``,
    one without a time has ``no time``.
    Null key columns are equal to each other. A row without an id is a heartbeat.
    """
    blank = F.coalesce(F.length("description"), F.lit(0)) == 0
    reason = F.when(~blank, "rejected").when(F.col("ts").isNull(), "no time")
    rows = requests.select(*SUGGESTION_KEY, "ts", F.col("request_id").alias("id"), F.lit(1).alias("mask"), F.lit(0).alias("answers"),
                           F.when(F.col("request_id").isNotNull(), reason).alias("refused"))
    failed = F.col("status").eqNullSafe("failed")
    stored = suggestion.groupBy(*SUGGESTION_KEY).agg(F.max(F.when(failed, 0).otherwise(1)).alias("taken"), F.bool_and(failed).alias("failed"))
    first = F.when(F.col("failed"), "retried").otherwise("created")
    name = F.when(F.col("said") == "accepted", first).when(F.col("said") == "again", "existing").otherwise(F.col("said")).alias("outcome")
    outcome = lambda decided: decided.select(F.col("id").alias("request_id"), name)
    return _in_order(rows, SUGGESTION_KEY, outcome, target, state, delay, stored=stored, buckets=buckets, trigger=trigger)
