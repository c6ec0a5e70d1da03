"""Streaming jobs over append-only logs.

Every job keeps its state as a table of one row per key (``KeyedTable``): a micro-batch
is reduced to one row per key, joined with the buckets its keys fall in, and these are
written anew. So a micro-batch reads and writes a bounded number of files, the tables
need no compaction, and a batch that runs again gives the same result.

No row is lost: each job that accepts or refuses writes an outcome for every row it
gets, in a folder for each batch. Where a delay bounds the state, a row older than
the watermark in force is refused as ``late``. The watermark in force is the greatest
event time of the batches before, less the delay; it is noted with each commit.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from draftlens.functions.values import parse_exported_at
from draftlens.operators.joins import null_safe
from draftlens.sources import files
from draftlens.streaming.keyed import BUCKETS, KeyedTable

DELAY = timedelta(days=2)


def read_log(spark: SparkSession, schema, path: str, files_per_batch: int | None = 1) -> DataFrame:
    """A Parquet table, one file or a folder of them, as a stream; ``None`` takes all files at hand as one batch.

    Signs that patterns use stand for themselves in the path. A single file is
    written as a pattern, since the source takes no plain file.
    """
    path = path.rstrip("/")
    pattern = files.literal(path)
    if files.is_file(spark, path):
        pattern = f"{files.literal(path[:-1])}[{files.literal(path[-1])}]"
    limit = {} if files_per_batch is None else {"maxFilesPerTrigger": files_per_batch}
    return spark.readStream.schema(schema).options(**limit).parquet(pattern)


def run(stream: DataFrame, write, state: str, trigger: dict | None = None) -> StreamingQuery:
    """Start a job whose batches are kept while ``write(batch, id)`` uses them."""

    def kept(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            write(batch, batch_id)
        finally:
            batch.unpersist()

    return (
        stream.writeStream.outputMode("append").foreachBatch(kept)
        .option("checkpointLocation", state).trigger(**(trigger or {"availableNow": True})).start()
    )


def outcomes(spark: SparkSession, target: str) -> DataFrame:
    """What became of every row."""
    return spark.read.parquet(files.literal(f"{target}/outcomes"))


def _log(rows: DataFrame, target: str, batch_id: int, kind: str = "outcomes") -> None:
    rows.write.mode("overwrite").parquet(f"{target}/{kind}/batch_id={batch_id}")


def fields(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


class Watermark:
    """The watermark in force for a batch, and the note that carries it on."""

    def __init__(self, table: KeyedTable, batch_id: int, delay: timedelta):
        self.seen = table.note(before=batch_id).get("seen")
        self.at = datetime.fromisoformat(self.seen) - delay if self.seen else None

    def late(self, time: str) -> Column:
        return F.lit(False) if self.at is None else F.coalesce(F.col(time) < F.lit(self.at.isoformat()).cast("timestamp"), F.lit(False))

    def note(self, batch: DataFrame, time: str) -> dict:
        latest = batch.agg(F.date_format(F.max(time), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).first()[0]
        return {"seen": max(filter(None, (self.seen, latest)), default=None)}


# --- first of a key wins ----------------------------------------------------


def first_wins(events: DataFrame, keys: list[str], order: list[str], target: str, state: str, ok: Column | None = None,
               buckets: int = BUCKETS, trigger: dict | None = None) -> StreamingQuery:
    """One accepted row per key, in order of arrival.

    Serves content dedup, create-once and finalize-once. Across micro-batches the
    earlier one wins; within one, the lowest order. A row that does not meet
    ``ok`` is ``failed`` and leaves its key open, so a later one is tried again.
    Outcomes: every row with ``outcome`` accepted, failed or repeat. State: one row
    per key, with what was accepted and how many rows came. Null keys are keys.
    """
    spark = events.sparkSession
    kept = ", ".join(f"`first_{n}` {events.schema[n].dataType.simpleString()}" for n in order)
    table = KeyedTable(spark, f"{target}/keys", keys, f"{fields(events, keys)}, {kept}, accepted boolean, n long", buckets)
    fits = F.lit(True) if ok is None else F.coalesce(ok, F.lit(False))

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("_ok", fits)
        touched = table.touched(rows)
        old = table.read(batch_id, touched)
        open_ = old.where("accepted").select(*keys, F.lit(True).alias("_closed"))
        first = F.min(F.when(F.col("_ok"), F.struct(*order)))
        new = rows.groupBy(*keys).agg(first.alias("_first"), F.count(F.lit(1)).alias("_n"))
        new = null_safe(new, open_, keys).withColumn("_wins", F.col("_closed").isNull() & F.col("_first").isNotNull())
        # Every row learns whether it is its key's winner; a hot key's rows stay spread.
        wins = new.where("_wins").select(*keys, *[F.col(f"_first.{c}").alias(c) for c in order], F.lit(True).alias("_won"))
        said = null_safe(rows, wins, keys + order).select(
            *batch.columns,
            F.when(F.coalesce("_won", F.lit(False)) & F.col("_ok"), "accepted").when(~F.col("_ok"), "failed").otherwise("repeat").alias("outcome"))
        _log(said, target, batch_id)
        part = new.select(*keys, *[F.when(F.col("_wins"), F.col(f"_first.{c}")).alias(f"first_{c}") for c in order],
                          F.col("_wins").alias("accepted"), F.col("_n").alias("n"))
        value = [F.max(f"first_{c}").alias(f"first_{c}") for c in order]
        both = old.unionByName(part).groupBy(*keys).agg(*value, F.bool_or("accepted").alias("accepted"), F.sum("n").alias("n"))
        table.write(batch_id, both, touched)

    return run(events, write, state, trigger)


def drop_repeats(events: DataFrame, keys: list[str], time: str, target: str, state: str, delay: timedelta = DELAY,
                 buckets: int = BUCKETS, trigger: dict | None = None) -> StreamingQuery:
    """Each key once, for logs whose repeats come within the delay of its first row.

    The state holds keys that are not older than the watermark. Outcomes: every row
    with ``outcome`` accepted, repeat or late. Rows without a time are never late.
    Buckets without new rows are cleared one by one, one in each batch.
    """
    spark = events.sparkSession
    table = KeyedTable(spark, f"{target}/keys", keys, f"{fields(events, keys)}, last timestamp", buckets)
    events = events.withColumn(time, F.col(time).cast("timestamp"))

    def write(batch: DataFrame, batch_id: int) -> None:
        mark = Watermark(table, batch_id, delay)
        rows = batch.withColumn("_late", mark.late(time)).withColumn("_row", F.monotonically_increasing_id()).persist()
        timely = rows.where("not _late")
        touched = table.touched(timely)
        swept = sorted({*touched, batch_id % buckets})
        old = table.read(batch_id, swept)
        new = timely.groupBy(*keys).agg(F.min(F.struct(time, "_row")).alias("_first"), F.max(time).alias("_last"))
        new = null_safe(new, old.select(*keys, F.lit(True).alias("_known")), keys)
        wins = new.where("_known IS NULL").select(F.col("_first._row").alias("_row"), F.lit("accepted").alias("_won"))
        said = rows.join(wins, "_row", "left").select(*batch.columns, F.when(F.col("_late"), "late").otherwise(F.coalesce("_won", F.lit("repeat"))).alias("outcome"))
        _log(said, target, batch_id)
        part = new.select(*keys, F.col("_last").alias("last"))
        both = old.unionByName(part).groupBy(*keys).agg(F.max("last").alias("last"))
        note = mark.note(batch, time)
        if mark.at is not None:  # keys that no timely row can repeat any more
            both = both.where(F.col("last").isNull() | (F.col("last") >= F.lit((mark.at - delay).isoformat()).cast("timestamp")))
        table.write(batch_id, both, swept, note)
        rows.unpersist()

    return run(events, write, state, trigger)


# --- running reports ----------------------------------------------------------


def running(events: DataFrame, keys: list[str], partial: list[Column], merge: list[Column], schema: str, target: str, state: str,
            buckets: int = BUCKETS, trigger: dict | None = None) -> StreamingQuery:
    """A report by key that every batch brings up to date: one row per key is kept.

    ``partial`` reduces a batch, ``merge`` what it gives and the stored rows.
    """
    table = KeyedTable(events.sparkSession, target, keys, schema, buckets)

    def write(batch: DataFrame, batch_id: int) -> None:
        new = batch.groupBy(*keys).agg(*partial)
        touched = table.touched(new)
        both = table.read(batch_id, touched).unionByName(new).groupBy(*keys).agg(*merge)
        table.write(batch_id, both, touched)

    return run(events, write, state, trigger)


def current(spark: SparkSession, target: str, keys: list[str], schema: str) -> DataFrame:
    """The rows of a running report."""
    return KeyedTable(spark, target, keys, schema).read()


STATUS = "uuid string, status string, ts timestamp, event_id long, changes long"


def status_latest(events: DataFrame, target: str, state: str, states=("pending", "executing", "done", "failed"),
                  buckets: int = BUCKETS, trigger: dict | None = None) -> StreamingQuery:
    """Running last state of each suggestion; other states are ignored."""
    last = lambda n: [F.max(F.struct("ts", "event_id", "status")).alias("_last"), n]
    known = events.where(F.col("status").isin(*states)).select("uuid", F.col("ts").cast("timestamp").alias("ts"), "event_id", "status")
    table = KeyedTable(events.sparkSession, target, ["uuid"], STATUS, buckets)
    flat = lambda df: df.select("uuid", "_last.status", "_last.ts", "_last.event_id", "changes")

    def write(batch: DataFrame, batch_id: int) -> None:
        new = flat(batch.groupBy("uuid").agg(*last(F.count(F.lit(1)).alias("changes"))))
        touched = table.touched(new)
        both = table.read(batch_id, touched).unionByName(new).groupBy("uuid").agg(*last(F.sum("changes").alias("changes")))
        table.write(batch_id, flat(both), touched)

    return run(known, write, state, trigger)


EXPORTS = "game_pid string, latest timestamp"


def latest_export(events: DataFrame, target: str, state: str, buckets: int = BUCKETS, trigger: dict | None = None) -> StreamingQuery:
    """Running newest export of each game."""
    return running(events, ["game_pid"], [F.max(parse_exported_at(F.col("exported_at"))).alias("latest")], [F.max("latest").alias("latest")],
                   EXPORTS, target, state, buckets, trigger)


UPLOADS = "hash string, first_upload long, accepted_upload long, uploads long"


def story_dedup(uploads: DataFrame, target: str, state: str, buckets: int = BUCKETS, trigger: dict | None = None) -> StreamingQuery:
    """One story per content hash over uploads (upload_id, hash, failed).

    The first upload that did not fail makes the story ready; a failed one is tried
    again by the next. First and count are kept, too, so the result is that of the
    whole log, in whatever order its files come.
    """
    partial = [F.min("upload_id").alias("first_upload"), F.min(F.when(~F.col("failed"), F.col("upload_id"))).alias("accepted_upload"), F.count(F.lit(1)).alias("uploads")]
    merge = [F.min("first_upload").alias("first_upload"), F.min("accepted_upload").alias("accepted_upload"), F.sum("uploads").alias("uploads")]
    return running(uploads, ["hash"], partial, merge, UPLOADS, target, state, buckets, trigger)


MONTHS = "model_id int, month timestamp, suggestion_count long"


def monthly_totals(made: DataFrame, assignment: DataFrame, target: str, state: str, delay: timedelta = DELAY,
                   buckets: int = BUCKETS, trigger: dict | None = None) -> StreamingQuery:
    """Suggestions (story_hash, ts) of each model by month, with the stored assignments.

    The state holds months that the watermark has not passed. A month that ended before
    it is closed: its rows go to the ``closed`` folder, for good, and suggestions of
    it that come later are written to ``late``. All buckets are cleared in the batch in
    which the watermark enters another month. Each suggestion counts for every model
    assigned; those whose story nobody serves count for none.
    """
    spark = made.sparkSession
    table = KeyedTable(spark, f"{target}/open", ["model_id", "month"], MONTHS, buckets)
    served = assignment.select(F.col("model_id").cast("int").alias("model_id"), "story_hash")

    def write(batch: DataFrame, batch_id: int) -> None:
        mark = Watermark(table, batch_id, delay)
        month = F.date_trunc("month", "ts")
        ended = lambda m: F.lit(False) if mark.at is None else F.coalesce(F.add_months(m, 1) <= F.lit(mark.at.isoformat()).cast("timestamp"), F.lit(False))
        rows = batch.withColumn("month", month)
        _log(rows.where(ended(F.col("month"))).select(*batch.columns), target, batch_id, "late")
        new = rows.where(~ended(F.col("month"))).join(served, "story_hash").groupBy("model_id", "month").agg(F.count(F.lit(1)).alias("suggestion_count"))
        new = new.persist()
        entered = mark.at.strftime("%Y-%m") if mark.at else None
        swept = table.touched(new) if entered == table.note(batch_id).get("month") else list(range(buckets))
        both = table.read(batch_id, swept).unionByName(new).groupBy("model_id", "month").agg(F.sum("suggestion_count").alias("suggestion_count"))
        _log(both.where(ended(F.col("month"))), target, batch_id, "closed")
        table.write(batch_id, both.where(~ended(F.col("month"))), swept, mark.note(batch, "ts") | {"month": entered})
        new.unpersist()

    return run(made.withColumn("ts", F.col("ts").cast("timestamp")), write, state, trigger)


def months(spark: SparkSession, target: str, buckets: int = BUCKETS) -> DataFrame:
    """Counts of open and of closed months."""
    rows = KeyedTable(spark, f"{target}/open", ["model_id", "month"], MONTHS, buckets).read()
    if not files.children(spark, f"{target}/closed"):
        return rows
    return rows.unionByName(spark.read.schema(MONTHS).parquet(files.literal(f"{target}/closed")).select(*rows.columns))


# --- retention -----------------------------------------------------------------

EXPORT = "id long, hash string, game_pid string, exported_at string, at timestamp"


def retention(events: DataFrame, target: str, state: str, buckets: int = BUCKETS, trigger: dict | None = None) -> StreamingQuery:
    """Superseded, unused exports, kept up to date by a log of exports and uses.

    Rows: kind (export or use), id, hash, game_pid, exported_at; a use names the hash.
    State: the newest exports of each game (ties are few), the hashes in use, and
    what is to be deleted. A newer export of a game supersedes the ones before; an
    older one that comes late is superseded at once. A use takes its export off the
    list, before or after. So the list equals that of the whole log, whatever the
    order. Stories without a game or a time are never superseded.
    """
    spark = events.sparkSession
    front = KeyedTable(spark, f"{target}/newest", ["game_pid"], EXPORT, buckets)
    used = KeyedTable(spark, f"{target}/used", ["hash"], "hash string", buckets)
    gone = KeyedTable(spark, f"{target}/deleted", ["hash"], EXPORT, buckets)
    names = front.schema.fieldNames()

    def write(batch: DataFrame, batch_id: int) -> None:
        new = batch.where("kind = 'export'").withColumn("at", parse_exported_at(F.col("exported_at"))).select(*names)
        new = new.where("game_pid IS NOT NULL AND at IS NOT NULL")
        uses = batch.where("kind = 'use' AND hash IS NOT NULL").select("hash").distinct()
        games = front.touched(new)
        both = front.read(batch_id, games).unionByName(new).persist()
        latest = both.groupBy("game_pid").agg(F.max("at").alias("latest"))
        rated = both.join(latest, "game_pid")
        superseded = rated.where("at < latest").select(*names).persist()
        took = used.touched(uses)
        asked = sorted({*took, *used.touched(superseded)})
        in_use = used.read(batch_id, asked).unionByName(uses).distinct().persist()
        dropped = superseded.join(in_use, "hash", "left_anti").select(*names)
        lists = sorted({*gone.touched(superseded), *took})  # both tables are dealt by hash
        _log(dropped, target, batch_id, "superseded")
        left = gone.read(batch_id, lists).join(in_use, "hash", "left_anti").select(*names)
        gone.write(batch_id, left.unionByName(dropped), lists)
        mine = F.array(*[F.lit(b) for b in took]).cast("array<int>")
        used.write(batch_id, in_use.where(F.array_contains(mine, used.bucket())), took)
        front.write(batch_id, rated.where("at = latest").select(*names), games)
        for df in (both, superseded, in_use):
            df.unpersist()

    return run(events, write, state, trigger)


def deletions(spark: SparkSession, target: str, buckets: int = BUCKETS) -> DataFrame:
    """Exports to delete, as of the last batch."""
    return KeyedTable(spark, f"{target}/deleted", ["hash"], EXPORT, buckets).read()
