"""Streams over several files, out of order of time, against the batch rules and plain Python."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from draftlens.operators import lifecycle as L
from draftlens.operators import retention as K
from draftlens.sources import files
from draftlens.streaming import jobs as J
from draftlens.streaming import rules as S
from draftlens.streaming.keyed import KeyedTable

START = datetime(2024, 1, 1)


def log(spark, folder, parts, schema):
    """One file for each part, in order."""
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return J.read_log(spark, spark.createDataFrame([], schema).schema, folder)


def at(hours):
    return START + timedelta(hours=hours)


def test_paths_are_taken_literally(spark, tmp_path):
    for name in ("fol[1]", "a{b,c}", "x*y?"):
        folder = str(tmp_path / name / "t.parquet")
        stream = log(spark, folder, [[(i,) for i in range(10)]], "id long")
        J.running(stream, ["id"], [F.count("*").alias("n")], [F.sum("n").alias("n")], "id long, n long", f"{folder}-t", f"{folder}-s").awaitTermination()
        assert J.current(spark, f"{folder}-t", ["id"], "id long, n long").count() == 10


def test_keyed_table(spark, tmp_path):
    """Untouched buckets stay, a repeat overwrites, a run that broke off is not seen, old versions go."""
    table = KeyedTable(spark, str(tmp_path / "t[1]"), ["k"], "k long, v long", buckets=4)
    put = lambda n, rows: table.write(n, spark.createDataFrame(rows, table.schema), table.touched(spark.createDataFrame(rows, table.schema)), {"n": n})
    every = [(i, 0) for i in range(40)]
    put(0, every)
    one = [(i, 1) for i in range(40) if table.touched(spark.createDataFrame([(i, 1)], table.schema)) == [2]]
    put(1, one)
    want = {**dict(every), **dict(one)}
    assert {r.k: r.v for r in table.read().collect()} == want and table.note() == {"n": 1}
    assert {r.k: r.v for r in table.read(before=1).collect()} == dict(every)  # what batch 1 starts from when it runs again
    put(1, one)
    assert {r.k: r.v for r in table.read().collect()} == want
    spark.createDataFrame([(99, 9)], table.schema).write.parquet(files.literal(f"{table.path}/data/bucket=2/batch_id=2"))  # no commit
    assert {r.k: r.v for r in table.read().collect()} == want
    for n in range(2, 6):
        put(n, [(k, n) for k, _ in one])
    versions = [v for v in files.children(spark, f"{table.path}/data/bucket=2") if v.startswith("batch_id=")]
    assert len(versions) == 2 and {r.k: r.v for r in table.read().collect()} == {**want, **{k: 5 for k, _ in one}}
    table.write(6, spark.createDataFrame([], table.schema), [2])
    assert {r.k for r in table.read().collect()} == {k for k, _ in every} - {k for k, _ in one}


def test_files_read_do_not_grow_with_history(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], "k long, v long", buckets=8)
    rows = spark.createDataFrame([(i, i) for i in range(100)], table.schema)
    for n in range(6):
        table.write(n, rows, list(range(8)))
    few = table.touched(spark.createDataFrame([(1, 1)], table.schema))
    assert len(few) == 1 and len(table.read(buckets=few).inputFiles()) == 1
    assert len(table.read().inputFiles()) == 8
    assert len(table.commits()) <= 3


def test_first_wins(spark, tmp_path):
    """In order of arrival; every row has an outcome; failed rows leave their key open."""
    rnd = random.Random(1)
    rows = [(i, rnd.choice(["a", "b", "c", None, "d", "e"]), rnd.random() < 0.3) for i in range(90)]
    rnd.shuffle(rows)
    parts = [rows[:30], rows[30:31], rows[31:]]
    stream = log(spark, str(tmp_path / "log"), parts, "id long, k string, bad boolean")
    target, state = str(tmp_path / "t"), str(tmp_path / "s")
    J.first_wins(stream, ["k"], ["id"], target, state, ok=~F.col("bad"), buckets=4).awaitTermination()
    want, taken = {}, set()
    for part in parts:
        for i, k, bad in sorted(part):
            want[i] = "failed" if bad else "repeat" if k in taken else "accepted"
            taken |= set() if bad else {k}
    assert {r.id: r.outcome for r in J.outcomes(spark, target).collect()} == want and len(want) == len(rows)
    # Nothing new: a second run adds nothing.
    J.first_wins(stream, ["k"], ["id"], target, state, ok=~F.col("bad"), buckets=4).awaitTermination()
    assert J.outcomes(spark, target).count() == len(rows)


def test_late_rows_are_refused_not_lost(spark, tmp_path):
    """Late first arrivals too: accepted, repeated and late rows add up to the input."""
    rnd = random.Random(2)
    delay = timedelta(hours=10)
    rows = [(i, at(rnd.uniform(0, 100)) if rnd.random() < 0.95 else None, rnd.choice("abcdefgh")) for i in range(120)] + [(500, at(1), "late"), (501, at(1), "late")]
    parts = [rows[:40], rows[40:80], rows[80:]]
    stream = log(spark, str(tmp_path / "log"), parts, "id long, ts timestamp, k string")
    J.drop_repeats(stream, ["k"], "ts", str(tmp_path / "t"), str(tmp_path / "s"), delay=delay, buckets=4).awaitTermination()
    got = J.outcomes(spark, str(tmp_path / "t"))
    mark, late, known = None, set(), {}
    accepted = 0
    for part in parts:
        timely = [r for r in part if mark is None or r[1] is None or r[1] >= mark - delay]
        late |= {r[0] for r in part} - {r[0] for r in timely}
        accepted += len({r[2] for r in timely} - set(known))
        known |= {r[2]: 1 for r in timely}
        mark = max([r[1] for r in part if r[1]] + [mark or START])
    assert {r.id for r in got.where("outcome = 'late'").collect()} == late and {500, 501} <= late
    assert got.count() == len(rows) == got.select("id").distinct().count()
    # Keys forgotten after the delay may be accepted once more, never less often.
    assert got.where("outcome = 'accepted'").count() >= accepted


def test_running_reports(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i, f"u{rnd.randrange(9)}", at(rnd.randrange(500)), rnd.choice(["pending", "done", "failed", "odd"])) for i in range(200)]
    parts = [rows[i::3] for i in range(3)]
    schema = "event_id long, uuid string, ts timestamp, status string"
    stream = log(spark, str(tmp_path / "log"), parts, schema)
    J.status_latest(stream, str(tmp_path / "a"), str(tmp_path / "b"), buckets=4).awaitTermination()
    got = J.current(spark, str(tmp_path / "a"), ["uuid"], J.STATUS)
    want = L.status_latest(spark.createDataFrame(rows, schema))
    assert got.count() == want.count()  # one row a key, whatever the number of updates
    assert sorted(map(tuple, got.select("uuid", "status", "changes").collect())) == sorted(map(tuple, want.select("uuid", "status", "changes").collect()))
    uploads = [(i, f"h{rnd.randrange(20)}", rnd.random() < 0.4) for i in range(100)]
    schema = "upload_id long, hash string, failed boolean"
    stream = log(spark, str(tmp_path / "up"), [uploads[1::2], uploads[::2]], schema)
    J.story_dedup(stream, str(tmp_path / "c"), str(tmp_path / "d"), 4).awaitTermination()
    got = J.current(spark, str(tmp_path / "c"), ["hash"], J.UPLOADS)
    want = K.story_dedup(spark.createDataFrame(uploads, schema)).drop("status")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_monthly_totals_close(spark, tmp_path):
    """State holds open months only; rows of closed months are refused as late."""
    day = lambda m, d: datetime(2024, m, d)
    parts = [[(1, "a", day(1, 5)), (2, "b", day(1, 30)), (3, "x", day(1, 3))], [(4, "a", day(2, 1)), (5, "a", day(1, 31))], [(6, "b", day(2, 20))],
             [(7, "a", day(1, 31)), (8, "a", day(2, 2)), (9, "b", day(3, 20))], [(10, "b", day(3, 21))]]
    made = log(spark, str(tmp_path / "log"), parts, "id long, story_hash string, ts timestamp")
    assignment = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b")], "model_id int, story_hash string")
    target = str(tmp_path / "t")
    J.monthly_totals(made, assignment, target, str(tmp_path / "s"), delay=timedelta(days=3), buckets=4).awaitTermination()
    got = {(r.model_id, r.month.month): r.suggestion_count for r in J.months(spark, target, 4).collect()}
    assert got == {(1, 1): 2, (2, 1): 3, (1, 2): 2, (2, 2): 3, (2, 3): 2}
    left = KeyedTable(spark, f"{target}/open", ["model_id", "month"], J.MONTHS, 4).read()
    assert {r.month.month for r in left.collect()} == {3}
    assert [r.id for r in spark.read.parquet(f"{target}/late").collect()] == [7]


def test_retention(spark, tmp_path):
    """Exports and uses in any order; the list equals that of the whole log after every batch."""
    rnd = random.Random(5)
    exports = [(i, f"h{i}", rnd.choice(["g", "g", "k", None, "m"]), rnd.choice([f"2024-01-{rnd.randint(1, 28):02}T00:00:00", "2024-01-28T00:00:00", None])) for i in range(60)]
    used = rnd.sample(range(60), 15)
    rows = [("export", *e) for e in exports] + [("use", 1000 + u, f"h{u}", None, None) for u in used] + [("use", 9, "unknown", None, None)]
    rnd.shuffle(rows)
    schema = "kind string, id long, hash string, game_pid string, exported_at string"
    folder, target, state = (str(tmp_path / n) for n in "lts")
    for k in range(0, len(rows), 20):
        stream = log(spark, folder, [rows[k:k + 20]], schema)
        J.retention(stream, target, state, 4).awaitTermination()
        so_far = rows[:k + 20]
        story = spark.createDataFrame([r[1:] for r in so_far if r[0] == "export"], "id long, hash string, game_pid string, exported_at string")
        uses = spark.createDataFrame([(r[2],) for r in so_far if r[0] == "use"], "story_hash string")
        want = {r.id for r in K.stories_to_delete(story, uses).collect()}
        assert {r.id for r in J.deletions(spark, target, 4).collect()} == want
    assert len(want) > 10


def test_feedback_once(spark, tmp_path):
    """Whole submissions, decided in order of time though files are not; late ones keep a reason."""
    rnd = random.Random(7)
    kinds = ["fluency", "relevance", "coherence", "likeability", "comments"]
    rows = []
    for i in range(150):
        types = rnd.sample(kinds, rnd.randint(0, 3)) or rnd.choice([[], ["fluency", "fluency"], ["odd"]])
        rows.append((i, rnd.choice(["s", "t", "u", None]), at(rnd.randrange(96)), [(t, rnd.choice("1234569")) for t in types]))
    delay = timedelta(hours=30)
    order = sorted(rows, key=lambda r: (r[2] + timedelta(hours=rnd.uniform(0, 28)), r[0]))
    late = (999, "s", at(1), [("fluency", "1")])
    parts = [order[:50], order[50:100], [*order[100:], late]]
    folder, target = str(tmp_path / "log"), str(tmp_path / "t")
    stream = log(spark, folder, parts, S.SUBMISSIONS)
    for _ in range(2):
        S.closing_row(spark, stream.schema, "2999-01-01").write.mode("append").parquet(folder)
    S.feedback_once(stream, target, str(tmp_path / "s"), delay=delay).awaitTermination()
    got = {r.batch_id: r.reject_reason for r in spark.read.schema(S.SAID).parquet(target).collect()}
    flat = [(i * 10 + k, i, ts, s, t, x) for i, s, ts, answers in rows for k, (t, x) in enumerate(answers)]
    batch = L.feedback_once(spark.createDataFrame(flat, "row_id long, batch_id long, ts timestamp, suggestion_id string, type string, response string"))
    want = {r.batch_id: r.reject_reason for r in batch.collect()}
    assert got.pop(999) == "late"
    assert {k: v for k, v in got.items() if k in want} == want and Counter(want.values())[None] >= 6
    assert len(got) == len(rows)


def test_feedback_state_is_forgotten(spark, tmp_path):
    """With a time to keep, a suggestion may be rated anew after it."""
    one = lambda i, h: (i, "s", at(h), [("fluency", "1")])
    folder = str(tmp_path / "log")
    stream = log(spark, folder, [[one(1, 0)], [one(2, 50)], [one(3, 51)], [one(4, 300)]], S.SUBMISSIONS)
    for _ in range(2):
        S.closing_row(spark, stream.schema, "2999-01-01").write.mode("append").parquet(folder)
    S.feedback_once(stream, str(tmp_path / "t"), str(tmp_path / "s"), delay=timedelta(hours=1), keep=timedelta(hours=100)).awaitTermination()
    got = {r.batch_id: r.reject_reason for r in spark.read.schema(S.SAID).parquet(str(tmp_path / "t")).collect()}
    assert got == {1: None, 2: "more than once", 3: "more than once", 4: None}


def test_get_or_create(spark, tmp_path):
    """From the stored table on, an outcome for every request, as the batch rule gives it."""
    rnd = random.Random(9)
    keys = [("h", c, "e") for c in "abcdef"] + [("h", None, "e")]
    rows = [(i, at(rnd.randrange(96)), *rnd.choice(keys), "text" if rnd.random() < 0.1 else rnd.choice([None, ""])) for i in range(150)]
    schema = "request_id long, ts timestamp, story_hash string, context_hash string, type string, description string"
    stored = spark.createDataFrame([("h", "a", "e", "done"), ("h", "b", "e", "failed"), ("h", "zzz", "e", "failed"), ("h", None, "e", "failed")],
                                   "story_hash string, context_hash string, type string, status string")
    order = sorted(rows, key=lambda r: (r[1] + timedelta(hours=rnd.uniform(0, 28)), r[0]))
    late = (999, at(1), "h", "new", "e", None)
    folder, target = str(tmp_path / "log"), str(tmp_path / "t")
    stream = log(spark, folder, [order[:60], order[60:100], [*order[100:], late]], schema)
    for _ in range(2):
        S.closing_row(spark, stream.schema, "2999-01-01").write.mode("append").parquet(folder)
    S.get_or_create(stream, stored, target, str(tmp_path / "s"), delay=timedelta(hours=30)).awaitTermination()
    got = {r.request_id: r.outcome for r in spark.read.schema(S.ASKED).parquet(target).collect()}
    assert got.pop(999) == "late"
    want = {r.request_id: r.outcome for r in L.suggestion_get_or_create(spark.createDataFrame(rows, schema), stored).collect()}
    assert got == want and {"created", "retried", "existing", "rejected"} == set(want.values())


def test_shared_folder_without_setting(spark, monkeypatch):
    from draftlens import session

    class Bare:
        class conf:
            get = staticmethod(lambda key, default=None: {"spark.master": "local[2]"}.get(key, default))
        sparkContext = spark.sparkContext

    assert session.shared_dir(Bare) == session.shared_dir(Bare)
    monkeypatch.setattr(Bare.conf, "get", staticmethod(lambda key, default=None: {"spark.master": "yarn"}.get(key, default)))
    with pytest.raises(ValueError):
        session.shared_dir(Bare)


def test_slices_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """No task gets a whole slice, and each slice comes as one micro-batch."""
    from types import SimpleNamespace

    from draftlens.plans import lifecycles as P

    monkeypatch.setattr(P, "scratch_path", lambda spark, label: str(tmp_path / label))
    rows, got = spark.range(0, 4000, 1, 4), []
    start = lambda stream: J.run(stream, lambda batch, n: got.append((n, batch.count())), str(tmp_path / "state"))
    P.arriving(SimpleNamespace(spark=spark), rows, "log", F.col("id") % P.SLICES, start)
    assert got == [(k, 1000) for k in range(P.SLICES)]
    assert len(list((tmp_path / "log").glob("part-*.parquet"))) > P.SLICES


def test_state_of_requests_is_one_row_a_key(spark, tmp_path):
    """Keyed tables hold what is taken, and nothing waits in the end."""
    schema = "request_id long, ts timestamp, story_hash string, context_hash string, type string, description string"
    rows = [(i, at(i % 50), "h", f"c{i % 40}", "e", None) for i in range(200)]
    stored = spark.createDataFrame([("h", "c0", "e", "done")], "story_hash string, context_hash string, type string, status string")
    folder, target, state = (str(tmp_path / n) for n in "lts")
    stream = log(spark, folder, [sorted(rows, key=lambda r: r[1])], schema)
    for _ in range(2):
        S.closing_row(spark, stream.schema, "2999-01-01").write.mode("append").parquet(folder)
    S.get_or_create(stream, stored, target, state, delay=timedelta(hours=1), buckets=2).awaitTermination()
    key = "story_hash string, context_hash string, type string"
    held = KeyedTable(spark, f"{state}/taken", L.SUGGESTION_KEY, f"{key}, taken int, until long, failed boolean", 2).read()
    assert held.count() == 40 and held.where("taken = 1").count() == 40
    assert KeyedTable(spark, f"{state}/waiting", L.SUGGESTION_KEY, f"{key}, at long, id long, mask int, answers int", 2).read().count() == 0
    assert Counter(r.outcome for r in S.said(spark, target, S.ASKED).collect()) == {"created": 39, "existing": 161}
