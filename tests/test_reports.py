import random

import pytest
from pyspark.sql import functions as F

from draftlens.operators import assignment as A
from draftlens.operators import joins as J
from draftlens.operators import reports as R
from draftlens.operators import retention as K
from draftlens.operators import store as S

MODEL = "id int, name string, url string, type string, status string, quota int"


@pytest.fixture(scope="module")
def world(spark):
    model = spark.createDataFrame(
        [(0, "m0", "u0", "scene_entry", "active", -1), (1, "m1", "u1", "scene_entry", "active", 2),
         (2, "m2", "u2", "scene_entry", "inactive", -1), (3, "m3", "u3", "scene_entry", "active", 5),
         (4, "m4", "u4", "scene_entry", "active", 0), (5, "m5", "u5", "other", "inactive", -1)], MODEL)
    assignment = spark.createDataFrame(
        [(0, "a"), (1, "b"), (1, "c"), (1, "d"), (2, "e"), (3, "f"), (2, "a"), (5, "g"), (4, "h")],
        "model_id int, story_hash string")
    suggestion = spark.createDataFrame(
        [(1, "s1", "a", "2024-02-03"), (2, "s2", "b", "2024-02-03"), (3, "s3", "c", "2024-02-05"),
         (4, "s4", "d", "2024-02-06"), (5, "s5", "f", "2024-01-20"), (6, "s6", "h", "2024-02-09")],
        "id int, uuid string, story_hash string, day string",
    ).withColumn("ts", F.to_timestamp("day"))
    return model, assignment, suggestion


def as_dict(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_monthly_totals(world):
    # m3 has only older suggestions, so it has no row; m5's story has none at all.
    assert as_dict(A.monthly_totals(*world), "model_id", "suggestion_count") == {0: 1, 1: 3, 2: 1, 4: 1, 5: 0}
    first = A.monthly_totals(*world, as_of="2024-02-01")
    assert as_dict(first, "model_id", "suggestion_count") == {0: 1, 1: 3, 2: 1, 4: 1}


def test_eligible_models(world):
    # m1 is over its quota, m4 may make none, m3 has no monthly row.
    assert as_dict(A.story_totals(*world), "id", "story_count") == {0: 1}
    assert as_dict(A.story_totals(*world, strict=False), "id", "story_count") == {0: 1, 3: 1}
    best = A.select_models(A.story_totals(*world, strict=False)).collect()
    assert [(r.type, r.id) for r in best] == [("scene_entry", 0)]


def test_quota_violations(world):
    assert as_dict(A.quota_violations(*world), "model_id", "reason") == {1: "quota", 2: "inactive", 4: "quota", 5: "inactive"}
    literal = as_dict(A.quota_violations(*world, unlimited_negative=False), "model_id", "reason")
    assert literal == {0: "quota", 1: "quota", 2: "inactive", 4: "quota", 5: "inactive"}


def test_reassign_equals_one_by_one(world):
    moved = A.reassign_stories(*world, strict=False).collect()
    assert {(r.old_model_id, r.story_hash) for r in moved} == {
        (1, "b"), (1, "c"), (1, "d"), (2, "e"), (2, "a"), (5, "g"), (4, "h")}
    assert [r.new_model_id for r in moved if r.type == "other"] == [None]
    counts = {m: sum(r.new_model_id == m for r in moved) for m in (0, 3)}
    assert counts == {0: 3, 3: 3}


@pytest.mark.parametrize(("n", "stories", "block"), [(6, 60, 4096), (6, 60, 2), (1, 7, 3), (9, 5, 4096), (4, 0, 4096)])
def test_turns_match_simulation(spark, monkeypatch, n, stories, block):
    monkeypatch.setattr(A, "BLOCK", block)
    rng = random.Random(n)
    loads = {i: rng.randint(0, 12) for i in rng.sample(range(50), n)}
    totals = spark.createDataFrame([("t", i, k) for i, k in loads.items()] + [("idle", 99, 1)], "type string, id int, story_count long")
    moved = spark.createDataFrame([("t",)] * stories + [("none",)] * 3, "type string")
    got = {(r.type, r["rank"]): r.new_model_id for r in A._turns(totals, moved).collect()}
    want = {}
    for rank in range(stories):
        best = min(loads, key=lambda i: (loads[i], i))
        loads[best] += 1
        want["t", rank] = best
    assert got == want


def test_reassignment_gathers_nothing(spark, data):
    from draftlens.sources.tables import Tables

    t = Tables(spark, data)
    plan = A.reassign_stories(t.model, t.assignment, t.suggestion)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_stored_tables(spark, tmp_path):
    from draftlens.sources.stored import reconcile

    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    model = make([(3, "m", None, "x")], "id long, name string, status string, note string")
    assert reconcile(model, "model").first().asDict() == {"id": 3, "name": "m", "url": None, "type": "scene_entry", "status": "inactive", "quota": -1}
    told = make([("h", 1, '{"game_pid": "g", "exported_at": "2024"}'), ("i", 2, None)], "hash string, id int, story string")
    assert [tuple(r) for r in reconcile(told, "story").orderBy("id").collect()] == [(1, "h", "g", "2024", "pending"), (2, "i", None, None, "pending")]
    with pytest.raises(ValueError, match="story_hash"):
        reconcile(make([(1,)], "model_id int"), "assignment")
    with pytest.raises(Exception, match="not one of"):
        reconcile(make([("u", "speed", "1")], "suggestion_id string, type string, response string"), "feedback").collect()
    with pytest.raises(Exception, match="CAST"):
        reconcile(make([("x", "m")], "id string, name string"), "model").collect()


def test_rank_by_hash_and_top_per_group(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"),
                                  F.md5(F.col("id").cast("string")).alias("h"))
    ranked = J.rank_by_hash(df, "g", "h").collect()
    for group in {r.g for r in ranked}:
        rows = sorted((r for r in ranked if r.g == group), key=lambda r: r.h)
        assert [r["rank"] for r in rows] == list(range(len(rows)))
    top = J.top_per_group(df, "g", "id", 4).collect()
    for group in {r.g for r in top}:
        want = sorted(r.id for r in ranked if r.g == group)[:4]
        assert sorted(r.id for r in top if r.g == group) == want


def test_excluded_games_from_a_table(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, game_pid string")
    ids = lambda games: sorted(r.id for r in R.exclude_games(rows, spark.createDataFrame(games, "w string")).collect())
    assert ids([("a",)]) == [2]
    assert ids([]) == [1, 2, 3]


def test_excluded_games(spark):
    df = spark.createDataFrame([("g1",), ("g2",), (None,)], "game_pid string")
    games = lambda *a: sorted(str(r[0]) for r in R.exclude_games(df, *a).collect())
    assert games(()) == ["None", "g1", "g2"]
    assert games(("g1",)) == ["g2"]
    assert games(spark.createDataFrame([("g1",)], "w string")) == ["g2"]
    assert games(spark.createDataFrame([], "w string")) == ["None", "g1", "g2"]


def test_users_by_threshold_counts_the_null_user(spark):
    model = spark.createDataFrame([(1, "m", "u", "t", "active", -1)], MODEL)
    assignment = spark.createDataFrame([(1, "h")], "model_id int, story_hash string")
    users = [None, None, "a"] + ["b"] * 6
    suggestion = spark.createDataFrame([("h", u) for u in users], "story_hash string, user_pid string")
    got = as_dict(R.users_by_threshold(model, assignment, suggestion), "threshold", "unique_user_count")
    assert got == {1: 2, 5: 2, 10: 3, 20: 3, None: 3}


def test_avg_ratings_fan_out_and_single(spark):
    model = spark.createDataFrame([(1, "m", "u", "t", "active", -1), (2, "n", "u", "t", "active", -1)], MODEL)
    assignment = spark.createDataFrame([(1, "h"), (2, "h"), (1, "k")], "model_id int, story_hash string")
    suggestion = spark.createDataFrame([("x", "h", True), ("y", "k", True)], "uuid string, story_hash string, is_finalized boolean")
    feedback = spark.createDataFrame([("x", "fluency", "4"), ("y", "fluency", "1"), ("x", "comments", "hm")],
                                     "suggestion_id string, type string, response string")
    got = {r.model_name: r for r in R.avg_ratings(model, assignment, suggestion, feedback).collect()}
    assert (got["m"].avg_rating, got["m"].rating_stddev, got["m"].feedback_count) == (2.5, 2.12, 2)
    assert (got["n"].avg_rating, got["n"].rating_stddev, got["n"].feedback_count) == (4.0, None, 1)


def test_retention(spark):
    story = spark.createDataFrame(
        [(1, "a", "g", "2024-01-01T00:00:00"), (2, "b", "g", "2024-01-02T00:00:00"), (3, "c", "g", "2024-01-02T00:00:00"),
         (4, "d", None, "2023-01-01T00:00:00"), (5, "e", "g", "2023-01-01T00:00:00")],
        "id int, hash string, game_pid string, exported_at string")
    suggestion = spark.createDataFrame([("u", "e")], "uuid string, story_hash string")
    gone = {r.id for r in K.stories_to_delete(story, suggestion).collect()}
    kept = {r.id for r in K.retained_stories(story, suggestion).collect()}
    assert gone == {1} and kept == {2, 3, 4, 5}  # ties, used and gameless ones stay


def test_store(spark):
    table = spark.createDataFrame([(1, "a", "x", 5), (2, "b", None, 6)], "id int, name string, status string, quota int")
    added = S.insert(table, spark.createDataFrame([(3, "c")], "id int, name string"), S.MODEL_DEFAULTS)
    assert [tuple(r) for r in added.where("id = 3").collect()] == [(3, "c", "inactive", -1)]
    changed = S.update(table, spark.createDataFrame([(2, "z")], "id int, status string")).orderBy("id").collect()
    assert [tuple(r) for r in changed] == [(1, "a", "x", 5), (2, "b", "z", 6)]
    both = S.upsert(table, spark.createDataFrame([(1, "q"), (9, "n")], "id int, name string"), defaults=S.MODEL_DEFAULTS)
    assert [tuple(r) for r in both.orderBy("id").collect()] == [(1, "q", "x", 5), (2, "b", None, 6), (9, "n", "inactive", -1)]
    assert [r.id for r in S.delete(table, {"status": None}).collect()] == [1]
    with pytest.raises(ValueError):
        S.delete(table)
    assert S.scan_one(table, ["name"]).first().name == "a"
