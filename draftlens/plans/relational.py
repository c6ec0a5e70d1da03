"""Queries: relational reports, assignment, retention, registry and store."""

from __future__ import annotations

from pyspark.sql import functions as F

from draftlens.functions.values import iso_text
from draftlens.operators import assignment as A
from draftlens.operators import reports as R
from draftlens.operators import retention as K
from draftlens.operators import store as S
from draftlens.operators.lifecycle import lookup_by_uuid
from draftlens.plans.registry import query, sql_list
from draftlens.sources.wordlists import EXCLUDED_GAMES

GAMES = sql_list(EXCLUDED_GAMES)
CORE = "model assignment suggestion story"
FROM_LIVE = """
FROM model m JOIN assignment a ON m.id = a.model_id
JOIN suggestion s ON s.story_hash = a.story_hash
"""
FROM_DONE = FROM_LIVE + """
JOIN story st ON st.hash = s.story_hash
"""
WHERE_DONE = f"""
WHERE s.finalized IS NOT NULL AND m.status = 'active' AND st.game_pid NOT IN ({GAMES})
"""


def core(t):
    return t.model, t.assignment, t.suggestion, t.story


DASHED = "concat(substr({0},1,8),'-',substr({0},9,4),'-',substr({0},13,4),'-',substr({0},17,4),'-',substr({0},21))"


@query("src_tables", """
SELECT s.id, s.uuid, s.user_pid, strftime(s.ts, '%Y-%m-%d %H:%M:%S') AS ts, s.is_finalized, CAST(length(s.finalized) AS INT) AS chars, st.game_pid, st.exported_at,
  'pending' AS story_status, m.name AS model_name, 'scene_entry' AS model_type, CAST(m.quota AS INT) AS quota, f.answers
FROM suggestion s JOIN assignment a USING (story_hash) JOIN model m ON m.id = a.model_id JOIN story st ON st.hash = s.story_hash
LEFT JOIN (SELECT suggestion_id, count(*) AS answers FROM feedback GROUP BY suggestion_id) f ON f.suggestion_id = s.uuid
""", CORE + " feedback")
def _(t):
    """Stored tables with other orders, widths and names, and columns too few and too many."""
    from draftlens.session import scratch_path
    from draftlens.sources.tables import Tables

    path = scratch_path(t.spark, "stored")
    more = F.lit("x").alias("note")
    put = lambda df, name: df.write.parquet(f"{path}/{name}.parquet")
    dashed = lambda c: F.upper(F.expr(DASHED.format(c)))
    put(t.model.select(F.col("quota").cast("long").alias("quota"), more, "url", "status", "name", F.col("id").cast("long").alias("id")), "model")
    put(t.story.select(F.to_json(F.struct("game_pid", "exported_at")).alias("story"), "hash", "id"), "story")
    put(t.assignment.select("story_hash", F.col("model_id").cast("long").alias("model_id"), more), "assignment")
    texts = [F.col("generated"), F.coalesce("finalized", F.lit("null")).alias("finalized")]
    put(t.suggestion.select(*texts, more, F.col("ts").alias("timestamp"), dashed("uuid").alias("uuid"), F.to_json(F.struct("user_pid")).alias("context"),
                            "status", "id", "story_hash", "context_hash", "created_at"), "suggestion")
    put(t.feedback.select("response", dashed("suggestion_id").alias("suggestion_id"), "type"), "feedback")
    s = Tables(t.spark, path)
    rated = s.feedback.groupBy(F.col("suggestion_id").alias("uuid")).agg(F.count(F.lit(1)).alias("answers"))
    told = s.story.select(F.col("hash").alias("story_hash"), "game_pid", "exported_at", F.col("status").alias("story_status"))
    named = s.model.select(F.col("id").alias("model_id"), F.col("name").alias("model_name"), F.col("type").alias("model_type"), "quota")
    rows = s.suggestion.join(s.assignment, "story_hash").join(named, "model_id").join(told, "story_hash").join(rated, "uuid", "left")
    return rows.select("id", "uuid", "user_pid", iso_text(F.col("ts")).alias("ts"), "is_finalized", F.length("finalized").alias("chars"), "game_pid",
                       "exported_at", "story_status", "model_name", "model_type", "quota", "answers")


@query("avg_ratings", f"""
SELECT f.type, m.name AS model_name,
  CAST(((200 * CAST(sum(CAST(f.response AS INT)) AS BIGINT) + count(*)) // (2 * count(*))) / 100.0 AS DOUBLE) AS avg_rating,
  round(stddev_samp(CAST(f.response AS INT)), 2) AS rating_stddev, count(m.name) AS feedback_count
{FROM_LIVE} JOIN feedback f ON f.suggestion_id = s.uuid
WHERE f.type IN ('fluency', 'relevance', 'coherence', 'likeability') AND s.finalized IS NOT NULL AND m.status = 'active'
GROUP BY f.type, m.name
""", CORE + " feedback")
def _(t):
    return R.avg_ratings(t.model, t.assignment, t.suggestion, t.feedback)


ANSWERS = ", ".join(f"max(response) FILTER (WHERE type = '{x}') AS {x}" for x in R.FEEDBACK_TYPES)
WIDE = f"""
WITH answers AS (SELECT suggestion_id, {ANSWERS} FROM feedback GROUP BY suggestion_id)
SELECT m.name AS model_name, st.game_pid, s.generated AS generated_text, s.finalized AS user_text,
  s.uuid AS suggestion_id, {', '.join(R.FEEDBACK_TYPES)}, s.created_at
{FROM_DONE} LEFT JOIN answers ON answers.suggestion_id = s.uuid {WHERE_DONE}
"""


@query("finalized_suggestions", WIDE + " ORDER BY created_at, suggestion_id, model_name", CORE + " feedback")
def _(t):
    return R.finalized_suggestions(*core(t), t.feedback)


@query("public_edits", WIDE + " ORDER BY created_at, suggestion_id, model_name LIMIT 10", CORE + " feedback")
def _(t):
    return R.public_edits(*core(t), t.feedback)


@query("suggestions_per_user", f"""
SELECT s.user_pid, count(s.user_pid) AS suggestion_count {FROM_LIVE}
WHERE m.status = 'active' GROUP BY s.user_pid
""", CORE)
def _(t):
    return R.suggestions_per_user(t.model, t.assignment, t.suggestion)


@query("users_by_threshold", f"""
WITH c AS (SELECT count(s.user_pid) AS n {FROM_LIVE} WHERE m.status = 'active' GROUP BY s.user_pid)
SELECT k.threshold, count(c.n) AS unique_user_count
FROM (SELECT CAST(unnest([1, 5, 10, 20, NULL]) AS INT) AS threshold) k
LEFT JOIN c ON k.threshold IS NULL OR c.n <= k.threshold GROUP BY k.threshold
""", CORE)
def _(t):
    return R.users_by_threshold(t.model, t.assignment, t.suggestion)


@query("distinct_models", f"SELECT DISTINCT m.name AS model_name {FROM_DONE} {WHERE_DONE}", CORE)
def _(t):
    return R.distinct_models(*core(t))


@query("f_blacklist", f"SELECT id, game_pid FROM story WHERE game_pid NOT IN ({GAMES})", "story")
def _(t):
    return R.exclude_games(t.story).select("id", "game_pid")


CONTEXTS = f"SELECT s.id AS suggestion_id, m.name AS model_name, s.story_hash, s.generated, s.finalized {FROM_DONE} {WHERE_DONE}"


@query("judgement_contexts", CONTEXTS + " QUALIFY count(*) OVER (PARTITION BY m.name ORDER BY s.id) <= 5", CORE)
def _(t):
    return R.judgement_contexts(*core(t), limit=5)


@query("judgement_contexts_all", CONTEXTS, CORE)
def _(t):
    return R.judgement_contexts(*core(t))


# --- assignment -----------------------------------------------------------

TOTALS = """
work AS (SELECT model_id, count(*) FILTER (WHERE s.story_hash IS NULL) AS idle,
    count(*) FILTER (WHERE s.story_hash IS NOT NULL AND coalesce(s.ts > TIMESTAMP '2024-02-01', true)) AS fresh
  FROM assignment LEFT JOIN suggestion s USING (story_hash) GROUP BY model_id),
mt AS (SELECT id AS model_id, coalesce(fresh, 0) AS suggestion_count
  FROM model LEFT JOIN work ON work.model_id = model.id WHERE fresh IS NULL OR idle + fresh > 0)
"""
STORY_TOTALS = TOTALS + """,
held AS (SELECT model_id, count(story_hash) AS stories FROM assignment GROUP BY model_id),
free AS (SELECT id FROM model WHERE status = 'active' AND quota < 0
  UNION SELECT id FROM model, mt WHERE mt.model_id = id AND status = 'active' AND suggestion_count < quota),
tot AS (SELECT id, url, name, type, status, coalesce(stories, 0) AS story_count
  FROM model SEMI JOIN free USING (id) LEFT JOIN held ON held.model_id = id)
"""


@query("monthly_totals", f"WITH {TOTALS} SELECT * FROM mt", CORE)
def _(t):
    return A.monthly_totals(t.model, t.assignment, t.suggestion)


@query("monthly_totals_one", f"WITH {TOTALS} SELECT * FROM mt WHERE model_id = 3", CORE)
def _(t):
    return A.monthly_totals(t.model, t.assignment, t.suggestion, model_id=3)


@query("story_totals", f"WITH {STORY_TOTALS} SELECT * FROM tot", CORE)
def _(t):
    return A.story_totals(t.model, t.assignment, t.suggestion)


@query("min_counts", f"WITH {STORY_TOTALS} SELECT type, min(story_count) AS min_count FROM tot GROUP BY type", CORE)
def _(t):
    return A.min_counts(A.story_totals(t.model, t.assignment, t.suggestion))


@query("select_models", f"""
WITH {STORY_TOTALS} SELECT DISTINCT ON (type) type, id, url, name, status, story_count FROM tot
ORDER BY type, story_count, id
""", CORE)
def _(t):
    return A.select_models(A.story_totals(t.model, t.assignment, t.suggestion))


VIOLATIONS = TOTALS + """,
bad AS (SELECT m.id AS model_id, m.name, m.type, m.quota, coalesce(mt.suggestion_count, 0) AS suggestion_count,
    (SELECT count(*) FROM assignment a WHERE a.model_id = m.id) AS stories,
    CASE WHEN m.status = 'inactive' THEN 'inactive' ELSE 'quota' END AS reason
  FROM model m LEFT JOIN mt ON mt.model_id = m.id
  WHERE EXISTS (SELECT 1 FROM assignment a WHERE a.model_id = m.id)
    AND (m.status = 'inactive' OR (m.quota >= 0 AND coalesce(mt.suggestion_count, 0) > m.quota)))
"""


@query("quota_violations", f"WITH {VIOLATIONS} SELECT * FROM bad", CORE)
def _(t):
    return A.quota_violations(t.model, t.assignment, t.suggestion)


@query("reassign_stories", f"""
WITH {STORY_TOTALS}, {VIOLATIONS.replace(TOTALS + ",", "")},
moved AS (SELECT a.story_hash, b.type, b.model_id AS old_model_id, b.reason,
    row_number() OVER (PARTITION BY b.type ORDER BY md5(concat(a.story_hash, ':', CAST(a.model_id AS STRING)))) AS rn
  FROM assignment a JOIN bad b ON a.model_id = b.model_id),
need AS (SELECT type, count(*) AS n FROM moved GROUP BY type),
slots AS (SELECT tot.type, tot.id, tot.story_count + k.k AS level
  FROM tot JOIN need ON need.type = tot.type JOIN (SELECT unnest(range(0, (SELECT max(n) FROM need))) AS k) k ON k.k < need.n),
turn AS (SELECT type, id, row_number() OVER (PARTITION BY type ORDER BY level, id) AS rn FROM slots)
SELECT moved.story_hash, moved.type, moved.old_model_id, moved.reason, turn.id AS new_model_id
FROM moved LEFT JOIN turn ON turn.type = moved.type AND turn.rn = moved.rn
""", CORE)
def _(t):
    return A.reassign_stories(t.model, t.assignment, t.suggestion)


# --- retention ------------------------------------------------------------

LATEST = """
latest AS (SELECT game_pid, max(CAST(replace(exported_at, 'T', ' ') AS TIMESTAMP)) AS latest FROM story GROUP BY game_pid)
"""
# Newest time beside each export; what a suggestion refers to is in use.
DELETED = """
SELECT id, hash, game_pid, exported_at FROM (
  SELECT *, max(told) OVER (PARTITION BY game_pid) AS newest FROM (SELECT *, CAST(replace(exported_at, 'T', ' ') AS TIMESTAMP) AS told FROM story)) e
WHERE game_pid IS NOT NULL AND told < newest AND NOT EXISTS (FROM suggestion WHERE story_hash = e.hash)
"""


@query("latest_export_by_game", f"WITH {LATEST} SELECT game_pid, strftime(latest, '%Y-%m-%d %H:%M:%S') AS latest FROM latest", "story")
def _(t):
    return K.latest_export_by_game(t.story).withColumn("latest", iso_text(F.col("latest")))


@query("stories_to_delete", DELETED, "story suggestion")
def _(t):
    return K.stories_to_delete(t.story, t.suggestion)


KEPT = f"WITH gone AS ({DELETED}) SELECT id, hash, game_pid, exported_at, status FROM story WHERE id NOT IN (SELECT id FROM gone)"


@query("retained_stories", KEPT, "story suggestion")
def _(t):
    return K.retained_stories(t.story, t.suggestion)


@query("retention_daily", KEPT.replace("SELECT id, hash, game_pid, exported_at, status FROM story", "SELECT game_pid, count(*) AS stories FROM story") + " GROUP BY game_pid", "story suggestion")
def _(t):
    return K.retained_stories(t.story, t.suggestion).groupBy("game_pid").agg(F.count("*").alias("stories"))


DEDUP = """
SELECT hash, min(upload_id) AS first_upload, min(upload_id) FILTER (NOT failed) AS accepted_upload, count(*) AS uploads,
  CASE WHEN bool_and(failed) THEN 'failed' ELSE 'ready' END AS status FROM upload_log GROUP BY hash
"""


@query("story_dedup", DEDUP, "upload_log")
def _(t):
    return K.story_dedup(t.upload_log)


@query("lookup_story_status", """
SELECT r.hash, st.status FROM (SELECT DISTINCT story_hash AS hash FROM request_log) r LEFT JOIN story st ON st.hash = r.hash
""", "request_log story")
def _(t):
    return K.lookup_story_status(t.request_log.select(F.col("story_hash").alias("hash")).distinct(), t.story)


# --- registry and store ---------------------------------------------------


@query("registry_query", "SELECT * FROM model WHERE status = 'active' AND type = 'scene_entry'", "model")
def _(t):
    return R.registry_query(t.model, status="active", type="scene_entry")


def stored(t, rows, name):
    """A new version of a table, as its readers will find it."""
    from draftlens.session import scratch_path

    path = scratch_path(t.spark, name)
    rows.write.parquet(path)
    return t.spark.read.parquet(path)


@query("registry_add_update", """
SELECT id, name, url, type, CASE WHEN id >= 10 THEN 'active' ELSE status END AS status, quota FROM model
UNION ALL SELECT id + 10, concat('new', CAST(id + 10 AS STRING)), NULL, 'scene_entry', 'active', -1 FROM model WHERE id >= 10
""", "model")
def _(t):
    ids = t.model.select((F.col("id") + 10).alias("id"))
    changes = ids.select("id", F.lit("active").alias("status"),
                         F.when(F.col("id") >= 20, F.concat(F.lit("new"), F.col("id").cast("string"))).alias("name"))
    return stored(t, S.upsert(t.model, changes, defaults=S.MODEL_DEFAULTS), "model")


@query("sink_upsert_append", """
SELECT s.id, s.hash, s.game_pid, s.exported_at, CASE WHEN p.story_hash IS NOT NULL THEN p.status ELSE s.status END AS status
FROM story s LEFT JOIN (SELECT story_hash, CASE WHEN bool_and(completed) THEN 'ready' ELSE 'failed' END AS status
  FROM preprocess_log GROUP BY story_hash) p ON p.story_hash = s.hash
""", "story preprocess_log")
def _(t):
    from draftlens.operators.lifecycle import story_ready_rollup
    from draftlens.session import scratch_path

    changes = story_ready_rollup(t.preprocess_log).select(F.col("story_hash").alias("hash"), "status")
    path = scratch_path(t.spark, "story")
    S.upsert(t.story, changes, key="hash").write.parquet(path)
    return t.spark.read.parquet(path)


@query("sink_delete", "SELECT id, uuid, status FROM suggestion WHERE NOT (status = 'failed' AND type = 'scene_entry')", "suggestion")
def _(t):
    """The table without the deleted rows, written and read back."""
    return stored(t, S.delete(t.suggestion, {"status": "failed", "type": "scene_entry"}), "suggestion").select("id", "uuid", "status")


@query("scan_all", "SELECT id, uuid FROM suggestion WHERE status = 'done' AND user_pid IS NULL", "suggestion")
def _(t):
    return S.scan_all(t.suggestion, ["id", "uuid"], {"status": "done", "user_pid": None})


@query("scan_one", "SELECT id, uuid, status FROM suggestion WHERE status = 'failed' ORDER BY id LIMIT 1", "suggestion")
def _(t):
    return S.scan_one(t.suggestion, ["id", "uuid", "status"], {"status": "failed"})


@query("scan_iterate", "SELECT id, hash, game_pid, exported_at, status FROM story", "story")
def _(t):
    return S.scan_all(t.story)


@query("lookup_by_uuid", f"""
WITH asked AS (SELECT {DASHED.format('uuid')} AS requested, uuid FROM suggestion UNION ALL SELECT hash, hash FROM story)
SELECT a.requested, a.uuid, s.id, s.status FROM asked a LEFT JOIN suggestion s ON s.uuid = a.uuid
""", "suggestion story")
def _(t):
    dashed = t.suggestion.select(F.expr(DASHED.format("upper(uuid)")).alias("requested"))
    asked = dashed.unionByName(t.story.select(F.col("hash").alias("requested")))
    found = lookup_by_uuid(asked, t.suggestion)
    return found.select(F.lower("requested").alias("requested"), "uuid", "id", "status")
