"""Queries: nested story exports built from conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from draftlens.operators import contexts as C
from draftlens.plans.registry import query
from draftlens.session import scratch_path
from draftlens.sources.scenes import judged_entries, scene_entries, story_exports

# Expected values straight from the conversations, without any JSON.
FLAT = """
WITH c AS (SELECT c.*, p.text AS before FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1),
w AS (SELECT *, CASE role WHEN 'user' THEN CASE WHEN conv_id % 8 = 1 THEN '9' ELSE '1' END WHEN 'system' THEN '2' END AS seq,
  concat(conv_id, ':', turn) AS suggestion_id, concat('src', conv_id % 20) AS model_name FROM c)
"""
FLAT_ROWS = FLAT + """
SELECT suggestion_id, model_name, CASE seq WHEN '1' THEN 'Ada' ELSE 'Ben' END AS character_name,
  concat(CASE seq WHEN '1' THEN 'Ada' ELSE 'Ben' END, ' of c', conv_id) AS character_description,
  CASE WHEN role <> 'system' THEN 'gate' END AS challenge_name, CASE WHEN role <> 'system' THEN 'about gate ' || role END AS challenge_text,
  CASE WHEN role <> 'system' THEN 'all is well' END AS challenge_success_description, NULL AS challenge_failure_description,
  'key' AS played_card_1_name, 'about key ' || role AS played_card_1_description,
  coalesce(before, '') AS previous_entry_text, text AS suggestion_text
FROM w WHERE conv_id % 6 <> 0 AND seq IN ('1', '2')
""".replace("NULL AS challenge_failure", "CAST(NULL AS VARCHAR) AS challenge_failure")


def judged(t):
    """Suggestions and the stories they name."""
    turns = t.raw("conversations")
    return judged_entries(turns), story_exports(turns)


@query("context_flatten", FLAT_ROWS)
def _(t):
    return C.context_flatten(*judged(t))


@query("context_reject_audit", FLAT + """
SELECT suggestion_id, model_name, seq AS character_seq_id,
  CASE WHEN conv_id % 6 = 0 THEN 'missing cards' WHEN seq IS NULL OR seq = '9' THEN 'missing character' ELSE 'missing challenge' END AS reason,
  conv_id % 6 <> 0 AND coalesce(seq, '9') <> '9' AS exported
FROM w WHERE conv_id % 6 = 0 OR seq IS NULL OR seq = '9' OR role = 'system'
""")
def _(t):
    return C.context_reject_audit(*judged(t))


@query("sink_csv_contexts", FLAT_ROWS)
def _(t):
    path = scratch_path(t.spark, "contexts-csv")
    contexts, stories = judged(t)
    C.write_contexts_csv(contexts, path, stories)
    schema = "suggestion_id string, " + ", ".join(f"{c} string" for c in C.CONTEXT_COLUMNS[1:])
    back = t.spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option(
        "lineSep", "\n").csv(path)
    return back.withColumn("previous_entry_text", F.coalesce("previous_entry_text", F.lit("")))


@query("sink_json_contexts", """
SELECT concat('c', conv_id) AS game_pid, count(*) OVER (PARTITION BY conv_id) AS scenes, concat(conv_id, ':', turn) AS suggestion_id, row_number() OVER w - 1 AS position,
  first_value(text) OVER w AS opening, concat('src', conv_id % 20) AS model_name, CAST(turn AS VARCHAR) AS seq_id, text AS generated, text AS finalized,
  CASE role WHEN 'user' THEN 'character:1' WHEN 'assistant' THEN 'narrator' ELSE 'director' END AS role,
  CASE role WHEN 'user' THEN 'move' WHEN 'assistant' THEN 'addition' ELSE 'whisper' END AS format, concat('u', conv_id) AS user_pid,
  CAST(CASE WHEN conv_id % 6 = 0 THEN 0 ELSE 2 END AS INT) AS cards, CASE WHEN role <> 'system' THEN concat('about gate ', role) END AS challenge
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
""")
def _(t):
    path = scratch_path(t.spark, "contexts-json")
    contexts, stories = judged(t)
    C.write_contexts_json(contexts, path, stories)
    entry = """struct<seq_id:string, description:string, role:string, format:string, user_pid:string,
        cards_played_on_challenge:array<struct<card_id:string>>, target_challenge_card:struct<description:string>>"""
    story = "struct<game_pid:string, scenes:array<struct<entries:array<struct<description:string>>>>>"
    back = t.spark.read.schema(f"""game_pid string, story {story}, contexts array<struct<suggestion_id:string, position:long, model_name:string,
        generated:{entry}, finalized:{entry}>>""").json(path)
    g = F.col("c.generated")
    return back.select("story", F.explode("contexts").alias("c")).select(
        "story.game_pid", F.size("story.scenes").cast("long").alias("scenes"), "c.suggestion_id", "c.position",
        F.get("story.scenes", F.lit(0))["entries"][0]["description"].alias("opening"), "c.model_name", g["seq_id"].alias("seq_id"),
        g["description"].alias("generated"), F.col("c.finalized.description").alias("finalized"), g["role"].alias("role"), g["format"].alias("format"),
        g["user_pid"].alias("user_pid"), F.size(g["cards_played_on_challenge"]).alias("cards"), g["target_challenge_card"]["description"].alias("challenge"))


# Faults planted in entries by turn, as replacements in their JSON.
PLANTED = {
    1: ('"polarity":0', '"polarity":"high"'),
    2: ('"image":null', '"image":{"url":"not a url","attribution_url":""}'),
    3: ('"is_wild":false', '"is_wild":"maybe"'),
    4: ('"challenge_cards":[]', '"challenge_cards":[5]'),
    5: ('"user_pid":"', '"user_pid":null,"user":"'),
    6: ('"autotexts":[]', '"autotexts":[{"type":"fly","automatic":"yes","text":"t","card":{"card_id":"x"}}]'),
}


def faulty_entries(conversations):
    rows = scene_entries(conversations)
    text = F.col("entry")
    for k, (good, bad) in PLANTED.items():
        text = F.when((F.col("conv_id") + F.col("turn")) % 8 == k, F.replace("entry", F.lit(good), F.lit(bad))).otherwise(text)
    return rows.withColumn("entry", F.when((F.col("conv_id") + F.col("turn")) % 8 == 7, F.concat(F.lit("{"), "entry")).otherwise(text))


def sql_card(path: str) -> str:
    """The faults of a card at a path, by the turn's rest."""
    return f"CASE k WHEN 1 THEN '{path}.polarity: int' WHEN 3 THEN '{path}.is_wild: bool' END"


@query("entry_validate", f"""
WITH e AS (SELECT *, (conv_id + turn) % 8 AS k FROM conversations)
SELECT conv_id, turn, CASE WHEN k = 7 THEN 'malformed' ELSE concat_ws('; ',
  CASE WHEN k = 5 THEN 'user_pid: missing' END, CASE WHEN role = 'system' THEN 'format: format' END, CASE WHEN role = 'system' THEN 'role: role' END,
  CASE WHEN length(text) % 5 = 0 THEN 'created_at: datetime' END, CASE WHEN k = 2 THEN 'image.url: url' END,
  CASE WHEN k = 4 THEN 'challenge_cards[0]: object' END,
  CASE WHEN role <> 'system' THEN {sql_card('target_challenge_card')} END,
  CASE WHEN conv_id % 6 <> 0 THEN {sql_card('cards_played_on_challenge[0]')} END, CASE WHEN conv_id % 6 <> 0 THEN {sql_card('cards_played_on_challenge[1]')} END,
  CASE WHEN k = 6 THEN 'autotexts[0].type: autotext type; autotexts[0].card.namespace: missing; autotexts[0].card.pretty_namespace: missing; '
    || 'autotexts[0].card.polarity: missing; autotexts[0].card.is_deleted: missing; autotexts[0].card.is_wild: missing; autotexts[0].card.stack_size: missing' END) END AS errors FROM e
""")
def _(t):
    return C.entry_validate(faulty_entries(t.raw("conversations"))).select("conv_id", "turn", "errors")


@query("null_key_profile", """
SELECT key, count(*) AS documents FROM (
  SELECT unnest(list_filter(['image', 'challenge_completion_polarity', 'place_card', 'redacted',
    CASE WHEN role = 'assistant' THEN 'character_seq_id' END, CASE WHEN role = 'system' THEN 'target_challenge_card' END,
    CASE WHEN role <> 'system' OR conv_id % 6 <> 0 THEN 'failure_stakes' END], lambda k: k IS NOT NULL)) AS key FROM conversations)
GROUP BY key
""")
def _(t):
    return C.null_key_profile(scene_entries(t.raw("conversations")), "entry")


@query("hand_fill", """
WITH e AS (SELECT concat('c', conv_id) AS game_pid, CAST(turn // 4 AS INT) AS scene, turn,
    CASE role WHEN 'user' THEN 'character:1' WHEN 'assistant' THEN 'narrator' ELSE 'director' END AS role,
    CASE WHEN turn = 0 OR turn % 3 = 0 THEN concat('[{"card_id":"c', turn, '","stack_size":', turn + 1, '}]') END AS post,
    CASE WHEN turn = 0 THEN '[{"card_id":"c0","stack_size":1}]' END AS pre FROM conversations),
f AS (SELECT *, last_value(coalesce(post, pre) IGNORE NULLS) OVER (PARTITION BY game_pid, scene, role ORDER BY turn
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM e)
SELECT game_pid, scene, role, turn, coalesce(pre, held) AS hand_before, coalesce(post, pre, held) AS hand_after FROM f
""")
def _(t):
    return C.hand_fill(scene_entries(t.raw("conversations")), block=2)
