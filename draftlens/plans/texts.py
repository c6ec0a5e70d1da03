"""Queries: text columns, ranges, JSON and time values."""

from __future__ import annotations

from pyspark.sql import functions as F

from draftlens.functions import text as X
from draftlens.functions import values as V
from draftlens.operators.cleaning import clean_suggestions
from draftlens.plans.registry import query, sql_list
from draftlens.sources.scenes import scene_entries, story_exports, read_story_json
from draftlens.sources.wordlists import STOPWORDS, load_word_list
from draftlens.session import scratch_path

# The same patterns spelled for RE2, which has ASCII \w and no look-ahead.
W = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]"
S = r"[\s\x{0b}\x{85}\p{Z}]"
NS = r"[^\s\x{0b}\x{85}\p{Z}]"
NSW = r"[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\s\x{0b}\x{85}\p{Z}]"
TOKEN = rf"{W}+|{NSW}+"
SPACE_TOKEN = r"[^\s\x{0b}\x{85}\p{Z}\x{1c}-\x{1f}]+"
PUNCT = r"""[!"#$%&'()*+,\-./:;<=>?@\[\]\^_`{|}~]"""
CLOSING = r"""[*_~"'”´’‚,„]"""
OPENING = r"""[*_~"'“`‘]"""
END = rf"({W}{W}{PUNCT}*[.?!]{CLOSING}*){S}+({OPENING}*[A-Z])"
MARK = "\x01\x02\x01"  # not the way the columns do it


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def sql_tokens(text: str) -> str:
    return f"regexp_extract_all({text}, {q(TOKEN)})"


def sql_ws_tokens(text: str) -> str:
    return f"regexp_extract_all({text}, {q(SPACE_TOKEN)})"


def sql_sentences(text: str) -> str:
    """Boundaries are marked twice: one pass uses up the next sentence's capital."""
    once = lambda t: f"regexp_replace({t}, {q(END)}, {q(chr(92) + '1' + MARK + chr(92) + '2')}, 'g')"
    return f"string_split({once(once(text))}, {q(MARK)})"


def sql_fragment(sentence: str) -> str:
    return f"NOT regexp_matches({sentence} || ' A', {q(END)})"


def sql_whole(sentences: str) -> str:
    return f"CASE WHEN {sql_fragment(f'list_last({sentences})')} THEN {sentences}[:-2] ELSE {sentences} END"


def sql_cut_last(text: str, piece: str) -> str:
    """Text before the last occurrence: the first one in the mirrored text."""
    mirror = lambda t: f"array_to_string(list_reverse(string_split({t}, '')), '')"
    at = f"strpos({mirror(text)}, {mirror(piece)})"
    return f"CASE WHEN {at} > 0 AND length({piece}) > 0 THEN left({text}, length({text}) - {at} - length({piece}) + 1) ELSE {text} END"


def documents(t):
    return t.spread(t.raw("documents").select("doc_id", "text"))


def suggestions(t):
    return t.suggestion


@query("tokenize", f"""
SELECT doc_id, len(k) AS n, array_to_string(k, ' ') AS tokens FROM (SELECT doc_id, {sql_tokens('text')} AS k FROM documents)
""")
def _(t):
    k = X.tokenize(F.col("text"))
    return documents(t).select("doc_id", F.size(k).cast("long").alias("n"), F.array_join(k, " ").alias("tokens"))


@query("ws_tokens", f"""
SELECT doc_id, len(k) AS n, array_to_string(k, ' ') AS tokens FROM (SELECT doc_id, {sql_ws_tokens('text')} AS k FROM documents)
""")
def _(t):
    k = X.ws_tokens(F.col("text"))
    return documents(t).select("doc_id", F.size(k).cast("long").alias("n"), F.array_join(k, " ").alias("tokens"))


@query("nfc", "SELECT doc_id, nfc_normalize(text) AS text FROM documents")
def _(t):
    return documents(t).select("doc_id", X.nfc(F.col("text")).alias("text"))


@query("split_sentences", f"""
SELECT doc_id, len(s) AS n, array_to_string(s, ' | ') AS sentences
FROM (SELECT doc_id, {sql_sentences('text')} AS s FROM documents)
""")
def _(t):
    rows = documents(t).select("doc_id", X.split_sentences(F.col("text")).alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n"), F.array_join("s", " | ").alias("sentences"))


@query("drop_fragment", f"""
SELECT doc_id, len({sql_whole('s')}) AS n, array_to_string({sql_whole('s')}, ' | ') AS sentences
FROM (SELECT doc_id, {sql_sentences('text')} AS s FROM documents)
""")
def _(t):
    rows = documents(t).select("doc_id", X.split_sentences(F.col("text"), keep_fragments=False).alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n"), F.array_join("s", " | ").alias("sentences"))


PROFILE = f"""
SELECT doc_id, length(nfc_normalize(text)) AS chars, len({sql_tokens('text')}) AS words,
  len({sql_ws_tokens('text')}) AS tokens, len({sql_sentences('text')}) AS sentences FROM documents
"""


@query("length_profile", PROFILE)
def _(t):
    return documents(t).select("doc_id", *[X.unit_length(F.col("text"), u).cast("long").alias(u) for u in X.UNITS])


def _chunk_sql(unit: str, chunks: str) -> str:
    return f"""SELECT doc_id, '{unit}' AS unit, u.pos - 1 AS pos, k[u.pos] AS chunk
  FROM (SELECT doc_id, {chunks} AS k FROM documents) JOIN LATERAL (SELECT unnest(range(1, len(k) + 1)) AS pos) u ON true"""


@query("chunk_units", " UNION ALL ".join(_chunk_sql(u, c) for u, c in {
    "chars": "string_split(nfc_normalize(text), '')", "words": sql_tokens("text"), "tokens": sql_ws_tokens("text"), "sentences": sql_sentences("text")}.items()))
def _(t):
    # One unit of a text at a time, so that no row holds all chunks of all units.
    rows = documents(t).select("doc_id", "text", X.nfc(F.col("text")).alias("composed"), F.explode(F.array(*map(F.lit, X.UNITS))).alias("unit"))
    rows = rows.select("doc_id", "unit", F.when(F.col("unit") == "chars", F.col("composed")).otherwise(F.col("text")).alias("text"))
    chunks = F.when(F.col("unit") == "chars", F.split("text", ""))
    for unit in X.UNITS[1:]:
        chunks = chunks.when(F.col("unit") == unit, X.chunk_units(F.col("text"), unit))
    return rows.select("doc_id", "unit", F.posexplode(chunks).alias("pos", "chunk")).withColumn("pos", F.col("pos").cast("long"))


@query("next_range", f"""
WITH n AS (SELECT doc_id, len({sql_tokens('text')}) AS used FROM documents)
SELECT doc_id, used, CASE WHEN used > 250 THEN NULL WHEN used = 250 THEN 250 WHEN 250 - used <= 50 THEN used END AS start_at,
  CASE WHEN used > 250 THEN NULL WHEN used = 250 THEN 250 WHEN 250 - used <= 50 THEN 249 ELSE 50 END AS end_at FROM n
""")
def _(t):
    rows = documents(t).select("doc_id", X.unit_length(F.col("text"), "words", False).cast("long").alias("used"))
    r = X.next_range(F.col("used"), F.lit(250), F.lit(50))
    return rows.select("doc_id", "used", r["start"].alias("start_at"), r["end"].cast("int").alias("end_at"))


RANGE_TEXT = """
CASE event_type WHEN 'view' THEN concat('words=', a, '-', b, ',', b, '-') WHEN 'click' THEN concat('chars=-', b)
  WHEN 'purchase' THEN concat('sentences=', a, '-', b) WHEN 'signup' THEN concat('tokens=', a, '-')
  ELSE concat('words=', a) END
"""
RANGE_ROWS = "SELECT event_id, event_type, CAST(event_id AS STRING) AS a, CAST(user_id AS STRING) AS b FROM {events}"


@query("range_parse", f"""
WITH e AS ({RANGE_ROWS.format(events='events')})
SELECT event_id, {RANGE_TEXT} AS header,
  CASE event_type WHEN 'view' THEN 'words' WHEN 'click' THEN 'chars' WHEN 'purchase' THEN 'sentences' WHEN 'signup' THEN 'tokens' END AS unit,
  CASE event_type WHEN 'view' THEN concat(a, '-', b, ',', b, '-') WHEN 'click' THEN concat('-', b)
    WHEN 'purchase' THEN concat(a, '-', b) WHEN 'signup' THEN concat(a, '-') END AS ranges,
  CASE WHEN event_type IN ('view', 'purchase', 'signup') THEN CAST(a AS BIGINT) END AS slice_start,
  CASE WHEN event_type IN ('view', 'purchase') THEN CAST(b AS BIGINT) + 1 WHEN event_type = 'click' THEN CAST(b AS BIGINT) END AS slice_stop,
  CASE WHEN event_type <> 'error' THEN event_type = 'purchase' END AS finite
FROM e
""")
def _(t):
    rows = t.spark.sql(RANGE_ROWS, events=t.raw("events")).select("event_id", F.expr(RANGE_TEXT).alias("header"))
    rows = rows.withColumn("p", X.range_parse(F.col("header")))
    cut = X.range_slice(F.get("p.ranges", F.lit(0)))
    return rows.select(
        "event_id", "header", "p.unit", F.substring_index(X.range_format(F.col("p")), "=", -1).alias("ranges"),
        cut["start"].alias("slice_start"), cut["stop"].alias("slice_stop"), X.range_is_finite(F.col("p")).alias("finite"))


@query("full_range", "SELECT doc_id, 0::BIGINT AS start_at, len(regexp_extract_all(text, '\\S+')) - 1 AS end_at FROM documents")
def _(t):
    n = F.size(F.regexp_extract_all("text", F.lit("\\S+"), F.lit(0)))
    return documents(t).select("doc_id", X.full_range(n).alias("r")).select("doc_id", F.col("r.start").alias("start_at"), F.col("r.end").alias("end_at"))


@query("trim_to_limit", f"""
SELECT doc_id, CASE WHEN len(k) > 250 THEN {sql_cut_last('text', 'k[251]')} ELSE text END AS text
FROM (SELECT doc_id, text, {sql_tokens('text')} AS k FROM documents)
""")
def _(t):
    return documents(t).select("doc_id", X.trim_to_limit(F.col("text"), "words", 250).alias("text"))


@query("trim_to_limit_exact", f"""
SELECT doc_id, CASE WHEN len(k) > 250
  THEN left(text, length(text) - length(array_to_string(k[251:], '')) - length(regexp_extract(text, {q(S + '*$')}))) || regexp_extract(k[251], {q('^' + S + '*')})
  ELSE text END AS text
FROM (SELECT doc_id, text, regexp_extract_all(text, {q(f'{S}*(?:{TOKEN})')}) AS k FROM documents)
""")
def _(t):
    return documents(t).select("doc_id", X.trim_to_limit(F.col("text"), "words", 250, exact=True).alias("text"))


@query("trim_to_sentence", f"""
SELECT doc_id, CASE WHEN {sql_fragment('list_last(s)')} THEN {sql_cut_last('text', 'list_last(s)')} ELSE text END AS text
FROM (SELECT doc_id, text, {sql_sentences('text')} AS s FROM documents)
""")
def _(t):
    return documents(t).select("doc_id", X.trim_to_sentence(F.col("text")).alias("text"))


@query("clean_suggestions", f"""
WITH a AS (SELECT uuid, generated AS previous, coalesce(finalized, '') AS response, status = 'done' AS complete,
    {sql_tokens("coalesce(finalized, '')")} AS k FROM suggestion),
b AS (SELECT *, CASE WHEN len(k) > 250 THEN {sql_cut_last('response', 'k[251]')} ELSE response END AS cut FROM a),
c AS (SELECT *, {sql_sentences('cut')} AS s, complete OR cut <> response AS done FROM b)
SELECT uuid, CASE WHEN previous = response THEN 'failed' WHEN done THEN 'done' ELSE 'executing' END AS status,
  CASE WHEN previous = response THEN previous
    WHEN done AND {sql_fragment('list_last(s)')} THEN {sql_cut_last('cut', 'list_last(s)')} ELSE cut END AS text
FROM c
""", "suggestion")
def _(t):
    rows = suggestions(t).select("uuid", F.col("generated").alias("previous"), F.coalesce("finalized", F.lit("")).alias("response"),
                               (F.col("status") == "done").alias("complete"))
    return clean_suggestions(rows).select("uuid", "status", "text")


SCORE_TEXT = "lower(trim(regexp_replace({0}, '[^A-Za-z0-9]+', ' ', 'g')))"


def sql_score_tokens(text: str) -> str:
    return f"list_filter(string_split({SCORE_TEXT.format(text)}, ' '), lambda x: x <> '')"


def sql_content_tokens(text: str) -> str:
    return f"list_filter(string_split({SCORE_TEXT.format(text)}, ' '), lambda x: x <> '' AND x NOT IN ({sql_list(STOPWORDS)}))"


@query("remove_stopwords", f"""
SELECT doc_id, len(k) AS n, array_to_string(k, ' ') AS tokens FROM (SELECT doc_id, {sql_content_tokens('text')} AS k FROM documents)
""")
def _(t):
    k = X.remove_stopwords(X.score_tokens(F.col("text")), STOPWORDS)
    return documents(t).select("doc_id", F.size(k).cast("long").alias("n"), F.array_join(k, " ").alias("tokens"))


@query("chunk_grams", f"""
WITH k AS (SELECT doc_id, {sql_ws_tokens('text')} AS k FROM documents),
g AS (SELECT doc_id, list_distinct(list_transform(range(0, (len(k) + 2) // 3), lambda i: array_to_string(k[i*3+1:i*3+3], ' '))) AS g FROM k)
SELECT doc_id, len(g) AS n, md5(array_to_string(list_sort(g), '|')) AS digest FROM g
""")
def _(t):
    rows = documents(t).select("doc_id", X.ws_tokens(F.col("text")).alias("k")).select("doc_id", X.chunk_grams(F.col("k")).alias("g"))
    return rows.select("doc_id", F.size("g").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("g"), "|")).alias("digest"))


@query("ngram_intersect", f"""
WITH k AS (SELECT uuid, {sql_ws_tokens('generated')} AS a, {sql_ws_tokens('finalized')} AS b FROM suggestion WHERE finalized IS NOT NULL),
g AS (SELECT uuid, list_transform(range(0, (len(a) + 2) // 3), lambda i: array_to_string(a[i*3+1:i*3+3], ' ')) AS a,
  list_transform(range(0, (len(b) + 2) // 3), lambda i: array_to_string(b[i*3+1:i*3+3], ' ')) AS b FROM k)
SELECT uuid, len(list_distinct(list_intersect(a, b))) AS shared FROM g
""", "suggestion")
def _(t):
    rows = suggestions(t).where("is_finalized").select("uuid", X.ws_tokens(F.col("generated")).alias("a"), X.ws_tokens(F.col("finalized")).alias("b"))
    rows = rows.select("uuid", X.chunk_grams(F.col("a")).alias("a"), X.chunk_grams(F.col("b")).alias("b"))
    return rows.select("uuid", F.size(F.array_intersect("a", "b")).cast("long").alias("shared"))


# --- values ---------------------------------------------------------------


@query("canonical_json", "SELECT event_id, replace(props, ' ', '') AS json FROM events")
def _(t):
    return t.raw("events").select("event_id", V.canonical_json(F.col("props")).alias("json"))


@query("content_hash", "SELECT event_id, md5(replace(props, ' ', '')) AS hash FROM events")
def _(t):
    return t.raw("events").select("event_id", V.content_hash(F.col("props")).alias("hash"))


@query("proj_json_text", "SELECT event_id, props::JSON->>'k' AS k FROM events")
def _(t):
    return t.raw("events").select("event_id", V.json_text(F.try_parse_json("props"), "$.k").alias("k"))


@query("parse_datetime", """
SELECT conv_id, turn, CASE WHEN length(text) % 5 = 0 THEN 'some day'
    WHEN turn % 2 = 0 THEN concat('2024-1-', turn + 1, ' 3:4:5 UTC') ELSE concat('2024-01-0', turn + 1, 'T03:04:05') END AS created_at,
  CASE WHEN length(text) % 5 <> 0 THEN concat('2024-01-0', turn + 1, ' 03:04:05') END AS parsed FROM conversations
""")
def _(t):
    rows = scene_entries(t.raw("conversations")).select("conv_id", "turn", F.get_json_object("entry", "$.created_at").alias("created_at"))
    return rows.withColumn("parsed", V.iso_text(V.parse_datetime(F.col("created_at"))))


@query("src_story_json", """
SELECT concat('c', conv_id) AS game_pid, turn, count(*) OVER w - 1 AS scenes, concat('c', conv_id) AS first_of, coalesce(lag(text) OVER w, '') AS last_text,
  count(*) OVER c AS all_scenes, arg_max(text, turn) OVER c AS end_text, CAST(sum(length(text)) OVER c AS BIGINT) AS chars
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), c AS (PARTITION BY conv_id)
""")
def _(t):
    """Whole exports, half of them written as gzip and half as deflate, and read back; a row for each turn, with what came before it."""
    path = scratch_path(t.spark, "stories")
    exports = story_exports(t.raw("conversations"))
    half = F.pmod(F.xxhash64("game_pid"), F.lit(2))
    for k, codec in enumerate(("gzip", "deflate")):
        exports.where(half == k).select("story").write.option("compression", codec).mode("append").text(path)
    story = read_story_json(t.spark, path, lines=True)
    of = lambda p, k="string": F.try_variant_get("story", p, k)
    entry = lambda s, p, k: F.try_variant_get(s, f"$.entries[0].{p}", k)
    scenes = F.transform(of("$.scenes", "array<variant>"), lambda s: F.struct(
        entry(s, "seq_id", "string").cast("long").alias("turn"), F.coalesce(entry(s, "description", "string"), F.lit("")).alias("text")))
    story = story.select(of("$.game_pid").alias("game_pid"), scenes.alias("told"), of("$.characters[0].description").alias("first_of"))
    turns = F.transform("told", lambda s, i: F.struct(
        s["turn"].alias("turn"), i.cast("long").alias("scenes"), F.coalesce(F.get("told", i - 1)["text"], F.lit("")).alias("last_text")))
    return story.select(
        "game_pid", F.inline(turns), F.replace("first_of", F.lit("Ada of "), F.lit("")).alias("first_of"), F.size("told").cast("long").alias("all_scenes"),
        F.try_element_at("told", F.lit(-1))["text"].alias("end_text"), F.aggregate("told", F.lit(0).cast("long"), lambda n, s: n + F.length(s["text"])).alias("chars")).select(
        "game_pid", "turn", "scenes", "first_of", "last_text", "all_scenes", "end_text", "chars")


@query("src_stopwords", r"SELECT DISTINCT lower(w) AS word FROM (SELECT unnest(string_split_regex(text, '[ \t\n\v\f\r]+')) AS w FROM benchmark) WHERE w <> ''")
def _(t):
    path = scratch_path(t.spark, "words")
    words = t.raw("benchmark").select(F.explode(F.split("text", r"[ \t\n\x0B\f\r]+")).alias("value"))
    words.select(F.concat(F.lit(" "), F.lower("value"), F.lit("  ")).alias("value")).write.text(path)
    return load_word_list(t.spark, path)


@query("src_blacklist", """
WITH bad AS (SELECT DISTINCT game_pid FROM story WHERE status = 'failed' AND game_pid IS NOT NULL)
SELECT id, hash, game_pid FROM story WHERE game_pid IS NOT NULL AND game_pid NOT IN (SELECT game_pid FROM bad)
""", "story")
def _(t):
    from draftlens.operators.reports import exclude_games

    path = scratch_path(t.spark, "games")
    bad = t.story.where("status = 'failed' AND game_pid IS NOT NULL").select(F.concat("game_pid", F.lit(" ")).alias("value"))
    bad.write.text(path)
    return exclude_games(t.story, load_word_list(t.spark, path)).select("id", "hash", "game_pid")


@query("names", """
SELECT DISTINCT event_type, concat('rouge-', user_id % 4 + 1) AS metric, concat('r', user_id % 4 + 1) AS abbrev,
  concat('story_', event_type) AS snake, printf('%.2f', value) AS shown FROM events
""")
def _(t):
    rows = t.raw("events").withColumn("metric", F.concat(F.lit("rouge-"), (F.col("user_id") % 4 + 1).cast("string")))
    camel = F.concat(F.lit("Story"), F.initcap("event_type"))
    return rows.select("event_type", "metric", X.metric_abbrev(F.col("metric")).alias("abbrev"),
                       X.snake_case(camel).alias("snake"), X.percent_format(F.col("value")).alias("shown")).distinct()
