"""The registered queries of the operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftlens.llm import bpe, centroids, chat, hard_negatives, html_text, license_scan, mixing, neighbours, quality, simhash, vector_dedup
from draftlens.llm.common import table
from draftlens.llm.repeated_bytes import repeated_bytes
from draftlens.llm.substring_dedup import maximal_repeats

#: The tokenizer's rank file.
RANKS = "byte_bpe_50k.tiktoken"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op1_substring_dedup", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
k AS (SELECT doc_id, i, ws[i] AS word, CASE WHEN i + 19 <= len(ws) THEN array_to_string(ws[i:i + 19], ' ') END AS win FROM p),
f AS (SELECT doc_id, i, word, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS late FROM k),
c AS (SELECT doc_id, i, word,
             max(CAST(late AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
      FROM f),
g AS (SELECT doc_id, sum(gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM c GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)
""")
def op1(spark, path):
    found = maximal_repeats(table(spark, path, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op8_suffix_array_dedup", """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, h, unnest(range(0, CAST(len(h) // 2 AS BIGINT))) AS i FROM b),
k AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS x,
             CASE WHEN 2 * i + 400 <= len(h) THEN md5(substr(h, 2 * i + 1, 400)) END AS win FROM p),
f AS (SELECT doc_id, i, x, win IS NOT NULL AND count(*) OVER (PARTITION BY win) > 1 AS again FROM k),
c AS (SELECT doc_id, i, x,
             max(CAST(again AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS gone
      FROM f),
e AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 AS opens FROM c),
g AS (SELECT doc_id, sum(gone) AS n, sum(CAST(opens AS INT)) AS spans,
             string_agg(x, '' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM e GROUP BY doc_id)
SELECT b.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM b LEFT JOIN g USING (doc_id)
""")
def op8(spark, path):
    found = repeated_bytes(table(spark, path, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


@query("op2_mixing", r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                  md5(concat('mix:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
      FROM d GROUP BY source),
r AS (SELECT *, 3 * source_size AS cap, 3 * source_size / w AS ratio, sum(source_size) OVER () AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(w) OVER (ORDER BY ratio, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
m AS (SELECT *, least(CAST(cap AS DOUBLE), max(CASE WHEN level <= ratio THEN level END) OVER () * w) AS target FROM l),
t AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS goal FROM m),
e AS (SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS epochs FROM t),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM d)
SELECT doc_id, p.source, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, goal - epochs * source_size - ahead)) AS BIGINT) AS taken
FROM p JOIN e ON p.source IS NOT DISTINCT FROM e.source
""")
def op2(spark, path):
    return mixing.mix(table(spark, path, "documents"))


@query("op5_byte_bpe")
def op5(spark, path):
    import public_tokenizers

    name = (public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    docs = table(spark, path, "documents").select("doc_id", "text")
    rows = bpe.encode(docs, *name, decoded_col="decoded")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op7_quality_classifier")
def op7(spark, path):
    rows = quality.select(table(spark, path, "documents").select("doc_id", "text"), table(spark, path, "labels"))
    return rows.select("doc_id", "importance", "key", "kept")


@query("op9_simhash_near_dedup")
def op9(spark, path):
    rows = simhash.near_duplicates(table(spark, path, "documents"))
    return rows.select("doc_id", simhash.hex_print(F.col("fp")).alias("fingerprint"), "component_id")


@query("op4_html_extraction")
def op4(spark, path):
    rows = html_text.main_text(table(spark, path, "pages"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))


PROBE = r"\### Assistant: </turn> ok"


@query("op6_chat_formatting", rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'),
e AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) <> role, true) AS opens,
             2 * length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '>', '')) AS n FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n + CASE WHEN opens THEN 15 + length(role) ELSE 7 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""")
def op6(spark, path):
    probe = [(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)]
    turns = table(spark, path, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame(probe, "conv_id long, turn long, role string, text string"))
    rows = chat.chat_format(turns)
    read = chat.read_turns(F.col("formatted"))
    rows = rows.select("conv_id", read.alias("turns"), chat.read_loss(F.col("segments")).alias("loss"), "formatted")
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


@query("op3_nearest_neighbours", """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
""")
def op3(spark, path):
    rows = table(spark, path, "embeddings")
    return neighbours.nearest(rows, rows["vec_id"] % 50 == 0)


@query("op10_embedding_near_dedup", """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS low FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, low AS component_id, vec_id = low AS kept
FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
""")
def op10(spark, path):
    return vector_dedup.near_duplicates(table(spark, path, "embeddings"))


def license_sql() -> str:
    """The templates as rows; words by regular expression, places by list comparison."""
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    rows = []
    for k, (base, label, words, at, key, must) in enumerate(license_scan.all_templates()):
        more = "[" + ", ".join(f"{{'pos': {i}, 'words': {listed(p)}}}" for i, p in [(at, key), *must]) + "]"
        rows.append(f"({k}, {str(base).lower()}, '{label}', {listed(words)}, {at}, {listed(key)}, {more})")
    return rf"""
WITH t(k, base, label, words, shift, key, must) AS (VALUES {", ".join(rows)}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{license_scan.UPPER}', '{license_scan.UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
n AS (SELECT count(*) AS n FROM d),
f AS (SELECT w, count(*) AS f FROM (SELECT unnest(list_distinct(ws)) AS w FROM d) GROUP BY w),
i AS (SELECT k, j, w, 1024 + CAST(floor(1024 * ln((n + 1) / (coalesce(f, 0) + 1))) AS BIGINT) AS idf
      FROM (SELECT k, unnest(range(0, len(words))) AS j, unnest(words) AS w FROM t) LEFT JOIN f USING (w), n),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS w FROM d),
c AS (SELECT doc_id, ws, pos - 1 AS start, pos - 1 - shift AS s, t.* FROM p JOIN t ON t.key[1] = w AND ws[pos:pos + len(key) - 1] = key),
a AS (SELECT doc_id, c.k, start, sum(CASE WHEN s + j >= 0 AND ws[s + j + 1] = i.w THEN idf ELSE 0 END) / sum(idf) AS share FROM c JOIN i ON i.k = c.k GROUP BY doc_id, c.k, start),
g AS (SELECT doc_id, start, base, label, share, base OR (share >= {license_scan.SHARE}
         AND len(list_filter(must, lambda m: s + m.pos < 0 OR ws[s + m.pos + 1:s + m.pos + len(m.words)] <> m.words)) = 0) AS whole
      FROM c JOIN a USING (doc_id, k, start))
SELECT d.doc_id, any_value(len(ws)) AS n_words, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (whole), '') AS labels,
       coalesce(max(share) FILTER (NOT base), 0.0) AS score
FROM d LEFT JOIN g USING (doc_id) GROUP BY d.doc_id
"""


@query("op11_license_scan", license_sql())
def op11(spark, path):
    rows = license_scan.license_scan(table(spark, path, "documents"))
    base = F.filter("places", lambda p: p["base"])
    names = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    starts = F.transform(base, lambda p: p["start"])
    return rows.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                       names(base).alias("base_labels"), names(F.filter("places", lambda p: p["whole"])).alias("labels"),
                       F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.lit(0.0)).alias("score"))


def cluster_sql(k: int = 8, rounds: int = 10) -> str:
    """Every round spelled out; sums are exact, floors are those of negative numbers too."""
    def assigned(r):
        return f"""a{r} AS MATERIALIZED (SELECT vec_id, x, c, d FROM (SELECT vec_id, v.x, c, d, row_number() OVER (PARTITION BY vec_id ORDER BY d, c) AS nth
  FROM (SELECT v.vec_id, v.x, c.c, c.x AS y, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v, c{r} c) v) WHERE nth = 1)"""

    steps = [f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, x FROM v ORDER BY sha256('3:' || vec_id) LIMIT {k})"]
    for r in range(rounds):
        steps += [assigned(r), f"""u{r} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x
  FROM (SELECT c, i, sum(y) AS s, count(*) AS n FROM (SELECT c, unnest(range(1, 65)) AS i, unnest(x) AS y FROM a{r}) GROUP BY c, i) GROUP BY c)""",
                  f"c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(u{r}.x, c{r}.x) AS x FROM c{r} LEFT JOIN u{r} USING (c))"]
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
{", ".join(steps)}, {assigned(rounds)}
SELECT vec_id, CAST(a.c AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} USING (c)
"""


@query("op12_centroid_clustering", cluster_sql())
def op12(spark, path):
    rows, _ = centroids.cluster(table(spark, path, "embeddings"))
    return rows.withColumns({c: F.col(c).try_cast("long") for c in ("cluster_inertia", "inertia")})


@query("op13_hard_negatives", """
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(list_zip(a.x, c.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank,
             vec_id AS negative_id, positive_score, score AS negative_score
      FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT * FROM n WHERE rank <= 5
""")
def op13(spark, path):
    rows = table(spark, path, "embeddings")
    turned = F.when(rows["vec_id"] % 7 == 0, (rows["label"] + 1) % 10).otherwise(rows["label"])
    return hard_negatives.mine(rows.select("vec_id", "embedding", turned.alias("label")))
