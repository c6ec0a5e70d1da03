"""How the domain tables follow from the raw Parquet tables.

One SQL text serves Spark and the DuckDB check: ``{name}`` marks a raw table.
All rows and whole texts are used; gaps (unrated, unfinished, unused) follow
from other columns, never from dropping rows.
"""

from __future__ import annotations

import re

DERIVED: dict[str, str] = {}

# The registry: one row per distinct source.
DERIVED["model"] = """
SELECT DISTINCT src AS id, concat('src', CAST(src AS STRING)) AS name,
       concat('http://model.example/', CAST(src AS STRING)) AS url,
       CASE WHEN src % 4 = 3 THEN 'scene_intro' ELSE 'scene_entry' END AS type,
       CASE WHEN src % 5 = 4 THEN 'inactive' ELSE 'active' END AS status,
       CASE WHEN src % 3 = 0 THEN -1 ELSE 10 * (src % 7) END AS quota
FROM (SELECT CAST(substr(source, 4) AS INT) AS src FROM {documents})
"""

# Story exports: every document is one (used), every page is one (never used).
# A third of all exports belong to one game.
DERIVED["story"] = """
SELECT id, hash,
       CASE WHEN n % 41 = 0 THEN NULL
            WHEN n % 3 = 0 THEN 'g0'
            ELSE concat('g', CAST(CAST(floor(n / 8) AS BIGINT) AS STRING)) END AS game_pid,
       concat('2024-', lpad(CAST(1 + n % 3 AS STRING), 2, '0'), '-',
              lpad(CAST(1 + (n * 7) % 28 AS STRING), 2, '0'), 'T',
              lpad(CAST(n % 24 AS STRING), 2, '0'), ':',
              lpad(CAST(n % 60 AS STRING), 2, '0'), ':00') AS exported_at,
       CASE WHEN n % 13 = 0 THEN 'failed' WHEN n % 13 = 1 THEN 'pending' ELSE 'ready' END AS status
FROM (SELECT doc_id AS id, doc_id AS n, md5(concat('story:', CAST(doc_id AS STRING))) AS hash
      FROM {documents}
      UNION ALL
      SELECT -1 - page_id AS id, page_id AS n, md5(concat('page:', CAST(page_id AS STRING))) AS hash
      FROM {pages})
"""

# Which model serves which story; poorly labelled documents have a second one.
DERIVED["assignment"] = """
SELECT CAST(substr(source, 4) AS INT) AS model_id,
       md5(concat('story:', CAST(doc_id AS STRING))) AS story_hash
FROM {documents}
UNION ALL
SELECT (CAST(substr(d.source, 4) AS INT) + 1) % 20 AS model_id,
       md5(concat('story:', CAST(d.doc_id AS STRING))) AS story_hash
FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id AND l.quality = 0
UNION ALL
SELECT CAST(page_id % 20 AS INT) AS model_id,
       md5(concat('page:', CAST(page_id AS STRING))) AS story_hash
FROM {pages}
"""

# One suggestion per document over its whole text. Toxic ones were never
# published, French ones unchanged, the rest reordered, reworded and extended.
DERIVED["suggestion"] = """
SELECT d.doc_id AS id, md5(concat('s', CAST(d.doc_id AS STRING))) AS uuid,
       md5(concat('story:', CAST(d.doc_id AS STRING))) AS story_hash,
       md5(concat('ctx:', CAST(d.doc_id AS STRING))) AS context_hash,
       'scene_entry' AS type,
       CASE WHEN d.doc_id % 53 = 0 THEN NULL
            WHEN d.doc_id % 3 = 0 THEN 'u0'
            ELSE concat('u', CAST(CAST(floor(sqrt(d.doc_id)) AS BIGINT) AS STRING)) END AS user_pid,
       concat('2024-', lpad(CAST(1 + d.doc_id % 2 AS STRING), 2, '0'), '-',
              lpad(CAST(1 + (d.doc_id * 11) % 28 AS STRING), 2, '0'), ' ',
              lpad(CAST(d.doc_id % 24 AS STRING), 2, '0'), ':00:00') AS created_at,
       make_timestamp(2024, CAST(1 + d.doc_id % 2 AS INT), CAST(1 + (d.doc_id * 11) % 28 AS INT),
                      CAST(d.doc_id % 24 AS INT), 0, 0) AS ts,
       CASE WHEN d.doc_id % 11 = 0 THEN 'failed' WHEN d.doc_id % 11 = 1 THEN 'executing'
            ELSE 'done' END AS status,
       coalesce(l.toxic, 0) <> 1 AS is_finalized,
       d.text AS generated,
       CASE WHEN coalesce(l.toxic, 0) = 1 THEN NULL
            WHEN d.lang = 'fr' THEN d.text
            ELSE concat(replace(replace(substr(d.text, 1 + CAST(floor(length(d.text) / 4) AS INT)),
                                        ' the ', ' that '), ' de ', ' '),
                        ' Nobody spoke for a while. ',
                        substr(d.text, 1, CAST(floor(length(d.text) / 4) AS INT))) END AS finalized
FROM {documents} d
LEFT JOIN {labels} l ON l.doc_id = d.doc_id
"""

# Ratings exist for labelled documents only, with gaps by label.
DERIVED["feedback"] = " UNION ALL ".join(
    f"""
SELECT md5(concat('s', CAST(doc_id AS STRING))) AS suggestion_id, '{kind}' AS type,
       CAST(1 + (doc_id + {3 * idx} + 2 * quality + (doc_id % 7) * {idx}) % 5 AS STRING) AS response
FROM {{labels}} WHERE {present}
"""
    for idx, (kind, present) in enumerate([
        ("fluency", "true"), ("relevance", "true"), ("coherence", "toxic = 0"), ("likeability", "quality = 1")])
) + """ UNION ALL
SELECT md5(concat('s', CAST(doc_id AS STRING))) AS suggestion_id, 'comments' AS type,
       concat('note ', CAST(doc_id AS STRING)) AS response
FROM {labels} WHERE quality = 1
"""

# Uploads of story text: every document and page, keyed by content.
DERIVED["upload_log"] = """
SELECT doc_id AS upload_id, md5(text) AS hash, doc_id % 13 = 0 AS failed FROM {documents}
UNION ALL
SELECT 1000000000000 + page_id AS upload_id, md5(html) AS hash, page_id % 13 = 0 AS failed FROM {pages}
"""

# Requests for a suggestion: one per event, for the story of the acting user.
DERIVED["request_log"] = """
SELECT event_id AS request_id, ts,
       md5(concat('story:', CAST(user_id * 8 AS STRING))) AS story_hash,
       CASE WHEN event_type = 'view' THEN md5(concat('ctx:', CAST(user_id * 8 AS STRING)))
            ELSE md5(props) END AS context_hash,
       'scene_entry' AS type,
       CASE WHEN event_type = 'error' THEN 'already written' END AS description
FROM {events}
"""

# Status changes; a third of them belong to one suggestion.
DERIVED["status_log"] = """
SELECT event_id, ts,
       CASE WHEN event_id % 3 = 0 THEN md5('s0') ELSE md5(concat('s', CAST(user_id AS STRING))) END AS uuid,
       CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'executing'
            WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'retired' END AS status
FROM {events}
"""

# Finalizations: users 0..9 name suggestions that do not exist.
DERIVED["finalize_log"] = """
SELECT event_id, ts, md5(concat('s', CAST((user_id - 10) * 5 AS STRING))) AS uuid,
       concat('edit ', props) AS entry
FROM {events}
"""

# Feedback submissions: one batch per event, one row per answer.
DERIVED["feedback_log"] = """
SELECT e.event_id * 8 + f.idx AS row_id, e.event_id AS batch_id, e.ts,
       md5(concat('s', CAST(e.user_id - 10 AS STRING))) AS suggestion_id, f.type,
       CASE WHEN f.type = 'comments' THEN e.props
            ELSE CAST(1 + (CAST(floor(e.value) AS BIGINT) + f.idx) % 6 AS STRING) END AS response
FROM {events} e
JOIN (SELECT 0 AS idx, 'fluency' AS type, 'signup' AS event_type
      UNION ALL SELECT 1, 'relevance', 'signup' UNION ALL SELECT 2, 'coherence', 'purchase'
      UNION ALL SELECT 3, 'likeability', 'purchase' UNION ALL SELECT 4, 'comments', 'click'
      UNION ALL SELECT 5, 'fluency', 'view' UNION ALL SELECT 0, 'fluency', 'error'
      UNION ALL SELECT 6, 'fluency', 'error' UNION ALL SELECT 1, 'relevance', 'view') f
  ON f.event_type = e.event_type
"""

# Outcome of handing each story to each of its models.
DERIVED["preprocess_log"] = """
SELECT md5(concat('story:', CAST(d.doc_id AS STRING))) AS story_hash,
       CAST(substr(d.source, 4) AS INT) AS model_id, d.lang <> 'fr' AS completed
FROM {documents} d
UNION ALL
SELECT md5(concat('story:', CAST(l.doc_id AS STRING))) AS story_hash, 20 AS model_id,
       l.toxic = 0 AS completed
FROM {labels} l
"""


def derive_sql(name: str) -> tuple[str, list[str]]:
    """The text of one derived table and the raw tables it names."""
    text = DERIVED[name]
    return text, sorted(set(re.findall(r"{(\w+)}", text)))


def duckdb_text(name: str) -> str:
    """The same text over plainly named tables."""
    return re.sub(r"{(\w+)}", r"\1", DERIVED[name])
