"""Fixture views that bind the operators' inputs to the driver tables (FIXTURES.md part B).

The same SQL text runs on Spark (through ``spark.sql`` with DataFrame arguments, so no
global view names are needed) and, as CTEs, at the head of each DuckDB oracle string.
Placeholders in braces name a base table or an earlier fixture.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.sources.tables import table

# The fixture definitions of FIXTURES.md part B, in their given order.
FIXTURE_SQL: dict[str, str] = {
    "fx_listing": """
SELECT d.doc_id,
       d.source AS source_name,
       concat('f', CAST(d.doc_id AS STRING)) AS file_id,
       CASE d.doc_id % 8
         WHEN 0 THEN concat('clip_', CAST(d.doc_id AS STRING), '.mp4')
         WHEN 1 THEN concat('CLIP_', CAST(d.doc_id AS STRING), '.H265')
         WHEN 2 THEN concat('notes_', CAST(d.doc_id AS STRING), '.pdf')
         WHEN 3 THEN concat('a/b', chr(92), CAST(d.doc_id AS STRING), '.mov')
         WHEN 4 THEN 'same_name.mkv'
         WHEN 5 THEN concat('raw_', CAST(d.doc_id AS STRING))
         WHEN 6 THEN concat('  cam ', CAST(d.doc_id AS STRING), '.hevc ')
         ELSE concat('clip_', CAST(d.doc_id AS STRING), '.webm') END AS file_name,
       CASE d.doc_id % 8
         WHEN 1 THEN 'application/octet-stream'
         WHEN 2 THEN 'application/pdf'
         WHEN 5 THEN 'video/h265'
         ELSE 'video/mp4' END AS mime_type,
       CASE WHEN d.doc_id % 19 = 0 THEN NULL ELSE md5(d.text) END AS md5,
       CASE WHEN d.doc_id % 29 = 0 THEN 0 ELSE d.n_chars * 10000 END AS size
FROM {documents} d
""",
    "fx_catalog": """
SELECT l.doc_id + 1 AS id,
       l.source_name, l.file_id,
       CASE WHEN l.doc_id % 41 = 0 THEN 'old_name.mp4' ELSE l.file_name END AS file_name,
       CASE WHEN l.doc_id % 7 = 0 THEN md5(concat(d.text, 'x'))
            WHEN l.md5 IS NULL THEN NULL
            ELSE concat(' ', upper(l.md5)) END AS checksum,
       l.size,
       CASE (l.doc_id * 7 + 3) % 10
         WHEN 0 THEN 'NEW' WHEN 6 THEN 'PROCESSING' WHEN 7 THEN 'FAILED'
         WHEN 8 THEN 'CORRUPTED' WHEN 9 THEN 'NEW' ELSE 'UPLOADED' END AS status,
       CASE WHEN l.doc_id % 23 = 0 THEN NULL
            ELSE concat(l.source_name, '/', l.file_id, '_',
                        trim(replace(replace(l.file_name, '/', '_'), chr(92), '_'))) END AS object_key,
       CAST(l.doc_id % 7 AS INT) AS attempt_count,
       CASE WHEN (l.doc_id * 7 + 3) % 10 = 7 THEN 'timeout' ELSE NULL END AS last_error,
       e.ts AS created_at,
       e.ts AS updated_at
FROM {fx_listing} l
JOIN {documents} d ON d.doc_id = l.doc_id
JOIN {events} e ON e.event_id = l.doc_id
WHERE l.doc_id % 11 <> 0
UNION ALL
SELECT 1000000 + p.page_id, concat('src', CAST(p.page_id % 20 AS STRING)),
       concat('gone', CAST(p.page_id AS STRING)),
       concat('gone_', CAST(p.page_id AS STRING), '.mp4'),
       md5(p.url), 1000, 'UPLOADED',
       concat('src', CAST(p.page_id % 20 AS STRING), '/gone', CAST(p.page_id AS STRING),
              '_gone_', CAST(p.page_id AS STRING), '.mp4'),
       0, NULL, e.ts, e.ts
FROM {pages} p
JOIN {events} e ON e.event_id = p.page_id
WHERE p.page_id % 3 = 0
""",
    "fx_inventory": """
SELECT concat(l.source_name, '/', l.file_id, '_',
              trim(replace(replace(l.file_name, '/', '_'), chr(92), '_'))) AS object_key,
       CASE WHEN l.doc_id % 13 = 0 THEN l.size - 1 ELSE l.size END AS object_size,
       CASE WHEN l.doc_id % 2 = 0 THEN 'X-Amz-Meta-Checksum' ELSE 'checksum' END AS meta_key,
       CASE WHEN l.doc_id % 10 = 0 THEN NULL
            WHEN l.doc_id % 17 = 0 THEN md5('old')
            WHEN l.md5 IS NULL THEN ''
            ELSE upper(l.md5) END AS meta_value
FROM {fx_listing} l
WHERE l.doc_id % 9 <> 0 AND l.doc_id % 29 <> 0 AND l.doc_id % 8 <> 2
UNION ALL
SELECT concat('src', CAST(p.page_id % 20 AS STRING), '/',
              CASE WHEN p.page_id % 3 = 0
                   THEN concat('gone', CAST(p.page_id AS STRING), '_gone_', CAST(p.page_id AS STRING), '.mp4')
                   ELSE concat('stray_', CAST(p.page_id AS STRING), '.mp4') END),
       1000, 'checksum', md5(p.url)
FROM {pages} p
""",
    "fx_bytes": """
SELECT d.doc_id, d.text AS source_bytes,
       CASE WHEN d.doc_id % 12 = 0 THEN NULL
            WHEN d.doc_id % 13 = 0 THEN substring(d.text, 1, length(d.text) - 1)
            WHEN d.doc_id % 14 = 0 AND length(d.text) > 1
              THEN concat(substring(d.text, 1, length(d.text) - 1), '#')
            ELSE d.text END AS stored_bytes,
       md5(d.text) AS source_md5,
       CASE WHEN d.doc_id % 15 = 0 THEN md5('old') WHEN d.doc_id % 16 = 0 THEN NULL
            ELSE upper(md5(d.text)) END AS meta_checksum
FROM {documents} d
""",
    "fx_corpus": """
SELECT vec_id AS chunk_id, embedding,
       concat('repo', CAST(label AS STRING)) AS repo,
       concat('repo', CAST(label AS STRING), '/dir/file_', CAST(vec_id AS STRING),
              CASE vec_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.md' WHEN 2 THEN '.yaml' ELSE '.sh' END) AS rel_path
FROM {embeddings}
""",
    "fx_query": """
SELECT vec_id AS query_id, embedding FROM {embeddings} WHERE vec_id % 100 = 0
""",
    "fx_frames": """
SELECT CAST(floor(vec_id / 4.0) AS BIGINT) AS file_no,
       CAST(vec_id % 4 AS INT) AS sample_no,
       CAST(CASE vec_id % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 0.33 WHEN 2 THEN 0.66 ELSE 0.97 END AS DOUBLE) AS rel_offset,
       embedding AS pixels,
       CAST(40 * (vec_id % 5) AS DOUBLE) AS scale
FROM {embeddings}
""",
    "fx_probe": """
SELECT doc_id, concat('f', CAST(doc_id AS STRING)) AS file_id, n_chars * 10000 AS file_size,
       CASE doc_id % 6
         WHEN 0 THEN '{"streams":[{"codec_type":"audio"}],"format":{}}'
         WHEN 1 THEN '{"streams":[{"codec_type":"video","codec_name":"hevc","width":1920,"height":1080}],"format":{"duration":"3.5"}}'
         WHEN 2 THEN '{"streams":[{"codec_type":"video","width":640}],"format":{"duration":"N/A"}}'
         WHEN 3 THEN '{"streams":[{"codec_type":"audio"},{"codec_type":"video","codec_name":"h264","width":1280,"height":720,"duration":"60.0"}],"format":{}}'
         WHEN 4 THEN NULL
         ELSE '{"streams":[{"codec_type":"video","codec_name":"hevc","width":1920,"height":1080}],"format":{"duration":"3600.0"}}'
       END AS probe_json
FROM {documents}
""",
}

# Timestamps of the fixtures are TIMESTAMP_NTZ; the sync clock is the newest catalog change.
AS_OF_SQL = "(SELECT max(updated_at) FROM fx_catalog)"
STALE_SECONDS = 86400
CHUNK_BYTES = 64

_REF = re.compile(r"\{([a-z_]+)\}")
# JSON literals in fx_probe also hold braces; only bare lower-case names are references.
_NAMES = set(FIXTURE_SQL) | {
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
}


def _refs(sql: str) -> list[str]:
    return [m for m in dict.fromkeys(_REF.findall(sql)) if m in _NAMES]


def _spark_text(sql: str) -> str:
    # spark.sql(..., **kwargs) formats the text: double every brace that is not a reference.
    out, pos = [], 0
    for m in _REF.finditer(sql):
        out.append(sql[pos:m.start()].replace("{", "{{").replace("}", "}}"))
        out.append(m.group(0) if m.group(1) in _NAMES else m.group(0).replace("{", "{{").replace("}", "}}"))
        pos = m.end()
    out.append(sql[pos:].replace("{", "{{").replace("}", "}}"))
    return "".join(out)


def fixture(spark: SparkSession, sf_dir: str, name: str, _memo: dict | None = None) -> DataFrame:
    """The fixture view ``name`` as a Spark DataFrame over the tables under ``sf_dir``.

    ``fx_inventory`` carries its metadata pair as ``metadata MAP<STRING,STRING>``.
    """
    memo = {} if _memo is None else _memo
    if name in memo:
        return memo[name]
    if name not in FIXTURE_SQL:
        df = table(spark, sf_dir, name)
    else:
        sql = FIXTURE_SQL[name]
        args = {ref: fixture(spark, sf_dir, ref, memo) for ref in _refs(sql)}
        df = spark.sql(_spark_text(sql), **args)
        if name == "fx_inventory":
            df = df.select("object_key", "object_size",
                           F.create_map("meta_key", "meta_value").alias("metadata"))
    memo[name] = df
    return df


def fixtures(spark: SparkSession, sf_dir: str, *names: str) -> tuple[DataFrame, ...]:
    memo: dict = {}
    return tuple(fixture(spark, sf_dir, n, memo) for n in names)


def with_fixtures(sql: str, *names: str) -> str:
    """Prefix a DuckDB oracle query with the fixture CTEs it needs (in dependency order)."""
    needed: list[str] = []

    def visit(n: str) -> None:
        if n in FIXTURE_SQL and n not in needed:
            for ref in _refs(FIXTURE_SQL[n]):
                visit(ref)
            needed.append(n)

    for n in names:
        visit(n)
    ctes = []
    for n in needed:
        body = FIXTURE_SQL[n]
        for ref in _refs(body):
            body = body.replace("{" + ref + "}", ref)
        ctes.append(f"{n} AS ({body.strip()})")
    body = sql.strip()
    if body[:4].upper() == "WITH":
        return "WITH " + ",\n".join(ctes) + ",\n" + body[4:].lstrip()
    return "WITH " + ",\n".join(ctes) + "\n" + body
