"""DuckDB oracle SQL, one string per registered query (the independent check).

Each string starts with the fixture CTEs it needs (``with_fixtures``) and spells the rules
out in plain SQL, so that it shares no code with the Spark operators it checks.
"""

from __future__ import annotations

from tidemark.sources.fixtures import AS_OF_SQL, CHUNK_BYTES, STALE_SECONDS, with_fixtures

WS = r"'^\s+|\s+$'"


def norm(x: str) -> str:
    return f"lower(regexp_replace({x}, {WS}, '', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {WS}, '', 'g')"


def video_like(mime: str, name: str) -> str:
    m, n = f"lower(coalesce({mime}, ''))", f"lower(coalesce({name}, ''))"
    sfx = " OR ".join(f"ends_with({n}, '{s}')" for s in
                      (".h265", ".hevc", ".265", ".mp4", ".mov", ".mkv", ".webm", ".m4v"))
    return f"(starts_with({m}, 'video/') OR {m} = 'application/vnd.google-apps.video' OR {sfx})"


def safe_name_ctes(src: str, name_col: str, out: str) -> str:
    """CTEs that add ``safe_name`` (sanitised ``name_col``) to ``src`` as relation ``out``."""
    return f"""
{out}_a AS (SELECT *, {strip(f"regexp_replace(regexp_replace(replace(coalesce({name_col}, ''), chr(0), ''), '[\\\\/]+', '_', 'g'), '[\\x00-\\x1f\\x7f]', '', 'g')")} AS _n0 FROM {src}),
{out}_b AS (SELECT *, CASE WHEN _n0 = '' THEN 'unnamed' ELSE _n0 END AS _n1,
                   regexp_extract(CASE WHEN _n0 = '' THEN 'unnamed' ELSE _n0 END, '\\.([^.]*)$', 1) AS _ext
            FROM {out}_a),
{out} AS (SELECT * EXCLUDE (_n0, _n1, _ext),
                 CASE WHEN length(_n1) <= 200 THEN _n1
                      WHEN position('.' IN _n1) > 0 AND length(_ext) <= 16
                        THEN substring(regexp_extract(_n1, '^(.*)\\.[^.]*$', 1), 1, 200 - length(_ext) - 1) || '.' || _ext
                      ELSE substring(_n1, 1, 200) END AS safe_name
          FROM {out}_b)"""


def key_expr(source: str, prefix: str | None, file_id: str, safe: str = "safe_name") -> str:
    p = source if prefix is None else f"coalesce({prefix}, {source})"
    return f"regexp_replace({strip(p)}, '^/+|/+$', '', 'g') || '/' || {file_id} || '_' || {safe}"


def meta_checksum(key: str = "meta_key", value: str = "meta_value") -> str:
    return f"CASE WHEN lower({key}) IN ('x-amz-meta-checksum', 'checksum') THEN {value} END"


def plan_sync_sql(select: str) -> str:
    return with_fixtures(f"""
WITH j AS (
  SELECT l.source_name, l.file_id, l.mime_type, l.md5, l.size AS l_size,
         c.id AS c_id, c.id IS NOT NULL AS c_present, c.file_name AS c_file_name,
         c.checksum AS c_checksum, c.size AS c_size, c.status AS status0, c.object_key AS c_object_key,
         c.attempt_count AS c_attempt_count, c.updated_at AS c_updated_at,
         coalesce(nullif(l.file_name, ''), c.file_name) AS eff_name
  FROM fx_listing l LEFT JOIN fx_catalog c ON c.source_name = l.source_name AND c.file_id = l.file_id
),
{safe_name_ctes("j", "eff_name", "jn")},
k AS (
  SELECT *, {key_expr("source_name", None, "file_id")} AS canonical_key,
         CASE WHEN status0 = 'CORRUPTED' AND NOT ({norm("c_checksum")} IS NOT DISTINCT FROM {norm("md5")})
              THEN 'NEW' ELSE status0 END AS status,
         coalesce(TRY_CAST(nullif({strip("CAST(l_size AS VARCHAR)")}, '') AS BIGINT), c_size, 0) AS eff_size
  FROM jn
),
o AS (
  SELECT k.*, i.object_key AS o_key, i.object_size AS o_size, {meta_checksum("i.meta_key", "i.meta_value")} AS o_checksum
  FROM k LEFT JOIN fx_inventory i ON i.object_key = k.canonical_key
),
f AS (
  SELECT *,
    o_key IS NOT NULL AS o_exists,
    coalesce(status0 = 'PROCESSING' AND c_updated_at > {AS_OF_SQL} - INTERVAL ({STALE_SECONDS}) SECOND, false) AS busy,
    coalesce(status0 = 'CORRUPTED' AND ({norm("c_checksum")} IS NOT DISTINCT FROM {norm("md5")}), false) AS skip_corrupted,
    NOT {video_like("mime_type", "eff_name")} AS non_video,
    eff_size <= 0 AS zero,
    o_key IS NOT NULL AND coalesce(o_size, 0) <> eff_size AS size_differs
  FROM o
),
g AS (
  SELECT *,
    coalesce(status = 'UPLOADED', false)
      AND coalesce(c_object_key, '') = canonical_key
      AND o_exists
      AND NOT coalesce(o_size IS NOT NULL AND eff_size <> o_size, false)
      AND NOT (o_exists AND md5 IS NOT NULL AND o_checksum IS NULL)
      AND NOT coalesce(o_checksum IS NOT NULL AND md5 IS NOT NULL AND {norm("o_checksum")} <> {norm("md5")}, false)
      AND ({norm("c_checksum")} IS NOT DISTINCT FROM {norm("md5")}) AS skip_db,
    o_exists AND NOT size_differs
      AND coalesce(o_checksum <> '' AND md5 <> '' AND {norm("o_checksum")} = {norm("md5")}, false) AS store_match
  FROM f
),
plan AS (
  SELECT source_name, file_id, eff_name AS file_name, md5 AS checksum, eff_size AS size,
         canonical_key AS object_key, status, c_id AS id, c_attempt_count AS attempt_count, o_size AS object_size,
         CASE WHEN NOT c_present THEN 'NO_ROW' WHEN busy THEN 'BUSY' WHEN skip_corrupted THEN 'SKIP_CORRUPTED'
              WHEN non_video THEN 'NON_VIDEO' WHEN zero THEN 'ZERO' WHEN skip_db THEN 'SKIP_DB'
              WHEN store_match AND status <> 'UPLOADED' THEN 'RECONCILE' WHEN store_match THEN 'SKIP_STORE'
              WHEN coalesce(c_attempt_count, 0) >= 5 THEN 'MAX_ATTEMPTS' ELSE 'TRANSFER' END AS action,
         CASE WHEN size_differs THEN 'size' WHEN o_exists THEN 'checksum'
              WHEN status = 'UPLOADED' THEN 'missing' ELSE 'new' END AS why
  FROM g
)
{select}
""", "fx_listing", "fx_catalog", "fx_inventory")



CAT = ("id, source_name, file_id, file_name, checksum, size, status, object_key, attempt_count, "
       "last_error, created_at, updated_at")
AS_OF = AS_OF_SQL
SYNC_FX = ("fx_listing", "fx_catalog", "fx_inventory")


def size_expr(x: str) -> str:
    return f"TRY_CAST(nullif({strip(f'CAST({x} AS VARCHAR)')}, '') AS BIGINT)"


def upsert_sql(requeue: bool, select: str = f"SELECT {CAT} FROM up") -> str:
    cond = (f"in_c AND in_l AND c_status IN ('UPLOADED', 'CORRUPTED') AND NOT "
            f"({norm('c_checksum')} IS NOT DISTINCT FROM {norm('md5')})") if requeue else "false"
    return with_fixtures(f"""
WITH l0 AS (SELECT source_name, file_id, coalesce(nullif(file_name, ''), 'unnamed') AS nm, md5,
                   coalesce({size_expr('size')}, 0) AS l_size FROM fx_listing),
{safe_name_ctes("l0", "nm", "l1")},
l AS (SELECT *, {key_expr("source_name", None, "file_id")} AS l_key FROM l1),
uj AS (
  SELECT coalesce(c.source_name, l.source_name) AS sn, coalesce(c.file_id, l.file_id) AS fid,
         c.id AS c_id, c.file_name AS c_file_name, c.checksum AS c_checksum, c.size AS c_size,
         c.status AS c_status, c.object_key AS c_object_key, c.attempt_count AS c_attempt_count,
         c.last_error AS c_last_error, c.created_at AS c_created_at, c.updated_at AS c_updated_at,
         l.file_id IS NOT NULL AS in_l, c.file_id IS NOT NULL AS in_c, l.nm, l.md5, l.l_size, l.l_key
  FROM fx_catalog c FULL OUTER JOIN l ON c.source_name = l.source_name AND c.file_id = l.file_id
),
um AS (
  SELECT c_id AS id, sn AS source_name, fid AS file_id,
         CASE WHEN in_l THEN nm ELSE c_file_name END AS file_name,
         CASE WHEN in_l THEN md5 ELSE c_checksum END AS checksum,
         CASE WHEN in_l THEN l_size ELSE c_size END AS size,
         CASE WHEN {cond} THEN 'NEW' WHEN in_c THEN c_status ELSE 'NEW' END AS status,
         CASE WHEN in_l THEN l_key ELSE c_object_key END AS object_key,
         CASE WHEN in_c THEN c_attempt_count ELSE 0 END AS attempt_count,
         c_last_error AS last_error,
         CASE WHEN in_c THEN c_created_at ELSE {AS_OF} END AS created_at,
         CASE WHEN in_l THEN {AS_OF} ELSE c_updated_at END AS updated_at
  FROM uj
),
up AS (
  SELECT coalesce(id, (SELECT max(id) FROM fx_catalog)
                      + row_number() OVER (PARTITION BY id IS NULL ORDER BY source_name, file_id)) AS id,
         * EXCLUDE (id)
  FROM um
)
{select}
""", *SYNC_FX)


def outcomes_sql(filter_: str) -> str:
    """Plan -> TRANSFER rows -> verify against the inventory -> outcomes CTE ``oc``."""
    return f""",
tr AS (SELECT * FROM plan WHERE action = 'TRANSFER'),
vt AS (SELECT tr.*, coalesce(i.object_size, 0) AS actual FROM tr LEFT JOIN fx_inventory i ON i.object_key = tr.object_key),
oc_all AS (
  SELECT source_name, file_id, CASE WHEN actual = size THEN 'ok' ELSE 'failed' END AS outcome, checksum, size,
         object_key,
         CASE WHEN actual <> size THEN 'upload truncated: store=' || format('{{:,}}', actual) || ' != source='
              || format('{{:,}}', size) || ' (lost ' || format('{{:,}}', size - actual) || ' bytes)' END AS message
  FROM vt
),
oc AS (SELECT * FROM oc_all WHERE {filter_})"""


def apply_sql(outcomes: str = "oc") -> str:
    return f"""
SELECT c.id, c.source_name, c.file_id, c.file_name,
       CASE WHEN o.outcome = 'ok' THEN o.checksum ELSE c.checksum END AS checksum,
       CASE WHEN o.outcome = 'ok' THEN o.size ELSE c.size END AS size,
       CASE o.outcome WHEN 'ok' THEN 'UPLOADED' WHEN 'failed' THEN 'FAILED' WHEN 'corrupted' THEN 'CORRUPTED'
            ELSE c.status END AS status,
       CASE WHEN o.outcome = 'ok' THEN o.object_key ELSE c.object_key END AS object_key,
       CASE o.outcome WHEN 'ok' THEN 0 WHEN 'failed' THEN c.attempt_count + 1 ELSE c.attempt_count END AS attempt_count,
       CASE o.outcome WHEN 'ok' THEN NULL WHEN 'failed' THEN substring(coalesce(o.message, ''), 1, 4000)
            WHEN 'corrupted' THEN substring(coalesce(nullif(o.message, ''), 'validation failed'), 1, 4000)
            ELSE c.last_error END AS last_error,
       c.created_at,
       CASE WHEN o.outcome IN ('ok', 'failed', 'corrupted') THEN {AS_OF} ELSE c.updated_at END AS updated_at
FROM fx_catalog c LEFT JOIN {outcomes} o ON o.source_name = c.source_name AND o.file_id = c.file_id"""


ARRIVALS = """arrivals AS (
  SELECT source_name, file_id, file_name, checksum AS md5, size, 0 AS seq FROM fx_catalog
  UNION ALL SELECT source_name, file_id, file_name, md5, size, 1 AS seq FROM fx_listing)"""

FILES_COLS = CAT


def page_sql(where: str, limit: int) -> str:
    return with_fixtures(f"SELECT {FILES_COLS} FROM fx_catalog WHERE {where} "
                         f"ORDER BY updated_at DESC, id DESC LIMIT {limit}", *SYNC_FX)


def audit_sql(full: bool, select: str) -> str:
    o_ck = meta_checksum("i.meta_key", "i.meta_value") if full else "CAST(NULL AS VARCHAR)"
    ck = (f"""CASE WHEN o_key IS NOT NULL AND coalesce(source_md5, '') <> '' AND coalesce(o_checksum, '') <> ''
                       AND {norm('source_md5')} <> {norm('o_checksum')} THEN 'checksum_mismatch' END,""" if full else "")
    return with_fixtures(f"""
WITH cfg AS (SELECT DISTINCT source_name, regexp_replace({strip('source_name')}, '^/+|/+$', '', 'g') AS prefix
             FROM fx_listing),
objs AS (SELECT cfg.source_name, i.object_key, i.object_size, {o_ck} AS o_checksum
         FROM fx_inventory i JOIN cfg ON starts_with(i.object_key, cfg.prefix)),
files AS (SELECT source_name, file_id, coalesce(file_name, '') AS file_name, md5 AS source_md5,
                 coalesce({size_expr('size')}, 0) AS source_size
          FROM fx_listing WHERE source_name IN (SELECT source_name FROM cfg)),
fa AS (SELECT f.*, c.status, c.object_key AS expected_key, o.object_key AS o_key, o.object_size AS o_size,
              o.o_checksum
       FROM files f
       LEFT JOIN fx_catalog c ON c.source_name = f.source_name AND c.file_id = f.file_id
       LEFT JOIN objs o ON o.source_name = f.source_name AND o.object_key = c.object_key),
fi AS (SELECT *, list_filter([
          CASE WHEN o_key IS NULL THEN 'missing_in_store' END,
          CASE WHEN o_key IS NOT NULL AND source_size > 0 AND o_size <> source_size THEN 'size_mismatch' END,
          {ck}
          CASE WHEN status IS NULL THEN 'not_in_db'
               WHEN status = 'UPLOADED' AND o_key IS NULL THEN 'db_inconsistent'
               WHEN status NOT IN ('UPLOADED', 'PROCESSING') AND o_key IS NOT NULL THEN 'db_inconsistent' END
        ], lambda x: x IS NOT NULL) AS issues
       FROM fa),
file_items AS (SELECT source_name, file_id, file_name, source_md5, source_size, expected_key AS object_key,
                      o_size AS object_size, o_checksum AS object_checksum, status, issues
               FROM fi WHERE len(issues) > 0),
matched AS (SELECT DISTINCT source_name, o_key AS object_key FROM fa WHERE o_key IS NOT NULL),
owners AS (SELECT source_name, object_key, arg_max(file_id, id) AS file_id, arg_max(file_name, id) AS file_name,
                  arg_max(status, id) AS status
           FROM fx_catalog WHERE coalesce(object_key, '') <> '' GROUP BY source_name, object_key),
orph AS (SELECT o.source_name, coalesce(w.file_id, 'unknown') AS file_id,
                coalesce(w.file_name, regexp_extract(o.object_key, '[^/]*$')) AS file_name,
                CAST(NULL AS VARCHAR) AS source_md5, CAST(0 AS BIGINT) AS source_size, o.object_key,
                o.object_size, CAST(NULL AS VARCHAR) AS object_checksum, w.status, ['orphaned_in_store'] AS issues
         FROM objs o LEFT JOIN owners w ON w.source_name = o.source_name AND w.object_key = o.object_key
         WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.source_name = o.source_name AND m.object_key = o.object_key)),
orphans AS (SELECT * FROM orph x
            WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.source_name = x.source_name AND f.file_id = x.file_id)),
items AS (SELECT * FROM file_items UNION ALL SELECT * FROM orphans)
{select}
""", *SYNC_FX)


ITEMS = ("source_name, file_id, file_name, source_md5, source_size, object_key, object_size, object_checksum, "
         "status, array_to_string(issues, ',') AS issues")


def bytes_sql(select: str, full: bool = False, as_files: bool = False) -> str:
    """K-05 over ``fx_bytes``; ``as_files`` counts and cuts bytes of UTF-8 instead of characters."""
    size = "strlen" if as_files else "length"

    def piece(column: str) -> str:
        return f"array_slice(encode({column}), r.off + 1, r.off + r.ln)" if as_files else f"substring({column}, r.off + 1, r.ln)"

    return with_fixtures(f"""
WITH files AS (SELECT doc_id, 'bytes/' || CAST(doc_id AS VARCHAR) AS object_key, {size}(source_bytes) AS source_size,
                      {size}(stored_bytes) AS store_size, source_md5, meta_checksum, source_bytes, stored_bytes
               FROM fx_bytes),
hashed AS (SELECT * FROM files WHERE store_size IS NOT NULL AND source_size = store_size),
rb AS (SELECT doc_id, source_size AS s, least(source_size, {CHUNK_BYTES}) AS ln FROM hashed WHERE source_size > 0),
rr AS (SELECT doc_id, 'head' AS name, 0 AS p, CAST(0 AS BIGINT) AS off, ln FROM rb
       UNION ALL SELECT doc_id, 'middle', 1, (s - ln) // 2, ln FROM rb
       UNION ALL SELECT doc_id, 'tail', 2, s - ln, ln FROM rb),
ranges AS (SELECT * FROM rr QUALIFY row_number() OVER (PARTITION BY doc_id, off, ln ORDER BY p) = 1),
cmp AS (SELECT r.doc_id, r.name, r.off AS "offset", r.ln AS length,
               sha256({piece('h.source_bytes')}) AS source_sha256,
               sha256({piece('h.stored_bytes')}) AS store_sha256
        FROM ranges r JOIN hashed h USING (doc_id)),
cmpm AS (SELECT *, coalesce(source_sha256 = store_sha256, false) AS match FROM cmp),
agg AS (SELECT doc_id, count(*) AS n_ranges, CAST(sum(CASE WHEN match THEN 1 ELSE 0 END) AS BIGINT) AS ranges_matched,
               bool_or(NOT match) AS any_mismatch, bool_and(match) AS all_match FROM cmpm GROUP BY doc_id),
fullm AS (SELECT doc_id, sha256(source_bytes) = sha256(stored_bytes) AS full_match FROM hashed),
rep AS (
  SELECT f.doc_id, f.object_key, CAST(f.source_size AS BIGINT) AS source_size, CAST(f.store_size AS BIGINT) AS store_size,
         CASE WHEN f.store_size IS NOT NULL THEN f.source_size = f.store_size END AS size_match,
         CASE WHEN coalesce(f.source_md5, '') <> '' AND coalesce(f.meta_checksum, '') <> ''
              THEN {norm('f.source_md5')} = {norm('f.meta_checksum')} END AS metadata_md5_match,
         {'CAST(0 AS BIGINT)' if full else 'coalesce(a.n_ranges, 0)'} AS n_ranges,
         {'CAST(0 AS BIGINT)' if full else 'coalesce(a.ranges_matched, 0)'} AS ranges_matched,
         {'fm.full_match' if full else 'CAST(NULL AS BOOLEAN)'} AS full_sha256_match,
         {'false' if full else 'coalesce(a.any_mismatch, false)'} AS any_mismatch,
         {'CAST(NULL AS BOOLEAN)' if full else 'a.all_match'} AS all_match
  FROM files f LEFT JOIN agg a USING (doc_id) LEFT JOIN fullm fm USING (doc_id)
),
verdicts AS (
  SELECT *, CASE WHEN coalesce(object_key, '') = '' THEN 'missing_store_key'
                 WHEN store_size IS NULL THEN 'missing_store_object'
                 WHEN NOT size_match THEN 'bytes_differ_upload_or_storage_suspect'
                 WHEN coalesce(NOT full_sha256_match, false) THEN 'bytes_differ_upload_or_storage_suspect'
                 WHEN any_mismatch THEN 'bytes_differ_upload_or_storage_suspect'
                 WHEN coalesce(NOT metadata_md5_match, false) THEN 'metadata_mismatch_upload_or_storage_suspect'
                 WHEN coalesce(full_sha256_match, false) THEN 'bytes_match_hook_or_splitter_suspect'
                 WHEN n_ranges > 0 AND coalesce(all_match, false) THEN 'sampled_bytes_match_run_full_for_proof'
                 ELSE 'inconclusive' END AS verdict
  FROM rep
)
{select}
""", "fx_bytes")


def stddev_expr(pixels: str = "pixels", scale: str = "scale") -> str:
    return (f"CASE WHEN {pixels} IS NULL THEN NULL WHEN len({pixels}) < 2 THEN 0.0 "
            f"ELSE list_stddev_samp(list_transform({pixels}, lambda x: CAST(x AS DOUBLE) * {scale})) END")


FRAMES_CTE = f"""samples AS (
  SELECT file_no AS doc_id, rel_offset AS rel, {stddev_expr()} AS variance,
         CASE WHEN abs(rel_offset - 0.97) < 1e-9 THEN 2.0 ELSE 8.0 END AS min_variance
  FROM fx_frames),
fv AS (
  SELECT doc_id,
         min(rel) FILTER (WHERE variance < min_variance) AS failed_rel,
         arg_min(variance, rel) FILTER (WHERE variance < min_variance) AS failed_variance,
         arg_min(min_variance, rel) FILTER (WHERE variance < min_variance) AS failed_min,
         arg_max(variance, rel) AS last_variance,
         count(*) AS n_samples
  FROM samples WHERE variance IS NOT NULL GROUP BY doc_id)"""

PROBE_CTE = """pr AS (
  SELECT doc_id, file_id, file_size, probe_json,
         list_filter(CAST(json_extract(probe_json, '$.streams') AS JSON[]),
                     lambda s: json_extract_string(s, '$.codec_type') = 'video')[1] AS v
  FROM fx_probe),
pp AS (
  SELECT doc_id, file_size, probe_json, probe_json IS NOT NULL AS probed, v IS NOT NULL AS has_video,
         coalesce(json_extract_string(v, '$.codec_name'), 'unknown') AS codec,
         coalesce(TRY_CAST(nullif(json_extract_string(v, '$.width'), '') AS INTEGER), 0) AS width,
         coalesce(TRY_CAST(nullif(json_extract_string(v, '$.height'), '') AS INTEGER), 0) AS height,
         TRY_CAST(coalesce(nullif(json_extract_string(probe_json, '$.format.duration'), ''),
                           nullif(json_extract_string(v, '$.duration'), '')) AS DOUBLE) AS duration_sec
  FROM pr)"""


def validate_sql(select: str) -> str:
    return with_fixtures(f"""
WITH {FRAMES_CTE},
{PROBE_CTE},
vm AS (
  SELECT pp.*, fv.failed_rel, fv.failed_variance, fv.failed_min, fv.last_variance,
         file_size < 5242880 AS too_small, NOT probed AS no_probe, NOT has_video AS no_video,
         duration_sec IS NOT NULL AND duration_sec < 5.0 AS short
  FROM pp LEFT JOIN fv ON fv.doc_id = pp.doc_id),
val AS (
  SELECT doc_id,
         CASE WHEN too_small THEN 'file too small: ' || format('{{:,}}', file_size) || ' B < 5,242,880 B'
              WHEN no_probe THEN 'probe failed'
              WHEN no_video THEN 'probe: no video stream found'
              WHEN short THEN 'duration too short: ' || printf('%.1f', duration_sec) || 's < 5.0s'
              WHEN failed_rel IS NOT NULL THEN 'frame variance too low at ' || printf('%.0f', failed_rel * 100)
                   || '%: ' || printf('%.1f', failed_variance) || ' < ' || printf('%.1f', failed_min)
                   || ' (green / gray / black frame)' END AS reason,
         NOT (too_small OR no_probe OR no_video) AS probed_ok, short, failed_rel, failed_variance, last_variance,
         duration_sec, codec, width, height
  FROM vm),
vr AS (
  SELECT doc_id, reason IS NULL AS ok, reason,
         CASE WHEN probed_ok THEN duration_sec END AS duration_sec, CASE WHEN probed_ok THEN codec END AS codec,
         CASE WHEN probed_ok THEN width END AS width, CASE WHEN probed_ok THEN height END AS height,
         CASE WHEN NOT probed_ok OR short THEN NULL WHEN failed_rel IS NOT NULL THEN failed_variance
              ELSE last_variance END AS variance
  FROM val)
{select}
""", "fx_probe", "fx_frames", "fx_listing", "fx_catalog")


def oracles() -> dict[str, str]:
    q: dict[str, str] = {}
    q["plan_sync"] = plan_sync_sql(
        "SELECT source_name, file_id, file_name, checksum, size, object_key, status, action, "
        "CASE WHEN action IN ('TRANSFER', 'MAX_ATTEMPTS') THEN why END AS reason FROM plan")
    q["sync_predicates"] = plan_sync_sql(f"""
SELECT source_name, file_id, busy AS is_fresh,
       NOT ({norm('c_checksum')} IS NOT DISTINCT FROM {norm('md5')}) AS checksum_changed,
       skip_db AS skip_from_catalog,
       coalesce(o_checksum <> '' AND md5 <> '' AND {norm('o_checksum')} = {norm('md5')}, false) AS skip_from_store,
       NOT (coalesce(c_attempt_count, 0) >= 5) AS attempts_left
FROM g WHERE c_present""")
    q["join_plan_inputs"] = plan_sync_sql("SELECT source_name, file_id, id, object_key, object_size FROM plan")

    q["upsert_discovered"] = upsert_sql(False)
    q["discover"] = upsert_sql(True)
    q["requeue_changed"] = upsert_sql(False, f"""
SELECT up.id, up.source_name, up.file_id, up.file_name, up.checksum, up.size, 'NEW' AS status, up.object_key,
       up.attempt_count, up.last_error, up.created_at, {AS_OF} AS updated_at
FROM up JOIN fx_catalog o ON o.source_name = up.source_name AND o.file_id = up.file_id
WHERE up.status IN ('UPLOADED', 'CORRUPTED')
  AND NOT ({norm('o.checksum')} IS NOT DISTINCT FROM {norm('up.checksum')})""")
    anti = ("FROM fx_listing l WHERE NOT EXISTS (SELECT 1 FROM fx_catalog c "
            "WHERE c.source_name = l.source_name AND c.file_id = l.file_id)")
    q["assign_ids"] = with_fixtures(
        "SELECT source_name, file_id, (SELECT max(id) FROM fx_catalog) + row_number() OVER "
        f"(ORDER BY source_name, file_id) AS id {anti}", *SYNC_FX)
    q["not_in_catalog"] = with_fixtures(f"SELECT source_name, file_id, file_name {anti}", *SYNC_FX)

    q["verify_transfer"] = plan_sync_sql(outcomes_sql("true") + "\nSELECT * FROM oc")
    q["mark_uploaded"] = plan_sync_sql(outcomes_sql("outcome = 'ok'") + apply_sql())
    q["mark_failed"] = plan_sync_sql(outcomes_sql("outcome = 'failed'") + apply_sql())
    q["reconcile_from_store"] = plan_sync_sql(""",
oc AS (SELECT source_name, file_id, 'ok' AS outcome, checksum, size, object_key, NULL AS message
       FROM plan WHERE action = 'RECONCILE')""" + apply_sql())
    q["reset_stale"] = with_fixtures(f"""
WITH s AS (SELECT *, coalesce(status = 'PROCESSING' AND updated_at < {AS_OF} - INTERVAL ({STALE_SECONDS}) SECOND,
                              false) AS stale FROM fx_catalog)
SELECT id, source_name, file_id, file_name, checksum, size, CASE WHEN stale THEN 'FAILED' ELSE status END AS status,
       object_key, attempt_count, CASE WHEN stale THEN 'stale_processing_reset' ELSE last_error END AS last_error,
       created_at, CASE WHEN stale THEN {AS_OF} ELSE updated_at END AS updated_at
FROM s""", *SYNC_FX)
    q["last_wins"] = with_fixtures(f"""WITH {ARRIVALS}
SELECT source_name, file_id, file_name, md5, size, seq FROM arrivals
QUALIFY row_number() OVER (PARTITION BY source_name, file_id ORDER BY seq DESC) = 1""", *SYNC_FX)
    q["key_violations"] = with_fixtures(f"""WITH {ARRIVALS}
SELECT source_name, file_id, count(*) AS n_rows FROM arrivals GROUP BY source_name, file_id HAVING count(*) > 1""",
                                        *SYNC_FX)
    q["count_files"] = with_fixtures("SELECT count(*) AS n_files FROM fx_catalog", *SYNC_FX)
    q["filter_files"] = with_fixtures(
        f"SELECT {CAT} FROM fx_catalog WHERE source_name = 'src3' AND file_name ILIKE '%CLIP_%'", *SYNC_FX)
    q["files_page"] = page_sql("status = 'UPLOADED' AND file_name ILIKE '%clip%'", 50)
    q["files_page_cursor"] = with_fixtures("""
WITH t AS (SELECT updated_at, id, row_number() OVER (ORDER BY updated_at DESC, id DESC) AS n
           FROM fx_catalog WHERE status = 'UPLOADED' AND file_name ILIKE '%clip%')
SELECT updated_at AS cursor_updated_at, id AS cursor_id FROM t
WHERE n = 50 AND EXISTS (SELECT 1 FROM t WHERE n = 51)""", *SYNC_FX)
    q["cursor_after"] = page_sql(
        "source_name = 'src7' AND (updated_at < TIMESTAMP '2024-01-20 12:00:00' OR "
        "(updated_at = TIMESTAMP '2024-01-20 12:00:00' AND id < 500))", 10)
    q["claim_next"] = with_fixtures(f"""
SELECT id, source_name, file_id, file_name, checksum, size, 'PROCESSING' AS status, object_key, attempt_count,
       last_error, created_at, {AS_OF} AS updated_at
FROM fx_catalog WHERE status IN ('NEW', 'FAILED') ORDER BY updated_at, id LIMIT 25""", *SYNC_FX)
    q["resolve_by_name"] = with_fixtures("""
WITH req AS (SELECT DISTINCT source_name, file_name FROM fx_listing),
cand AS (
  SELECT c.source_name, c.file_name, c.file_id, c.id, c.size, c.status, c.object_key, c.updated_at,
         count(*) OVER (PARTITION BY c.source_name, c.file_name) AS n_matches,
         row_number() OVER (PARTITION BY c.source_name, c.file_name ORDER BY c.updated_at DESC, c.id DESC) AS candidate_rank
  FROM fx_catalog c
  WHERE EXISTS (SELECT 1 FROM req r WHERE r.source_name = c.source_name AND r.file_name = c.file_name))
SELECT source_name, file_name, CASE WHEN n_matches = 1 THEN 'resolved' ELSE 'ambiguous' END AS outcome, n_matches,
       candidate_rank, file_id, id, size, status, object_key, updated_at FROM cand
UNION ALL
SELECT r.source_name, r.file_name, 'not_found', 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM req r
WHERE NOT EXISTS (SELECT 1 FROM fx_catalog c WHERE c.source_name = r.source_name AND c.file_name = r.file_name)""",
                                         *SYNC_FX)
    q["listing_projection"] = with_fixtures(
        "SELECT file_id, file_name, size, status, object_key, updated_at FROM fx_catalog", *SYNC_FX)

    q["file_expressions"] = with_fixtures(f"""
WITH lc AS (SELECT l.source_name, l.file_id, l.file_name, l.mime_type, l.size, c.checksum AS c_checksum,
                   c.size AS c_size, c.object_key AS c_object_key
            FROM fx_listing l LEFT JOIN fx_catalog c ON c.source_name = l.source_name AND c.file_id = l.file_id),
{safe_name_ctes("lc", "file_name", "ls")},
lk AS (SELECT *, {key_expr("source_name", None, "file_id")} AS built FROM ls)
SELECT source_name, file_id, {norm('c_checksum')} AS checksum_norm, safe_name, built AS built_key,
       regexp_replace('//' || built, '^/+', '') AS bucket_key, regexp_extract(c_object_key, '[^/]*$') AS key_basename,
       {video_like('mime_type', 'file_name')} AS video_like,
       coalesce({size_expr('size')}, c_size, 0) AS effective_size,
       coalesce(nullif(c_object_key, ''), built) AS expected_key
FROM lk""", *SYNC_FX)
    q["meta_checksum"] = with_fixtures(f"SELECT object_key, {meta_checksum()} AS checksum FROM fx_inventory", *SYNC_FX)
    q["join_listing_catalog"] = with_fixtures("""
SELECT l.source_name, l.file_id, l.file_name, c.id, c.status
FROM fx_listing l LEFT JOIN fx_catalog c ON c.source_name = l.source_name AND c.file_id = l.file_id""", *SYNC_FX)
    q["join_catalog_inventory"] = with_fixtures(f"""
SELECT c.id, c.object_key, i.object_size, {meta_checksum('i.meta_key', 'i.meta_value')} AS object_checksum
FROM fx_catalog c LEFT JOIN fx_inventory i ON i.object_key = c.object_key""", *SYNC_FX)
    q["config_join"] = with_fixtures(f"""
WITH cfg AS (SELECT source_name, CASE WHEN min(doc_id) % 2 = 0 THEN 'video/' || source_name END AS object_prefix
             FROM fx_listing GROUP BY source_name),
lc AS (SELECT l.source_name, l.file_id, l.file_name, cfg.object_prefix FROM fx_listing l
       LEFT JOIN cfg ON cfg.source_name = l.source_name),
{safe_name_ctes("lc", "file_name", "ls")}
SELECT source_name, file_id, object_prefix, {key_expr("source_name", "object_prefix", "file_id")} AS object_key
FROM ls""", *SYNC_FX)
    q["sync_counts"] = with_fixtures(f"""
SELECT source_name, count(*) AS discovered FROM fx_listing WHERE {video_like('mime_type', 'file_name')}
GROUP BY source_name""", *SYNC_FX)

    q["audit_sources"] = audit_sql(False, f"SELECT {ITEMS} FROM items")
    q["audit_union"] = audit_sql(True, f"SELECT {ITEMS} FROM items")
    q["audit_summary"] = audit_sql(False, """
SELECT source_name, issue, count(*) AS n FROM (SELECT source_name, unnest(issues) AS issue FROM items)
GROUP BY source_name, issue""")
    q["audit_totals"] = audit_sql(False, """
SELECT c.source_name,
       coalesce((SELECT count(DISTINCT file_id) FROM files f WHERE f.source_name = c.source_name), 0) AS total_files,
       coalesce((SELECT count(DISTINCT object_key) FROM objs o WHERE o.source_name = c.source_name), 0) AS total_objects,
       CAST(greatest(0, coalesce((SELECT count(DISTINCT file_id) FROM files f WHERE f.source_name = c.source_name), 0)
                       - coalesce((SELECT count(DISTINCT file_id) FROM file_items i WHERE i.source_name = c.source_name), 0))
            AS BIGINT) AS synced_ok
FROM (SELECT DISTINCT source_name FROM cfg) c""")
    q["orphan_objects"] = audit_sql(False, f"SELECT {ITEMS} FROM orphans")
    q["issue_set"] = audit_sql(False, "SELECT DISTINCT source_name, file_id FROM file_items")

    rep_cols = ("doc_id, object_key, source_size, store_size, size_match, metadata_md5_match, n_ranges, "
                "ranges_matched, full_sha256_match, verdict")
    q["diagnose_bytes"] = bytes_sql(f"SELECT {rep_cols}, 'chunks' AS mode FROM verdicts")
    q["diagnose_bytes_full"] = bytes_sql(f"SELECT {rep_cols}, 'full' AS mode FROM verdicts", full=True)
    q["diagnose_files"] = bytes_sql(f"SELECT {rep_cols}, 'chunks' AS mode FROM verdicts", as_files=True)
    q["diagnose_files_full"] = bytes_sql(f"SELECT {rep_cols}, 'full' AS mode FROM verdicts", full=True, as_files=True)
    q["range_read"] = bytes_sql('SELECT doc_id, name, "offset", length, source_sha256, store_sha256, match FROM cmpm', as_files=True)
    q["hash_compare"] = bytes_sql('SELECT doc_id, name, "offset", length, source_sha256, store_sha256, match FROM cmpm')
    q["all_ranges_match"] = bytes_sql("SELECT doc_id, n_ranges, ranges_matched, any_mismatch, all_match FROM agg")
    q["content_hash"] = with_fixtures(
        "SELECT doc_id, sha256(source_bytes) AS source_sha256, sha256(stored_bytes) AS store_sha256 FROM fx_bytes",
        "fx_bytes")
    ranges_all = f"""
WITH rb AS (SELECT doc_id, length(source_bytes) AS s, least(length(source_bytes), {CHUNK_BYTES}) AS ln
            FROM fx_bytes WHERE length(source_bytes) > 0),
rr AS (SELECT doc_id, 'head' AS name, 0 AS p, CAST(0 AS BIGINT) AS off, ln FROM rb
       UNION ALL SELECT doc_id, 'middle', 1, (s - ln) // 2, ln FROM rb
       UNION ALL SELECT doc_id, 'tail', 2, s - ln, ln FROM rb)
SELECT doc_id, name, off AS "offset", CAST(ln AS BIGINT) AS length FROM rr
QUALIFY row_number() OVER (PARTITION BY doc_id, off, ln ORDER BY p) = 1"""
    q["chunk_ranges"] = with_fixtures(ranges_all, "fx_bytes")
    q["range_distinct"] = with_fixtures(ranges_all, "fx_bytes")
    q["pixel_stddev"] = with_fixtures(
        f"SELECT file_no AS doc_id, sample_no, round({stddev_expr()}, 6) AS variance FROM fx_frames", "fx_frames")
    q["frame_verdict"] = with_fixtures(f"""WITH {FRAMES_CTE}
SELECT doc_id, failed_rel, round(failed_variance, 6) AS failed_variance, round(last_variance, 6) AS last_variance,
       n_samples FROM fv""", "fx_frames")
    q["validate_media"] = validate_sql(
        "SELECT doc_id, ok, reason, duration_sec, codec, width, height, round(variance, 6) AS variance FROM vr")
    q["parse_probe"] = with_fixtures(f"""WITH {PROBE_CTE}
SELECT doc_id, probed, has_video, codec, width, height, duration_sec FROM pp""", "fx_probe")
    q["sample_offsets"] = with_fixtures("""
SELECT doc_id, rel, (CAST(floor(CAST(file_size AS DOUBLE) * rel) AS BIGINT) // 1048576) * 1048576 AS "offset",
       CASE WHEN rel = 0.97 THEN 2.0 ELSE 8.0 END AS min_variance
FROM fx_probe, (SELECT CAST(unnest([0.0, 0.33, 0.66, 0.97]) AS DOUBLE) AS rel)""", "fx_probe")
    q["mark_corrupted"] = validate_sql(""",
oc AS (SELECT l.source_name, l.file_id, 'corrupted' AS outcome, NULL AS checksum, NULL AS size, NULL AS object_key,
              vr.reason AS message
       FROM vr JOIN fx_listing l ON l.doc_id = vr.doc_id WHERE vr.ok = false)""" + apply_sql())

    # ---------------------------------------------------------------- retrieval
    uws = (r"'^[\x{09}-\x{0d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}]+"
           r"|[\x{09}-\x{0d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}]+$'")
    texts = f"""texts AS (
  SELECT doc_id, source, '/corpus/' || source || '/docs/doc_' || CAST(doc_id AS VARCHAR) || '.md' AS path,
         CAST(n_chars AS VARCHAR) AS mtime, regexp_replace(text, {uws}, '', 'g') AS text
  FROM documents),
st AS (SELECT * FROM texts WHERE text <> '')"""
    nchunks = ("CASE WHEN length(text) = 0 THEN 0 ELSE 1 + CAST(ceil(greatest(length(text) - 2000, 0) / 1800) "
               "AS BIGINT) END")
    built = f"""WITH {texts},
cn AS (SELECT *, {nchunks} AS n FROM st),
ce AS (SELECT *, unnest(range(0, n)) AS j FROM cn),
idx AS (
  SELECT path || '::' || CAST(j AS VARCHAR) || '::' || mtime AS chunk_id, path AS file,
         source || '/docs/doc_' || CAST(doc_id AS VARCHAR) || '.md' AS rel_path, source AS repo,
         CAST(j AS BIGINT) AS chunk, n AS total_chunks, path || ':' || mtime AS file_mtime_key,
         substring(text, CAST(j AS BIGINT) * 1800 + 1, 2000) AS text
  FROM ce)"""
    q["read_text"] = f"WITH {texts} SELECT doc_id, text FROM st"
    q["chunk_text"] = f"""
WITH cn AS (SELECT doc_id, text, {nchunks} AS n FROM documents WHERE text IS NOT NULL),
ce AS (SELECT *, unnest(range(0, n)) AS j FROM cn)
SELECT doc_id, CAST(j AS BIGINT) AS chunk, n AS total_chunks, substring(text, CAST(j AS BIGINT) * 1800 + 1, 2000) AS text
FROM ce"""
    q["build_index"] = built + "\nSELECT chunk_id, file, rel_path, repo, chunk, total_chunks, file_mtime_key, text FROM idx"
    q["chunk_keys"] = built + "\nSELECT file, chunk, chunk_id, file_mtime_key FROM idx"
    q["corpus_stats"] = built + "\nSELECT repo, count(DISTINCT file) AS n_files, count(*) AS n_chunks FROM idx GROUP BY repo"
    q["corpus_labels"] = f"""WITH {texts}
SELECT path, source AS repo, source || '/docs/doc_' || CAST(doc_id AS VARCHAR) || '.md' AS rel_path FROM texts"""
    q["unchanged_files"] = f"""WITH {texts},
keys AS (SELECT path || ':' || CASE WHEN doc_id % 3 = 0 THEN mtime ELSE mtime || '.old' END AS k
         FROM texts WHERE doc_id % 3 <> 2)
SELECT path, mtime FROM texts WHERE path || ':' || mtime NOT IN (SELECT k FROM keys)"""
    snip = ("'    ' || replace(substring({t}, 1, 400), chr(10), chr(10) || '    ') || CASE WHEN length({t}) > 400 "
            "THEN chr(10) || '    ... (' || CAST(length({t}) AS VARCHAR) || ' chars total)' ELSE '' END")
    q["snippet"] = f"SELECT doc_id, {snip.format(t='text')} AS snippet FROM documents"
    scored = """
WITH qv AS (SELECT query_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM fx_query),
cv AS (SELECT chunk_id, repo, rel_path, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM fx_corpus),
sc AS (SELECT qv.query_id, cv.chunk_id, cv.repo, cv.rel_path,
              list_dot_product(qv.v, cv.v) / (sqrt(list_dot_product(qv.v, qv.v)) * sqrt(list_dot_product(cv.v, cv.v))) AS raw
       FROM qv, cv),
sr AS (SELECT *, round(raw, 6) AS score FROM sc)"""
    top = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank"
    q["knn"] = with_fixtures(scored + f"\nSELECT query_id, {top}, chunk_id, score FROM sr QUALIFY rank <= 5",
                             "fx_query", "fx_corpus")
    q["knn_repo"] = with_fixtures(scored + f"\nSELECT query_id, {top}, chunk_id, score, repo FROM sr "
                                  "WHERE repo = 'repo3' QUALIFY rank <= 5", "fx_query", "fx_corpus")
    q["knn_postfilter"] = with_fixtures(scored + f""",
wide AS (SELECT query_id, {top}, chunk_id, score, rel_path FROM sr QUALIFY rank <= 15),
kept AS (SELECT query_id, rank AS wide_rank, chunk_id, score, rel_path FROM wide WHERE ends_with(rel_path, '.py'))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY wide_rank) AS rank, chunk_id, score, rel_path
FROM kept QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY wide_rank) <= 5""", "fx_query", "fx_corpus")
    q["similarity_join"] = with_fixtures(scored + "\nSELECT query_id, chunk_id, score FROM sr WHERE raw >= 0.25",
                                         "fx_query", "fx_corpus")
    q["knn_approx"] = q["knn"]
    q["search"] = with_fixtures(scored + f""",
hits AS (SELECT query_id, {top}, chunk_id, raw, rel_path FROM sr QUALIFY rank <= 5)
SELECT h.query_id, h.rank, h.rel_path, 'chunk 1/1' AS chunk_label, printf('%.3f', h.raw) AS score_text,
       {snip.format(t='d.text')} AS snippet
FROM hits h LEFT JOIN documents d ON d.doc_id = h.chunk_id""", "fx_query", "fx_corpus")

    # ---------------------------------------------------------------- streams (end state) and file sources
    q["stream_discover"] = upsert_sql(True, """
SELECT up.* REPLACE (CASE WHEN up.id > m.top THEN m.top + row_number() OVER (
         PARTITION BY up.id > m.top ORDER BY l.doc_id % 4, up.source_name, up.file_id) ELSE up.id END AS id)
FROM up LEFT JOIN fx_listing l ON l.source_name = up.source_name AND l.file_id = up.file_id
CROSS JOIN (SELECT max(id) AS top FROM fx_catalog) m""")
    snaps = f"""
WITH a AS (SELECT source_name, file_id, checksum AS md5, 0 AS snap FROM fx_catalog),
b AS (SELECT source_name, file_id, md5, 1 AS snap FROM fx_listing)
SELECT * FROM a
UNION ALL
SELECT b.* FROM b
WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.source_name = b.source_name AND a.file_id = b.file_id
                  AND {{cond}})"""
    q["stream_changes"] = with_fixtures(snaps.format(
        cond=f"{norm('a.md5')} IS NOT DISTINCT FROM {norm('b.md5')}"), *SYNC_FX)
    q["stream_dedupe"] = with_fixtures(snaps.format(
        cond=f"{norm('a.md5')} IS NOT DISTINCT FROM {norm('b.md5')}"), *SYNC_FX)
    q["stream_stale"] = with_fixtures(
        "SELECT DISTINCT source_name, file_id, true AS stale FROM fx_catalog WHERE status <> 'UPLOADED'", *SYNC_FX)
    files = """
WITH f AS (
  SELECT doc_id, source, text,
         source || '/' || CASE WHEN doc_id % 7 = 0 THEN 'node_modules' ELSE 'docs' END || '/doc_' || CAST(doc_id AS VARCHAR)
           || CASE WHEN doc_id % 5 = 0 THEN '.txt' WHEN doc_id % 11 = 0 THEN '.py' ELSE '.md' END AS rel,
         CAST(coalesce(strlen(text), 0) AS BIGINT) AS size
  FROM documents),
kept AS (SELECT * FROM f WHERE doc_id % 7 <> 0 AND doc_id % 5 <> 0 AND size <= 500000)"""
    q["scan_corpus"] = files + "\nSELECT rel, size FROM kept"
    q["scan_inventory"] = files + "\nSELECT rel AS object_key, size AS object_size FROM f WHERE starts_with(rel, 'src1')"
    q["stream_index"] = files + f""",
st AS (SELECT rel, source, regexp_replace(text, {uws}, '', 'g') AS text FROM kept),
cn AS (SELECT *, {nchunks} AS n FROM st WHERE text <> ''),
ce AS (SELECT *, unnest(range(0, n)) AS j FROM cn)
SELECT rel AS rel_path, source AS repo, CAST(j AS BIGINT) AS chunk, n AS total_chunks,
       substring(text, CAST(j AS BIGINT) * 1800 + 1, 2000) AS text
FROM ce"""

    cfg = """cfg AS (SELECT source_name,
       CASE WHEN min(doc_id) % 3 = 0 THEN '' ELSE md5(source_name) END AS folder_id,
       CASE WHEN min(doc_id) % 2 = 0 THEN 'video/' || source_name END AS object_prefix
FROM fx_listing GROUP BY source_name)"""
    q["source_config"] = with_fixtures(f"""WITH {cfg}
SELECT source_name, folder_id, object_prefix,
       length(folder_id) >= 1 AND length(source_name) BETWEEN 1 AND 128
         AND coalesce(length(object_prefix) <= 512, true) AS valid,
       array_to_string(list_filter([CASE WHEN length(source_name) NOT BETWEEN 1 AND 128 THEN 'name_length' END,
                                    CASE WHEN coalesce(length(folder_id), 0) < 1 THEN 'folder_id_empty' END,
                                    CASE WHEN length(object_prefix) > 512 THEN 'prefix_length' END],
                                   lambda x: x IS NOT NULL), ',') AS violations
FROM cfg""", *SYNC_FX)
    q["unknown_source"] = with_fixtures(f"""WITH {cfg}
SELECT DISTINCT 'src' || CAST(page_id % 25 AS VARCHAR) AS source_name FROM pages
WHERE 'src' || CAST(page_id % 25 AS VARCHAR) NOT IN (SELECT source_name FROM cfg)""", *SYNC_FX)
    q["config_diff"] = with_fixtures("""
WITH a AS (SELECT source_name, min(file_id) AS folder_id FROM fx_listing GROUP BY source_name),
b AS (SELECT source_name, min(file_id) AS folder_id FROM fx_catalog WHERE starts_with(file_id, 'f') GROUP BY source_name)
SELECT *, 'only_in_a' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
UNION ALL
SELECT *, 'only_in_b' AS side FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""", *SYNC_FX)
    q["scan_listing_pages"] = with_fixtures(f"""
SELECT source_name, file_id, file_name, mime_type, md5, size FROM fx_listing
WHERE {video_like('mime_type', 'file_name')} AND doc_id % 31 <> 0""", *SYNC_FX)
    q["stat_objects"] = with_fixtures(f"""
SELECT c.source_name, c.file_id, c.object_key, i.object_size, {meta_checksum('i.meta_key', 'i.meta_value')} AS checksum
FROM fx_catalog c LEFT JOIN fx_inventory i ON i.object_key = c.object_key""", *SYNC_FX)
    q["point_lookup"] = with_fixtures("""
WITH c AS (SELECT * FROM fx_catalog UNION ALL SELECT * FROM fx_catalog WHERE id % 50 = 0)
SELECT l.source_name, l.file_id, count(c.id) AS n_rows,
       CASE WHEN count(c.id) = 1 THEN max(c.id) END AS id, CASE WHEN count(c.id) = 1 THEN max(c.status) END AS status,
       CASE WHEN count(c.id) = 1 THEN max(c.object_key) END AS object_key
FROM (SELECT DISTINCT source_name, file_id FROM fx_listing) l
LEFT JOIN c ON c.source_name = l.source_name AND c.file_id = l.file_id GROUP BY l.source_name, l.file_id""", *SYNC_FX)
    q["fetch_metadata"] = with_fixtures("""
SELECT source_name, file_id, file_name, md5, size FROM fx_listing l WHERE EXISTS (
  SELECT 1 FROM fx_catalog c WHERE c.source_name = l.source_name AND c.file_id = l.file_id AND c.status = 'FAILED')""",
                                          *SYNC_FX)
    q["meta_file_id"] = with_fixtures(
        "SELECT doc_id, CASE WHEN doc_id % 4 <> 3 THEN file_id END AS meta_file_id FROM fx_listing", "fx_listing")
    job = files + f""",
v2 AS (SELECT doc_id, source, rel, CASE WHEN doc_id % 500 = 1 THEN repeat(text || ' ', CAST(ceil(500001.0 / (length(text) + 1)) AS BIGINT))
                                        WHEN doc_id % 3 = 0 THEN text || ' v2' ELSE text END AS text FROM kept),
sz AS (SELECT *, coalesce(strlen(text), 0) <= 500000 AS fits FROM v2),
st AS (SELECT doc_id, rel, source, fits, regexp_replace(coalesce(text, ''), {uws}, '', 'g') AS text FROM sz),
old AS (SELECT rel, regexp_replace(coalesce(text, ''), {uws}, '', 'g') <> '' AS indexed FROM kept)"""
    # A pruned run also drops the files that no longer belong to the corpus, here the large ones.
    q["index_job"] = job + f""",
cn AS (SELECT *, {nchunks} AS n FROM st WHERE text <> '' AND fits),
ce AS (SELECT *, unnest(range(0, n)) AS j FROM cn)
SELECT rel AS rel_path, source AS repo, CAST(j AS BIGINT) AS chunk, n AS total_chunks,
       substring(text, CAST(j AS BIGINT) * 1800 + 1, 2000) AS text
FROM ce"""
    q["index_job_counts"] = job + """,
r AS (SELECT st.*, fits AND (st.doc_id % 3 = 0 OR NOT old.indexed) AS again FROM st JOIN old USING (rel))
SELECT count(*) FILTER (again AND text <> '') AS processed, count(*) FILTER (fits AND NOT again) AS skipped,
       count(*) FILTER (again AND text = '') AS empty, CAST(0 AS BIGINT) AS unreadable,
       count(*) FILTER (NOT fits) AS oversized
FROM r"""
    q["oversized_files"] = files.replace(" AND size <= 500000", " AND size > 20000") + "\nSELECT rel, size FROM kept"
    paged = """
p AS (SELECT source_name, CAST(floor(doc_id / 200.0) AS BIGINT) AS page, 't' AS stem, 0 AS stray FROM fx_listing
      UNION ALL
      SELECT source_name, CAST(floor(doc_id / 200.0) AS BIGINT), 'stray', 1 FROM fx_listing WHERE doc_id % 10 = 0),
n AS (SELECT source_name, stem, stray, row_number() OVER w AS n, count(*) OVER (PARTITION BY source_name, stem) AS total
      FROM (SELECT DISTINCT * FROM p) WINDOW w AS (PARTITION BY source_name, stem ORDER BY page))"""
    q["listing_chain"] = with_fixtures("WITH" + paged + """
SELECT source_name, CASE WHEN n > 1 THEN stem || '-' || n WHEN stray = 1 THEN stem ELSE '' END AS token,
       CASE WHEN n < total THEN stem || '-' || (n + 1) END AS next,
       CASE WHEN stray = 0 THEN n - 1 END AS position, CASE WHEN stray = 1 THEN 'unreached' END AS issue
FROM n""", *SYNC_FX)
    q["scan_catalog"] = q["upsert_discovered"]
    q["discover_work"] = with_fixtures("SELECT DISTINCT source_name, file_id FROM fx_listing", *SYNC_FX)
    q["claim_next_catalog"] = with_fixtures(f"""
WITH c AS (SELECT id AS claimed FROM fx_catalog WHERE status IN ('NEW', 'FAILED') ORDER BY updated_at, id LIMIT 25)
SELECT id, source_name, file_id, file_name, checksum, size,
       CASE WHEN claimed IS NULL THEN status ELSE 'PROCESSING' END AS status, object_key, attempt_count, last_error,
       created_at, CASE WHEN claimed IS NULL THEN updated_at ELSE {AS_OF} END AS updated_at
FROM fx_catalog LEFT JOIN c ON claimed = id""", *SYNC_FX)
    q["offset_page"] = with_fixtures("""
WITH m AS (SELECT *, count(*) OVER () AS total FROM fx_catalog WHERE status = 'UPLOADED')
SELECT id, source_name, file_id, file_name, checksum, size, status, object_key, attempt_count, last_error, created_at,
       updated_at, total, total > 150 AS has_next
FROM m ORDER BY updated_at DESC, id DESC LIMIT 50 OFFSET 100""", *SYNC_FX)
    q["stable_change"] = with_fixtures("""
WITH c AS (SELECT file_no % 20 AS board, file_no * 4 + sample_no AS frame, scale, unnest(pixels) AS pixel,
                  unnest(range(0, 64)) AS cell FROM fx_frames),
h AS (SELECT board, cell, frame, abs(scale * CAST(pixel AS DOUBLE)) > 16 AS hit,
             row_number() OVER (PARTITION BY board, cell ORDER BY frame) AS place FROM c),
g AS (SELECT *, place - row_number() OVER (PARTITION BY board, cell ORDER BY frame) AS island FROM h WHERE hit)
SELECT board, cell, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS n_frames
FROM g GROUP BY board, cell, island HAVING count(*) >= 2""", "fx_frames")
    q["grid_offset"] = """
WITH o AS (SELECT label, 240 - median(200 + 4 * label + 100 * CAST(embedding[1] AS DOUBLE)) AS ox,
                  240 - median(240 + 100 * CAST(embedding[2] AS DOUBLE)) AS oy FROM embeddings GROUP BY label)
SELECT label, round(ox, 6) AS offset_x, round(oy, 6) AS offset_y, round(CASE WHEN abs(ox) > 5 THEN ox ELSE 0 END, 6) AS dx,
       round(CASE WHEN abs(oy) > 5 THEN oy ELSE 0 END, 6) AS dy FROM o"""
    q["merge_predictions"] = """
WITH p AS (SELECT doc_id, lang AS value, CASE WHEN doc_id % 17 <> 0 THEN CAST(doc_id * 37 % 101 AS DOUBLE) / 100 END AS confidence
           FROM documents WHERE doc_id % 5 <> 0
           UNION ALL
           SELECT doc_id, lang || '2', CAST(doc_id * 41 % 101 AS DOUBLE) / 100 FROM documents WHERE doc_id % 10 = 1),
f AS (SELECT doc_id, 'q' || quality AS value, CAST(doc_id * 53 % 101 AS DOUBLE) / 100 AS confidence FROM labels),
a AS (SELECT * FROM p WHERE value IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC NULLS LAST, value) = 1),
b AS (SELECT * FROM f WHERE value IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC NULLS LAST, value) = 1),
j AS (SELECT a.doc_id AS ad, a.value AS av, a.confidence AS ac, b.doc_id AS bd, b.value AS bv, b.confidence AS bc,
             coalesce(a.confidence >= 0.5, false) OR b.doc_id IS NULL AS own
      FROM a FULL JOIN b ON a.doc_id = b.doc_id)
SELECT CASE WHEN own THEN ad ELSE bd END AS doc_id, CASE WHEN own THEN av ELSE bv END AS value,
       CASE WHEN own THEN ac ELSE bc END AS confidence, CASE WHEN own THEN 'primary' ELSE 'fallback' END AS predictor FROM j"""
    q["sweep_leaderboard"] = r"""
WITH r AS (SELECT 'flag=' || l_returnflag || ';status=' || l_linestatus || ';tax\;rate=' || CAST(round(l_tax * 100) AS INT) AS setting,
                  l_suppkey % 8 AS board, CAST(l_quantity AS BIGINT) AS moves, l_orderkey * 10 + l_linenumber AS run FROM lineitem),
s AS (SELECT 'total' AS scope, CAST(NULL AS BIGINT) AS board, setting, count(*) AS n_runs, sum(moves) AS score FROM r GROUP BY setting
      UNION ALL SELECT 'board', board, setting, count(*), sum(moves) FROM r GROUP BY board, setting),
o AS (SELECT 'total' AS scope, CAST(NULL AS BIGINT) AS board, setting, run,
             row_number() OVER (PARTITION BY setting ORDER BY moves DESC, run) AS k FROM r
      UNION ALL SELECT 'board', board, setting, run, row_number() OVER (PARTITION BY board, setting ORDER BY moves DESC, run) FROM r)
SELECT s.scope, s.board, s.setting, s.n_runs, CAST(s.score AS BIGINT) AS score, o.run AS best_run,
       rank() OVER (PARTITION BY s.scope, s.board ORDER BY s.score DESC) AS place,
       dense_rank() OVER (PARTITION BY s.scope, s.board ORDER BY s.score DESC) AS dense_place
FROM s JOIN o ON o.scope = s.scope AND o.board IS NOT DISTINCT FROM s.board AND o.setting = s.setting AND o.k = 1"""
    q["orient_board"] = """
WITH f AS (SELECT label, vec_id, list_transform(embedding, lambda e: CASE WHEN e > 0.1 THEN 'P' WHEN e < -0.1 THEN 'p' ELSE '.' END) AS c
           FROM embeddings),
t AS (SELECT label, len(list_filter(c[1:8], lambda x: x = 'P')) > len(list_filter(c[1:8], lambda x: x = 'p')) AS reversed
      FROM f QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1)
SELECT label, vec_id, array_to_string(CASE WHEN reversed THEN list_reverse(c) ELSE c END, '') AS cells, reversed
FROM f JOIN t USING (label)"""
    return q
