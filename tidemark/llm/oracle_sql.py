"""DuckDB SQL for the rows of operators 1, 4 and 7, written from their contracts.

Each compares everything with everything by plain joins, which is right for checking small
tables and nothing else.
"""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Smallest id reachable from every id of ``ids(id)`` over the links ``e(x, y)``.
_REACH = """both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (SELECT id AS a, id AS b FROM ids UNION SELECT reach.a, l.y FROM reach JOIN both_ways l ON reach.b = l.x),
comp AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)"""

OP1_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + least(len(w), 5) - 1], ' ') AS sh
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(sh, chr(10) ORDER BY sh)) AS same FROM g GROUP BY doc_id),
r AS (SELECT same, min(doc_id) AS id, any_value(n) AS n FROM n GROUP BY same),
ids AS (SELECT id FROM r),
rg AS (SELECT r.id, r.n, g.sh FROM r JOIN g ON g.doc_id = r.id),
p AS (SELECT a.id AS x, b.id AS y, a.n AS nx, b.n AS ny, count(*) AS c FROM rg a JOIN rg b ON a.sh = b.sh AND a.id < b.id
      GROUP BY ALL),
e AS (SELECT x, y FROM p WHERE 100 * c >= 85 * (nx + ny - c)),
{_REACH}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(r.id, d.doc_id) AS class_id,
       coalesce(comp.component_id, d.doc_id) AS component_id,
       coalesce(comp.component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.same = n.same LEFT JOIN comp ON comp.id = r.id
"""

OP4_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20)),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS nth FROM g),
gone AS (SELECT DISTINCT doc_id, x FROM (SELECT doc_id, unnest(range(p, p + 20)) AS x FROM f WHERE nth > 1)),
a AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS x FROM d),
k AS (SELECT a.doc_id, count(*) AS n_kept, string_agg(a.word, ' ' ORDER BY a.x) AS kept
      FROM a LEFT JOIN gone ON gone.doc_id = a.doc_id AND gone.x = a.x WHERE gone.x IS NULL GROUP BY a.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n_kept, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""

OP7_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS c FROM embeddings),
ok AS (SELECT vec_id AS id, c FROM v WHERE len(c) > 0 AND len(list_filter(c, lambda t: t IS NULL OR NOT isfinite(t))) = 0
       AND list_dot_product(c, c) > 0),
ids AS (SELECT id FROM ok),
e AS (SELECT a.id AS x, b.id AS y FROM ok a JOIN ok b ON a.id < b.id AND len(a.c) = len(b.c)
      WHERE list_dot_product(a.c, b.c) / (sqrt(list_dot_product(a.c, a.c)) * sqrt(list_dot_product(b.c, b.c))) >= 0.9),
{_REACH},
n AS (SELECT x AS id, count(*) AS n_links FROM both_ways GROUP BY x)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, coalesce(comp.component_id, v.vec_id) AS component_id,
       coalesce(comp.component_id, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN n ON n.id = v.vec_id LEFT JOIN comp ON comp.id = v.vec_id
"""
