"""DuckDB SQL for the queries over pairs and passages: brute force over whole tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _components(links: str, items: str) -> str:
    """CTEs after which comp (id, component) has the smallest id that each id reaches."""
    return f"""both_ways AS (SELECT a, b FROM {links} UNION SELECT b, a FROM {links}),
reach(id, other) AS (SELECT id, id FROM {items} UNION SELECT r.id, l.b FROM reach r JOIN both_ways l ON l.a = r.other),
comp AS (SELECT id, min(other) AS component FROM reach GROUP BY id)"""


def substring(window: int = 20) -> str:
    return f"""WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - {window - 2})) AS p FROM w WHERE len(w) >= {window}),
placed AS (SELECT doc_id, p, row_number() OVER (PARTITION BY array_to_string(w[p:p + {window - 1}], ' ') ORDER BY doc_id, p) AS place FROM starts),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + {window})) AS i FROM placed WHERE place > 1),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS s FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(kept.s, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)"""


def minhash(words: int = 3, percent: int = 85) -> str:
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(words))
    return f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
sets AS (SELECT doc_id AS id, CASE WHEN len(w) >= {words} THEN list_distinct(list_transform(range(1, len(w) - {words - 2}), lambda i: {gram})) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
items AS (SELECT id, len(s) AS n, unnest(s) AS g FROM sets),
common AS (SELECT x.id AS a, y.id AS b, x.n AS m, y.n AS n, count(*) AS k FROM items x JOIN items y ON x.g = y.g AND x.id < y.id AND 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * k >= {percent} * (m + n - k)),
{_components("links", "sets")},
classes AS (SELECT id, min(id) OVER (PARTITION BY array_to_string(list_sort(s), chr(10))) AS class_id FROM sets WHERE len(s) > 0)
SELECT s.id AS doc_id, len(s.s) AS n_shingles, component AS component_id, component = s.id AS kept, class_id FROM sets s JOIN comp USING (id) LEFT JOIN classes USING (id)"""


def vectors(cosine: float = 0.9) -> str:
    return f"""WITH RECURSIVE raw AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
usable AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS n FROM raw WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT x.id AS a, y.id AS b FROM usable x JOIN usable y ON x.id < y.id AND len(x.v) = len(y.v) WHERE list_dot_product(x.v, y.v) / (x.n * y.n) >= {cosine}),
{_components("links", "raw")},
counts AS (SELECT a AS id, count(*) AS n FROM both_ways GROUP BY a),
classes AS (SELECT id, min(id) OVER (PARTITION BY v) AS class_id FROM usable)
SELECT r.id AS vec_id, coalesce(counts.n, 0) AS n_links, component AS component_id, component = r.id AS kept, class_id FROM raw r JOIN comp USING (id) LEFT JOIN counts USING (id) LEFT JOIN classes USING (id)"""
