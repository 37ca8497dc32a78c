"""Plain SQL with the results of the operators that SQL can express, over whole tables."""

from __future__ import annotations

from . import license_scan

_WORDS = "regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+')"


def _components(links: str, nodes: str) -> str:
    """WITH clauses ln(a, b) both ways, reach(a, b) and comp(id, c), the smallest id reachable."""
    return f"""ln AS (SELECT a, b FROM ({links}) UNION SELECT b, a FROM ({links})),
reach AS (SELECT a, b FROM ln UNION SELECT r.a, l.b FROM reach r JOIN ln l ON l.a = r.b),
comp AS (SELECT n.id, least(n.id, coalesce(min(r.b), n.id)) AS c FROM ({nodes}) n LEFT JOIN reach r ON r.a = n.id GROUP BY n.id)"""


def jaccard() -> str:
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text=low)} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ') || ' #' || len(w)] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w)),
n AS (SELECT w.doc_id, count(sh.s) AS n FROM w LEFT JOIN sh USING (doc_id) GROUP BY w.doc_id),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM met JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
{_components("SELECT a, b FROM link", "SELECT doc_id AS id FROM n")}
SELECT doc_id, n AS n_shingles, c AS component_id FROM n JOIN comp ON id = doc_id"""


def mix() -> str:
    return f"""WITH d AS (SELECT doc_id, source, CAST(len({_WORDS.format(text="coalesce(text, '')")}) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS turn FROM documents),
s AS (SELECT *, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS weight FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)),
r AS (SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / weight AS ratio FROM s),
lv AS (SELECT *, ((SELECT CAST(sum(source_size) AS DOUBLE) FROM s) - coalesce(sum(cap) OVER (ORDER BY ratio ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY ratio ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, weight, source_size, least(cap, (SELECT coalesce(arg_min(level, ratio) FILTER (level <= ratio), 0) FROM lv) * weight) AS target FROM lv),
o AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.weight, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY turn, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offs, CAST(floor(t.target + 0.5) AS BIGINT) AS need FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN source_size = 0 THEN 0 ELSE need // source_size * size + greatest(0, least(size, need - need // source_size * source_size - offs)) END AS BIGINT) AS taken,
CAST(CASE WHEN size = 0 THEN 0 ELSE (offs < need)::INT + (offs + source_size < need)::INT + (offs + 2 * source_size < need)::INT END AS BIGINT) AS passes,
-- the schedules of weights 1.5 - x, 1 and 0.5 + x over time x, integrated and inverted
round(CASE WHEN size > 0 AND offs < need THEN CASE weight WHEN 1 THEN 1.5 - sqrt(greatest(2.25 - 2 * offs / need, 0)) WHEN 2 THEN offs / need ELSE sqrt(0.25 + 2 * offs / need) - 0.5 END END, 6) AS first_position FROM o"""


def substrings() -> str:
    return f"""WITH d AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS c FROM win) WHERE c > 1),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
mark AS (SELECT p.doc_id, p.p, p.w[p.p] AS word, max(dup.i) OVER (PARTITION BY p.doc_id ORDER BY p.p) AS last FROM pos p LEFT JOIN dup ON dup.doc_id = p.doc_id AND dup.i = p.p),
kept AS (SELECT doc_id, count(*) FILTER (coalesce(last + 34 >= p, false)) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT coalesce(last + 34 >= p, false)) AS text FROM mark GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""


def embeddings() -> str:
    pairs = "SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id AND len(x.e) = len(y.e) WHERE list_dot_product(x.e, y.e) / (x.n * y.n) >= 0.93"
    return f"""WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0) WHERE len(list_filter(e, lambda x: x <> 0)) > 0),
link AS MATERIALIZED ({pairs}), {_components("SELECT a, b FROM link", "SELECT vec_id AS id FROM embeddings")}
SELECT vec_id, (SELECT count(*) FROM ln WHERE ln.a = vec_id) AS n_links, c AS component_id, c = vec_id AS kept FROM embeddings JOIN comp ON id = vec_id"""


def licenses() -> str:
    rows, idf, rare = license_scan.template_rows()
    vectors = ", ".join(f"('{a}', '{w}', {x!r}::DOUBLE)" for a, w, x in rows)
    known = ", ".join(f"('{w}', {x!r}::DOUBLE)" for w, x in sorted(idf.items()))
    trigger, word = license_scan.TRIGGER, license_scan.WORD
    return f"""WITH f AS (SELECT doc_id, source || '/' || lang || CASE WHEN doc_id % 2 = 1 THEN '/p' || CAST(doc_id % 97 AS VARCHAR) ELSE '' END || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, text FROM documents),
vec(license, word, share) AS (VALUES {vectors}), kn(word, idf) AS (VALUES {known}),
ul AS (SELECT doc_id, i AS line, l[i] AS unit FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM f WHERE regexp_matches(text, '{trigger}')) WHERE regexp_matches(l[i], '{trigger}')),
wd AS (SELECT doc_id, line, unnest(regexp_extract_all(lower(unit), '{word}')) AS word FROM ul),
bag AS (SELECT doc_id, line, word, count(*) AS n FROM wd GROUP BY ALL),
wt AS (SELECT bag.*, n * coalesce(idf, {rare!r}::DOUBLE) AS w FROM bag LEFT JOIN kn USING (word)),
nm AS (SELECT doc_id, line, sqrt(sum(w * w)) AS norm FROM wt GROUP BY ALL),
ms AS (SELECT * FROM (SELECT doc_id, line, license, round(sum(w * share) / any_value(norm), 6) AS score FROM wt JOIN vec USING (word) JOIN nm USING (doc_id, line) GROUP BY doc_id, line, license) WHERE score >= 0.6),
best AS (SELECT doc_id, split_part(arg_min(license, (-score, line, license)), '#', 1) AS own_license, max(score) AS own_score FROM ms GROUP BY doc_id),
own AS (SELECT b.*, (SELECT sum(len(regexp_extract_all(lower(unit), '{word}'))) FROM ul WHERE ul.doc_id = b.doc_id AND line IN (SELECT line FROM ms WHERE ms.doc_id = b.doc_id)) / greatest(len(regexp_extract_all(lower(f.text), '{word}')), 1) AS share FROM best b JOIN f USING (doc_id)),
p AS (SELECT f.doc_id, f.path, regexp_replace(f.path, '/?[^/]*$', '') AS dir, own_license, own_score, share FROM f LEFT JOIN own USING (doc_id)),
dl AS (SELECT dir, arg_min(own_license, (-share, path)) AS license FROM p WHERE share >= 0.2 GROUP BY dir),
nr AS (SELECT d.dir, arg_max(dl.license, len(dl.dir)) AS license, arg_max(dl.dir, len(dl.dir)) AS above FROM (SELECT DISTINCT dir FROM p) d JOIN dl ON dl.dir = d.dir OR dl.dir = '' OR starts_with(d.dir, dl.dir || '/') GROUP BY d.dir)
SELECT doc_id, path, own_license, own_score, coalesce(own_license, nr.license) AS license, CASE WHEN own_license IS NOT NULL THEN 'header' WHEN nr.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin, CASE WHEN own_license IS NULL THEN nr.above END AS inherited_from FROM p LEFT JOIN nr USING (dir)"""


ORACLES = {"op1_license_scan": licenses(), "op2_ngram_jaccard": jaccard(), "op3_source_mix": mix(), "op5_substring_dedup": substrings(), "op8_embedding_dedup": embeddings()}
