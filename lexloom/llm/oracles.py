"""DuckDB SQL for the rows of those queries that SQL can express, by brute force."""

from __future__ import annotations

from collections import Counter

from .license_scan import LICENSE_FILE, MARKS, MIDDLE, SHORT, TERM, THRESHOLD, anchor_places, inverse_frequencies, templates
from .source_mixture import MOST, SYMBOLS, WEIGHTS

NEAREST = """
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
q AS (SELECT vec_id, min(e) AS e FROM ok WHERE vec_id % 100 = 0 GROUP BY vec_id),
d AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda x, y: x + y)) AS score FROM q JOIN ok c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

JACCARD = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i : i + 4], ' '))) AS g FROM w WHERE len(w) > 0),
k AS (SELECT doc_id, len(g) AS n, array_to_string(list_sort(g), '|') AS k FROM g),
x AS (SELECT doc_id, unnest(g) AS gram FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS s FROM x a JOIN x b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT p.a, p.b FROM p JOIN k ka ON ka.doc_id = p.a JOIN k kb ON kb.doc_id = p.b WHERE p.s >= 0.8 * (ka.n + kb.n - p.s) - 1e-9),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
cls AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a),
deg AS (SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY a),
cpy AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS copy_id, count(*) OVER (PARTITION BY k) AS n_class FROM k)
SELECT d.doc_id, cls.class_id, coalesce(cpy.copy_id, d.doc_id) AS copy_id, coalesce(cpy.n_class, 1) AS n_class, coalesce(deg.n_links, 0) AS n_links
FROM documents d JOIN cls USING (doc_id) LEFT JOIN cpy USING (doc_id) LEFT JOIN deg USING (doc_id)
"""

MIXTURE = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    CASE WHEN coalesce(length(text), 0) = 0 THEN 0.25::DOUBLE ELSE 0.25::DOUBLE + 0.75::DOUBLE * length(translate(text, '{SYMBOLS}', '')) / length(text) END AS q,
    (('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, '')) || '|' || (row_number() OVER (PARTITION BY doc_id, source, coalesce(text, '')) - 1)), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM documents),
k AS (SELECT *, -ln(u) / q AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n, avg(q) AS quality FROM k GROUP BY source),
w AS (SELECT *, [{", ".join(f"{x}::DOUBLE" for x in WEIGHTS)}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}) + 1] AS w, {MOST}::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE)) / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
o AS (SELECT *, coalesce(min_by(CASE WHEN cap / w > level THEN level END, CASE WHEN cap / w > level THEN cap / w END) OVER (), 0::DOUBLE) AS open FROM l),
t AS (SELECT source, source_size, n, quality, CASE WHEN cap / w <= level THEN cap ELSE open * w END AS target FROM o),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-9)::BIGINT ELSE 0 END AS epochs, ceil(n / 4096.0::DOUBLE) AS ranges FROM t),
r AS (SELECT *, greatest(0::DOUBLE, target - epochs * source_size) AS rest FROM e),
p AS (SELECT k.*, r.source_size, r.target, r.epochs, r.rest, floor((1 - exp(-k.key * r.quality)) * r.ranges)::BIGINT AS slot FROM k JOIN r ON k.source IS NOT DISTINCT FROM r.source),
b AS (SELECT source, slot, sum(size)::BIGINT AS words, any_value(rest) AS rest FROM p GROUP BY source, slot),
c AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b),
z AS (SELECT source AS l_source, slot AS l_slot, before FROM c WHERE before <= rest AND before + words > rest),
i AS (SELECT p.source, p.key, sum(p.size) AS words, max(p.size) AS longest, any_value(z.before) AS before, any_value(p.rest) AS rest FROM p JOIN z ON p.source IS NOT DISTINCT FROM z.l_source AND p.slot = z.l_slot GROUP BY p.source, p.key),
f AS (SELECT *, before + sum(words) OVER (PARTITION BY source ORDER BY key) AS upto FROM i),
h AS (SELECT *, coalesce(max(CASE WHEN upto <= rest THEN key END) OVER (PARTITION BY source), -1) AS c_key, rest - coalesce(max(CASE WHEN upto <= rest THEN upto END) OVER (PARTITION BY source), before) AS gap FROM f),
y AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY key) AS filled FROM h WHERE key > c_key AND longest * 4 <= gap),
fill AS (SELECT source, max(key) AS f_key, max(filled) AS filled FROM y WHERE filled <= gap GROUP BY source),
cut AS (SELECT source, any_value(c_key) AS c_key, any_value(gap) AS gap, any_value(rest) AS rest, min(CASE WHEN upto > rest THEN upto END) AS n_upto, min(CASE WHEN upto > rest THEN key END) AS n_key FROM h GROUP BY source),
ends AS (SELECT cut.source AS e_source, gap, CASE WHEN n_upto - rest < gap - coalesce(filled, 0) THEN n_key ELSE c_key END AS c_key, CASE WHEN n_upto - rest < gap - coalesce(filled, 0) THEN NULL ELSE f_key END AS f_key FROM cut LEFT JOIN fill ON cut.source IS NOT DISTINCT FROM fill.source),
fin AS (SELECT p.*, coalesce(slot < l_slot OR (slot = l_slot AND (key <= ends.c_key OR coalesce(key <= ends.f_key AND size * 4 <= gap, false))), false) AS chosen
  FROM p LEFT JOIN z ON p.source IS NOT DISTINCT FROM z.l_source LEFT JOIN ends ON p.source IS NOT DISTINCT FROM ends.e_source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST((epochs + CASE WHEN chosen AND rest > 0 THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM fin
"""


def license_sql() -> str:
    idf, unknown = inverse_frequencies()
    every = list(enumerate(templates()))
    values = ", ".join(f"({k}, '{name}', '{term}', {n}, {idf[term]!r}::DOUBLE)" for k, (name, terms) in every for term, n in Counter(terms).items())
    places = ", ".join(f"({k}, '{terms[at]}', {at}, {len(terms)})" for k, (_, terms) in every for at in anchor_places(terms))
    notice = " OR ".join(f"contains(low, '{m}')" for m in MARKS)
    return rf"""
WITH tt(template, license, t_term, t_count, idf) AS (VALUES {values}),
tp(template, term, place, size) AS (VALUES {places}),
tn AS (SELECT template, sqrt(sum((t_count * idf) ** 2)) AS t_norm FROM tt GROUP BY template),
wt AS (SELECT DISTINCT t_term, idf FROM tt),
l0 AS (SELECT *, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
d0 AS (SELECT doc_id, low, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words, {notice} AS notice, '/' || coalesce(source, '-') || '/' || coalesce(lang, '-') AS lang FROM l0),
f AS (SELECT doc_id, low, notice, CASE WHEN notice AND words <= {SHORT} THEN lang || '/LICENSE-' || doc_id WHEN notice AND words <= {MIDDLE} THEN lang || '/' || (doc_id // 256) || '/LICENSE-' || doc_id ELSE lang || '/' || (doc_id // 256) || '/' || doc_id || '.txt' END AS path FROM d0),
fd AS (SELECT *, regexp_replace(path, '/?[^/]*$', '') AS dir, regexp_matches(path, '{LICENSE_FILE}') AS whole FROM f),
tx AS MATERIALIZED (SELECT doc_id, whole, regexp_extract_all(low, '{TERM}') AS t FROM fd WHERE notice),
hit AS (SELECT doc_id, unnest(t) AS term, unnest(range(len(t))) AS i FROM tx),
win AS (SELECT DISTINCT doc_id, template, greatest(i - place, 0) AS first, i - place + size AS last FROM hit JOIN tp USING (term) UNION SELECT doc_id, template, 0, len(t) FROM tx, tn WHERE whole),
seg AS (SELECT doc_id, template, first, last, unnest(t[first + 1 : last]) AS term FROM win JOIN tx USING (doc_id)),
cnt AS (SELECT doc_id, template, first, last, term, count(*) AS tf FROM seg GROUP BY ALL),
ww AS (SELECT cnt.*, tf * coalesce(idf, {unknown!r}::DOUBLE) AS w FROM cnt LEFT JOIN wt ON term = t_term),
nn AS (SELECT doc_id, template, first, last, sqrt(sum(w ** 2)) AS norm FROM ww GROUP BY ALL),
dot AS (SELECT doc_id, ww.template, first, last, license, sum(w * t_count * idf) AS dot FROM ww JOIN tt ON term = t_term AND ww.template = tt.template GROUP BY ALL),
sc AS (SELECT doc_id, license, round(dot / norm / t_norm, 6) AS score FROM dot JOIN nn USING (doc_id, template, first, last) JOIN tn USING (template)),
own AS (SELECT doc_id, license AS own_license, score AS own_score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license) AS k FROM sc WHERE score >= {THRESHOLD}) WHERE k = 1),
s AS (SELECT doc_id, path, dir, whole, own_license, own_score FROM fd LEFT JOIN own USING (doc_id)),
hold AS (SELECT dir AS h_dir, own_license AS dir_license FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY own_score DESC, own_license, doc_id) AS k FROM s WHERE whole AND own_license IS NOT NULL) WHERE k = 1),
near AS (SELECT s.doc_id, h_dir, dir_license, row_number() OVER (PARTITION BY s.doc_id ORDER BY length(h_dir) DESC) AS k FROM s JOIN hold ON s.dir = h_dir OR starts_with(s.dir, h_dir || '/'))
SELECT s.doc_id, path, own_license, own_score, coalesce(own_license, dir_license) AS license, CASE WHEN own_license IS NOT NULL THEN 'file' WHEN h_dir IS NOT NULL THEN 'directory' ELSE 'none' END AS origin, CASE WHEN own_license IS NULL THEN h_dir END AS from_dir
FROM s LEFT JOIN near ON near.doc_id = s.doc_id AND k = 1
"""


FILL_MIDDLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
c AS (SELECT doc_id, text, u, len(u) AS n, [CAST('0x' || h[8 * i + 1 : 8 * i + 8] AS BIGINT) FOR i IN range(4)] AS h,
 text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') AS plain FROM d),
k AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS first, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS last, CASE WHEN plain THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c),
p AS (SELECT doc_id, text, n, form, array_to_string(u[1 : first], '') AS prefix, array_to_string(u[first + 1 : last], '') AS middle, array_to_string(u[last + 1 :], '') AS suffix FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_vptree_ann": NEAREST, "op2_license_scan": license_sql(), "op6_source_mixture": MIXTURE, "op8_ngram_jaccard": JACCARD, "op12_fill_middle": FILL_MIDDLE}
