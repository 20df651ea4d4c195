"""DuckDB SQL with the same rows as those registered queries that SQL expresses, over the same tables."""

from __future__ import annotations

from pointloom.llm import fill_middle, mixing

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Targets by water-filling in closed form: sources in order of bound for each unit of weight; those before the level are held at their bound.
OP2 = f"""
WITH sized AS (
  SELECT doc_id, source, len({_WORDS.format("coalesce(text, '')")})::BIGINT AS size,
         ('0x' || substr(md5(concat_ws(':', '{{seed}}', doc_id, text)), 1, 13))::BIGINT AS key
  FROM documents),
ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM sized GROUP BY source),
held AS (
  SELECT *, 3.0 * source_size AS bound,
         sum(3.0 * source_size) OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS upto,
         sum(weight) OVER () - sum(weight) OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS rest,
         sum(source_size) OVER () AS total
  FROM ranked),
levels AS (
  SELECT max(total)::DOUBLE / (SELECT sum(weight) FROM ranked) AS level FROM held
  UNION ALL SELECT (total - upto) / rest FROM held WHERE rest > 0 AND bound <= weight * (total - upto) / rest),
goal AS (
  SELECT source, source_size, weight, bound, least(bound, weight * (SELECT max(level) FROM levels))::DOUBLE AS target FROM held),
banded AS (
  SELECT s.*, g.source_size, g.target, CASE WHEN size > 0 THEN floor(ln(greatest(size, 1)) / {mixing.STEP!r} + 1e-9)::INT ELSE -1 END AS band,
         CASE WHEN g.source_size > 0 THEN least(3.0, g.target / greatest(g.source_size, 1)) ELSE 0.0 END AS rate
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source),
many AS (
  SELECT source, band, max(rate) AS rate, count(*) AS n,
         ('0x' || substr(md5(concat_ws(':', '{{seed}}', 'start', source)), 1, 13))::BIGINT / {float(1 << 52)!r}::DOUBLE AS start
  FROM banded GROUP BY source, band),
asked AS (
  SELECT *, floor(sum((rate - floor(rate)) * n) OVER (PARTITION BY source ORDER BY band) + start + 1e-9) AS upto FROM many),
more AS (
  SELECT source, band, upto - coalesce(lag(upto) OVER (PARTITION BY source ORDER BY band), 0) AS more FROM asked),
placed AS (
  SELECT b.*, m.more, rank() OVER (PARTITION BY b.source, b.band ORDER BY b.key) AS place
  FROM banded b JOIN more m ON b.source IS NOT DISTINCT FROM m.source AND b.band = m.band)
SELECT doc_id, size, source_size, target, ((floor(rate) + CASE WHEN place <= more THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM placed
"""

OP8 = f"""
WITH words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos, len(w) AS n
  FROM (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents)),
windows AS (
  SELECT doc_id, pos, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) AS h
  FROM words QUALIFY n - pos >= 49),
late AS (
  SELECT doc_id, pos FROM windows QUALIFY min(doc_id) OVER (PARTITION BY h) < doc_id),
marked AS (
  SELECT w.doc_id, w.word, w.pos, max(l.pos) OVER (PARTITION BY w.doc_id ORDER BY w.pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM words w LEFT JOIN late l ON w.doc_id = l.doc_id AND w.pos = l.pos),
kept AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS text FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

OP9 = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, {_WORDS.format(_FOLDED)} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i : i + 4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM words),
sets AS (
  SELECT doc_id, count(*) AS n, md5(string_agg(s, '|' ORDER BY s)) AS name FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sets m ON m.doc_id = a.doc_id JOIN sets n ON n.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (max(m.n) + max(n.n) - count(*))),
reached AS (
  SELECT doc_id, doc_id AS to_id FROM sets UNION SELECT r.doc_id, l.y FROM reached r JOIN links l ON l.x = r.to_id),
classes AS (
  SELECT doc_id, min(to_id) AS component_id FROM reached GROUP BY doc_id),
degrees AS (
  SELECT x AS doc_id, count(*) AS n FROM links GROUP BY x),
firsts AS (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY name) AS copy_of FROM sets)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(f.copy_of, d.doc_id) AS copy_of, coalesce(c.component_id, d.doc_id) AS component_id, coalesce(g.n, 0)::BIGINT AS n_links
FROM documents d LEFT JOIN sets s ON s.doc_id = d.doc_id LEFT JOIN firsts f ON f.doc_id = d.doc_id
LEFT JOIN classes c ON c.doc_id = d.doc_id LEFT JOIN degrees g ON g.doc_id = d.doc_id
"""

OP11 = """
WITH keyed AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
hashed AS (
  SELECT doc_id, t, length(t) AS n, ('0x' || substr(k, 1, 8))::BIGINT AS h1, ('0x' || substr(k, 9, 8))::BIGINT AS h2, ('0x' || substr(k, 17, 8))::BIGINT AS h3, ('0x' || substr(k, 25, 8))::BIGINT AS h4 FROM keyed),
formed AS (
  SELECT *, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
         least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b
  FROM hashed),
parts AS (
  SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM formed)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""

ORACLE_SQL: dict[str, str] = {
    "op2_mixing": OP2.replace("{seed}", str(mixing.SEED)),
    "op8_substring_dedup": OP8,
    "op9_jaccard_join": OP9,
    "op11_fill_middle": OP11.replace("{seed}", str(fill_middle.SEED)),
}
