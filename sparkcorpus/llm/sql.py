"""DuckDB SQL for the queries of the operators that SQL can express."""

from .quality_rules import STOP_WORDS

_STOP = ", ".join(f"'{x}'" for x in sorted({x for w in STOP_WORDS.split() for x in (w, w.capitalize())}))

OP5 = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
p AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win
      FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM p) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + j) AS n FROM twice CROSS JOIN (VALUES (0), (1), (2)) AS v(j) GROUP BY r),
s AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')) AS BIGINT) AS n_upper,
             CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(len(list_filter(words, lambda x: x IN ({_STOP}))) AS BIGINT) AS n_stop_words,
             CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN covered USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND coalesce(word_chars / nullif(n_words, 0), 0) BETWEEN 2 AND 16
         AND coalesce(n_symbols / nullif(n_words, 0), 0) <= 0.25 AND coalesce(n_stop_words / nullif(n_words, 0), 0) >= 0.02
         AND coalesce(n_dup_lines / nullif(n_lines, 0), 0) <= 0.5 AND coalesce(n_upper / nullif(word_chars, 0), 0) <= 0.5 AS kept
FROM s
"""

OP7 = r"""
WITH RECURSIVE q AS (SELECT doc_id, CASE WHEN avg(quality) >= 0.5 THEN 2.0 ELSE 0.5 END AS weight FROM labels
                     WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
d AS (SELECT d.doc_id, d.source, CAST(len(list_filter(regexp_split_to_array(coalesce(d.text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
             CAST(coalesce(q.weight, 1.0) AS DOUBLE) AS weight
      FROM documents d LEFT JOIN q ON d.doc_id = q.doc_id),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS DOUBLE) AS w FROM d GROUP BY source),
-- each round shares what is left among the sources that aren't capped, and caps those that come out above
rounds AS (SELECT 0 AS k, source, source_size, w, CAST(NULL AS DOUBLE) AS fixed,
                  1.5 * sum(source_size) OVER () * w / sum(w) OVER () AS share FROM s
           UNION ALL
           SELECT k + 1, source, source_size, w, fixed2,
                  CASE WHEN fixed2 IS NULL THEN (1.5 * sum(source_size) OVER () - coalesce(sum(fixed2) OVER (), 0)) * w / sum(CASE WHEN fixed2 IS NULL THEN w END) OVER () ELSE fixed2 END
           FROM (SELECT *, CASE WHEN fixed IS NOT NULL OR share > 2 * source_size THEN 2.0 * source_size END AS fixed2 FROM rounds WHERE k < 40)),
target AS (SELECT source, source_size, share AS target FROM rounds WHERE k = 40),
k AS (SELECT d.doc_id, d.source, size, source_size, target,
             -ln((CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12)) AS BIGINT) + 0.5) / 281474976710656.0) / weight AS key
      FROM d JOIN target ON d.source IS NOT DISTINCT FROM target.source),
b AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - size AS before,
             CASE WHEN source_size > 0 THEN floor(round(target) / source_size) ELSE 0 END AS epochs FROM k)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, round(target) - epochs * source_size - before)) AS BIGINT) AS taken
FROM b
"""

OP10 = r"""
WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS text, array_to_string(list_distinct(string_split(coalesce(text, ''), chr(10))), chr(10)) AS unordered FROM documents),
l AS (SELECT doc_id, source, lang, text, string_split(text, chr(10)) AS lines FROM d),
r AS (SELECT doc_id, source, lang, text, array_to_string(list_filter(lines, lambda x, i: list_position(lines, x) = i), chr(10)) AS short FROM l),
w AS (SELECT doc_id, source, lang, len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS w0,
             len(list_filter(regexp_split_to_array(short, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS w1,
             length(text) - length(regexp_replace(text, '[!-/:-@\[-`{-~]', '', 'g')) AS p0, length(short) - length(regexp_replace(short, '[!-/:-@\[-`{-~]', '', 'g')) AS p1 FROM r),
c AS (SELECT doc_id, source, lang, 'words-1' AS tokenizer, w0 AS t0, w1 AS t1 FROM w UNION ALL SELECT doc_id, source, lang, 'words-2', w0 + p0, w1 + p1 FROM w),
x AS (SELECT c.*, CAST(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS BIGINT) AS gone FROM c)
SELECT source, lang, tokenizer, CAST(sum(1 - gone) AS BIGINT) AS docs, CAST(sum(t1 * (1 - gone)) AS BIGINT) AS tokens,
       CAST(count(*) + 2 * count(*) FILTER (WHERE t0 <> t1) + sum(gone) AS BIGINT) AS n_changes
FROM x GROUP BY source, lang, tokenizer
"""

OP2 = r"""
WITH l AS (SELECT doc_id, unnest(range(0, len(lines))) AS line, unnest(lines) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)),
s AS (SELECT doc_id, line, list_sort(list_distinct(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS words FROM l),
m AS (SELECT words, len(words) AS n, min(struct_pack(doc_id := doc_id, line := line)) AS first, count(*) AS copies, row_number() OVER () AS k FROM s WHERE len(words) > 0 GROUP BY words),
t AS (SELECT k, n, unnest(words) AS word FROM m),
f AS (SELECT word, count(*) AS df FROM t GROUP BY word),
p AS (SELECT k, n, t.word, row_number() OVER (PARTITION BY k ORDER BY df, t.word) AS pos FROM t JOIN f ON t.word = f.word),
q AS (SELECT k, n, word FROM p WHERE pos <= n - ceil(0.8 * n - 1e-9) + 1),
c AS (SELECT DISTINCT x.k AS a, y.k AS b FROM q x JOIN q y ON x.word = y.word AND x.k < y.k AND x.n >= 0.8 * y.n - 1e-9 AND y.n >= 0.8 * x.n - 1e-9),
v AS (SELECT a, b FROM (SELECT a, b, x.n AS n, y.n AS o, len(list_intersect(x.words, y.words)) AS i FROM c JOIN m x ON x.k = a JOIN m y ON y.k = b) WHERE i >= 0.8 * (n + o - i) - 1e-9),
e AS (SELECT a AS k, b AS o FROM v UNION ALL SELECT b, a FROM v),
g AS (SELECT e.k, min(m.first) AS other, count(*) AS n_links FROM e JOIN m ON m.k = e.o GROUP BY e.k),
h AS (SELECT m.words, CASE WHEN g.other < m.first THEN g.other ELSE m.first END AS first, coalesce(g.n_links, 0) AS n_links FROM m LEFT JOIN g ON m.k = g.k)
SELECT s.doc_id, CAST(s.line AS INTEGER) AS line, h.first.doc_id AS first_doc_id, CAST(h.first.line AS INTEGER) AS first_line, CAST(h.n_links AS BIGINT) AS n_links
FROM s JOIN h ON s.words = h.words WHERE h.first < struct_pack(doc_id := s.doc_id, line := s.line)
"""

ORACLE_SQL = {"op2_line_dedup": OP2, "op10_token_counts": OP10, "op5_quality_rules": OP5, "op7_mix_sources": OP7}
