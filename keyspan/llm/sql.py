"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

OP4 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, len(regexp_extract_all(text, '\\|<\|im_start\|>|<\|im_end\|>|<\|image\|>|<\|audio\|>|<\|document\|>|<\|endoftext\|>|<\|startoftext\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>')) AS marks FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(text) + marks + length('<|im_start|>') + 1 + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

OP6 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang FROM documents),
w AS (SELECT rid, doc_id, lang, text, list_filter(regexp_split_to_array(text, '[ \t\n\v\f\r]+'), lambda x: x <> '') AS ws FROM d),
places AS (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2),
windows AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS n FROM places),
repeats AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE n > 1) GROUP BY rid),
k AS (
  SELECT w.rid, doc_id, lang, ws, len(ws) AS n_words, coalesce(n_repeat_words, 0) AS n_repeat_words,
    length(array_to_string(ws, '')) AS word_chars, array_to_string(ws, '') AS solid,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^ \t\n\v\f\r]')) AS lines
  FROM w LEFT JOIN repeats USING (rid)
),
m AS (
  SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines, length(regexp_replace(solid, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    length(regexp_replace(solid, '[^\p{Lu}]+', '', 'g')) AS upper, length(regexp_replace(solid, '[^\p{L}]+', '', 'g')) AS letters, length(regexp_replace(solid, '[^0-9]+', '', 'g')) AS digits
  FROM k
),
f AS (SELECT *, [upper, letters - upper, digits, n_symbols, word_chars - letters - digits - n_symbols] AS classes FROM m),
larger AS (SELECT lang FROM d GROUP BY lang HAVING count(*) >= 0.001 * (SELECT count(*) FROM d)),
counted AS (SELECT lang, word, count(*) AS n FROM (SELECT rid, lang, unnest(list_distinct(ws)) AS word FROM w) WHERE lang IN (FROM larger) GROUP BY ALL),
top AS (SELECT lang, word, place FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS place FROM counted) WHERE place <= 20),
uses AS (SELECT rid, lang, place, len(list_filter(ws, lambda x: x = word)) AS c, n_words FROM f JOIN top USING (lang)),
witness AS (
  SELECT rid FROM uses WHERE n_words >= 50 GROUP BY rid HAVING max(c) <= 0.2 * max(n_words)
  UNION ALL SELECT rid FROM f WHERE n_words >= 50 AND lang NOT IN (SELECT lang FROM top)
),
ref_words AS (SELECT lang, place, avg(c / n_words) AS y FROM uses WHERE rid IN (FROM witness) GROUP BY ALL),
shares AS (SELECT lang, place, classes[place] / word_chars AS y FROM (SELECT lang, classes, word_chars, unnest([1, 2, 3, 4, 5]) AS place FROM f WHERE rid IN (FROM witness) AND word_chars > 0)),
ref_classes AS (
  SELECT lang, place, avg(y) AS y FROM shares WHERE lang IN (SELECT lang FROM top) GROUP BY ALL
  UNION ALL SELECT rare.lang, place, avg(y) FROM shares, (SELECT DISTINCT lang FROM f WHERE lang NOT IN (SELECT lang FROM ref_words)) rare GROUP BY ALL
),
pairs AS (
  SELECT rid, 'w' AS kind, c / n_words AS x, y FROM uses JOIN ref_words USING (lang, place) WHERE n_words >= 50
  UNION ALL SELECT rid, 'c', classes[place] / word_chars, y FROM f JOIN ref_classes USING (lang) WHERE n_words >= 50
),
whole AS (SELECT * FROM pairs UNION ALL SELECT rid, kind, greatest(0, 1 - sum(x)), greatest(0, 1 - sum(y)) FROM pairs GROUP BY rid, kind),
distances AS (
  SELECT rid, kind, sqrt(greatest(0, sum(CASE WHEN x > 0 THEN x * log2(x / ((x + y) / 2)) ELSE 0 END + CASE WHEN y > 0 THEN y * log2(y / ((x + y) / 2)) ELSE 0 END) / 2)) AS js FROM whole GROUP BY rid, kind
),
joined AS (
  SELECT f.*, c.js AS char_js, v.js AS word_js, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM f LEFT JOIN (FROM distances WHERE kind = 'c') c USING (rid) LEFT JOIN (FROM distances WHERE kind = 'w') v USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(char_js > 0.27, false) AND NOT coalesce(word_js > 0.14 + 2 / sqrt(n_words), false) AS kept,
  round(char_js, 6) AS char_distance, round(word_js, 6) AS word_distance
FROM joined
"""

OP10 = r"""
WITH RECURSIVE s AS (
  SELECT source, count(*) AS docs, CASE source WHEN 'src0' THEN 2.0 WHEN 'src1' THEN 4.0 WHEN 'src2' THEN 3.0 WHEN 'src3' THEN 0.5 WHEN 'src4' THEN 1.5 ELSE 1.0 END::DOUBLE AS weight FROM documents GROUP BY source
), r AS (
  SELECT source, (SELECT sum(docs) FROM s)::DOUBLE * weight / ((SELECT sum(weight) FROM s) * docs) AS rate FROM s
), p AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM r
  UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM p WHERE k < ceil(rate + 12 * sqrt(rate) + 30)
), u AS (
  SELECT *, (CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':1'), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656 AS u, row_number() OVER () AS rid FROM documents
), n AS (
  SELECT u.rid, coalesce(min(k) FILTER (u.u < p.c), max(k)) AS n FROM u JOIN p ON u.source IS NOT DISTINCT FROM p.source WHERE p.rate > 0 GROUP BY u.rid
), copies AS (
  SELECT doc_id, text, lang, source, n_chars, unnest(generate_series(1, n)) AS copy_no FROM u JOIN n USING (rid)
)
SELECT doc_id, text, lang, source, n_chars, CAST(copy_no AS INTEGER) AS copy_no, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || copy_no) AS shuffle_key FROM copies
"""
