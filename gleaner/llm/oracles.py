"""DuckDB SQL for the operators that SQL expresses over whole tables."""

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

BLOCK_ANCHORS = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
win AS (SELECT doc_id, unnest(list_transform(range(1, len(words) - 48), lambda i: {{'i': i, 'h': md5(array_to_string(words[i:i + 49], ' '))}})) AS s FROM w WHERE len(words) >= 50),
low AS (SELECT s.h AS h, min(doc_id) AS m FROM win GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, s.i + k AS p FROM win JOIN low ON h = s.h, (SELECT unnest(range(0, 50)) AS k) WHERE m < doc_id),
pos AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w),
left_over AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS body, count(*) AS n FROM pos ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM w LEFT JOIN left_over ON w.doc_id = left_over.doc_id
"""

QUALITY_CASCADE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
win AS (SELECT doc_id, unnest(list_transform(range(1, len(words) - 1), lambda i: {{'i': i, 'g': array_to_string(words[i:i + 2], ' ')}})) AS s FROM d WHERE len(words) >= 3),
twice AS (SELECT doc_id, s.g AS g FROM win GROUP BY 1, 2 HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT s.i + k) AS n FROM win JOIN twice USING (doc_id), (SELECT unnest(range(0, 3)) AS k) WHERE s.g = g GROUP BY doc_id),
b AS (SELECT d.doc_id, text, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  len(lines) AS n_lines, coalesce(n, 0) AS n_repeat_words, greatest(strlen(text), 1) AS n_bytes,
  length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals, length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) AS letters,
  strlen(text) - length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) AS far_bytes FROM d LEFT JOIN covered ON covered.doc_id = d.doc_id),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (n_symbols > 0.1 * n_words)
  AND NOT (word_chars / n_words < 2 OR word_chars / n_words > 14) AND NOT (n_dup_lines > 0.3 * n_lines) AND NOT (capitals / n_bytes > 0.4)
  AND NOT ((letters + far_bytes) / n_bytes < 0.5) AS kept
FROM j
"""
