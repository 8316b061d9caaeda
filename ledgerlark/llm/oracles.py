"""DuckDB SQL that gives the rows of a query, for those that SQL can express."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP7 = rf"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS words, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
v AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM r) GROUP BY 1),
m AS (SELECT w.doc_id, text, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(v.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN v USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
NOT (base_failed OR 10 * n_symbols > 3 * greatest(1, word_chars) OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 10 * n_dup_lines > 3 * (length(text) - length(replace(text, chr(10), '')) + 1)
OR 10 * length(regexp_replace(text, '[^0-9]', '', 'g')) > 3 * greatest(1, strlen(text))) AS kept FROM f"""

FOLDED = r"list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '\S+'), lambda x: regexp_replace(lower(x), '[^\p{L}\p{N}]', '', 'g')), lambda x: x <> '')"

OP5 = rf"""WITH i AS (SELECT item_id, words, least(5, len(words)) AS k FROM (SELECT item_id, {FOLDED} AS words FROM benchmark) WHERE len(words) > 0),
want AS (SELECT DISTINCT item_id, k, array_to_string(words[p:p + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(words) - k + 2)) AS p FROM i)),
d AS (SELECT doc_id, words, unnest((SELECT list(DISTINCT k) FROM i)) AS k FROM (SELECT doc_id, {FOLDED} AS words FROM documents)),
have AS (SELECT DISTINCT doc_id, k, array_to_string(words[p:p + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(words) - k + 2)) AS p FROM d WHERE len(words) >= k)),
n AS (SELECT item_id, count(*) AS n FROM want GROUP BY 1)
SELECT item_id, doc_id, count(*) * 1.0 / any_value(n.n) AS containment FROM want JOIN have USING (k, g) JOIN n USING (item_id) GROUP BY 1, 2 HAVING count(*) * 1.0 / any_value(n.n) >= 0.8"""

OP12 = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || doc_id) AS h FROM documents),
u AS (SELECT *, len(w) AS n, [CAST('0x' || substr(h, 8 * k - 7, 8) AS BIGINT) FOR k IN [1, 2, 3, 4]] AS r FROM d),
c AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 90 THEN 'plain' WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
s AS (SELECT *, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM s"""

ORACLES: dict[str, str] = {"op5_decontam": OP5, "op7_quality": OP7, "op12_fim": OP12}
