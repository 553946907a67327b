"""SQL that gives the same rows as the queries, for those that SQL can express."""

from __future__ import annotations

from swelter.llm import mixing, quality, urlfilter

#: A word is a run of anything but these.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_HAS_WORD = r"regexp_matches({0}, '[^\x20\x09-\x0D]')"

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first_id < page_id THEN first_id END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)"""

LINES = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS p FROM split),
worded AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS k FROM lines WHERE {_HAS_WORD.format('line')}),
windows AS (SELECT doc_id, k, line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w AS t FROM worded WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
later AS (SELECT doc_id, k FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, k) AS nth FROM windows WHERE t IS NOT NULL) WHERE nth > 1),
covered AS (SELECT DISTINCT doc_id, k + j AS k FROM later CROSS JOIN range(3) r(j)),
gone AS (SELECT doc_id, p FROM worded JOIN covered USING (doc_id, k)),
n AS (SELECT doc_id, count(*) AS n_lines FROM worded GROUP BY 1), g AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY 1),
left_ AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY p) AS kept FROM lines ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, md5(CASE WHEN n_removed > 0 THEN coalesce(kept, '') ELSE text END) AS kept_md5
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN left_ USING (doc_id)"""


def _mixing() -> str:
    """The passes by sorting where the operator uses histograms."""
    weights, top = list(map(float, mixing.WEIGHTS)), 1 << mixing.HASH_BITS
    ctes = [
        f"docs AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, list_reduce(list_transform(string_split(substr(md5(CAST(doc_id AS VARCHAR)), 1, {mixing.HASH_BITS // 4}), ''), lambda c: CAST(strpos('0123456789abcdef', c) - 1 AS BIGINT)), lambda a, b: a * 16 + b) AS h FROM documents)",
        "sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY 1)",
        f"ranked AS (SELECT *, {weights}[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)}] AS w, CAST({mixing.CAP} * source_size AS DOUBLE) AS most, sum(source_size) OVER () AS whole FROM sums)",
        "levels AS (SELECT *, (whole - coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS water FROM ranked)",
        "plan AS (SELECT source, source_size, coalesce(least((SELECT max(water) FROM levels WHERE water * w <= most) * w, most), most) AS target FROM levels)",
        f"todo AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS rounds FROM plan)",
        f"state0 AS (SELECT source, target - rounds * source_size AS budget, CAST(0 AS BIGINT) AS first, CAST({1 << 62} AS BIGINT) AS longest FROM todo)",
    ]
    for k in range(mixing.PASSES):
        nearer = "CASE WHEN budget - base > more - (budget - base) THEN 1 ELSE 0 END" if k == mixing.PASSES - 1 else "0"
        ctes += [
            f"run{k} AS (SELECT d.source, h, sum(size) AS more, sum(sum(size)) OVER (PARTITION BY d.source ORDER BY h) AS upto, any_value(budget) AS budget FROM docs d JOIN state{k} s ON d.source IS NOT DISTINCT FROM s.source WHERE h >= first AND size <= longest GROUP BY d.source, h)",
            f"hit{k} AS (SELECT source, h AS spot, upto - more AS base, more FROM run{k} WHERE upto > budget AND upto - more <= budget)",
            f"cut{k} AS MATERIALIZED (SELECT s.source, first, longest, budget, spot, base, coalesce(spot + {nearer}, {top}) AS stop FROM state{k} s LEFT JOIN hit{k} b ON s.source IS NOT DISTINCT FROM b.source)",
            f"state{k + 1} AS (SELECT source, budget - base AS budget, spot + 1 AS first, CAST(floor(budget - base) AS BIGINT) AS longest FROM cut{k} WHERE spot IS NOT NULL)",
        ]
    cuts = " UNION ALL ".join(f"SELECT source, first, longest, stop FROM cut{k}" for k in range(mixing.PASSES))
    return f"""WITH {', '.join(ctes)}, cuts AS ({cuts})
SELECT doc_id, size, source_size, target, size * (rounds + CASE WHEN EXISTS (SELECT 1 FROM cuts c WHERE c.source IS NOT DISTINCT FROM d.source AND h >= first AND h < stop AND size <= longest) THEN 1 ELSE 0 END) AS taken
FROM docs d JOIN todo t ON d.source IS NOT DISTINCT FROM t.source"""


def _urls() -> str:
    rules = ", ".join(map(str, urlfilter.RULES))
    return rf"""WITH rules(rh, rp, v) AS (VALUES {rules}),
u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
fits AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS verdict FROM u JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN fits USING (page_id)"""


def _quality() -> str:
    """Counts, the exact binomial test of each cutoff, and the verdicts."""
    alpha = quality.RISK / len(quality.RULES)
    rules = " UNION ALL ".join(f"SELECT doc_id, lang, {i} AS place, '{name}' AS rule, ({formula.replace(' / ', ' * 1.0 / ')}) AS value, {list(cuts)} AS cuts FROM counts" for i, (name, (formula, cuts)) in enumerate(quality.RULES.items()))
    return rf"""WITH split AS (SELECT doc_id, lang, coalesce(text, '') AS t, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: {_HAS_WORD.format('x')}) AS l FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM split),
windows AS (SELECT doc_id, pos, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS t FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
repeated AS (SELECT doc_id, pos FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, t) AS n FROM windows WHERE t IS NOT NULL) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT pos + j) AS n_repeat_words FROM repeated CROSS JOIN range(3) r(j) GROUP BY 1),
counts AS (SELECT doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(length(t) - length(regexp_replace(t, '[A-Z\x{{C0}}-\x{{D6}}\x{{D8}}-\x{{DE}}]', '', 'g')) AS BIGINT) AS n_capitals, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM split LEFT JOIN covered USING (doc_id)),
stats AS (SELECT *, len(list_filter(cuts, lambda c: c >= value)) AS spared FROM ({rules})),
good AS (SELECT s.* FROM stats s JOIN labels ON labels.doc_id = s.doc_id WHERE quality = 1),
chains AS (SELECT lang, rule, any_value(cuts) AS cuts, count(*) AS n FROM good GROUP BY 1, 2),
tests AS (SELECT lang, rule, cuts, n, unnest(range(len(cuts))) AS i FROM chains),
tried AS (SELECT t.*, (SELECT count(*) FROM good g WHERE g.lang IS NOT DISTINCT FROM t.lang AND g.rule = t.rule AND g.spared <= t.i) AS k, (SELECT count(*) FROM chains) AS m FROM tests t),
judged AS (SELECT *, n > 0 AND k <= n * {alpha!r} AND list_sum(list_transform(range(k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({alpha!r}) + (n - j) * ln(1 - {alpha!r})))) <= {quality.DELTA!r} / m AS ok FROM tried),
ends AS (SELECT lang, rule, any_value(cuts) AS cuts, coalesce(min(CASE WHEN NOT ok THEN i END), count(*)) AS bad FROM judged GROUP BY 1, 2),
cutoffs AS (SELECT lang, rule, cuts[CAST(bad AS INTEGER)] AS cutoff FROM ends WHERE bad > 0),
rejects AS (SELECT doc_id, string_agg(s.rule, ',' ORDER BY place) AS rejected_by FROM stats s JOIN cutoffs c ON c.rule = s.rule AND c.lang IS NOT DISTINCT FROM s.lang WHERE value > cutoff GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND rejected_by IS NULL AS kept, coalesce(rejected_by, '') AS rejected_by
FROM counts LEFT JOIN rejects USING (doc_id)"""


FIM = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (SELECT *, CAST(len(u) AS BIGINT) AS n, list_transform(range(4), lambda i: CAST('0x' || substr(h, CAST(8 * i + 1 AS INTEGER), 8) AS BIGINT)) AS x FROM d),
f AS (SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR x[3] % 100 >= 90 THEN 'plain' WHEN x[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
c AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:n], ''), '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM c"""

#: One step of CRC-32 for a byte, and pairs one edit apart by the words with one letter less.
VARIANTS = r"""
WITH RECURSIVE bits AS (SELECT i, 0 AS k, CAST(i AS BIGINT) AS v FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
per_doc AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS hx FROM runs WHERE length(run) > 4 GROUP BY 1, 2),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(length(hx) // 2), lambda i: CAST('0x' || substr(hx, CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT))), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295) AS h FROM per_doc, crc),
edited AS (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM edited WHERE length(word) > 4 GROUP BY 1 HAVING sum(n) > 2),
less AS MATERIALIZED (SELECT word, i, substr(word, 1, CAST(i AS INTEGER)) || substr(word, CAST(i AS INTEGER) + 2) AS v FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
pairs AS (SELECT l.word AS a, v AS b FROM less l JOIN words w ON w.word = v UNION SELECT v, l.word FROM less l JOIN words w ON w.word = v
  UNION SELECT a.word, b.word FROM less a JOIN less b USING (i, v) WHERE a.word <> b.word),
best AS (SELECT a, count(*) AS n_near, first(b ORDER BY n DESC, b) AS b, max(n) AS form_n FROM pairs JOIN words ON word = b GROUP BY 1),
formed AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n THEN b END AS form, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n FROM words LEFT JOIN best ON a = word),
ways AS (SELECT word, form AS e, 1 AS k FROM formed WHERE form IS NOT NULL UNION ALL SELECT w.word, f.form, k + 1 FROM ways w JOIN formed f ON f.word = w.e WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(e, k) AS root FROM ways GROUP BY 1)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM formed LEFT JOIN ends USING (word)"""


SQL = {"op1_warc_transactions": WARC, "op2_line_dedup": LINES, "op3_mixing": _mixing(), "op6_url_filter": _urls(), "op8_quality_rules": _quality(), "op11_spelling_variants": VARIANTS, "op12_fill_in_middle": FIM}
