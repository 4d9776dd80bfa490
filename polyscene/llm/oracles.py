"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = "coalesce(regexp_extract_all(translate(text, '" + _UPPER + "', '" + _LOWER + "'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"

#: Windows of 8 words, or of a whole shorter item, joined on their words; runs on one diagonal give the longest match.
DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
p AS (SELECT item, unnest(range(1, greatest(2, len(w) - 6))) AS j, w FROM b WHERE len(w) > 0),
pat AS (SELECT item, j, least(8, len(w)) AS k, array_to_string(w[j:j + 7], ' ') AS s FROM p),
ks AS (SELECT DISTINCT k FROM pat),
places AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM d, ks WHERE len(w) >= k),
hits AS (SELECT doc_id, i, pat.k, item, j FROM (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM places) x JOIN pat ON x.s = pat.s AND x.k = pat.k),
hit_words AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM hits) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits WHERE item IS NOT NULL) GROUP BY 1),
starts AS (SELECT *, CASE WHEN lag(i) OVER w = i - 1 THEN 0 ELSE 1 END AS head FROM hits WINDOW w AS (PARTITION BY doc_id, item, i - j ORDER BY i)),
runs AS (SELECT *, sum(head) OVER (PARTITION BY doc_id, item, i - j ORDER BY i) AS run FROM starts),
longest AS (SELECT doc_id, max(n) AS longest FROM (SELECT doc_id, max(i + k) - min(i) AS n FROM runs GROUP BY doc_id, item, i - j, run) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated, coalesce(longest, 0)::BIGINT AS longest_match
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN longest USING (doc_id)
"""

#: The first document of every window; words that a window of an earlier document covers go.
SUBSTRING_DEDUP = """
WITH d AS (SELECT doc_id, coalesce(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''), []) AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
firsts AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS pos FROM firsts WHERE first < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
marked AS (SELECT words.doc_id, words.pos, word, gone.pos IS NOT NULL AS g FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.pos = words.pos),
runs AS (SELECT *, g AND NOT coalesce(lag(g) OVER (PARTITION BY doc_id ORDER BY pos), false) AS head FROM marked),
sums AS (SELECT doc_id, count(*) FILTER (WHERE g) AS n, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT g) AS kept, count(*) FILTER (WHERE head) AS f FROM runs GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(f, 0)::BIGINT AS n_factors
FROM d LEFT JOIN sums USING (doc_id)
"""


def _codes(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Codebooks round by round; distances are exact, as all numbers are integers below 2^53."""
    out = f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({1 << 10} * x::DOUBLE)) AS v FROM embeddings
WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, label, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS x FROM kept, range({parts}) t(p)),
book0 AS MATERIALIZED (SELECT * FROM (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts) WHERE e < {entries})"""
    near = "SELECT vec_id, label, p, x, min((list_dot_product(x, x) + list_dot_product(c, c) - 2 * list_dot_product(x, c))::HUGEINT * {n} + e) AS best FROM parts JOIN book{k} USING (p) GROUP BY ALL"
    for k in range(rounds):
        out += f""",
near{k} AS MATERIALIZED ({near.format(n=entries, k=k)}),
each{k} AS (SELECT p, best % {entries} AS e, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM near{k}),
mean{k} AS (SELECT p, e, list(v ORDER BY i) AS c FROM (SELECT p, e, i, floor(sum(v) / count(*)) AS v FROM each{k} GROUP BY ALL) GROUP BY ALL),
book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m USING (p, e))"""
    out += f""",
last AS ({near.format(n=entries, k=rounds)}),
rows AS (SELECT vec_id, label, string_agg(printf('%02x', (best % {entries})::INTEGER), '' ORDER BY p) AS code, sum(best // {entries})::BIGINT AS error FROM last GROUP BY ALL),
sums AS (SELECT label, sum(error)::BIGINT AS label_error FROM rows GROUP BY 1),
said AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda v: v::BIGINT::VARCHAR), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, label_error, codebooks_sha256 FROM rows JOIN sums ON rows.label IS NOT DISTINCT FROM sums.label, said
"""
    return out


#: The mask of every document, every order of the filters, and what each step finds.
FILTER_AUDIT = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM d),
m AS (SELECT doc_id, part, {'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
'D': regexp_matches(t, '[#$%&*|]'), 'E': doc_id > min(doc_id) OVER (PARTITION BY t)} AS f FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY 1),
cells AS (SELECT part, [f.A, f.B, f.C, f.D, f.E] AS f, coalesce(good, false) AS good, coalesce(bad, false) AS bad, count(*) AS n FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
k AS (SELECT range AS k FROM range(1, 6)),
orders AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM k a, k b, k c, k d, k e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
named AS (SELECT array_to_string(list_transform(o, lambda x: substr('ABCDE', x::INTEGER, 1)), '') AS filter_order, o FROM orders),
steps AS (SELECT part, filter_order, k::INTEGER AS step, o[k] AS filter, good, bad, n, coalesce(f[o[k]], false) AS fails,
len(list_filter(o[:k - 1], lambda x: coalesce(f[x], false))) > 0 AS gone, len(list_filter(f, lambda x: coalesce(x, false))) AS many FROM cells, named, k),
sums AS (SELECT part, filter_order, step, filter, coalesce(sum(n) FILTER (WHERE NOT gone AND NOT fails), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE NOT gone AND fails), 0)::BIGINT AS removed,
coalesce(sum(n) FILTER (WHERE gone AND fails), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE fails AND many = 1), 0)::BIGINT AS unique_fails,
coalesce(sum(n) FILTER (WHERE NOT gone AND fails AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (WHERE NOT gone AND fails AND bad), 0)::BIGINT AS toxic_lost FROM steps GROUP BY ALL)
SELECT * EXCLUDE (filter), (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM sums
"""

ORACLES: dict[str, str] = {"op2_decontamination": DECONTAMINATION, "op10_substring_dedup": SUBSTRING_DEDUP, "op11_vector_codes": _codes(), "op12_filter_audit": FILTER_AUDIT}
