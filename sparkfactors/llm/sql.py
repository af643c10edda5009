"""DuckDB SQL with the same rows as the queries."""

WS = r"[\x20\x09-\x0D]+"

OP3 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{WS}'), lambda w: w <> '') AS w
  FROM documents),
g AS (
  SELECT doc_id, t, len(w) AS n, string_split(t, chr(10)) AS ls, regexp_replace(t, '{WS}', '', 'g') AS chars,
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS grams
  FROM d),
r AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS k
      FROM (SELECT doc_id, unnest(grams) AS gram, unnest(range(1, len(grams) + 1)) AS i FROM g) x) y
    WHERE k > 1) z GROUP BY doc_id),
f AS (
  SELECT g.doc_id, n::BIGINT AS n_words, length(chars)::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    (len(list_filter(ls, lambda x: regexp_replace(x, '{WS}', '', 'g') <> ''))
      - len(list_distinct(list_filter(ls, lambda x: regexp_replace(x, '{WS}', '', 'g') <> ''))))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
    length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_upper
  FROM g LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR 100 * n_symbols > 10 * n_words OR 100 * n_upper > 50 * word_chars OR 100 * n_dup_lines > 50 * n_lines) AS kept
FROM f"""

OP5 = r"""
WITH l AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
often AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.*, last IS NOT NULL AND last <> doc_id AS gone FROM k LEFT JOIN often USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id"""

OP2 = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r AS (
  SELECT *, CASE
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
      WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
      WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/'
      WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
      WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM u),
s AS (
  SELECT *, CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS label,
    array_to_string(list_transform(string_split(path, '/'),
      lambda x: regexp_replace(regexp_replace(x, '[0-9a-fA-F]{8,}', '*', 'g'), '[0-9]+', '*', 'g')), '/') AS shape FROM r),
shapes AS (SELECT host, shape, count(*) FILTER (WHERE label = 'block') AS n_block, count(label) AS n_label FROM s GROUP BY ALL),
steps AS (
  SELECT host, shape, i, segs[i] AS seg, array_to_string(segs[1:i - 1], '/') AS parent
  FROM (SELECT host, shape, string_split(shape, '/') AS segs, unnest(range(1, len(string_split(shape, '/')) + 1)) AS i FROM shapes) x),
wild AS (SELECT host, i, parent, count(DISTINCT seg) > 16 AS wild FROM steps GROUP BY ALL),
per AS (
  SELECT host, shape, string_agg(CASE WHEN wild THEN '*' ELSE seg END, '/' ORDER BY i) AS general
  FROM steps JOIN wild USING (host, i, parent) GROUP BY host, shape),
branch AS (
  SELECT host, general, sum(n_block)::DOUBLE AS n_block, sum(n_label)::DOUBLE AS n_label,
    regexp_replace(general, '[^/*]+((?:/[^/]*\*[^/]*)*/?)$', '?\1') AS family, (sum(n_block) + 1e0) / (sum(n_label) + 2e0) AS rate
  FROM per JOIN shapes USING (host, shape) GROUP BY host, general),
lagged AS (
  SELECT *, lag(n_block) OVER w AS rb, lag(n_label) OVER w AS rn FROM branch WINDOW w AS (PARTITION BY host, family ORDER BY rate, general)),
parts AS (
  SELECT *, CASE WHEN rn IS NULL THEN 0 WHEN abs(rate - (rb + 1e0) / (rn + 2e0)) > 1.64e0 * sqrt(p * (1 - p) * (1e0 / (n_label + 2e0) + 1e0 / (rn + 2e0)))
    THEN 1 ELSE 0 END AS parted FROM (SELECT *, (n_block + rb + 1e0) / (n_label + rn + 2e0) AS p FROM lagged) q),
runs AS (SELECT *, sum(parted) OVER (PARTITION BY host, family ORDER BY rate, general ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM parts),
m AS (
  SELECT host, general, sum(n_block) OVER w AS mb, sum(n_label) OVER w AS mn,
    CASE WHEN count(*) OVER w > 1 THEN family || '#' || run ELSE general END AS template
  FROM runs WINDOW w AS (PARTITION BY host, family, run)),
total AS (SELECT (sum(n_block) + 1e0) / (sum(n_label) + 2e0) AS p_all FROM branch),
h AS (SELECT host, (sum(n_block) + 4e0 * max(p_all)) / (sum(n_label) + 4e0) AS p_host FROM branch, total GROUP BY host),
scored AS (
  SELECT per.host, shape, template, (mb + 4e0 * p_host) / (mn + 4e0) AS purity
  FROM per JOIN m USING (host, general) JOIN h USING (host))
SELECT page_id, host, path, rule, coalesce(label, CASE WHEN round(purity, 9) >= 0.75 THEN 'block' ELSE 'allow' END) AS verdict, template
FROM s LEFT JOIN scored USING (host, shape)"""

OP6 = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
phrases AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM items WHERE len(w) > 0) x),
lengths AS (SELECT DISTINCT k FROM phrases),
places AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, lengths WHERE len(w) >= k) x),
hits AS (SELECT doc_id, k, i, item_id FROM places JOIN phrases USING (k, phrase)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) x GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits) x GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)"""

OP4 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, max(x.n) AS na, max(y.n) AS nb, count(*) AS k FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common WHERE 100 * k >= 75 * (na + nb - k)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS v, doc_id AS r FROM s UNION SELECT b, r FROM reach JOIN both_ways ON v = a WHERE r < b)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM s JOIN (SELECT v AS doc_id, min(r) AS component_id FROM reach GROUP BY v) m USING (doc_id)"""

OP1 = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20) x),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS r FROM p) x WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM late),
l AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM l ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""

OP13 = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
f AS (
  SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
    + 4 * (100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS bits FROM w),
lab AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (
  SELECT part, bits, count(*) AS n, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE toxic) AS n_toxic
  FROM f LEFT JOIN lab USING (doc_id) GROUP BY part, bits),
l AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(x, b)),
o AS (
  SELECT l1.x || l2.x || l3.x || l4.x || l5.x AS filter_order, [l1.b, l2.b, l3.b, l4.b, l5.b] AS bs
  FROM l l1, l l2, l l3, l l4, l l5 WHERE l1.b + l2.b + l3.b + l4.b + l5.b = 31 AND len(list_distinct([l1.b, l2.b, l3.b, l4.b, l5.b])) = 5),
s AS (SELECT filter_order, step, bs[step] AS own, coalesce(list_sum(bs[1:step - 1]), 0)::INT AS before FROM (SELECT *, unnest(range(1, 6)) AS step FROM o) q),
e AS (SELECT *, bits & own <> 0 AS fails, bits & before <> 0 AS gone FROM c, s)
SELECT part, filter_order, step::INT AS step, coalesce(sum(n) FILTER (WHERE NOT fails AND NOT gone), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (WHERE fails AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (WHERE fails AND gone), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (WHERE bits = own), 0)::BIGINT AS unique_fails, coalesce(sum(n_good) FILTER (WHERE fails AND NOT gone), 0)::BIGINT AS good_lost,
  coalesce(sum(n_toxic) FILTER (WHERE fails AND NOT gone), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * 120 // greatest(bit_count(bits), 1)) FILTER (WHERE fails), 0)::BIGINT AS shapley
FROM e GROUP BY part, filter_order, step"""


def _merkle_levels(tree: str, path: str, levels: int) -> str:
    """Levels of runs r1.. over {tree}0 (tree, idx, n, digest), and paths p1.. of the leaves through them."""
    out = []
    for k in range(1, levels + 1):
        below, was = f"{tree}{k - 1}", f"{path}{k - 1}"
        out.append(f"""{tree}{k} AS (
  SELECT tree, idx // 16 AS idx, (max(n) + 15) // 16 AS n, sha256(string_agg(digest, '' ORDER BY idx)) AS digest, list(digest ORDER BY idx) AS kids
  FROM {below} b WHERE n > 1 GROUP BY tree, b.idx // 16),
{path}{k} AS (
  SELECT p.* REPLACE (p.idx // 16 AS idx,
    CASE WHEN kids IS NULL THEN folded ELSE sha256(array_to_string(list_concat(list_concat(kids[1:p.idx % 16], [folded]), kids[p.idx % 16 + 2:]), '')) END AS folded,
    CASE WHEN kids IS NULL THEN proof ELSE proof || array_to_string(list_concat(kids[1:p.idx % 16], kids[p.idx % 16 + 2:]), '') END AS proof)
  FROM {was} p LEFT JOIN {tree}{k} r ON r.tree = p.tree AND r.idx = p.idx // 16)""")
    return ",\n".join(out)


def _merkle_tops(tree: str, levels: int) -> str:
    return " UNION ALL ".join(f"SELECT tree, digest FROM {tree}{k} WHERE n = 1" for k in range(levels + 1))


def _merkle_field(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}::VARCHAR)::VARCHAR || ':' || {x}::VARCHAR END"


def _merkle_leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_merkle_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


#: Six levels hold 16 million rows of a source, and as many sources.
OP12 = f"""
WITH bytes AS (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, i::BIGINT) AS v FROM range(256) t(i)),
crc AS (SELECT list(v ORDER BY i) AS tab FROM bytes),
d AS (
  SELECT *, xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS crc FROM documents, crc),
leaves AS (
  SELECT doc_id, source, {_merkle_leaf("text")} AS leaf,
    {_merkle_leaf("CASE WHEN crc % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END")} AS start FROM d),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM leaves),
r0 AS (SELECT tree, idx, n, leaf AS digest FROM placed),
p0 AS (SELECT doc_id, tree, tree AS source_tree, idx, leaf, start AS folded, '' AS proof FROM placed),
{_merkle_levels("r", "p", 6)},
sub AS ({_merkle_tops("r", 6)}),
t0 AS (SELECT 0::BIGINT AS tree, tree AS idx, count(*) OVER () AS n, digest FROM sub),
q0 AS (SELECT p.* REPLACE (0::BIGINT AS tree, p.tree AS idx) FROM p6 p),
{_merkle_levels("t", "q", 6)},
tops AS ({_merkle_tops("t", 6)})
SELECT q.doc_id, leaf, sub.digest AS subroot, (SELECT digest FROM tops) AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = (SELECT digest FROM tops) AS verified
FROM q6 q JOIN sub ON sub.tree = q.source_tree"""

ORACLES = {
    "op1_substring_dedup": OP1, "op2_url_filters": OP2, "op3_quality_rules": OP3, "op4_minhash_near_dedup": OP4, "op5_line_dedup": OP5,
    "op6_benchmark_decontamination": OP6, "op12_merkle_manifest": OP12, "op13_filter_interaction_audit": OP13,
}
