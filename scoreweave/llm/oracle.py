"""Expected results of the text queries as DuckDB SQL, where SQL can express them.

Not expressed: byte-pair merges (op1, op5), trained models (op7, op8, op9) and canonical JSON with schema
checks (op10); their tests compare them with brute-force versions.
"""

from __future__ import annotations

from . import links, quality

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STATEMENTS: dict[str, str] = {}

_RATIO = " UNION ALL ".join(
    f"SELECT doc_id, lang, source, '{m}' AS metric, CAST({ratio.split(' / ')[0]} AS DOUBLE) / {ratio.split(' / ')[1]} AS x FROM measured WHERE NOT base_failed"
    for m, ratio in quality.METRICS.items()
)

STATEMENTS["op2_quality_rules"] = rf"""
WITH base AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
    [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w,
    [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l
  FROM documents
), windows AS (
  SELECT doc_id, i, list_slice(w, i, i + 7) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM base)
), twice AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1
), inside AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest(range(8)) AS k FROM twice) GROUP BY doc_id
), counted AS (
  SELECT b.doc_id, lang, source, len(w) AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM base b LEFT JOIN inside i ON b.doc_id = i.doc_id
), measured AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted
), ratios AS ({_RATIO}), buckets AS (
  SELECT lang, source, metric, CASE WHEN x > 0 THEN CAST(ceil(ln(x) / ln({quality.GAMMA})) AS BIGINT) ELSE {quality.ZERO} END AS bucket,
    count(*) AS n FROM ratios GROUP BY ALL
), merged AS (
  SELECT metric, bucket, lang, source, 2 * grouping(lang) + grouping(source) AS level, sum(n) AS n
  FROM buckets GROUP BY GROUPING SETS ((metric, bucket, lang, source), (metric, bucket, lang), (metric, bucket))
), marked AS (
  SELECT *, 2 * sum(CASE WHEN bucket = {quality.ZERO} THEN n ELSE 0 END) OVER g > sum(n) OVER g AS sparse
  FROM merged WINDOW g AS (PARTITION BY level, lang, source, metric)
), summed AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bucket) AS upto,
    sum(n) OVER (PARTITION BY level, lang, source, metric) AS total FROM marked WHERE bucket > {quality.ZERO} OR NOT sparse
), deciles AS (
  SELECT level, lang, source, metric, sparse, max(total) AS total, min(CASE WHEN 10 * upto >= total THEN bucket END) AS b1,
    min(CASE WHEN 10 * upto >= 9 * total THEN bucket END) AS b9 FROM summed GROUP BY level, lang, source, metric, sparse
), valued AS (
  SELECT *, CASE WHEN b1 > {quality.ZERO} THEN 2 * pow({quality.GAMMA}, b1) / (1 + {quality.GAMMA}) ELSE 0 END AS q1,
    CASE WHEN b9 > {quality.ZERO} THEN 2 * pow({quality.GAMMA}, b9) / (1 + {quality.GAMMA}) ELSE 0 END AS q9 FROM deciles
), fences AS (
  SELECT level, lang, source, metric, total, CASE WHEN sparse THEN 0 ELSE q1 - {quality.FENCE} * (q9 - q1) END AS low,
    q9 + {quality.FENCE} * (q9 - q1) AS high FROM valued
), cells AS (
  SELECT * FROM (SELECT DISTINCT lang, source FROM ratios) CROSS JOIN (SELECT DISTINCT metric FROM fences)
), chosen AS (
  SELECT p.lang, p.source, p.metric,
    CASE WHEN o.total >= {quality.MIN_ROWS} THEN o.low WHEN g.total >= {quality.MIN_ROWS} THEN g.low ELSE a.low END AS low,
    CASE WHEN o.total >= {quality.MIN_ROWS} THEN o.high WHEN g.total >= {quality.MIN_ROWS} THEN g.high ELSE a.high END AS high
  FROM cells p
  LEFT JOIN fences o ON o.level = 0 AND o.metric = p.metric AND o.lang IS NOT DISTINCT FROM p.lang AND o.source IS NOT DISTINCT FROM p.source
  LEFT JOIN fences g ON g.level = 1 AND g.metric = p.metric AND g.lang IS NOT DISTINCT FROM p.lang
  LEFT JOIN fences a ON a.level = 3 AND a.metric = p.metric
), broken AS (
  SELECT DISTINCT r.doc_id FROM ratios r JOIN chosen c
  ON c.metric = r.metric AND c.lang IS NOT DISTINCT FROM r.lang AND c.source IS NOT DISTINCT FROM r.source WHERE x < low OR x > high
)
SELECT m.doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND b.doc_id IS NULL AS kept
FROM measured m LEFT JOIN broken b ON b.doc_id = m.doc_id
"""

_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

STATEMENTS["op3_decontamination"] = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {_ALNUM}) AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {_ALNUM}) AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, list_slice(w, i, i + least(10, len(w)) - 1) AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), places AS (
  SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS s
  FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM windows))
), hits AS (
  SELECT doc_id, i, places.n AS n, item_id FROM places JOIN windows ON places.s = windows.s
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN named ON named.doc_id = d.doc_id
"""

STATEMENTS["op4_near_duplicates"] = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+') IF x <> ''] AS w
  FROM documents
), sets AS (
  SELECT doc_id, list_sort(list_distinct([list_slice(w, i, i + least(4, len(w)) - 1) FOR i IN range(1, greatest(len(w) - 3, 1) + 1)])) AS s
  FROM w WHERE len(w) > 0
), classes AS (
  SELECT min(doc_id) AS rec, len(s) AS n, s FROM sets GROUP BY s
), tokens AS (
  SELECT rec, n, unnest(s) AS x FROM classes
), links AS (
  SELECT l.rec AS a, r.rec AS b FROM tokens l JOIN tokens r ON l.x = r.x AND l.rec < r.rec
  GROUP BY l.rec, r.rec, l.n, r.n HAVING 100 * count(*) >= 80 * (l.n + r.n - count(*))
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT a AS v, b AS u FROM edges UNION SELECT r.v, e.b FROM reach r JOIN edges e ON r.u = e.a
), roots AS (
  SELECT v, least(v, min(u)) AS root FROM reach GROUP BY v
), found AS (
  SELECT s.doc_id, len(s.s) AS n, coalesce(root, c.rec) AS component
  FROM sets s JOIN classes c ON s.s = c.s LEFT JOIN roots ON roots.v = c.rec
)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, w.doc_id) AS component_id, w.doc_id = coalesce(component, w.doc_id) AS kept
FROM w LEFT JOIN found ON found.doc_id = w.doc_id
"""

_FITS = " ".join(
    f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{start}') THEN '{name}{start}'"
    for _, name, start in sorted(links.RULES, key=lambda r: -len(r[1] + r[2]))
)
_BLOCKS = ", ".join(f"'{name}{start}'" for verdict, name, start in links.RULES if verdict == "block")

_HREF = r"href\s*=\s*[\x22'']?\s*([^\x22''\s<>]*)"


def _host_of(address: str) -> str:
    """Host of an address that names one, with or without its scheme, else empty."""
    return f"translate(regexp_extract({address}, '(?i)^(?:https?:)?//([^/?#]*)', 1), '{UPPER}', '{LOWER}')"


def _walks(rounds: int) -> str:
    """Both walks, one step a common table expression."""
    steps = ["s0 AS MATERIALIZED (SELECT walk, host, seed AS score FROM base)"]
    for i in range(1, rounds + 1):
        steps.append(
            f"s{i} AS MATERIALIZED (SELECT walk, host, sum(part) AS score FROM (SELECT walk, host, {1 - links.DAMPING} * seed AS part FROM base UNION ALL "
            f"SELECT m.walk, m.dest, {links.DAMPING} * s.score * m.share FROM s{i - 1} s JOIN moves m ON m.walk = s.walk AND m.origin = s.host) GROUP BY walk, host)"
        )
    return ", ".join(steps)


STATEMENTS["op6_url_filters"] = rf"""
WITH p AS (
  SELECT page_id, html, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), ruled AS (
  SELECT *, CASE {_FITS} END AS rule FROM p
), based AS (
  SELECT host AS src, html, regexp_extract(html, '(?i)<base\b[^>]*?\s{_HREF}', 1) AS base FROM p WHERE host <> ''
), addresses AS (
  SELECT src, base, unnest(regexp_extract_all(CASE WHEN base <> '' THEN regexp_replace(html, '(?i)<base\b[^>]*>', '', 'g') ELSE html END,
    '(?i){_HREF}', 1)) AS address FROM based
), edges AS (
  SELECT src, dst, count(*) AS n FROM (
    SELECT src, CASE WHEN regexp_matches(address, '(?i)^([a-z][a-z0-9+.-]*:|//)') THEN {_host_of("address")} ELSE {_host_of("base")} END AS dst FROM addresses
  ) WHERE dst <> '' AND src <> dst GROUP BY src, dst
), moves AS (
  SELECT 'trust' AS walk, src AS origin, dst AS dest, n / sum(n) OVER (PARTITION BY src) AS share FROM edges
  UNION ALL SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM edges
), seeds AS (
  SELECT CASE WHEN rule IN ({_BLOCKS}) THEN 'distrust' ELSE 'trust' END AS walk, host, count(*) AS n
  FROM ruled WHERE rule IS NOT NULL AND host <> '' GROUP BY ALL
), base AS (
  SELECT walk, host, n / sum(n) OVER (PARTITION BY walk) AS seed FROM seeds
), {_walks(100)}, scores AS (
  SELECT host, sum(CASE WHEN walk = 'trust' THEN score ELSE 0 END) AS trust, sum(CASE WHEN walk = 'distrust' THEN score ELSE 0 END) AS distrust
  FROM s100 GROUP BY host
)
SELECT page_id, r.host AS host, path, rule, CASE WHEN rule IN ({_BLOCKS}) THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled r LEFT JOIN scores ON scores.host = r.host
"""

# CRC-32 (reflected, polynomial 0xEDB88320) of the decimal digits of an id, bit by bit.
_STEP = "list_reduce(list_prepend({v}, [0, 0, 0, 0, 0, 0, 0, 0]), lambda b, z: xor(b >> 1, (b & 1) * 3988292384))"
_CRC = (
    "xor(list_reduce(list_prepend(4294967295, [ascii(x) FOR x IN string_split(CAST(conv_id AS VARCHAR), '')]), lambda c, d: "
    + _STEP.format(v="xor(c, d)")
    + "), 4294967295)"
)

STATEMENTS["op11_conversation_trie"] = f"""
WITH own AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}}
    ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), rebuilt AS (
  SELECT o.conv_id, coalesce(list_slice(f.own, 1, h), []) || list_slice(o.own, h + 1, len(o.own)) AS seq
  FROM (SELECT *, {_CRC} % 9 AS h FROM own) o LEFT JOIN own f ON f.conv_id = o.conv_id - o.conv_id % 5
), prefixes AS (
  SELECT conv_id, len(seq) AS full_depth, d AS depth, list_slice(seq, 1, d) AS path
  FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (full_depth = depth), '')) AS ends_sha256
  FROM prefixes GROUP BY path, depth
), children AS (
  SELECT list_slice(path, 1, depth - 1) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), known AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children,
    CASE WHEN n.depth > 0 THEN (n_convs - 1) * strlen(n.path[n.depth].text) ELSE 0 END AS saved
  FROM nodes n LEFT JOIN children c ON n.path = c.path
), below AS (
  SELECT list_slice(path, 1, d) AS path, CAST(sum(saved) AS BIGINT) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT path, saved, n_children, unnest(range(0, depth + 1)) AS d FROM known) GROUP BY 1
)
SELECT k.conv_id, k.depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, b.n_leaves, b.saved_tokens, k.ends_sha256
FROM known k JOIN below b ON k.path = b.path LEFT JOIN nodes p ON k.depth > 0 AND p.path = list_slice(k.path, 1, k.depth - 1)
"""
