"""DuckDB SQL of the queries that SQL can express, over the test tables."""

from __future__ import annotations

from tessera.llm.quality import STOP_LANGS, STOP_WORDS

_SPACE = r"[\x20\x09-\x0D]"

OP2 = r"""
WITH parts AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^?#]*\?([^#]*)', 1), '') AS query
  FROM pages),
toks AS (
  SELECT *, list_distinct(list_concat(
    list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x),
    list_transform(list_filter(regexp_split_to_array(path, '[^A-Za-z0-9]+'), lambda x: x <> ''),
                   lambda x: 'p:' || CASE WHEN regexp_full_match(x, '[0-9]+') THEN '#' ELSE x END),
    list_transform(list_filter(list_transform(string_split(query, '&'), lambda x: regexp_extract(x, '^([^=]*)', 1)), lambda x: x <> ''), lambda x: 'q:' || x)
  )) AS tokens FROM parts),
marked AS (
  SELECT doc_id AS page_id, bool_or(quality = 0 OR toxic = 1) AS bad FROM labels
  WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY 1),
known AS MATERIALIZED (SELECT row_number() OVER () AS k, coalesce(bad, false) AS bad, tokens FROM toks JOIN marked USING (page_id) WHERE len(tokens) > 0),
place AS (SELECT k, unnest(tokens) AS t FROM known WHERE bad),
common AS (SELECT t, count(*) AS n FROM place GROUP BY t HAVING count(*) >= 3),
items AS (SELECT k, list_slice(list(t ORDER BY n DESC, t), 1, 12) AS i FROM place JOIN common USING (t) GROUP BY k),
subsets AS (
  SELECT k, list_sort(list_filter(list_transform(range(len(i)), lambda p: CASE WHEN (m >> p) & 1 = 1 THEN i[p + 1] END), lambda x: x IS NOT NULL)) AS s
  FROM (SELECT k, i, unnest(range(1, 1 << len(i))) AS m FROM items)),
mined AS MATERIALIZED (SELECT s FROM subsets GROUP BY s HAVING count(*) >= 3),
rules AS (SELECT s FROM mined JOIN known ON list_has_all(tokens, s) GROUP BY s HAVING sum(bad::INT) >= 0.5 * count(*)),
hits AS (SELECT DISTINCT url FROM toks JOIN rules ON list_has_all(tokens, s)),
fits AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule
  FROM toks)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN url IN (SELECT url FROM hits WHERE url IS NOT NULL) THEN 'block' ELSE 'allow' END AS verdict
FROM fits
"""

OP3 = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, lang FROM documents),
w AS (SELECT k, doc_id, text, lang, list_filter(regexp_split_to_array(text, '{_SPACE}+'), lambda x: x <> '') AS w FROM d),
grams AS (
  SELECT k, i, w[i] || chr(32) || w[i + 1] || chr(32) || w[i + 2] AS g
  FROM (SELECT k, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w)),
twice AS (SELECT k, g FROM grams GROUP BY 1, 2 HAVING count(*) > 1),
covered AS (
  SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM grams JOIN twice USING (k, g)) GROUP BY 1),
lines AS (
  SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup
  FROM (SELECT k, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1),
c AS (
  SELECT doc_id, coalesce(regexp_extract(lower(lang), '^[a-z]+') IN ({", ".join(f"'{x}'" for x in STOP_LANGS)}), false) AS covers_lang, len(w)::BIGINT AS n_words, length(regexp_replace(text, '{_SPACE}+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in STOP_WORDS)}))) AS n_stop
  FROM w LEFT JOIN covered USING (k) LEFT JOIN lines USING (k)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars BETWEEN 2.0 * n_words AND 12.0 * n_words AND n_symbols <= 0.25 * n_words
  AND n_dup_lines <= 0.5 * n_lines AND (NOT covers_lang OR n_stop >= 0.02 * n_words) AS kept
FROM j
"""

OP6 = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
g AS (SELECT b, max(page_id) AS top, count(*) AS n FROM p WHERE octet_length(b) >= 1000 GROUP BY 1)
SELECT page_id, octet_length(p.b)::BIGINT AS payload_bytes, sha1(p.b) AS payload_digest,
  CASE WHEN n > 1 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n > 1 AND page_id <> top THEN top END AS refers_to
FROM p LEFT JOIN g ON p.b = g.b
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{}')"

OP4 = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS.format(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")} AS w FROM benchmark),
wb AS (SELECT item_id, len(p) AS n, array_to_string(p, chr(32)) AS p FROM (
  SELECT item_id, list_slice(w, i, i + 9) AS p FROM (
    SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0))),
sizes AS (SELECT DISTINCT n FROM wb),
wd AS (SELECT k, i, n, array_to_string(list_slice(w, i, i + n - 1), chr(32)) AS p FROM (
  SELECT k, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes)),
m AS (SELECT DISTINCT k, i, wd.n, item_id FROM wd JOIN wb ON wd.p = wb.p AND wd.n = wb.n),
hit AS (SELECT k, count(DISTINCT pos) AS n FROM (SELECT k, unnest(generate_series(i, i + n - 1)) AS pos FROM m) GROUP BY 1),
its AS (SELECT k, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT k, item_id::VARCHAR AS s FROM m) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (k) LEFT JOIN its USING (k)
"""

_CLASSES = rf"""
d AS (SELECT doc_id, {_WORDS.format(r"[^\x20\x09-\x0D]+")} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, array_to_string(list_slice(w, i, i + 4), chr(32)) AS s FROM (
    SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1)
"""

OP5 = rf"""
WITH RECURSIVE {_CLASSES},
links AS (SELECT a, b FROM (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) t
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(b) AS component_id, d.doc_id = min(b) AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id, n.n
"""

OP8 = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT k, i, md5(array_to_string(list_slice(w, i, i + 34), chr(32))) AS h FROM (
  SELECT k, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d)),
twice AS (SELECT h FROM win GROUP BY 1 HAVING count(*) > 1),
starts AS (SELECT k, i FROM win WHERE h IN (SELECT h FROM twice)),
gone AS (SELECT DISTINCT k, unnest(generate_series(i, i + 34)) AS p FROM starts),
word AS (SELECT k, unnest(generate_series(1, len(w))) AS p, unnest(w) AS x FROM d),
kept AS (SELECT word.k, string_agg(x, ' ' ORDER BY word.p) AS t FROM word ANTI JOIN gone ON word.k = gone.k AND word.p = gone.p GROUP BY 1),
n AS (SELECT k, count(*) AS n FROM gone GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (k) LEFT JOIN kept USING (k)
"""

#: CRC-32 as a fold over bytes; ``crc`` holds the table of the 256 byte values, made by its rule.
_CRC_TABLE = """crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
  lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t)"""


def _crc32(s: str) -> str:
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen({s})),
      lambda i: ('0x' || substr(hex(encode({s})), 2 * i + 1, 2))::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])))"""


OP11 = rf"""
WITH tok AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS.format(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")} AS w FROM documents),
d AS (SELECT k, doc_id, len(w)::BIGINT AS n FROM tok WHERE len(w) > 0),
tf AS (SELECT k, t, count(*) AS tf FROM (SELECT k, unnest(w) AS t FROM tok) GROUP BY 1, 2),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS l FROM d),
wt AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY t, n_docs),
q AS (SELECT item, item_id, t, count(*) AS qtf FROM (
  SELECT row_number() OVER () AS item, item_id, unnest({_WORDS.format(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")}) AS t
  FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY 1, 2, 3),
scored AS (
  SELECT item, item_id, doc_id, k, sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // l))))::BIGINT AS score
  FROM q JOIN wt USING (t) JOIN tf USING (t) JOIN d USING (k), s GROUP BY 1, 2, 3, 4)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST, k) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""

OP13 = rf"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT doc, r, count(*) AS n FROM (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS r FROM documents) GROUP BY 1, 2),
hashed AS (SELECT r, n, {_crc32("(doc || ':' || r)")} AS h FROM runs, crc),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(r, 1, (h % length(r))::INT) || substr(r, (h % length(r))::INT + 2) ELSE r END AS w, sum(n)::BIGINT AS n FROM hashed GROUP BY 1),
v AS MATERIALIZED (SELECT w, n FROM w WHERE length(w) >= 6 AND n >= 5),
cut AS MATERIALIZED (SELECT w, n, i, substr(w, 1, i - 1) AS x, substr(w, i + 1) AS y FROM (SELECT w, n, unnest(generate_series(1, length(w))) AS i FROM v)),
pairs AS (
  SELECT a.w, b.w AS o, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.x = b.x AND a.y = b.y AND a.w <> b.w
  UNION SELECT v.w, cut.w, cut.n FROM v JOIN cut ON v.w = x || y
  UNION SELECT cut.w, v.w, v.n FROM v JOIN cut ON v.w = x || y),
best AS MATERIALIZED (SELECT w, count(*) AS n_near, max(n) AS top, min(o) FILTER (WHERE n = t) AS o FROM (SELECT *, max(n) OVER (PARTITION BY w) AS t FROM pairs) GROUP BY 1),
f AS MATERIALIZED (SELECT v.w, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * v.n THEN o END AS form, CASE WHEN top >= 5 * v.n THEN top END AS form_n FROM v LEFT JOIN best USING (w)),
chain AS (SELECT w, w AS node FROM f UNION ALL SELECT chain.w, f.form FROM chain JOIN f ON chain.node = f.w WHERE f.form IS NOT NULL),
ends AS (SELECT chain.w, node FROM chain JOIN f ON chain.node = f.w WHERE f.form IS NULL)
SELECT f.w AS word, form, node AS root, n, n_near::BIGINT AS n_near, form_n FROM f JOIN ends USING (w)
"""

SQL = {"op11_ranked_search": OP11, "op13_spelling_variants": OP13, "op8_substring_dedup": OP8, "op4_decontamination": OP4, "op5_minhash_dedup": OP5, "op2_url_filters": OP2, "op3_quality_rules": OP3, "op6_warc": OP6}
