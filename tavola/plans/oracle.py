"""DuckDB twins of the queries in plans.queries, over the same tables."""

from __future__ import annotations

import re

from tavola.config import ALIASES, CITIES, LEGAL_SUFFIXES, MENU_HINTS, SECTION_TITLES, STOP_WORDS, STREET_WORDS
from tavola.plans.tables import TAILS, TAXONOMY


def _quoted(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


STOPS, SUFFIXES, STREETS = _quoted(STOP_WORDS), _quoted(LEGAL_SUFFIXES), _quoted(STOP_WORDS + STREET_WORDS)


def words(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '\s+'), lambda w: w <> '')"


def lcs(a: str, b: str) -> str:
    """The longest common subsequence, row by row of the usual table."""
    cell = lambda x: f"list_transform(string_split({x}, ''), lambda c: {{'c': c, 'r': CAST([] AS INTEGER[])}})"
    inner = f"list_reduce({cell(b)}, lambda p, y: {{'c': '', 'r': list_append(p.r, CASE WHEN y.c = x.c THEN q.r[len(p.r)] + 1 ELSE greatest(q.r[len(p.r) + 1], p.r[len(p.r)]) END)}}, {{'c': '', 'r': [0]}})"
    outer = f"list_reduce({cell(a)}, lambda q, x: {{'c': '', 'r': ({inner}).r}}, {{'c': '', 'r': list_resize([0], len({b}) + 1, 0)}})"
    return f"(CASE WHEN {a} = '' OR {b} = '' THEN 0 ELSE ({outer}).r[-1] END)"


def ratio(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) + len({b}) = 0 THEN 100.0 ELSE 200.0::DOUBLE * {lcs(a, b)} / (len({a}) + len({b})) END)"


def sorted_words(x: str) -> str:
    return f"array_to_string(list_sort({words(x)}), ' ')"


#: From pairs(a, b): `sets` has the strings that token sets are compared by, `ratios` the three ratios.
RATIOS = f"""
sets AS (
  SELECT a, b, len(wa) AS na, len(wb) AS nb, list_sort(list_intersect(wa, wb)) AS i,
         list_sort(list_filter(wa, lambda w: NOT list_contains(wb, w))) AS da, list_sort(list_filter(wb, lambda w: NOT list_contains(wa, w))) AS db
  FROM (SELECT a, b, list_distinct({words("a")}) AS wa, list_distinct({words("b")}) AS wb FROM pairs)
), joined AS (
  SELECT *, array_to_string(i, ' ') AS s, array_to_string(list_concat(i, da), ' ') AS sa, array_to_string(list_concat(i, db), ' ') AS sb,
         {sorted_words("a")} AS ta, {sorted_words("b")} AS tb
  FROM sets
), ratios AS (
  SELECT a, b, {ratio("a", "b")} AS plain, {ratio("ta", "tb")} AS token_sort,
         CASE WHEN na = 0 OR nb = 0 THEN 0.0 WHEN len(i) > 0 AND (len(da) = 0 OR len(db) = 0) THEN 100.0
              ELSE greatest({ratio("sa", "sb")}, CASE WHEN len(i) > 0 THEN {ratio("s", "sa")} ELSE 0 END, CASE WHEN len(i) > 0 THEN {ratio("s", "sb")} ELSE 0 END) END AS token_set
  FROM joined
)
"""

NAME_PAIRS = """
pairs AS (
  SELECT DISTINCT a, b FROM (SELECT DISTINCT p_name AS a FROM part) x,
    (SELECT lower(n_name) AS b FROM nation UNION SELECT 'the ' || p_name FROM part) y WHERE len(a) <= len(b)
)
"""

VENUES = f"""
raw AS (SELECT doc_id, n_chars, string_split_regex(text, '\\s+') AS w FROM documents),
venues AS (
  SELECT doc_id % 2 AS side, CAST(doc_id AS VARCHAR) AS id, doc_id AS ordinal, array_to_string(w[1:3], ' ') AS name,
         array_to_string(w[4:5], ' ') || ' ' || CAST(n_chars % 200 AS VARCHAR) AS address,
         CASE WHEN doc_id % 97 <> 0 THEN 41.3::DOUBLE + (n_chars % 500) / 2500.0::DOUBLE END AS lat, 2.0::DOUBLE + (n_chars % 400) / 2000.0::DOUBLE AS lon
  FROM raw
), split_names AS (SELECT *, {words("lower(strip_accents(name))")} AS t FROM venues),
based AS (
  SELECT *, trim(regexp_replace(array_to_string(CASE WHEN len(t) > 0 AND list_contains({SUFFIXES}, t[-1]) THEN t[1:len(t) - 1] ELSE t END, ' '), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g')) AS base
  FROM split_names
), cleaned AS (
  SELECT *, coalesce(nullif(array_to_string(list_filter({words("base")}, lambda w: NOT list_contains({STOPS}, w)), ' '), ''), base) AS clean,
         {words("regexp_replace(lower(strip_accents(address)), '[^a-z0-9\\s]', '', 'g')")} AS at
  FROM based
), v AS (
  SELECT *, list_distinct(list_filter(at, lambda w: regexp_full_match(w, '\\d+'))) AS numbers,
         list_filter(at, lambda w: NOT regexp_full_match(w, '\\d+') AND NOT list_contains({STREETS}, w)) AS streets
  FROM cleaned WHERE name <> ''
), l AS (SELECT * FROM v WHERE side = 0), r AS (SELECT * FROM v WHERE side = 1)
"""

#: Every pair in the band, by the plain band, and the left venues without coordinates with all right ones.
BAND = """
near AS (
  SELECT l.id AS l_id, r.id AS r_id, l.ordinal AS lo, r.ordinal AS ro, l.clean AS a, r.clean AS b, l.lat AS lat1, l.lon AS lon1, r.lat AS lat2, r.lon AS lon2,
         l.numbers AS n1, r.numbers AS n2, l.streets AS s1, r.streets AS s2,
         CASE WHEN l.lat IS NULL THEN 0 ELSE list_position([0, -11, -10, -9, -1, 1, 9, 10, 11],
           CAST(10 * (round_even(r.lat / 0.05::DOUBLE, 0) - round_even(l.lat / 0.05::DOUBLE, 0)) + (round_even(r.lon / 0.05::DOUBLE, 0) - round_even(l.lon / 0.05::DOUBLE, 0)) AS INTEGER)) END AS cell_rank
  FROM l JOIN r ON (abs(l.lat - r.lat) <= 0.02::DOUBLE AND abs(l.lon - r.lon) <= 0.02::DOUBLE) OR l.lat IS NULL
)
"""


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    return f"(6371000.0::DOUBLE * 2 * atan2(sqrt({a}), sqrt(1 - {a})))"


ADDRESS = """(CASE WHEN len(list_intersect(n1, n2)) > 0 AND len(list_intersect(s1, s2)) > 0 THEN 1.0 WHEN len(list_intersect(n1, n2)) > 0 THEN 0.5
  ELSE 0.3::DOUBLE * len(list_intersect(list_distinct(s1), list_distinct(s2))) / greatest(len(s1), len(s2), 1) END)"""

SCORED = f"""
{BAND}, pairs AS (SELECT DISTINCT a, b FROM near), {RATIOS}, named AS (
  SELECT a, b, CASE WHEN a = '' OR b = '' THEN 0.0 WHEN greatest(plain, token_sort) / 100 < 0.70 THEN greatest(plain, token_sort, token_set) / 100 ELSE greatest(plain, token_sort) / 100 END AS name_score
  FROM ratios
), parts AS (
  SELECT near.*, name_score, CASE WHEN lat1 IS NULL OR lat2 IS NULL OR lon1 IS NULL OR lon2 IS NULL THEN 0.0 ELSE exp(-0.00035::DOUBLE * {haversine("lat1", "lon1", "lat2", "lon2")}) END AS geo, {ADDRESS} AS addr
  FROM near JOIN named USING (a, b)
), scored AS (
  SELECT *, CASE WHEN addr > 0.8 THEN least(1.0::DOUBLE, 0.6::DOUBLE * name_score + 0.4::DOUBLE * geo + 0.15::DOUBLE)
                 WHEN addr > 0.4 THEN least(1.0::DOUBLE, 0.6::DOUBLE * name_score + 0.4::DOUBLE * geo + 0.08::DOUBLE)
                 ELSE 0.6::DOUBLE * name_score + 0.4::DOUBLE * geo END AS score
  FROM parts
)
"""

BEST = """
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_id ORDER BY score DESC, cell_rank, ro) AS k FROM scored WHERE score > 0) WHERE k = 1 AND score >= 0.7
)
"""
UNIQUE = """
matches AS (
  SELECT * FROM (SELECT l_id, r_id, score, row_number() OVER (PARTITION BY r_id ORDER BY score DESC, lo) AS k FROM best) WHERE k = 1
)
"""
ITEMS = "items AS (SELECT p_partkey AS item_id, p_partkey % 10 AS venue_id, p_name AS name, lower(p_type) AS description, p_retailprice AS price, p_brand AS section, p_size FROM part)"
_ROWS = ", ".join(f"('{i}', '{n}', {o})" for i, n, o in TAXONOMY)
TAX = f"tax(taxonomy_id, name, ordinal) AS (VALUES {_ROWS})"
CLASSIFIED = f"classified AS (SELECT l_partkey AS item_id, 'T' || lpad(CAST(l_partkey % {len(TAXONOMY)} + 1 AS VARCHAR), 2, '0') AS taxonomy_id, round(max(l_discount), 2) AS confidence FROM lineitem GROUP BY l_partkey)"
MATCHED = "matched AS (SELECT o_custkey AS venue_id, o_orderkey AS match_id FROM orders WHERE o_orderstatus = 'F')"
LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS at FROM documents)"
PRICES = """
cents AS (SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS c FROM part), parts AS (SELECT p_partkey, c // 100 AS w, lpad(CAST(c % 100 AS VARCHAR), 2, '0') AS r FROM cents)
"""
DIFFS = "diffs AS (SELECT user_id AS menu_id, (['match', 'new', 'price_changed', 'desc_changed', 'removed'])[event_id % 5 + 1] AS diff_type, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS section, event_id FROM events)"
COUNTS = """count(*) FILTER (WHERE diff_type = 'match') AS matches, count(*) FILTER (WHERE diff_type = 'new') AS new_items, count(*) FILTER (WHERE diff_type = 'removed') AS removed,
  count(*) FILTER (WHERE diff_type IN ('price_changed', 'desc_changed')) AS price_changes, count(*) FILTER (WHERE diff_type IN ('match', 'new', 'price_changed', 'desc_changed')) AS total_extracted"""
URLS = "u AS (SELECT page_id, unnest([url, 'https://a.b/restaurants-' || page_id || '/menu', 'https://a.b/menu/' || page_id || '/x', 'https://a.b/?cid=' || page_id, ' not a url']) AS url, unnest([0, 1, 2, 3, 4]) AS at FROM pages)"
TEXTS = f"texts AS (SELECT p_partkey AS item_id, trim(p_name || ' ' || ({_quoted(TAILS)})[p_partkey % {len(TAILS)} + 1]) AS text FROM part)"
TOKENS = f"""
cut AS (SELECT item_id, list_transform({words("lower(text)")}, lambda w: trim(w, '.,!?()[]{{}}''"')) AS ws FROM texts),
once AS (SELECT item_id, list_filter(ws, lambda w, i: list_position(ws, w) = i) AS ws FROM cut),
tokens AS (SELECT item_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS at FROM once)
"""


def ascii_fold(x: str) -> str:
    return rf"regexp_replace(strip_accents({x}), '[^\x00-\x7F]', '', 'g')"


_ALIAS_ROWS = ", ".join(f"('{k}', '{v}')" for k, v in ALIASES.items())
ALIASED = f"""
aliases(alias, category) AS (VALUES {_ALIAS_ROWS}),
known AS (SELECT {ascii_fold("alias")} AS alias, min(taxonomy_id) AS alias_id FROM aliases JOIN tax ON lower(tax.name) = category GROUP BY 1),
aliased AS (SELECT item_id, arg_min(alias_id, at) AS alias_id FROM tokens JOIN known ON {ascii_fold("word")} = known.alias GROUP BY item_id)
"""


def normal(x: str) -> str:
    out = ascii_fold(f"lower({x})")
    out = rf"regexp_replace({out}, '^\d+[\s.\-)]*', '')"
    out = rf"regexp_replace({out}, '[^a-z0-9\s]', ' ', 'g')"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


MENU = f"""
known AS (SELECT p_brand AS menu_id, p_partkey AS item_id, p_name AS db_name, p_retailprice AS db_price, lower(p_type) AS db_description FROM part),
cand AS (
  SELECT p_brand AS menu_id, p_partkey AS at, CASE p_size % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN '7. ' || p_name WHEN 2 THEN p_name || ' xl' ELSE 'zzz qq' END AS name,
         CASE WHEN p_size % 3 = 0 THEN p_retailprice + 1 ELSE p_retailprice END AS price, CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN 'something else' ELSE lower(p_type) END AS description
  FROM part
), n1 AS (SELECT *, {normal("name")} AS a FROM cand), n2 AS (SELECT *, {normal("db_name")} AS b FROM known),
described AS (SELECT DISTINCT {normal("c.description")} AS a, {normal("k.db_description")} AS b FROM cand c, (SELECT DISTINCT db_description FROM known) k),
pairs AS (SELECT DISTINCT a, b FROM (SELECT DISTINCT a FROM n1) x, (SELECT DISTINCT b FROM n2) y UNION SELECT a, b FROM described), {RATIOS},
ranked AS (
  SELECT n1.menu_id, n1.at, n2.item_id, n2.db_price, n2.db_description, token_set / 100 AS score, row_number() OVER (PARTITION BY n1.menu_id, n1.at ORDER BY token_set DESC, n2.item_id) AS k
  FROM n1 JOIN n2 USING (menu_id) JOIN ratios USING (a, b) WHERE token_set / 100 >= 0.55
)
SELECT c.menu_id, c.at,
       CASE WHEN m.item_id IS NULL THEN 'new' WHEN abs(c.price - m.db_price) > 0.01 THEN 'price_changed'
            WHEN trim(c.description) <> '' AND trim(m.db_description) <> '' AND d.token_set < 60 THEN 'desc_changed' ELSE 'match' END AS diff_type,
       m.item_id, round(m.score, 2) AS match_score, 'general' AS section
FROM cand c LEFT JOIN (SELECT * FROM ranked WHERE k = 1) m ON c.menu_id = m.menu_id AND c.at = m.at
LEFT JOIN ratios d ON d.a = {normal("c.description")} AND d.b = {normal("m.db_description")}
"""

GARBAGE = rf"""
WITH {LINES}, m AS (
  SELECT *, len(line) AS n, len(regexp_extract_all(line, '\p{{Nd}}')) AS dg, len(regexp_extract_all(line, '\p{{L}}')) AS lt, {words("line")} AS ws,
         len(list_distinct(list_filter(string_split(lower(replace(line, ' ', '')), ''), lambda c: c <> ''))) AS kinds, trim(regexp_extract(line, '\d+\s*€(.*)$', 1)) AS rest
  FROM lines
)
SELECT doc_id, at, CASE WHEN n < 3 THEN true ELSE
  dg / n > 0.6 OR (n - dg - lt) / n > 0.4 OR (lt > 0 AND lt / n < 0.2) OR (regexp_replace(line, '[ .,]', '', 'g') <> '' AND lt = 0)
  OR regexp_matches(line, '(?i)www\.|\.com|\.es\b')
  OR regexp_matches(line, '(?i)pedido\s*m[níi]*nimo|horario|tel[eé]fono|abierto|domingo|s[bá]bado|viernes|lunes|martes|mi[eé]rcoles|reparto|recoger|€\s*\d+[,.]\d{{2}}\s*(iva|tva|vat)')
  OR len(list_filter(ws, lambda w: len(w) > 2 AND replace(w, w[1], '') = '')) > 0
  OR (kinds <= 3 AND n > 6 AND lt / n < 0.5) OR (n > 3 AND n < 6 AND dg > 0 AND lt > 0 AND NOT regexp_matches(line, '\s'))
  OR (contains(line, '€') AND dg / n > 0.3 AND lt < 3) OR (len(ws) >= 2 AND len(list_distinct(ws)) = 1) OR (len(ws) >= 3 AND len(list_distinct(ws)) < len(ws))
  OR (regexp_matches(line, '\d+\s*€') AND rest <> '' AND len(rest) < 12 AND lt / n < 0.65)
  OR regexp_matches(line, '^\d+[,.]\d*[a-zA-Z]') OR regexp_matches(line, '[bcdfghjklmnpqrstvwxyzBCDFGHJKLMNPQRSTVWXYZ]{{4,}}') END AS garbage
FROM m
"""

CLASSIFY = f"""
WITH {TEXTS}, {TOKENS}, {TAX}, {ALIASED},
entries AS (SELECT taxonomy_id, ordinal, list_filter(list_transform({words("lower(name)")}, lambda w: trim(w, '.,!?()[]{{}}''"-')), lambda w: w <> '') AS ws FROM tax),
tw AS (SELECT taxonomy_id, ordinal, len(ws) AS n, unnest(ws) AS tax_word FROM entries),
vocabulary AS (SELECT DISTINCT word FROM tokens),
pairs AS (
  SELECT DISTINCT tax_word, word FROM (SELECT DISTINCT tax_word FROM tw) x, vocabulary
  WHERE {ascii_fold("tax_word")} = {ascii_fold("word")} OR (len(tax_word) >= 4 AND (contains({ascii_fold("word")}, {ascii_fold("tax_word")}) OR {ratio("tax_word", "word")} >= 80))
), scores AS (
  SELECT item_id, taxonomy_id, ordinal, sum(hit) / max(n) AS score FROM (
    SELECT i.item_id, tw.taxonomy_id, tw.ordinal, tw.n, CASE WHEN EXISTS (SELECT 1 FROM tokens t JOIN pairs p ON t.word = p.word WHERE t.item_id = i.item_id AND p.tax_word = tw.tax_word) THEN 1 ELSE 0 END AS hit
    FROM texts i, tw
  ) GROUP BY ALL
), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, ordinal) AS k FROM scores WHERE score > 0) WHERE k = 1)
SELECT i.item_id, CASE WHEN coalesce(b.score, 0) < 1 AND a.alias_id IS NOT NULL THEN a.alias_id ELSE coalesce(b.taxonomy_id, 'unknown') END AS taxonomy_id,
       CASE WHEN coalesce(b.score, 0) < 1 AND a.alias_id IS NOT NULL THEN 1.0 ELSE coalesce(round(b.score, 6), 0.0) END AS confidence
FROM texts i LEFT JOIN best b USING (item_id) LEFT JOIN aliased a USING (item_id)
"""

PREDICTED = f"{TAX}, {CLASSIFIED}, predicted AS (SELECT item_id, arg_max(lower(name), taxonomy_id) AS predicted FROM classified JOIN tax USING (taxonomy_id) GROUP BY item_id), truth AS (SELECT p_partkey AS item_id, lower(string_split(p_name, ' ')[2]) AS label FROM part)"
HINT = " OR ".join(f"contains(t, '{h}')" for h in MENU_HINTS)
_CITY = " ".join(rf"WHEN regexp_matches(lower(address), '\b{c.lower()}\b') THEN '{c}'" for c in CITIES)
_PLACES = _quoted([c.upper() for c in (*CITIES, "Nowhere", "Londonderry")])
SUPPLIER_MENUS = """
SELECT CAST(s_suppkey AS VARCHAR) AS venue_id, s_name AS name, 'd' AS description, s_suppkey + 0.5::DOUBLE AS price, 'S' || s_nationkey AS section, s_suppkey FROM supplier WHERE s_suppkey % 10 <> 9
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'second', '', NULL, 'S' || s_nationkey, s_suppkey FROM supplier WHERE s_suppkey % 10 <> 9
"""


def oracle_sql() -> dict[str, str]:
    """SQL by query; the column ``at``, a reserved word, is quoted here."""
    from tavola.plans import oracle_files

    return {k: re.sub(r'(?<![."\w])at(?!["\w])', '"at"', sql) for k, sql in {**_queries(), **oracle_files.queries()}.items()}


def _queries() -> dict[str, str]:
    return {
        "kpi_match_rate": f"WITH {MATCHED} SELECT (SELECT count(*) FROM customer) AS total_venues, count(DISTINCT venue_id) AS matched_venues, round(100.0 * count(DISTINCT venue_id) / (SELECT count(*) FROM customer), 2) AS match_rate FROM matched",
        "kpi_density": f"WITH {MATCHED} SELECT (SELECT count(*) FROM customer) AS left_venues, (SELECT count(*) FROM supplier) AS right_venues, count(DISTINCT venue_id) AS matched_venues FROM matched",
        "kpi_coverage": f"WITH {CLASSIFIED} SELECT (SELECT count(*) FROM part) AS total_items, count(DISTINCT item_id) AS classified_items, round(100.0 * count(DISTINCT item_id) / (SELECT count(*) FROM part), 2) AS coverage FROM classified",
        "kpi_health": "SELECT 'ok' AS status",
        "top_categories": f"WITH {TAX}, {CLASSIFIED} SELECT name, count(*) AS n FROM classified JOIN tax USING (taxonomy_id) GROUP BY name ORDER BY n DESC, name LIMIT 10",
        "venue_flags": f"WITH {MATCHED} SELECT c_custkey AS id, c_name AS name, c_custkey IN (SELECT venue_id FROM matched) AS is_matched FROM customer",
        "venue_images": f"""WITH {MATCHED}, places AS (SELECT s_suppkey, s_name FROM supplier), firsts AS (SELECT venue_id % 50 AS place, arg_min(venue_id, match_id) AS venue_id FROM matched GROUP BY 1)
            SELECT CAST(s_suppkey * 7 AS VARCHAR) AS menu_id, venue_id, coalesce(c_name, 'Unknown') AS venue_name, s_suppkey || '/a.jpg' AS images, s_name < 'Supplier#000000020' AS has_detections
            FROM firsts JOIN places ON s_suppkey = place LEFT JOIN customer ON c_custkey = venue_id""",
        "diff_counts": f"WITH {DIFFS} SELECT menu_id, {COUNTS} FROM diffs GROUP BY menu_id",
        "menu_extractions": f"""WITH {DIFFS}, counts AS (SELECT menu_id, menu_id % 13 AS venue_id, {COUNTS} FROM diffs GROUP BY menu_id)
            SELECT counts.*, coalesce(c_name, 'Unknown') AS venue_name, (SELECT count(*) FROM part WHERE p_partkey % 10 = venue_id) AS db_items FROM counts LEFT JOIN customer ON c_custkey = venue_id""",
        "menu_extraction_one": f"WITH {DIFFS} SELECT event_id, diff_type, CASE WHEN section = '' THEN 'general' ELSE section END AS section FROM diffs WHERE menu_id = 7",
        "unclassified_anti": "SELECT p_partkey AS item_id, p_name AS name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)",
        "matched_semi": f"WITH {MATCHED} SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey IN (SELECT venue_id FROM matched)",
        "stale_ids": f"WITH {MATCHED} SELECT o_custkey AS venue_id FROM orders EXCEPT SELECT venue_id FROM matched",
        "export_join3": f"WITH {TAX}, {CLASSIFIED} SELECT p_partkey AS item_id, p_name AS name, tax.name AS category, confidence FROM part JOIN classified ON item_id = p_partkey JOIN tax USING (taxonomy_id)",
        "upsert_merge": "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT o_custkey, max(o_orderpriority) FROM orders GROUP BY o_custkey",
        "insert_or_ignore": "SELECT o_custkey AS venue_id, coalesce(min(o_orderkey) FILTER (WHERE o_orderstatus = 'F'), min(o_orderkey)) AS match_id FROM orders GROUP BY o_custkey",
        "replace_children": f"WITH {ITEMS} SELECT venue_id, name, price FROM items WHERE venue_id >= 3 UNION ALL SELECT venue_id, name, max(price) FROM items WHERE venue_id < 3 GROUP BY venue_id, name",
        "last_wins_merge": "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1",
        "split_chunks": "SELECT c_custkey AS id, c_name AS name, CAST((row_number() OVER (ORDER BY c_custkey) - 1) // ((SELECT count(*) + 2 FROM customer) // 3) AS INTEGER) AS part FROM customer",
        "flatten_json": f"WITH one AS ({SUPPLIER_MENUS}) SELECT venue_id, name, description, price, section FROM one UNION ALL SELECT venue_id, name, description, price, section FROM one WHERE s_suppkey % 2 = 1",
        "venue_rows": "SELECT CAST(s_suppkey AS VARCHAR) AS id, s_suppkey AS ordinal, s_name AS name, s_name AS address, CASE WHEN s_suppkey % 3 = 0 THEN 41.5::DOUBLE END AS lat, CASE WHEN s_suppkey % 3 = 0 THEN 2.5::DOUBLE END AS lon, 'u' AS url FROM supplier WHERE s_suppkey % 10 <> 9",
        "parse_price_us": f"WITH {PRICES} SELECT p_partkey, CAST(w || '.' || r AS DOUBLE) AS price FROM parts",
        "parse_price_eu": f"WITH {PRICES} SELECT p_partkey, CAST(w || '.' || r AS DOUBLE) AS price FROM parts",
        "parse_price_auto": f"WITH {PRICES} SELECT p_partkey, CAST(CASE p_partkey % 6 WHEN 0 THEN w || '.' || r WHEN 1 THEN w || '.' || r WHEN 2 THEN CAST(w AS VARCHAR) WHEN 3 THEN w || '.' || r WHEN 4 THEN '1000' || r ELSE '0' END AS DOUBLE) AS price FROM parts",
        "menu_price": """WITH e AS (SELECT p_partkey, p_name, p_type, p_size // 2 AS w, lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') AS c FROM part)
            SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN CAST(w || '.' || c AS DOUBLE) END AS price, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' EUR' ELSE p_name || ' ' || p_type END AS rest FROM e""",
        "url_venue_id": rf"""WITH {URLS} SELECT page_id, at, coalesce(nullif(regexp_extract(url, '/restaurants[-/]?(.+?)(?:/menu|/|$)', 1), ''), nullif(regexp_extract(url, '/menu/(.+?)(?:/|$)', 1), ''), list_filter(string_split(url, '/'), lambda s: s <> '')[-1], url) AS venue_id,
            regexp_matches(trim(url), '(?i)^https?://[^\s/$.?#].[^\s]*$') AS valid FROM u""",
        "url_param": rf"WITH {URLS} SELECT page_id, at, nullif(regexp_extract(url, 'cid=(\d+)', 1), '') AS cid, nullif(regexp_extract(url, 'page=(\d+)', 1), '') AS page FROM u",
        "fold_text": "SELECT doc_id, strip_accents(text) AS folded FROM documents",
        "clean_name": f"WITH {VENUES} SELECT id, base, clean FROM cleaned",
        "normalize_match": f"WITH {LINES} SELECT doc_id, at, {normal('line')} AS normal FROM lines",
        "detect_city": f"WITH a AS (SELECT c_custkey, 'calle ' || c_nationkey || ', ' || ({_PLACES})[c_custkey % {len(CITIES) + 2} + 1] || ', x' AS address FROM customer) SELECT c_custkey, CASE {_CITY} ELSE 'unknown' END AS city FROM a",
        "garbage_flag": GARBAGE,
        "section_header": rf"WITH {LINES} SELECT doc_id, at, regexp_full_match(trim(line), '(?i)({'|'.join(SECTION_TITLES)})') OR (upper(trim(line)) = trim(line) AND lower(trim(line)) <> trim(line) AND len(trim(line)) < 30 AND NOT regexp_matches(trim(line), '\d{{1,2}}[.,]\d{{1,2}}')) AS header FROM lines",
        "item_text": "SELECT p_partkey AS item_id, trim(p_name || ' ' || CASE WHEN p_partkey % 4 <> 0 THEN lower(p_type) ELSE '' END) AS text FROM part",
        "normalize_price": f"WITH {PRICES} SELECT p_partkey, CAST(w || '.' || r AS DOUBLE) AS us, CAST(w || '.' || r AS DOUBLE) AS eu FROM parts",
        "address_line": "SELECT c_custkey, c_name || CASE WHEN c_nationkey % 2 = 0 THEN ', ' || c_mktsegment ELSE '' END || CASE WHEN c_nationkey % 3 = 0 THEN ', ' || c_nationkey ELSE '' END AS address FROM customer",
        "stop_words": f"WITH {VENUES} SELECT id, array_to_string(list_filter({words('base')}, lambda w: NOT list_contains({STOPS}, w)), ' ') AS rest FROM cleaned",
        "first_match": f"WITH {MATCHED}, k AS (SELECT CAST(s_suppkey % 20 AS VARCHAR) AS menu_id, venue_id, CAST(s_suppkey AS VARCHAR) AS place_id, match_id FROM matched JOIN supplier ON venue_id % 50 = s_suppkey) SELECT menu_id, arg_min(venue_id, match_id) AS venue_id, arg_min(place_id, match_id) AS place_id FROM k GROUP BY menu_id",
        "save_matches": f"WITH {MATCHED} SELECT venue_id, max(match_id) AS match_id FROM matched GROUP BY venue_id",
        "indel_ratio": f"WITH {NAME_PAIRS} SELECT a, b, round({ratio('a', 'b')}, 6) AS ratio FROM pairs",
        "indel_ratio_native": f"WITH {NAME_PAIRS} SELECT a, b, round({ratio('a', 'b')}, 6) AS ratio FROM pairs",
        "token_sort": f"WITH {NAME_PAIRS}, {RATIOS} SELECT a, b, round(token_sort, 6) AS ratio FROM ratios",
        "token_set": f"WITH {NAME_PAIRS}, {RATIOS} SELECT a, b, round(token_set, 6) AS ratio FROM ratios",
        "geo_score": f"WITH {VENUES}, h AS (SELECT id, {haversine('lat', 'lon', '41.4::DOUBLE', '2.1::DOUBLE')} AS m FROM venues) SELECT id, round(m, 6) AS metres, round(CASE WHEN m IS NULL THEN 0 ELSE exp(-0.00035::DOUBLE * m) END, 6) AS score FROM h",
        "grid_cells": f"WITH {VENUES} SELECT id, CAST(round_even(lat / 0.05::DOUBLE, 0) AS INTEGER) AS ci, CAST(round_even(lon / 0.05::DOUBLE, 0) AS INTEGER) AS cj, CASE WHEN lat IS NULL OR lon IS NULL THEN 'no_coords' ELSE printf('%.2f_%.2f', round_even(lat / 0.05::DOUBLE, 0) * 0.05::DOUBLE, round_even(lon / 0.05::DOUBLE, 0) * 0.05::DOUBLE) END AS grid FROM venues",
        "band_join": f"WITH {VENUES} SELECT l.id AS l_id, r.id AS r_id FROM l JOIN r ON abs(l.lat - r.lat) <= 0.02::DOUBLE AND abs(l.lon - r.lon) <= 0.02::DOUBLE",
        "null_coord_scan": f"WITH {VENUES} SELECT l.id AS l_id, r.id AS r_id FROM l, r WHERE l.lat IS NULL",
        "address_sim": f"WITH {VENUES}, {BAND} SELECT l_id, r_id, round(CAST({ADDRESS} AS DOUBLE), 6) AS score FROM near WHERE lat1 IS NOT NULL",
        "total_score": f"WITH {VENUES}, {SCORED} SELECT l_id, r_id, round(name_score, 6) AS name_score, round(score, 6) AS score FROM scored WHERE lat1 IS NOT NULL",
        "er_best": f"WITH {VENUES}, {SCORED}, {BEST} SELECT l_id, r_id, round(score, 6) AS score FROM best",
        "er_one_to_one": f"WITH {VENUES}, {SCORED}, {BEST}, {UNIQUE} SELECT l_id, r_id, round(score, 6) AS score FROM matches",
        "er_unmatched": f"WITH {VENUES}, {SCORED}, {BEST}, {UNIQUE} SELECT id AS l_id FROM l WHERE id NOT IN (SELECT l_id FROM matches)",
        "score_stats": f"WITH {VENUES}, {SCORED}, {BEST} SELECT count(*) AS n, round(min(score), 6) AS min_score, round(max(score), 6) AS max_score, round(avg(score), 6) AS avg_score FROM best",
        "classify_items": CLASSIFY,
        "alias_fallback": f"WITH {TEXTS}, {TOKENS}, {TAX}, {ALIASED} SELECT item_id, alias_id FROM aliased",
        "accuracy": f"""WITH {PREDICTED} SELECT count(*) AS total_items, count(*) FILTER (WHERE predicted = label) AS correct, count(*) FILTER (WHERE predicted <> label) AS incorrect, count(*) FILTER (WHERE predicted IS NULL) AS unclassified,
            round(count(*) FILTER (WHERE predicted = label) / count(*), 4) AS accuracy, (SELECT count(DISTINCT item_id) FROM predicted) AS classified_items FROM truth LEFT JOIN predicted USING (item_id)""",
        "confusion": f"WITH {PREDICTED} SELECT label, predicted, count(*) AS n FROM truth JOIN predicted USING (item_id) GROUP BY label, predicted",
        "menu_diff": f"WITH {MENU}",
        "reading_order": """SELECT image, string_agg(text, chr(10) ORDER BY c, cy, ordinal, text) AS text FROM (
            SELECT l_orderkey AS image, l_linenumber + l_partkey * 10 AS ordinal, CASE WHEN (l_quantity * 7) % 100 >= 50 THEN 1 ELSE 0 END AS c, floor(l_extendedprice) AS cy, l_returnflag || '-' || l_partkey AS text FROM lineitem WHERE l_discount * 8 >= 0.35
            ) GROUP BY image""",
        "orientation": f"""WITH t AS (SELECT user_id AS image, event_type AS rotation, event_id AS ordinal, trim(lower(CASE event_id % 3 WHEN 0 THEN '--- ' WHEN 1 THEN 'Pizza x' ELSE props END)) AS t FROM events),
            s AS (SELECT image, rotation, min(ordinal) AS f, CAST(sum(CASE WHEN len(t) >= 3 AND regexp_matches(t, '[a-zA-Z0-9]') THEN 1 + CASE WHEN {HINT} THEN 2 ELSE 0 END ELSE 0 END) AS BIGINT) AS score FROM t GROUP BY image, rotation)
            SELECT image, rotation, score FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, f) AS k FROM s) WHERE k = 1""",
        "crawl_stats": "SELECT count(*) AS pages, count(*) FILTER (WHERE coalesce(html, '') <> '') AS fetched, count(*) FILTER (WHERE coalesce(html, '') <> '') / count(*) AS success_rate FROM pages",
        "mock_menu": "SELECT CAST(page_id AS VARCHAR) AS venue_id, m.* FROM pages, (VALUES ('Starters', 'Burger', 'Delicious beef burger', 9.99::DOUBLE), ('Starters', 'Fries', 'Crispy fries', 3.49), ('Desserts', 'Ice Cream', 'Vanilla ice cream', 4.99), ('Desserts', 'Brownie', 'Chocolate brownie', 5.49)) m(section, name, description, price)",
    }
