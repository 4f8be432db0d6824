"""DuckDB twins of the queries over files and stored tables, of menu parsing and of the re-check."""

from __future__ import annotations

from tavola.config import SECTION_TITLES
from tavola.functions.prices import MENU_PRICE
from tavola.operators.tables import SCHEMAS
from tavola.plans import oracle as o

#: Known pairs beside those in the band; a known match is kept if it still reaches the threshold.
_KNOWN = (
    o.BAND.replace("near AS", "banded AS", 1)
    + """, near AS (
  SELECT *, false AS known FROM banded UNION ALL
  SELECT l.id, r.id, l.ordinal, r.ordinal, l.clean, r.clean, l.lat, l.lon, r.lat, r.lon, l.numbers, r.numbers, l.streets, r.streets, 0, true FROM l JOIN r ON r.id = CAST(l.ordinal + 1 AS VARCHAR)
)"""
)
RECHECK = f"""
WITH {o.VENUES}, {o.SCORED.replace(o.BAND, _KNOWN)},
kept AS (SELECT l_id, r_id, lo, score FROM scored WHERE known AND score >= 0.7),
found AS (
  SELECT l_id, r_id, lo, score FROM (SELECT *, row_number() OVER (PARTITION BY l_id ORDER BY score DESC, cell_rank, ro) AS k FROM scored WHERE NOT known AND score > 0 AND l_id NOT IN (SELECT l_id FROM kept)) WHERE k = 1 AND score >= 0.7
), best AS (SELECT * FROM kept UNION ALL SELECT * FROM found), {o.UNIQUE}
SELECT l_id, r_id, round(score, 6) AS score FROM matches
"""


def garbage_of(rows: str) -> str:
    """doc_id, at, line, garbage of a query's rows (doc_id, at, line)."""
    return o.GARBAGE.replace(o.LINES, f"lines AS ({rows})").replace("SELECT doc_id, at, CASE", "SELECT doc_id, at, line, CASE")


_PRICE = MENU_PRICE.removeprefix("(?i)")
PARSE_MENU = rf"""
WITH RECURSIVE cut AS (
  SELECT doc_id, pos, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
), numbered AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, line, round(CAST(replace(nullif(regexp_extract(line, '(?i){_PRICE}', 1), ''), ',', '.') AS DOUBLE), 2) AS price,
         rtrim(regexp_replace(regexp_replace(line, '(?i){_PRICE}', '', 'g'), '^\s+|\s+$', '', 'g'), '.,-–— ' || chr(9)) AS rest
  FROM cut WHERE line <> ''
), told AS (
  SELECT *, regexp_full_match(line, '(?i)({"|".join(SECTION_TITLES)})') OR (upper(line) = line AND lower(line) <> line AND len(line) < 30 AND price IS NULL) AS title,
         regexp_matches(rest, '^\d+[\s.-]+') AS has_number, regexp_replace(regexp_replace(rest, '^\d+[\s.-]+', ''), '^\s+|\s+$', '', 'g') AS bare, upper(rest) = rest AND lower(rest) <> rest AND len(rest) > 3 AND len(rest) < 40 AS shouted
  FROM numbered
), state AS (
  SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS i, 'general' AS section, false AS opened, '' AS name, CAST(NULL AS DOUBLE) AS price, '' AS description, '' AS own, false AS emits, '' AS e_name, CAST(NULL AS DOUBLE) AS e_price, '' AS e_description, '' AS e_section FROM told
  UNION ALL
  SELECT t.doc_id, t.i, CASE WHEN t.title THEN lower(t.line) ELSE s.section END,
         CASE WHEN t.title THEN s.opened AND s.name = '' ELSE true END,
         CASE WHEN t.title THEN s.name WHEN begins THEN CASE WHEN t.has_number THEN t.bare ELSE t.rest END WHEN grows THEN s.name || ' ' || t.rest ELSE s.name END,
         CASE WHEN t.title THEN s.price WHEN begins THEN t.price WHEN coalesce(s.price, 0) <> 0 THEN s.price WHEN coalesce(t.price, 0) <> 0 THEN t.price ELSE s.price END,
         CASE WHEN t.title THEN s.description WHEN begins THEN '' WHEN t.rest = '' OR grows THEN s.description WHEN s.description <> '' THEN s.description || ' ' || t.rest ELSE t.rest END,
         CASE WHEN begins AND NOT t.title THEN s.section ELSE s.own END,
         (t.title OR begins) AND s.opened AND s.name <> '', s.name, s.price, s.description, s.own
  FROM (SELECT s.*, t.title AS _t FROM state s JOIN told t ON t.doc_id = s.doc_id AND t.i = s.i + 1) s JOIN told t ON t.doc_id = s.doc_id AND t.i = s.i + 1,
       LATERAL (SELECT t.has_number OR NOT s.opened OR t.shouted AS begins) b, LATERAL (SELECT t.rest <> '' AND s.description = '' AND len(s.name) < 15 AS grows) g
), ends AS (SELECT doc_id, max(i) AS i FROM told GROUP BY doc_id), emitted AS (
  SELECT doc_id, i, 0 AS late, e_name AS name, e_price AS price, e_description AS description, e_section AS section FROM state WHERE emits
  UNION ALL SELECT s.doc_id, s.i, 1, s.name, s.price, s.description, s.own FROM state s JOIN ends USING (doc_id, i) WHERE s.opened AND s.name <> ''
), placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, late) - 1 AS INTEGER) AS at FROM emitted),
judged AS ({garbage_of("SELECT doc_id, at, name AS line FROM placed")})
SELECT p.doc_id AS menu_id, p.at, p.name, p.price, p.description, p.section FROM placed p JOIN judged j ON p.doc_id = j.doc_id AND p.at = j.at
WHERE len(p.name) >= 3 AND NOT regexp_full_match(p.name, '\p{{Nd}}+') AND NOT j.garbage
"""

SUPPLIERS = "s AS (SELECT *, CAST(s_suppkey AS VARCHAR) AS key FROM supplier)"
CLASSIFIED = f"(SELECT * FROM ({o.CLASSIFY}) WHERE confidence >= 1)"
DIFFED = f"(WITH {o.MENU})"
_COLUMNS = ", ".join(f"('{t}', '{f.name}', '{f.dataType.simpleString()}')" for t, s in SCHEMAS.items() for f in s)
MOCK = "m AS (SELECT CAST(page_id AS VARCHAR) AS venue_id, x.* FROM pages, (VALUES ('Burger', 9.99::DOUBLE), ('Fries', 3.49), ('Ice Cream', 4.99), ('Brownie', 5.49)) x(name, price))"


def queries() -> dict[str, str]:
    stale = f"WITH {o.MATCHED}, gone AS (SELECT DISTINCT o_custkey AS venue_id FROM orders WHERE o_custkey NOT IN (SELECT venue_id FROM matched))"
    return {
        "er_recheck": RECHECK,
        "parse_menu": PARSE_MENU,
        "venue_files": f"WITH {SUPPLIERS} SELECT key AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'New ' || s_name ELSE s_name END AS name, s_name AS address, CASE WHEN s_suppkey % 3 <> 0 THEN 41.0::DOUBLE + s_suppkey / 1000.0::DOUBLE END AS lat, CASE WHEN s_suppkey % 3 <> 0 THEN 2.5::DOUBLE END AS lon, 'u' || key AS url FROM s",
        "venue_split": f"WITH {SUPPLIERS} SELECT key AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'New ' || s_name ELSE s_name END AS name FROM s",
        "place_list": f"""WITH {SUPPLIERS} SELECT s_name AS name, CASE s_suppkey % 3 WHEN 0 THEN key WHEN 1 THEN 'g' || key ELSE 'made' END AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'raw ' || key ELSE 'plain ' || key END AS address,
            CASE WHEN s_suppkey % 4 <> 0 THEN 41.5::DOUBLE END AS lat, s_suppkey / 100.0::DOUBLE AS lon FROM s WHERE s_suppkey % 10 <> 9""",
        "taxonomy_file": "SELECT p_brand AS category_uidentifier, CASE WHEN len(min(p_name)) % 2 = 0 THEN max(p_name) ELSE min(p_name) END AS name FROM part GROUP BY p_brand",
        "url_file": "SELECT 'p' || page_id AS id, url FROM pages UNION ALL SELECT CAST(row_number() OVER (ORDER BY page_id, url) - 1 AS VARCHAR), url FROM pages",
        "image_list": "SELECT CAST(n_nationkey AS VARCHAR) AS menu_id, array_to_string((['0.png', '1.JPG', '2.jpeg'])[1:n_regionkey % 3 + 1], ',') AS names FROM nation",
        "matches_json": f"WITH {o.MATCHED} SELECT venue_id, match_id FROM matched",
        "unmatched_json": f"{stale} SELECT (SELECT count(*) FROM gone) AS count, venue_id FROM gone",
        "diffs_json": f"SELECT menu_id, at, diff_type, item_id FROM {DIFFED}",
        "diffs_csv": f"SELECT menu_id, diff_type, count(*) AS n, count(item_id) AS known, count(*) AS priced FROM {DIFFED} GROUP BY menu_id, diff_type",
        "venue_json_files": f"WITH {SUPPLIERS} SELECT key, s_name, s_acctbal FROM s",
        "delete_by_menu": "SELECT p_partkey AS item_id, p_brand AS menu_id FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_partkey % 7 = 0 AND p_brand < 'Brand#3')",
        "merge_files": "SELECT venue_id, arg_max(n_name, n_nationkey) AS name FROM (SELECT *, CASE WHEN n_nationkey % 3 = 0 THEN CAST(n_nationkey % 2 AS VARCHAR) ELSE 'n' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') END AS venue_id FROM nation WHERE n_nationkey <> 7) GROUP BY venue_id",
        "created_tables": f"SELECT * FROM (VALUES {_COLUMNS}) x(table_name, column_name, column_type)",
        "migrated_table": "SELECT p_partkey AS id, CAST(p_partkey % 10 AS VARCHAR) AS venue_id, p_name AS name, true AS no_section FROM part",
        "classify_incremental": f"SELECT item_id, taxonomy_id FROM {CLASSIFIED} WHERE item_id % 2 = 1",
        "classify_force": f"SELECT item_id, taxonomy_id FROM {CLASSIFIED}",
        "classify_force_failed": f"SELECT item_id, taxonomy_id FROM {CLASSIFIED} WHERE item_id % 2 = 1",
        "save_extractions": "SELECT p_brand AS menu_id, 'i' || (p_partkey % 3) AS image_file, count(*) AS n, CAST(count(*) AS DOUBLE) AS confidence, round(sum(CASE WHEN p_size % 3 = 0 THEN p_retailprice + 1 ELSE p_retailprice END), 4) AS price FROM part GROUP BY ALL",
        "save_diffs": f"SELECT menu_id, 'v' AS venue_id, diff_type, count(*) AS n, count(item_id) AS known FROM {DIFFED} GROUP BY menu_id, diff_type",
        "save_batch_venues": "SELECT CAST(page_id AS VARCHAR) AS id, 'Mock Restaurant ' || page_id AS name FROM pages UNION ALL SELECT 'x', 'kept'",
        "save_batch_items": f"WITH {MOCK} SELECT venue_id, name, CAST(CASE WHEN CAST(venue_id AS BIGINT) % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n FROM m",
        "save_matches_empty": f"WITH {o.MATCHED} SELECT venue_id, max(match_id) AS match_id, false AS strict FROM matched GROUP BY venue_id",
        "falsy_coalesce": "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE 'other' END AS value FROM supplier",
        "default_if_absent": f"WITH {SUPPLIERS} SELECT key AS venue_id, CASE s_suppkey % 3 WHEN 0 THEN 'S' WHEN 1 THEN '' ELSE 'general' END AS section FROM s",
        "safe_cast": f"WITH {o.PRICES} SELECT p_partkey, CASE p_partkey % 6 WHEN 2 THEN CAST(w AS DOUBLE) END AS value FROM parts",
        "item_number": f"SELECT doc_id AS menu_id, line AS name FROM ({garbage_of('SELECT p_partkey AS doc_id, 0 AS at, p_name AS line FROM part')}) WHERE NOT garbage AND len(line) >= 3",
        "log_slice": "SELECT c_custkey AS id, c_name AS name FROM customer ORDER BY c_custkey LIMIT 10",
        "column_names": "SELECT CAST(ordinal_position - 1 AS INTEGER) AS place, column_name AS name FROM (SELECT row_number() OVER () AS ordinal_position, column_name FROM (DESCRIBE part))",
        "jsonld_venues": f"""WITH {SUPPLIERS} SELECT key AS venue_id, s_name AS name, 'S ' || key AS first_line, '2.1,41.4' AS coordinates, CASE WHEN s_suppkey % 5 = 0 THEN 4.5::DOUBLE ELSE 0 END AS star_rating, CAST(CASE WHEN s_suppkey % 5 = 0 THEN 12 ELSE 0 END AS BIGINT) AS rating_count,
            CAST(([3, 2, 1, 1])[s_suppkey % 4 + 1] AS BIGINT) AS objects, CASE WHEN s_suppkey % 4 < 3 THEN 2 ELSE 0 END AS sections FROM s""",
        "jsonld_items": f"WITH {SUPPLIERS} SELECT key AS venue_id, x.section, x.name || ' ' || key AS name, '' AS description, x.price FROM s, (VALUES ('Rolls', 'a', 12.5::DOUBLE), ('Menu', 'b', 4.5)) x(section, name, price) WHERE s_suppkey % 4 < 3",
        "jsonld_objects": f"WITH {SUPPLIERS} SELECT 'https://x/restaurants-' || key || '/menu' AS url, ([3, 2, 1, 1])[s_suppkey % 4 + 1] AS objects FROM s",
    }
