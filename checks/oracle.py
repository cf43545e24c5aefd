"""Expected results in SQL, straight from the given tables and never from rendered pages."""

from __future__ import annotations

# Lines grouped into the product pages the queries read: page of each line, place on it.
_SHOP = """
WITH salted AS (SELECT *, l_orderkey // 1048576 AS salt FROM lineitem),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY l_partkey, salt
      ORDER BY l_suppkey, l_shipdate, l_orderkey, l_linenumber) - 1 AS place
  FROM salted),
lines AS (
  SELECT *, salt * 1048576 + place // 32 AS page_no, place % 32 AS pos FROM placed),
shop AS (
  SELECT p.*, coalesce(g.page_no, 0) AS page_no,
      'https://shop.example/p/' || p_partkey AS link,
      'https://shop.example/p/' || p_partkey || '?page=' || coalesce(g.page_no, 0) AS url
  FROM part p LEFT JOIN (SELECT DISTINCT l_partkey, page_no FROM lines) g
    ON p_partkey = l_partkey),
offers AS (
  SELECT s.url, s.p_partkey, CAST(coalesce(l.pos, 0) AS INTEGER) AS pos,
      CASE WHEN l.l_partkey IS NULL THEN p_name ELSE p_name || ' ' || l_suppkey END AS name,
      CASE WHEN l_suppkey % 7 <> 0 THEN 'S' || l_suppkey END AS sku,
      CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
      CASE WHEN l_returnflag <> 'R' THEN 'USD' END AS currency,
      coalesce(l_linestatus = 'O', false) AS available
  FROM shop s LEFT JOIN lines l ON s.p_partkey = l.l_partkey AND s.page_no = l.page_no
  WHERE l.l_partkey IS NOT NULL OR s.p_partkey % 2 = 1),
rolled AS (
  SELECT s.url,
      coalesce(min(price) FILTER (WHERE available), min(price)) AS price,
      CASE WHEN count(price) FILTER (WHERE available) > 0
        THEN arg_min(currency, pos) FILTER (WHERE available AND price IS NOT NULL AND currency IS NOT NULL)
        ELSE arg_min(currency, pos) FILTER (WHERE price IS NOT NULL AND currency IS NOT NULL)
        END AS currency,
      coalesce(bool_or(available), false) AS available,
      CAST(count(o.url) AS INTEGER) AS variants
  FROM shop s LEFT JOIN offers o ON s.url = o.url GROUP BY s.url)
"""

# The same pages with the faults that are put into them for the constraint checks.
_SPOILED = _SHOP + """,
bad_offers AS (
  SELECT url, p_partkey, pos, available,
      CASE WHEN p_partkey % 19 = 3 AND pos = 1 THEN -5.0
           WHEN p_partkey % 23 = 4 AND pos = 0 THEN 12345678901.5
           WHEN p_partkey % 31 = 8 AND pos = 0 THEN 1e30
           ELSE price END AS price,
      CASE WHEN p_partkey % 13 = 5 THEN 'EURO' ELSE currency END AS currency
  FROM offers WHERE p_partkey % 17 <> 6 AND p_partkey % 29 <> 7 AND price IS NOT NULL),
bad_rolled AS (
  SELECT url, min(p_partkey) AS p_partkey,
      coalesce(min(price) FILTER (WHERE available), min(price)) AS price,
      min(price) AS lowest, max(price) AS highest
  FROM bad_offers GROUP BY url)
"""

# Every line as a page; pages of a part and a group of suppliers share their address.
_PAGES = """
WITH paged AS (
  SELECT *, 'https://shop.example/p/' || l_partkey || '/' || (l_suppkey % 4) AS source_url,
      year(l_shipdate) AS year, CASE WHEN year(l_shipdate) <= 1997 THEN 1995 ELSE 1996 END AS run,
      l_linestatus = 'O' OR l_quantity > 25 OR l_linenumber = 1 AS page_available,
      CASE WHEN l_returnflag <> 'R' THEN 'USD' END AS currency,
      (l_shipdate, l_orderkey, l_linenumber, l_suppkey) AS seq
  FROM lineitem),
listed AS (
  SELECT source_url, year, run, seq, 0 AS pos, 'S' || l_suppkey AS sku,
      CAST(l_extendedprice AS DECIMAL(12,2)) AS price, currency, l_linestatus = 'O' AS available
  FROM paged
  UNION ALL
  SELECT source_url, year, run, seq, 1, 'L' || l_linenumber,
      CAST(l_quantity AS DECIMAL(12,2)), currency, l_quantity > 25 FROM paged
  UNION ALL
  SELECT source_url, year, run, seq, 2, 'S' || l_suppkey,
      CAST(l_quantity AS DECIMAL(12,2)), currency, l_linestatus <> 'O' FROM paged
  WHERE l_linenumber = 1)
"""


def _last_of(relation: str, period: str) -> str:
    """Last page per product and last place per variant of each run."""
    return f"""
last_page AS (
  SELECT source_url, {period} AS run_year, max(seq) AS last_seq FROM {relation} GROUP BY 1, 2),
last_listed AS (
  SELECT source_url, {period} AS run_year, 'sku:' || sku AS source_key, sku, price, currency,
      available, seq
  FROM (SELECT *, row_number() OVER (PARTITION BY source_url, {period}, sku
          ORDER BY seq DESC, pos DESC) AS rn FROM {relation}) WHERE rn = 1)"""


def _two_runs(complete: bool) -> str:
    gone = "p2.source_url IS NULL" if complete else "false"
    return (
        _PAGES
        + ","
        + _last_of("listed", "run")
        + f""",
catalog AS (
  SELECT coalesce(b.source_url, a.source_url) AS source_url,
      coalesce(b.source_key, a.source_key) AS source_key,
      CASE WHEN b.sku IS NOT NULL THEN b.sku ELSE a.sku END AS sku,
      CASE WHEN b.sku IS NOT NULL THEN b.price ELSE a.price END AS price,
      CASE WHEN b.sku IS NOT NULL THEN b.currency ELSE a.currency END AS currency,
      CASE WHEN b.sku IS NOT NULL THEN b.available AND b.seq = p2.last_seq
           WHEN p2.source_url IS NOT NULL OR {gone} THEN false
           ELSE a.available AND a.seq = p1.last_seq END AS available,
      CASE WHEN a.sku IS NOT NULL THEN TIMESTAMP '1995-12-31' ELSE TIMESTAMP '1996-12-31' END AS created_at,
      CASE WHEN p2.source_url IS NOT NULL OR {gone} THEN TIMESTAMP '1996-12-31'
           ELSE TIMESTAMP '1995-12-31' END AS updated_at
  FROM (SELECT * FROM last_listed WHERE run_year = 1995) a
  FULL OUTER JOIN (SELECT * FROM last_listed WHERE run_year = 1996) b
    ON a.source_url = b.source_url AND a.source_key = b.source_key
  LEFT JOIN (SELECT * FROM last_page WHERE run_year = 1995) p1
    ON p1.source_url = coalesce(b.source_url, a.source_url)
  LEFT JOIN (SELECT * FROM last_page WHERE run_year = 1996) p2
    ON p2.source_url = coalesce(b.source_url, a.source_url))
"""
    )


_SEVEN = (
    _PAGES
    + """,
product AS (
  SELECT source_url, min(year) AS first_year, max(year) AS last_year, max(seq) AS last_seq,
      arg_max(page_available, seq) AS page_available
  FROM paged GROUP BY source_url),
stamped AS (
  SELECT *, make_timestamp(first_year, 12, 31, 0, 0, 0) AS created_at,
      make_timestamp(last_year, 12, 31, 0, 0, 0) AS last_seen_at,
      coalesce(last_year < full_year, false) AS stale,
      make_timestamp(CASE WHEN last_year < full_year THEN full_year ELSE last_year END, 12, 31, 0, 0, 0) AS updated_at
  FROM product, (SELECT max(year) AS full_year FROM paged WHERE year < (SELECT max(year) FROM paged))),
variant AS (
  SELECT source_url, sku, min(year) AS first_year,
      arg_max((price, currency, available, seq), (seq, pos)) AS v
  FROM listed GROUP BY source_url, sku),
final AS (
  SELECT v.source_url, 'sku:' || sku AS source_key, sku, 'Item ' || sku AS name,
      v.v[1] AS price, v.v[2] AS currency,
      v.v[3] AND v.v[4] = s.last_seq AND NOT s.stale AS available,
      make_timestamp(v.first_year, 12, 31, 0, 0, 0) AS created_at, s.updated_at
  FROM variant v JOIN stamped s ON v.source_url = s.source_url)
"""
)

_CRAWL = """
WITH chain AS (
  SELECT user_id AS catalog, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS page_no,
      '/k/' || json_extract_string(props, '$.k') AS k,
      '/v/' || CAST(floor(value) AS BIGINT) AS v
  FROM events),
links AS (
  SELECT catalog, page_no, 0 AS pos, k AS url FROM chain WHERE {cap}
  UNION ALL SELECT catalog, page_no, 1, v FROM chain WHERE {cap}),
firsts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY catalog, url ORDER BY page_no, pos) AS rn
                 FROM links) WHERE rn = 1),
stops AS (
  SELECT l.catalog, min(l.page_no) AS stop FROM links l
  WHERE NOT EXISTS (SELECT 1 FROM firsts f WHERE f.catalog = l.catalog AND f.page_no = l.page_no)
  GROUP BY l.catalog),
numbered AS (
  SELECT f.catalog, row_number() OVER (PARTITION BY f.catalog ORDER BY f.page_no, f.pos) AS seq,
      f.page_no, f.pos, f.url
  FROM firsts f LEFT JOIN stops s ON f.catalog = s.catalog
  WHERE s.stop IS NULL OR f.page_no < s.stop)
SELECT catalog, seq, page_no, pos, url FROM numbered WHERE {limit}
"""

_LINE_KEY = "l_partkey, l_suppkey, l_shipdate, l_orderkey, l_linenumber"
_SPACES = (
    r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
    r"\x{202F}\x{205F}\x{3000}]+"
)

_PARTS_TWICE = """
WITH run1 AS (
  SELECT 'https://shop.example/p/' || p_partkey AS source_url, p_name AS name, p_brand AS brand,
      CAST(p_retailprice AS DECIMAL(12,2)) AS price, p_size > 10 AS available, p_type AS type
  FROM part),
run2 AS (
  SELECT 'https://shop.example/p/' || p_partkey || CASE WHEN p_partkey % 6 = 0 THEN '-new' ELSE '' END AS source_url,
      p_name AS name, CASE WHEN p_partkey % 2 = 0 OR p_partkey % 3 <> 0 THEN p_brand END AS brand,
      CAST(CASE WHEN p_partkey % 2 = 1 THEN 2 ELSE 1 END * CAST(p_retailprice AS DECIMAL(12,2)) AS DECIMAL(12,2)) AS price,
      p_size > 10 AS available, p_type AS type
  FROM part WHERE p_partkey % 4 <> 1),
merged AS (
  SELECT coalesce(b.source_url, a.source_url) AS source_url,
      CASE WHEN b.source_url IS NULL THEN a.name ELSE b.name END AS name,
      CASE WHEN b.source_url IS NULL THEN a.brand ELSE b.brand END AS brand,
      CASE WHEN b.source_url IS NULL THEN a.price ELSE b.price END AS price,
      CASE WHEN b.source_url IS NULL THEN a.available ELSE b.available END AS available,
      CASE WHEN b.source_url IS NULL THEN a.type ELSE b.type END AS type,
      CASE WHEN b.source_url IS NULL THEN 'run-1995' ELSE 'run-1996' END AS last_seen_run_id,
      CASE WHEN b.source_url IS NULL THEN TIMESTAMP '1995-12-31' ELSE TIMESTAMP '1996-12-31' END AS seen_at,
      CASE WHEN a.source_url IS NULL THEN TIMESTAMP '1996-12-31' ELSE TIMESTAMP '1995-12-31' END AS made_at
  FROM run1 a FULL OUTER JOIN run2 b ON a.source_url = b.source_url)
"""

ORACLE: dict[str, str] = {
    "normalize_text": f"""
SELECT doc_id, trim(regexp_replace(text || chr(160) || ' x' || chr(28) || chr(8195) || 'y' || chr(8203) || 'z ' || chr(133),
  '{_SPACES}', ' ', 'g')) AS text FROM documents""",
    "parse_price": f"""
SELECT {_LINE_KEY}, CASE WHEN (l_orderkey + l_linenumber) % 8 IN (2, 3, 4, 6) THEN NULL
  ELSE CAST(l_extendedprice AS DECIMAL(12,2)) END AS price FROM lineitem""",
    "content_hash": r"""
SELECT p_partkey, sha256('{"brand":' || CASE WHEN p_partkey % 3 <> 0 THEN '"' || p_brand || '"' ELSE 'null' END
  || ',"characteristics":{"Size":"' || p_size || '","Type":"' || p_type || '","Ж":"1"}'
  || ',"currency":"USD","description":"' || p_name || ' \"quoted\" \\ é\n"'
  || ',"name":"' || p_name || '","price":'
  || CASE WHEN p_partkey % 10 = 0 THEN 'null'
     ELSE regexp_replace(CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR), '\.?0+$', '') END
  || '}') AS content_hash FROM part""",
    "variant_keys": f"""
SELECT {_LINE_KEY}, CASE WHEN l_suppkey % 7 <> 0 THEN 'sku:S' || l_suppkey
  WHEN l_suppkey % 2 = 0 THEN 'name:' || sha256('Item ' || l_partkey)
  ELSE 'name:' || sha256('') END AS source_key FROM lineitem""",
    "redact_secrets": """
SELECT doc_id, text || ' PostgreSQL://shop:***@db.example/x Password = *** end' AS message FROM documents""",
    "page_links": """
SELECT page_id, CAST(i AS INTEGER) AS pos, hrefs[i + 1] AS href
FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM pages),
  LATERAL (SELECT unnest(range(len(hrefs))) AS i)""",
    "resolve_links": """
SELECT page_id, CAST(i AS INTEGER) AS pos, regexp_extract(url, '^[a-z]+://[^/]+') || hrefs[i + 1] AS link
FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM pages),
  LATERAL (SELECT unnest(range(len(hrefs))) AS i)""",
    "links_dedup_first": """
WITH occurrences AS (
  SELECT page_id, i AS pos, regexp_extract(url, '^[a-z]+://[^/]+') || hrefs[i + 1] AS link
  FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM pages),
    LATERAL (SELECT unnest(range(len(hrefs))) AS i)),
firsts AS (SELECT page_id, link, min(pos) AS pos FROM occurrences GROUP BY page_id, link)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INTEGER) AS pos, link FROM firsts""",
    "crawl_order": _CRAWL.format(cap="true", limit="true"),
    "crawl_max_pages": _CRAWL.format(cap="page_no <= 5", limit="true"),
    "crawl_limit": _CRAWL.format(cap="true", limit="seq <= 7"),
    "jsonld_products": _SHOP + "SELECT url, p_name AS name, link FROM shop",
    "jsonld_graph": _SHOP
    + """
SELECT url, CASE WHEN p_partkey % 5 = 0 THEN '/WebPage/' ELSE '' END
  || CASE WHEN p_partkey % 2 = 0 THEN 'ProductGroup' ELSE 'Product' END AS types FROM shop""",
    "offers_flat": _SHOP + "SELECT url, pos, name, sku, price, currency, available FROM offers",
    "product_rollup": _SHOP + "SELECT url, price, currency, available FROM rolled",
    "brand_counts": _SHOP + "SELECT p_brand AS brand, count(*) AS pages FROM shop GROUP BY p_brand",
    "longest_text_first": f"""
WITH texts AS (SELECT conv_id, turn, trim(regexp_replace(text, '{_SPACES}', ' ', 'g')) AS text FROM conversations)
SELECT conv_id, turn, text FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS rn
  FROM texts WHERE text <> '') WHERE rn = 1""",
    "characteristics_long": _SHOP
    + """
SELECT url, 'Type' AS name, p_type AS value FROM shop
UNION ALL SELECT url, 'Size', CAST(p_size AS VARCHAR) FROM shop
UNION ALL SELECT url, 'Бренд', p_brand FROM shop""",
    "extract_products": _SHOP
    + """
SELECT s.url, true AS found, p_name AS name, link, r.price, r.currency, r.available, p_brand AS brand,
  CASE WHEN p_partkey % 3 = 0 THEN 'All about the ' || p_name || ' & more' ELSE 'About ' || p_name END AS description,
  link || '.jpg' AS image, r.variants, CAST(3 AS INTEGER) AS characteristics
FROM shop s JOIN rolled r ON s.url = r.url""",
    "json_roundtrip": """
SELECT 'Деталь ' || p_name AS name, 'https://shop.example/p/' || p_partkey AS link,
  CAST(p_retailprice AS DECIMAL(12,2)) AS price, CAST(NULL AS VARCHAR) AS currency, p_size > 25 AS available,
  CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS brand, '' AS description, p_type AS type,
  CAST(0 AS INTEGER) AS variants FROM part""",
    "rejects": _SPOILED
    + """
SELECT url, 'no_product' AS reason FROM shop WHERE p_partkey % 17 = 6 OR p_partkey % 29 = 7
UNION ALL SELECT url, 'blank_name' FROM shop WHERE p_partkey % 11 = 2 AND p_partkey % 17 <> 6 AND p_partkey % 29 <> 7
UNION ALL SELECT url, 'price_overflow' FROM bad_rolled WHERE price > 9999999999
UNION ALL SELECT url, 'price_negative' FROM bad_rolled WHERE price < 0
UNION ALL SELECT url, 'currency_length' FROM bad_rolled WHERE p_partkey % 13 = 5
UNION ALL SELECT url, 'variant_price_overflow' FROM bad_rolled WHERE highest > 9999999999
UNION ALL SELECT url, 'variant_price_negative' FROM bad_rolled WHERE lowest < 0
UNION ALL SELECT url, 'variant_currency_length' FROM bad_rolled WHERE p_partkey % 13 = 5""",
    "duplicate_keys": """
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
    "orphan_variants": f"""
SELECT {_LINE_KEY} FROM lineitem WHERE NOT EXISTS (
  SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_partkey % 10 <> 0)""",
    "latest_per_key": """
SELECT l_partkey, l_suppkey, l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_quantity FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey
    ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS rn FROM lineitem) WHERE rn = 1""",
    "merge_products": _PARTS_TWICE
    + """
SELECT 'shop' AS source, 'parts' AS category, source_url, name, brand, '' AS description, price, 'USD' AS currency,
  available, CAST(NULL AS VARCHAR) AS image_url, last_seen_run_id, made_at AS first_seen_at,
  seen_at AS last_seen_at, made_at AS created_at, seen_at AS updated_at, type FROM merged""",
    "deactivate_products": _PARTS_TWICE
    + """
SELECT source_url, available AND last_seen_run_id IS NOT DISTINCT FROM 'run-1996' AS available, last_seen_run_id,
  TIMESTAMP '1996-12-31' AS updated_at FROM merged""",
    "changed_products": _PARTS_TWICE
    + """
SELECT b.source_url, CASE WHEN a.source_url IS NULL THEN 'new'
  WHEN a.price IS DISTINCT FROM b.price OR a.brand IS DISTINCT FROM b.brand THEN 'changed'
  ELSE 'same' END AS change
FROM run2 b LEFT JOIN run1 a ON a.source_url = b.source_url""",
    "merge_variants": _two_runs(False)
    + """
SELECT source_url, source_key, sku, 'Item ' || sku AS name, price, currency, available, created_at, updated_at
FROM catalog""",
    "deactivate_variants": _two_runs(True)
    + "SELECT source_url, source_key, available, updated_at FROM catalog",
    "merge_partial_run": _PAGES
    + """,
kept AS (SELECT * FROM paged WHERE year <= 1997 OR l_quantity <> 1),
last AS (SELECT source_url, max(run) AS run, arg_max(page_available, (run, seq)) AS available FROM kept GROUP BY 1)
SELECT source_url,
  CASE WHEN (SELECT count(*) FROM paged WHERE year > 1997 AND l_quantity = 1) = 0
    THEN available AND run = 1996 ELSE available END AS available,
  'run-' || run AS last_seen_run_id,
  CASE WHEN (SELECT count(*) FROM paged WHERE year > 1997 AND l_quantity = 1) = 0 OR run = 1996
    THEN TIMESTAMP '1996-12-31' ELSE TIMESTAMP '1995-12-31' END AS updated_at
FROM last""",
    "missing_variants": _PAGES
    + """
SELECT DISTINCT source_url, 'sku:' || sku AS source_key FROM listed a
WHERE run = 1995 AND EXISTS (SELECT 1 FROM paged p WHERE p.run = 1996 AND p.source_url = a.source_url)
  AND NOT EXISTS (SELECT 1 FROM listed b WHERE b.run = 1996 AND b.source_url = a.source_url AND b.sku = a.sku)""",
    "scoped_runs": _PAGES
    + """,
monthly AS (SELECT *, year(l_shipdate) * 12 + month(l_shipdate) - 1 AS run_no FROM paged),
runs AS (
  SELECT DISTINCT run_no, run_no % 2 AS scope, make_timestamp(run_no // 12, run_no % 12 + 1, 28, 0, 0, 0) AS made
  FROM monthly),
fulls AS (SELECT scope, max(run_no) AS full_no, max(made) AS off_at FROM runs WHERE run_no % 5 <> 0 GROUP BY scope),
product AS (
  SELECT source_url, min(run_no) AS first_no, max(run_no) AS last_no, max(seq) AS last_seq,
      arg_max(page_available, seq) AS page_available
  FROM monthly GROUP BY source_url),
stated AS (
  SELECT p.*, a.scope, a.made AS first_seen_at, z.made AS last_seen_at,
      coalesce(last_no < full_no, false) AS stale, CASE WHEN last_no < full_no THEN off_at ELSE z.made END AS updated_at
  FROM product p JOIN runs a ON first_no = a.run_no JOIN runs z ON last_no = z.run_no
  LEFT JOIN fulls f ON a.scope = f.scope),
variant AS (
  SELECT l.source_url, sku, arg_max((available, seq), (seq, pos)) AS v, min(seq) AS first_seq
  FROM listed l GROUP BY l.source_url, sku),
counted AS (
  SELECT s.source_url, count(*) AS variants,
      count(*) FILTER (WHERE v.v[1] AND v.v[2] = s.last_seq AND NOT s.stale) AS on_offer,
      min(make_timestamp(year(first_seq[1]), month(first_seq[1]), 28, 0, 0, 0)) AS oldest
  FROM variant v JOIN stated s ON v.source_url = s.source_url GROUP BY s.source_url)
SELECT s.source_url, CASE scope WHEN 0 THEN 'even' ELSE 'odd' END AS category,
  page_available AND NOT stale AS available, 'run-' || last_no AS last_seen_run_id, first_seen_at, last_seen_at,
  updated_at, variants, on_offer, oldest, updated_at AS newest
FROM stated s JOIN counted c ON s.source_url = c.source_url""",
    "seen_history": _SEVEN
    + """
SELECT source_url, created_at AS first_seen_at, last_seen_at, created_at, updated_at,
  'run-' || last_year AS last_seen_run_id FROM stamped""",
    "catalog_after_runs": _SEVEN
    + """
SELECT source_url, source_key, sku, name, price, currency, available, created_at, updated_at FROM final""",
    "catalog_stats": _SEVEN
    + """
SELECT (SELECT count(*) FROM stamped) AS products,
  (SELECT count(*) FROM stamped WHERE page_available AND NOT stale) AS available,
  (SELECT count(*) FROM final) AS variants""",
    "run_ledger": """
WITH years AS (
  SELECT DISTINCT CAST(year(l_shipdate) AS INTEGER) AS y FROM lineitem UNION SELECT 2100),
counted AS (
  SELECT year(l_shipdate) AS y, count(*) AS found,
      count(*) FILTER (WHERE year(l_shipdate) % 2 = 0 AND l_quantity <= 1) AS failed
  FROM lineitem GROUP BY 1),
filled AS (
  SELECT years.y, coalesce(found, 0) AS found, coalesce(failed, 0) AS failed
  FROM years LEFT JOIN counted ON years.y = counted.y)
SELECT 'run-' || y AS id, 'shop' AS source, 'parts' AS category, 'https://shop.example/c/' AS catalog_url,
  'both' AS storage_mode,
  CASE WHEN y = 1999 THEN 'cancelled' WHEN found = 0 THEN 'failed' WHEN failed = 0 THEN 'completed'
    ELSE 'partial' END AS status,
  y % 3 <> 0 AS full_scan, found AS products_found, found - failed AS products_saved,
  failed AS products_failed,
  CASE WHEN y = 1999 THEN 'stop postgresql://u:***@db.example/x' WHEN found = 0 THEN 'the catalog gave no products' END AS error_message,
  make_timestamp(y, 1, 1, 0, 0, 0) AS started_at, TIMESTAMP '2003-01-01' AS finished_at,
  y % 3 <> 0 AND found > 0 AND failed = 0 AS complete, CAST(0 AS INTEGER) AS refused
FROM filled""",
    "stream_merge": """
WITH pages_of AS (
  SELECT *, CASE WHEN p_partkey % 3 = 2 THEN p_partkey - 1 ELSE p_partkey END AS grp FROM part),
last AS (SELECT grp, max(p_partkey) AS last_key FROM pages_of GROUP BY grp)
SELECT 'https://shop.example/p/' || a.grp AS source_url, z.p_name AS product, z.p_brand AS brand,
  'sku:P' || a.p_partkey AS source_key, a.p_name AS name, CAST(a.p_retailprice AS DECIMAL(12,2)) AS price,
  'USD' AS currency, a.p_size > 10 AND a.p_partkey = last_key AS available
FROM pages_of a JOIN last USING (grp) JOIN part z ON z.p_partkey = last_key""",
    "stream_catalog": """
WITH both_variants AS (
  SELECT p.*, 'S' AS kind, p_name || ' S' AS variant, 0 AS less, p_size > 10 AS in_stock FROM part p
  UNION ALL SELECT p.*, 'N', p_name, 1, p_size > 30 FROM part p),
counted AS (
  SELECT 'run-1' AS run_id, count(*) AS n FROM part
  UNION ALL SELECT 'run-2', count(*) FROM part WHERE p_partkey % 4 <> 1)
SELECT 'https://shop.example/p/' || p_partkey AS source_url, p_partkey % 4 <> 1 AND p_size > 10 AS product_available,
  run_id AS last_seen_run_id, 'completed' AS status, n AS products_found, n AS products_saved,
  'sku:' || kind || p_partkey AS source_key, variant AS name,
  CAST(CAST(p_retailprice AS DECIMAL(12,2)) * CASE WHEN p_partkey % 4 <> 1 THEN 2 ELSE 1 END - less AS DECIMAL(12,2)) AS price,
  p_partkey % 4 <> 1 AND in_stock AS available, TIMESTAMP '2024-02-01' AS updated_at
FROM both_variants JOIN counted ON run_id = CASE WHEN p_partkey % 4 <> 1 THEN 'run-2' ELSE 'run-1' END""",
    "catalog_run": """
WITH states AS (
  SELECT *, p_partkey % 50 NOT IN (7, 11) AS in_first, p_partkey % 4 <> 1 AS in_second,
      CAST(p_retailprice AS DECIMAL(12,2)) * CASE WHEN p_partkey % 4 <> 1 THEN 2 ELSE 1 END
        - CASE WHEN p_size > 10 AND p_size <= 30 THEN 0 ELSE 1 END AS lowest
  FROM part),
numbered AS (
  SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS export_seq FROM states WHERE in_second)
SELECT 'https://shop.example/p/' || s.p_partkey AS source_url, p_name AS name, p_brand AS brand,
  CAST(lowest AS DECIMAL(12,2)) AS price, 'USD' AS currency, in_second AND p_size > 10 AS available,
  CASE WHEN in_second THEN 'run-2' ELSE 'run-1' END AS last_seen_run_id,
  CASE WHEN in_first THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-02-01' END AS first_seen_at,
  TIMESTAMP '2024-02-01' AS updated_at,
  CASE WHEN in_second THEN CAST(p_size > 10 AS BIGINT) + CAST(p_size > 30 AS BIGINT) ELSE 0 END AS on_offer,
  'sku:N' || s.p_partkey || '=' || p_name || ',sku:S' || s.p_partkey || '=' || p_name || ' S' AS variants,
  export_seq, CASE WHEN in_second THEN CAST(lowest AS DOUBLE) END AS export_price
FROM states s LEFT JOIN numbered n ON s.p_partkey = n.p_partkey WHERE in_first OR in_second""",
    "catalog_run_ledger": """
WITH counts AS (
  SELECT 1 AS run, count(*) AS found, count(*) FILTER (WHERE p_partkey % 50 IN (7, 11)) AS failed FROM part
  UNION ALL SELECT 2, count(*), 0 FROM part WHERE p_partkey % 4 <> 1)
SELECT 'run-' || run AS id, 'shop' AS source, 'parts' AS category, 'https://shop.example/c/' AS catalog_url,
  'both' AS storage_mode, CASE WHEN failed > 0 THEN 'partial' ELSE 'completed' END AS status, true AS full_scan,
  found AS products_found, found - failed AS products_saved, failed AS products_failed,
  CAST(NULL AS VARCHAR) AS error_message, make_timestamp(2024, run, 1, 0, 0, 0) AS started_at,
  TIMESTAMP '2024-03-01' AS finished_at
FROM counts""",
}
