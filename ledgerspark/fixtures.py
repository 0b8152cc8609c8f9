"""Ledger, price and catalogue views over the TPC-H-like test tables.

Each view is one SQL text that Spark and DuckDB read the same way. ``{S}`` is the
string type and ``{N}`` the suffix of the zone-less timestamp type; the other braces
name source tables. Every view reads its tables whole. ``SHUFFLED`` says how Spark gets the
rows of the largest views with fewer shuffles.
"""

import re

from pyspark.sql import DataFrame, SparkSession

from ledgerspark.functions.state import cut_lineage

# The date the valuation queries are run for; it lies after the last ledger date.
AS_OF = "2001-12-31"

VIEWS = {
    # Ledger core. A line number may repeat within an order, so one row per pair is kept.
    "tx": """
SELECT CAST(l_orderkey*10+l_linenumber AS BIGINT) AS transaction_id,
 CAST(l_partkey AS {S}) AS product_id, p_name AS product_name,
 CASE WHEN l_returnflag='N' OR l_linestatus='O' THEN 'BUY'
      WHEN l_returnflag='R' THEN 'SELL' ELSE 'OPEN' END AS transaction_type,
 CAST(l_quantity AS BIGINT) AS quantity,
 CASE WHEN l_returnflag='A' AND l_linestatus='F' THEN NULL
      ELSE CAST(CAST(l_extendedprice/l_quantity AS DECIMAL(18,6)) AS DECIMAL(18,2)) END AS price_per_unit,
 CASE WHEN (l_returnflag='A' AND l_linestatus='F') OR l_linenumber=1 THEN NULL
      ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS total_amount,
 CAST(l_shipdate AS DATE) AS transaction_date
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey,l_linenumber
        ORDER BY l_partkey,l_suppkey,l_shipdate,l_extendedprice) AS rn FROM {lineitem}) l
JOIN {part} ON p_partkey=l_partkey WHERE rn=1""",
    # Prices as collected, with several rows per product and day.
    "raw_prices": """
SELECT CAST(l_partkey AS {S}) AS product_id, CAST(o_orderdate AS DATE) AS snapshot_date,
 CAST(replace(p_brand,'Brand#','') AS INT) AS set_code,
 CASE WHEN l_discount=0 THEN NULL
      ELSE CAST(CAST(l_extendedprice/l_quantity AS DECIMAL(18,6)) AS DECIMAL(18,2)) END AS market_price,
 l_orderkey AS order_key, l_linenumber AS line_number, l_suppkey AS supp_key, l_extendedprice AS ext_price
FROM {lineitem} JOIN {orders} ON o_orderkey=l_orderkey JOIN {part} ON p_partkey=l_partkey""",
    # One price per product and day.
    "pr": """
SELECT product_id, snapshot_date, market_price FROM (
 SELECT product_id, snapshot_date, market_price,
  row_number() OVER (PARTITION BY product_id, snapshot_date
    ORDER BY order_key, line_number, supp_key, ext_price) AS rn
 FROM raw_prices) x WHERE rn=1""",
    # The price feed of one day, also the raw material of the catalogue.
    "feed": """
SELECT CAST(p_partkey AS {S}) AS product_id, p_name AS name, upper(p_name) AS clean_name,
 concat('img/', p_partkey) AS image_url, concat('item/', p_partkey) AS url,
 CAST(replace(p_brand,'Brand#','') AS INT) AS set_code,
 CASE WHEN p_size=50 THEN NULL ELSE DATE '2017-01-01' + p_size*60 END AS modified_on,
 CASE p_type WHEN 'ECONOMY' THEN NULL WHEN 'PROMO' THEN '' WHEN 'LARGE' THEN 'None' ELSE p_type END AS ext_rarity,
 CASE WHEN p_partkey%4=0 THEN 'N1' WHEN p_partkey%4=1 THEN '' ELSE NULL END AS ext_number,
 CASE WHEN p_size=7 THEN '' WHEN p_size=8 THEN 'n/a' ELSE CAST(p_retailprice AS {S}) END AS market_price
FROM {part}""",
    "earliest": """
SELECT CAST(l_partkey AS {S}) AS product_id, min(CAST(o_orderdate AS DATE)) + 400 AS earliest_date
FROM {lineitem} JOIN {orders} ON o_orderkey=l_orderkey GROUP BY 1""",
    # Catalogue with the first day each product may be traded. Parts nobody ordered have none.
    "products": """
SELECT CAST(p_partkey AS {S}) AS product_id, p_name AS name, upper(p_name) AS clean_name,
 earliest_date, CAST(replace(p_brand,'Brand#','') AS INT) AS set_code
FROM {part} LEFT JOIN earliest ON product_id=CAST(p_partkey AS {S})""",
    # Catalogue with longer and more varied names, for the search.
    "named": """
SELECT CAST(p_partkey AS {S}) AS product_id, concat(p_name, ' ', lower(p_type), ' ', p_brand) AS name,
 CASE WHEN p_size=9 THEN NULL ELSE concat(p_name, ' ', replace(p_brand,'Brand#','')) END AS clean_name
FROM {part}""",
    "ledger": """
SELECT t.*, t.transaction_date AS input_date,
 CASE WHEN transaction_date < earliest_date THEN TRUE WHEN quantity > 25 THEN FALSE END AS date_adjusted,
 CASE WHEN quantity < 10 THEN NULL ELSE concat('lot ', quantity) END AS notes,
 CAST(t.transaction_date AS TIMESTAMP{N}) + INTERVAL '1' HOUR * (t.transaction_id%10) AS created_at,
 CASE WHEN transaction_type='BUY' AND o_orderpriority<>'5-LOW' THEN o_orderpriority END AS purchase_method,
 CASE WHEN transaction_type<>'BUY' THEN NULL WHEN c_mktsegment='BUILDING' THEN '  ' ELSE n_name END AS purchase_location
FROM tx t JOIN {orders} ON o_orderkey=CAST(floor(t.transaction_id/10.0) AS BIGINT)
JOIN {customer} ON c_custkey=o_custkey JOIN {nation} ON n_nationkey=c_nationkey
JOIN earliest e ON e.product_id=t.product_id""",
    # One change per ledger row; the line number decides the kind. Inserts have no id yet,
    # some name an unknown product or type, and some ask for too much. Line 4 often names
    # an id that does not exist, line 6 changes the row that line 5 deletes. Lines 2, 3 and 7
    # are edited once more and lines 3 twice more, before all others or among later orders.
    "changes": """
SELECT transaction_id AS seq,
 CASE transaction_id%10 WHEN 3 THEN 'PATCH' WHEN 6 THEN 'PATCH' WHEN 5 THEN 'DELETE' WHEN 7 THEN 'UPDATE'
      WHEN 4 THEN 'UPDATE' ELSE 'INSERT' END AS op,
 CASE WHEN transaction_id%10 IN (3,5,7) THEN transaction_id WHEN transaction_id%10=4 THEN transaction_id*3
      WHEN transaction_id%10=6 THEN transaction_id-1 ELSE NULL END AS transaction_id,
 CASE WHEN transaction_id%70=1 THEN 'missing' ELSE product_id END AS product_id,
 CASE WHEN transaction_id%91=1 THEN 'GIFT' ELSE transaction_type END AS transaction_type,
 CASE transaction_id%10 WHEN 3 THEN CASE WHEN quantity > 20 THEN quantity-1 END WHEN 5 THEN NULL
      ELSE quantity*CASE WHEN transaction_id%3=0 THEN 100 ELSE 1 END END AS quantity,
 CASE transaction_id%10 WHEN 5 THEN NULL ELSE CAST(price_per_unit+1 AS DECIMAL(18,2)) END AS price_per_unit,
 CASE WHEN transaction_id%10 IN (3,5) THEN NULL ELSE input_date - 300 END AS input_date,
 CASE WHEN transaction_id%10 IN (3,6,7) THEN concat('edit ', transaction_id) END AS notes,
 purchase_method, purchase_location
FROM ledger
UNION ALL SELECT transaction_id + 5 AS seq, 'UPDATE' AS op, transaction_id, product_id, transaction_type,
 CASE WHEN transaction_id%9=0 THEN quantity*20 ELSE quantity+transaction_id%5 END AS quantity,
 price_per_unit, input_date, notes, coalesce(purchase_method, 'Fair') AS purchase_method, 'Hall' AS purchase_location
FROM ledger WHERE transaction_id%10=3
UNION ALL SELECT transaction_id + 1006 AS seq, 'PATCH' AS op, transaction_id, product_id, NULL AS transaction_type,
 CASE WHEN transaction_id%4=0 THEN quantity+2 END AS quantity,
 CASE WHEN transaction_id%3=0 THEN CAST(7.25 AS DECIMAL(18,2)) END AS price_per_unit, NULL AS input_date,
 CASE WHEN transaction_id%2=0 THEN 'again' END AS notes, NULL AS purchase_method, NULL AS purchase_location
FROM ledger WHERE transaction_id%10=3
UNION ALL SELECT transaction_id + 1008 AS seq, CASE WHEN transaction_id%3=0 THEN 'DELETE' ELSE 'UPDATE' END AS op,
 transaction_id, product_id, NULL AS transaction_type, quantity, price_per_unit, input_date, notes,
 purchase_method, purchase_location
FROM ledger WHERE transaction_id%10=2
UNION ALL SELECT -transaction_id AS seq, 'PATCH' AS op, transaction_id, product_id, NULL AS transaction_type,
 quantity+1 AS quantity, NULL AS price_per_unit, NULL AS input_date, NULL AS notes, NULL AS purchase_method,
 NULL AS purchase_location
FROM ledger WHERE transaction_id%10=7 AND transaction_id%4=3""",
    "ids": "SELECT product_id FROM feed WHERE modified_on >= DATE '2020-01-01'",
    # Search phrases made out of the product names: as they are, turned round, cut, and extended.
    "phrases": """
SELECT CAST(n AS INT) AS query_id,
 CASE n%4 WHEN 0 THEN upper(p_name)
  WHEN 1 THEN concat(split_part(p_name,' ',2), '  ', split_part(p_name,' ',1))
  WHEN 2 THEN substr(p_name, 2)
  ELSE concat(' ', p_name, ' zz') END AS query
FROM (SELECT p_name, row_number() OVER (ORDER BY p_name) AS n FROM (SELECT DISTINCT p_name FROM {part}) d) q""",
}

# The rows of the views above for Spark. The lines travel twice: to their order, where copies of a line meet as
# well (equal keys have equal order numbers), and to their part, whose facts are joined beforehand. The ledger is
# left lying by product, so that sums per product combine before they travel.
SHUFFLED = {
    "ledger": """
SELECT /*+ MERGE(f) */ transaction_id, CAST(l_partkey AS {S}) AS product_id, p_name AS product_name, transaction_type, quantity,
 price_per_unit, total_amount, transaction_date, transaction_date AS input_date,
 CASE WHEN transaction_date < earliest_date THEN TRUE WHEN quantity > 25 THEN FALSE END AS date_adjusted,
 CASE WHEN quantity < 10 THEN NULL ELSE concat('lot ', quantity) END AS notes,
 CAST(transaction_date AS TIMESTAMP{N}) + INTERVAL '1' HOUR * (transaction_id%10) AS created_at, purchase_method, purchase_location
FROM (SELECT transaction_id, l_partkey, kind AS transaction_type, CAST(l_quantity AS BIGINT) AS quantity,
  CASE WHEN unpriced THEN NULL
       ELSE CAST(CAST(l_extendedprice/l_quantity AS DECIMAL(18,6)) AS DECIMAL(18,2)) END AS price_per_unit,
  CASE WHEN unpriced OR l_linenumber=1 THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS total_amount,
  CAST(l_shipdate AS DATE) AS transaction_date,
  CASE WHEN kind='BUY' AND o_orderpriority<>'5-LOW' THEN o_orderpriority END AS purchase_method,
  CASE WHEN kind<>'BUY' THEN NULL WHEN c_mktsegment='BUILDING' THEN '  ' ELSE n_name END AS purchase_location
 FROM (SELECT *, CAST(l_orderkey*10+l_linenumber AS BIGINT) AS transaction_id,
   row_number() OVER (PARTITION BY order_no,l_orderkey,l_linenumber
         ORDER BY l_partkey,l_suppkey,l_shipdate,l_extendedprice) AS rn
  FROM (SELECT *, CAST(floor(CAST(l_orderkey*10+l_linenumber AS BIGINT)/10.0) AS BIGINT) AS order_no
   FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity,
     CASE WHEN l_returnflag='N' OR l_linestatus='O' THEN 'BUY' WHEN l_returnflag='R' THEN 'SELL' ELSE 'OPEN' END AS kind,
     coalesce(l_returnflag='A' AND l_linestatus='F', FALSE) AS unpriced
    FROM {lineitem} WHERE l_orderkey*10+l_linenumber IS NOT NULL
    DISTRIBUTE BY CAST(floor(CAST(l_orderkey*10+l_linenumber AS BIGINT)/10.0) AS BIGINT)) d) n) l
 JOIN (SELECT o_orderkey, o_orderpriority, c_mktsegment, n_name FROM {orders} JOIN {customer} ON c_custkey=o_custkey
  JOIN {nation} ON n_nationkey=c_nationkey) o ON o_orderkey=order_no WHERE rn=1) b
JOIN (SELECT p_partkey, p_name, earliest_date FROM {part} JOIN earliest ON product_id=CAST(p_partkey AS {S})) f
 ON p_partkey=l_partkey""",
    "pr": """
SELECT product_id, snapshot_date, min_by(market_price, struct(order_key, line_number, supp_key, ext_price)) AS market_price
FROM (SELECT /*+ MERGE(p) */ p.product_id, snapshot_date, market_price, order_key, line_number, supp_key, ext_price
 FROM (SELECT CAST(l_partkey AS {S}) AS product_id, CAST(o_orderdate AS DATE) AS snapshot_date,
   CASE WHEN l_discount=0 THEN NULL
        ELSE CAST(CAST(l_extendedprice/l_quantity AS DECIMAL(18,6)) AS DECIMAL(18,2)) END AS market_price,
   l_orderkey AS order_key, l_linenumber AS line_number, l_suppkey AS supp_key, l_extendedprice AS ext_price
  FROM {lineitem} JOIN {orders} ON o_orderkey=l_orderkey) q
 JOIN (SELECT CAST(p_partkey AS {S}) AS product_id FROM {part}) p ON p.product_id=q.product_id) x
GROUP BY product_id, snapshot_date""",
}

_WORD = re.compile(r"\b(?:FROM|JOIN)\s+(\w+)")


def _needed(name: str, texts: dict[str, str] = VIEWS) -> list[str]:
    """Views ``name`` is made of, each after the ones it reads itself."""
    found: list[str] = []
    for part in _WORD.findall(texts[name]):
        if part in texts:
            found += [v for v in _needed(part, texts) if v not in found]
    return found + [name]


def _typed(text: str, string_type: str, naive_suffix: str) -> str:
    return text.replace("{S}", string_type).replace("{N}", naive_suffix)


def duckdb_ctes(*names: str) -> str:
    """``WITH`` clause defining the named views (and what they read) for DuckDB."""
    order = list(dict.fromkeys(v for name in names for v in _needed(name)))
    bodies = [f"{v} AS ({_typed(VIEWS[v], 'VARCHAR', '')})" for v in order]
    return re.sub(r"\{(\w+)\}", r"\1", "WITH " + ",\n".join(bodies))


def view(spark: SparkSession, sf_dir: str, name: str, stored: dict[str, DataFrame] | None = None) -> DataFrame:
    """The named view as a Spark DataFrame over the parquet files in ``sf_dir``; the views it reads are taken
    from ``stored`` if they are there."""
    stored = stored or {}
    if name in stored:
        return stored[name]
    texts = {v: text for v, text in (VIEWS | SHUFFLED).items() if v not in stored}
    order = _needed(name, texts)
    text = _typed(",\n".join(f"{v} AS ({texts[v]})" for v in order), "STRING", "_NTZ")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", text))}
    text = re.sub(r"\b(FROM|JOIN)(\s+)(\w+)", lambda m: f"{m[1]}{m[2]}{{{m[3]}}}" if m[3] in stored else m[0], text)
    read = {v: df for v, df in stored.items() if f"{{{v}}}" in text}
    return spark.sql(f"WITH {text}\nSELECT * FROM {name}", **tables, **read)


def views(spark: SparkSession, sf_dir: str, names: tuple[str, ...], often: tuple[str, ...] = (),
          columns: dict[str, tuple[str, ...]] | None = None) -> list[DataFrame]:
    """The named views. Those of ``often`` that they are made of are worked out once and stored, whole or with the
    ``columns`` that anything reads."""
    stored: dict[str, DataFrame] = {}
    for name in often:
        rows = view(spark, sf_dir, name, stored)
        stored[name] = cut_lineage(rows.select(*(columns or {}).get(name, rows.columns)))
    return [view(spark, sf_dir, name, stored) for name in names]
