"""Every operator as a query over the test tables, with equivalent SQL where SQL can say it.

The SQL is phrased differently from the operator it checks (dense instead of sparse,
self joins and ASOF joins instead of windows), so that one is not a copy of the other.
Query results show dates as text and decimals as doubles, which both engines print alike.
"""

import re
from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.fixtures import AS_OF, duckdb_ctes, views as fixture_views
from ledgerspark.operators import catalogue, changes, holdings, reports, search, snapshots, timeseries

Query = Callable[[SparkSession, str], DataFrame]

TODAY = date.fromisoformat(AS_OF)
ENTERED_AT = datetime(2002, 1, 1, 12, 0, 0)
QUERIES: dict[str, Query] = {}
# Name -> the views a query reads and the function that builds it from them.
BUILDERS: dict[str, tuple[tuple[str, ...], Callable[..., DataFrame]]] = {}
ORACLES: dict[str, str] = {}


def present(df: DataFrame) -> DataFrame:
    """Dates and timestamps as text, decimals as doubles."""
    def shown(field: T.StructField):
        column = F.col(field.name)
        if isinstance(field.dataType, T.DateType):
            return F.date_format(column, "yyyy-MM-dd").alias(field.name)
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(field.name)
        if isinstance(field.dataType, T.DecimalType):
            return column.cast("double").alias(field.name)
        return column
    return df.select(*[shown(f) for f in df.schema.fields])


def query(name: str, *views: str, sql: str | None = None, often: tuple[str, ...] = (),
          columns: dict[str, tuple[str, ...]] | None = None):
    """Register ``build(views...)`` under ``name``; ``sql`` may use the same views. ``often`` names views that the
    query reads several times over, ``columns`` those it needs of them, if not all."""
    def register(build):
        BUILDERS[name] = (views, build)
        QUERIES[name] = lambda spark, sf_dir: present(build(*fixture_views(spark, sf_dir, views, often, columns)))
        if sql is not None:
            names = [v for v in views] + [v for v in _extra_views(sql) if v not in views]
            ORACLES[name] = _oracle(names, sql)
        return build
    return register


def _extra_views(sql: str) -> list[str]:
    return [word.strip("<>") for word in sql.split() if word.startswith("<") and word.endswith(">")]


# Shared pieces of the SQL side. Half-up rounding goes through six decimals in both engines.
_SHARED = {
    "typed": """typed AS (SELECT *, coalesce(total_amount, CAST(quantity*price_per_unit AS DECIMAL(18,2))) AS amount,
 CASE transaction_type WHEN 'BUY' THEN quantity WHEN 'SELL' THEN -quantity WHEN 'OPEN' THEN -quantity ELSE 0 END AS signed
 FROM tx)""",
    "calendar": f"""calendar AS (SELECT DISTINCT date FROM (SELECT snapshot_date AS date FROM pr
 UNION ALL SELECT transaction_date FROM tx UNION ALL SELECT DATE '{AS_OF}') d
 WHERE date >= (SELECT min(transaction_date) FROM tx))""",
    "held": f"""held AS (SELECT product_id,
 (SELECT arg_min(product_name, (transaction_date, created_at, transaction_id)) FROM ledger l WHERE l.product_id=t.product_id) AS product_name,
 coalesce(sum(quantity) FILTER (transaction_type='BUY'),0) AS bought,
 coalesce(sum(quantity) FILTER (transaction_type='SELL'),0) AS sold,
 coalesce(sum(quantity) FILTER (transaction_type='OPEN'),0) AS opened,
 coalesce(sum(amount) FILTER (transaction_type='BUY'),0) - coalesce(sum(amount) FILTER (transaction_type='SELL'),0) AS basis,
 coalesce(sum(quantity*price_per_unit) FILTER (transaction_type='BUY'),0) AS buy_cost
 FROM typed t WHERE transaction_date <= DATE '{AS_OF}' GROUP BY product_id)""",
    "held_view": """held_view AS (SELECT product_id, product_name, CAST(bought-sold-opened AS BIGINT) AS current_quantity, basis,
 CASE WHEN bought > 0 THEN CAST(CAST(CAST(buy_cost AS DOUBLE)/CAST(bought AS DOUBLE) AS DECIMAL(18,6)) AS DECIMAL(18,2)) ELSE 0 END AS average
 FROM held)""",
    "stock_days": """stock_days AS (SELECT product_id, transaction_date AS date,
 sum(sum(signed)) OVER (PARTITION BY product_id ORDER BY transaction_date) AS stock,
 sum(sum(CASE transaction_type WHEN 'BUY' THEN amount WHEN 'SELL' THEN -amount ELSE 0 END))
   OVER (PARTITION BY product_id ORDER BY transaction_date) AS basis
 FROM typed GROUP BY product_id, transaction_date)""",
    "known": """known AS (SELECT product_id, snapshot_date, market_price FROM pr WHERE market_price IS NOT NULL
 AND snapshot_date >= (SELECT min(transaction_date) FROM tx))""",
    "valued": """valued AS (SELECT c.date, coalesce(sum(s.basis),0) AS cost,
 coalesce(sum(CASE WHEN s.stock > 0 THEN s.stock*k.market_price END),0) AS market
 FROM (SELECT date, product_id FROM calendar, (SELECT DISTINCT product_id FROM tx) p) c
 ASOF LEFT JOIN stock_days s ON s.product_id=c.product_id AND s.date<=c.date
 ASOF LEFT JOIN known k ON k.product_id=c.product_id AND k.snapshot_date<=c.date
 GROUP BY c.date)""",
    "sales": """sales AS (SELECT s.product_id, s.transaction_date AS date, sum(coalesce(s.amount,0)) AS proceeds, sum(s.quantity) AS sold
 FROM typed s WHERE transaction_type='SELL' GROUP BY 1, 2)""",
    "profits": """profits AS (SELECT s.date, sum(CAST(CAST(proceeds AS DOUBLE) - CAST(sold AS DOUBLE) *
   coalesce(CAST(b.cost AS DOUBLE)/CAST(b.bought AS DOUBLE), 0) AS DECIMAL(24,6))) AS profit
 FROM sales s LEFT JOIN (SELECT s.product_id, s.date, sum(t.quantity*t.price_per_unit) AS cost, sum(t.quantity) AS bought
   FROM sales s JOIN tx t ON t.product_id=s.product_id AND t.transaction_type='BUY' AND t.transaction_date<=s.date
   GROUP BY 1, 2) b ON b.product_id=s.product_id AND b.date=s.date
 GROUP BY s.date)""",
    "series": """series AS (SELECT v.date, v.cost, v.market, coalesce(sum(p.profit),0) AS profit
 FROM valued v LEFT JOIN profits p ON p.date<=v.date GROUP BY 1, 2, 3)""",
    "on_hand": "on_hand AS (SELECT product_id, CAST(sum(signed) AS BIGINT) AS current_quantity FROM typed GROUP BY product_id)",
    "checked": """checked AS (SELECT c.*, p.name, p.earliest_date, CASE
  WHEN c.transaction_type IS NULL OR c.quantity IS NULL OR c.input_date IS NULL THEN 'missing_field'
  WHEN p.product_id IS NULL THEN 'unknown_product'
  WHEN c.transaction_type NOT IN ('BUY','SELL','OPEN') THEN 'unknown_type'
  WHEN c.transaction_type<>'BUY' AND coalesce(h.current_quantity,0) < c.quantity THEN 'insufficient_stock'
  WHEN c.transaction_type<>'OPEN' AND c.price_per_unit IS NULL THEN 'missing_price'
  WHEN c.transaction_type='BUY' AND coalesce(c.purchase_method,'')='' THEN 'missing_method'
  WHEN c.transaction_type='BUY' AND trim(coalesce(c.purchase_location,''))='' THEN 'missing_location' END AS reason
 FROM changes c LEFT JOIN products p ON p.product_id=c.product_id LEFT JOIN on_hand h ON h.product_id=c.product_id
 WHERE c.op='INSERT')""",
    # A batch walked change by change, for each product; ``rows`` holds the rows edited so far.
    "steps": """steps AS (SELECT c.seq, c.op, CASE WHEN c.op<>'INSERT' THEN c.transaction_id END AS id,
  CASE WHEN c.op<>'INSERT' THEN l.product_id WHEN p.product_id IS NULL THEN concat('unknown ', c.seq) ELSE c.product_id END AS lane,
  CASE WHEN c.op='INSERT' THEN c.transaction_type ELSE l.transaction_type END AS kind, c.quantity, c.price_per_unit AS price,
  c.input_date, c.notes, c.purchase_method, c.purchase_location, p.product_id IS NOT NULL AS known, p.product_id, p.name, p.earliest_date,
  CASE WHEN c.op<>'INSERT' THEN {'q': l.quantity, 'price': l.price_per_unit, 'total': l.total_amount, 'day': l.transaction_date,
   'input': l.input_date, 'adjusted': l.date_adjusted, 'notes': l.notes, 'method': l.purchase_method,
   'location': l.purchase_location, 'gone': FALSE} END AS stored,
  row_number() OVER (PARTITION BY lane ORDER BY c.seq) AS n
 FROM changes c LEFT JOIN ledger l ON c.op<>'INSERT' AND l.transaction_id=c.transaction_id
 LEFT JOIN products p ON p.product_id=CASE WHEN c.op='INSERT' THEN c.product_id ELSE l.product_id END
 WHERE c.op='INSERT' OR l.transaction_id IS NOT NULL)""",
    "batch_walk": """batch_walk AS (
 SELECT DISTINCT s.lane, CAST(0 AS BIGINT) AS n, coalesce(h.current_quantity, 0) AS stock,
  MAP(CAST([] AS BIGINT[]), list_filter([s.stored], lambda x: FALSE)) AS rows, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS reason
 FROM steps s LEFT JOIN on_hand h ON h.product_id=s.lane WHERE s.n=1
 UNION ALL SELECT lane, n, CASE WHEN reason IS NULL THEN stock + sign*(next.q - coalesce(now.q, 0)) ELSE stock END,
  CASE WHEN reason IS NULL AND id IS NOT NULL THEN map_concat(rows, MAP {id: next}) ELSE rows END, seq, reason
 FROM (SELECT *, CASE kind WHEN 'BUY' THEN 1 WHEN 'SELL' THEN -1 WHEN 'OPEN' THEN -1 ELSE 0 END AS sign,
   CASE WHEN now.gone THEN 'not_found' WHEN op IN ('PATCH','DELETE') THEN NULL
    WHEN kind IS NULL OR quantity IS NULL OR input_date IS NULL THEN 'missing_field' WHEN NOT known THEN 'unknown_product'
    WHEN kind NOT IN ('BUY','SELL','OPEN') THEN 'unknown_type'
    WHEN kind<>'BUY' AND stock + coalesce(now.q, 0) < quantity THEN 'insufficient_stock'
    WHEN kind<>'OPEN' AND price IS NULL THEN 'missing_price'
    WHEN kind='BUY' AND coalesce(purchase_method,'')='' THEN 'missing_method'
    WHEN kind='BUY' AND trim(coalesce(purchase_location,''))='' THEN 'missing_location' END AS reason,
   CASE op WHEN 'DELETE' THEN struct_update(now, q := CAST(0 AS BIGINT), gone := TRUE)
    WHEN 'PATCH' THEN {'q': coalesce(quantity, now.q), 'price': coalesce(price, now.price),
     'total': CASE WHEN quantity IS NULL AND price IS NULL THEN now.total
      ELSE coalesce(CAST(coalesce(quantity, now.q)*coalesce(price, now.price) AS DECIMAL(18,2)), now.total) END,
     'day': now.day, 'input': now.input, 'adjusted': now.adjusted, 'notes': coalesce(notes, now.notes),
     'method': coalesce(purchase_method, now.method), 'location': coalesce(purchase_location, now.location), 'gone': FALSE}
    ELSE {'q': quantity, 'price': CASE WHEN kind<>'OPEN' THEN price END,
     'total': CASE WHEN kind<>'OPEN' THEN CAST(quantity*price AS DECIMAL(18,2)) END,
     'day': CASE WHEN earliest_date > input_date THEN earliest_date ELSE input_date END, 'input': input_date,
     'adjusted': coalesce(earliest_date > input_date, FALSE), 'notes': coalesce(notes, ''),
     'method': CASE WHEN kind='BUY' THEN purchase_method END, 'location': CASE WHEN kind='BUY' THEN purchase_location END,
     'gone': FALSE} END AS next
  FROM (SELECT s.*, w.stock, w.rows, coalesce(w.rows[s.id], s.stored) AS now
   FROM batch_walk w JOIN steps s ON s.lane=w.lane AND s.n=w.n+1) x) y)""",
}
_USES = {"typed": [], "calendar": [], "held": ["typed"], "held_view": ["held"], "stock_days": ["typed"], "known": [],
         "valued": ["calendar", "stock_days", "known"], "sales": ["typed"], "profits": ["sales"],
         "series": ["valued", "profits"], "on_hand": ["typed"], "checked": ["on_hand"], "steps": [],
         "batch_walk": ["steps", "on_hand"]}


def _with_uses(names: list[str]) -> list[str]:
    order: list[str] = []
    for name in names:
        order += [n for n in _with_uses(_USES[name]) + [name] if n not in order]
    return order


def _oracle(views: list[str], sql: str) -> str:
    shared = _with_uses([n for n in _SHARED if re.search(rf"\b{n}\b", sql)])
    base = {"tx"} if shared else set()
    for name in shared:
        base |= {v for v in ("pr", "ledger", "changes", "products") if re.search(rf"\b{v}\b", _SHARED[name])}
    ctes = duckdb_ctes(*views, *sorted(base - set(views)))
    if "walk AS" in sql or "batch_walk" in shared:
        ctes = ctes.replace("WITH ", "WITH RECURSIVE ", 1)
    text = ",\n".join([ctes] + [_SHARED[n] for n in shared])
    return f"{text}\n{re.sub(r'<(\w+)>', r'\1', sql).strip()}"


def _money(expr: str) -> str:
    """``expr`` rounded half-up to cents, as a double."""
    return f"CAST(CAST(CAST({expr} AS DECIMAL(24,6)) AS DECIMAL(18,2)) AS DOUBLE)"


def _day(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d')"


# --- Stock and cost -------------------------------------------------------------------

@query("on_hand", "tx", sql="SELECT product_id, current_quantity FROM on_hand")
def _(tx):
    return holdings.on_hand(tx)


@query("current_holdings", "ledger", sql=f"""
SELECT product_id, product_name, CAST(bought AS BIGINT) AS total_quantity_bought, CAST(sold AS BIGINT) AS total_quantity_sold,
 CAST(opened AS BIGINT) AS total_quantity_opened, CAST(bought-sold-opened AS BIGINT) AS current_quantity,
 {_money('basis')} AS total_cost_basis,
 CASE WHEN bought > 0 THEN {_money('CAST(buy_cost AS DOUBLE)/CAST(bought AS DOUBLE)')} ELSE 0.0 END AS average_cost_per_unit,
 '{AS_OF}' AS last_updated
FROM held""")
def _(ledger):
    return holdings.current_holdings(ledger, TODAY)


@query("active_holdings", "ledger", sql="""
SELECT product_id, product_name, current_quantity, CAST(basis AS DOUBLE) AS total_cost_basis,
 CAST(average AS DOUBLE) AS average_cost_per_unit
FROM held_view WHERE current_quantity > 0 ORDER BY product_name, product_id""")
def _(ledger):
    return (holdings.active_holdings(holdings.current_holdings(ledger, TODAY))
            .select("product_id", "product_name", "current_quantity", "total_cost_basis", "average_cost_per_unit")
            .orderBy("product_name", "product_id"))


@query("product_detail", "products", "tx", sql=f"""
SELECT p.product_id, name, clean_name, {_day('earliest_date')} AS earliest_date,
 coalesce((SELECT h.current_quantity FROM on_hand h WHERE h.product_id=p.product_id), 0) AS current_quantity
FROM products p""")
def _(products, tx):
    return holdings.product_detail(products, tx)


# --- Time series ----------------------------------------------------------------------

@query("ledger_bounds", "tx", sql=f"""
SELECT {_day('(SELECT transaction_date FROM tx ORDER BY 1 LIMIT 1)')} AS first_date,
 {_day('(SELECT transaction_date FROM tx ORDER BY 1 DESC LIMIT 1)')} AS last_date""")
def _(tx):
    return timeseries.ledger_bounds(tx)


@query("transaction_dates", "tx", sql=f"SELECT {_day('transaction_date')} AS date FROM tx GROUP BY transaction_date")
def _(tx):
    return timeseries.transaction_dates(tx)


@query("valuation_calendar", "pr", "tx", sql=f"SELECT {_day('date')} AS date FROM calendar")
def _(pr, tx):
    return timeseries.valuation_calendar(pr, tx, TODAY)


@query("cost_history_sparse", "tx", sql=f"""
SELECT d.product_id, {_day('d.date')} AS date,
 CAST(coalesce(sum(t.amount) FILTER (t.transaction_type='BUY'),0) AS DOUBLE) AS cumulative_buy_amt,
 CAST(coalesce(sum(t.amount) FILTER (t.transaction_type='SELL'),0) AS DOUBLE) AS cumulative_sell_amt,
 CAST(coalesce(sum(t.amount) FILTER (t.transaction_type='BUY'),0)
    - coalesce(sum(t.amount) FILTER (t.transaction_type='SELL'),0) AS DOUBLE) AS cumulative_cost_basis,
 CAST(sum(t.signed) AS BIGINT) AS sealed_quantity,
 CAST(coalesce(sum(t.signed) FILTER (t.transaction_type<>'OPEN'),0) AS BIGINT) AS cost_basis_quantity,
 CASE WHEN sum(t.quantity) FILTER (t.transaction_type='BUY') > 0 THEN
  {_money('''CAST(sum(t.quantity*t.price_per_unit) FILTER (t.transaction_type='BUY') AS DOUBLE)
    / CAST(sum(t.quantity) FILTER (t.transaction_type='BUY') AS DOUBLE)''')} ELSE 0.0 END AS average_cost_per_unit,
 {_money('''coalesce(sum(t.amount) FILTER (t.transaction_type='BUY'),0)
    - coalesce(sum(t.amount) FILTER (t.transaction_type='SELL'),0)''')} AS total_cost_basis
FROM (SELECT DISTINCT product_id, transaction_date AS date FROM tx) d
JOIN typed t ON t.product_id=d.product_id AND t.transaction_date<=d.date
GROUP BY d.product_id, d.date""")
def _(tx):
    return timeseries.cost_history(tx)


@query("cost_history_dense", "tx", "pr", sql="""
SELECT strftime(c.date, '%Y-%m-%d') AS date, count(*) AS products, CAST(sum(s.basis) AS DOUBLE) AS total_cost_basis,
 CAST(sum(s.stock) AS BIGINT) AS sealed_quantity, CAST(sum(a.average) AS DOUBLE) AS average_cost_sum
FROM (SELECT date, product_id FROM calendar JOIN (SELECT product_id, min(transaction_date) AS start FROM tx GROUP BY 1) f
   ON date >= start) c
ASOF JOIN stock_days s ON s.product_id=c.product_id AND s.date<=c.date
ASOF JOIN (SELECT product_id, transaction_date, CASE WHEN bought > 0 THEN
    CAST(CAST(CAST(cost AS DOUBLE)/CAST(bought AS DOUBLE) AS DECIMAL(18,6)) AS DECIMAL(18,2)) ELSE 0 END AS average
  FROM (SELECT product_id, transaction_date,
     coalesce(sum(sum(quantity) FILTER (transaction_type='BUY')) OVER w, 0) AS bought,
     coalesce(sum(sum(quantity*price_per_unit) FILTER (transaction_type='BUY')) OVER w, 0) AS cost
   FROM tx GROUP BY 1, 2 WINDOW w AS (PARTITION BY product_id ORDER BY transaction_date)) x) a
  ON a.product_id=c.product_id AND a.transaction_date<=c.date
GROUP BY c.date""")
def _(tx, pr):
    dense = timeseries.dense_cost_history(tx, timeseries.valuation_calendar(pr, tx, TODAY))
    return timeseries.daily_totals(dense)


@query("running_avg_cost", "tx", sql=f"""
SELECT d.product_id, {_day('d.date')} AS date, CAST(coalesce(sum(t.quantity),0) AS BIGINT) AS quantity_bought,
 CASE WHEN sum(t.quantity) > 0 THEN CAST(sum(t.quantity*t.price_per_unit) AS DOUBLE)/CAST(sum(t.quantity) AS DOUBLE)
      ELSE 0.0 END AS average_cost
FROM (SELECT DISTINCT product_id, transaction_date AS date FROM tx) d
LEFT JOIN tx t ON t.product_id=d.product_id AND t.transaction_date<=d.date AND t.transaction_type='BUY'
GROUP BY d.product_id, d.date""")
def _(tx):
    return timeseries.running_avg_cost(tx)


@query("realized_pnl", "tx", sql=f"""
SELECT {_day('p.date')} AS date, {_money('p.profit')} AS realized_pnl, {_money('sum(q.profit)')} AS cumulative_realized_pnl
FROM profits p JOIN profits q ON q.date<=p.date GROUP BY p.date, p.profit""")
def _(tx):
    return timeseries.realized_pnl(tx)


@query("asof_price", "tx", "pr", sql=f"""
SELECT t.transaction_id, t.product_id, {_day('t.transaction_date')} AS date,
 CAST(k.market_price AS DOUBLE) AS market_price, {_day('k.snapshot_date')} AS price_date
FROM tx t ASOF LEFT JOIN known k ON k.product_id=t.product_id AND k.snapshot_date<=t.transaction_date""")
def _(tx, pr):
    asked = tx.select("transaction_id", "product_id", F.col("transaction_date").alias("date"))
    return timeseries.asof_price(asked, pr, tx.agg(F.min("transaction_date")).scalar())


@query("exact_price", "tx", "pr", sql=f"""
SELECT t.transaction_id, t.product_id, {_day('t.transaction_date')} AS date,
 (SELECT CAST(p.market_price AS DOUBLE) FROM pr p WHERE p.product_id=t.product_id
   AND p.snapshot_date=t.transaction_date) AS market_price
FROM tx t""")
def _(tx, pr):
    return timeseries.exact_price(
        tx.select("transaction_id", "product_id", F.col("transaction_date").alias("date")), pr)


@query("daily_portfolio_value", "tx", "pr", sql=f"""
SELECT {_day('date')} AS date, {_money('cost')} AS total_cost_basis, {_money('market')} AS total_market_value,
 {_money('market - cost')} AS unrealized_pnl, {_money('profit')} AS cumulative_realized_pnl
FROM series""")
def _(tx, pr):
    return timeseries.daily_portfolio_value(tx, pr, TODAY)


@query("latest_day", "tx", "pr", sql=f"""
SELECT {_day('date')} AS date, {_money('market')} AS total_market_value, {_money('cost')} AS total_cost_basis
FROM series WHERE date = (SELECT max(date) FROM series)""")
def _(tx, pr):
    daily = timeseries.daily_portfolio_value(tx, pr, TODAY)
    return timeseries.latest_by_date(daily).select("date", "total_market_value", "total_cost_basis")


@query("price_staleness", "tx", "pr", sql=f"""
SELECT {_day('last_day')} AS last_day, {_day('latest')} AS latest_price_date,
 CAST(date_diff('day', latest, DATE '{AS_OF}') AS INT) AS days_behind, coalesce(latest < DATE '{AS_OF}', FALSE) AS is_stale
FROM (SELECT last_day, max(k.snapshot_date) AS latest
 FROM (SELECT max(date) AS last_day FROM calendar) c, on_hand h,
  (SELECT product_id, max(snapshot_date) AS snapshot_date FROM known GROUP BY 1) k
 WHERE h.current_quantity > 0 AND k.product_id=h.product_id AND k.snapshot_date < last_day GROUP BY last_day) x""")
def _(tx, pr):
    return timeseries.price_staleness(tx, pr, TODAY)


# --- Reports --------------------------------------------------------------------------

@query("chart_series", "tx", "pr", sql=f"""
SELECT {_day('date')} AS date, {_money('market')} AS market_value, {_money('cost')} AS cost_basis
FROM series ORDER BY 1""")
def _(tx, pr):
    return reports.chart_series(timeseries.daily_portfolio_value(tx, pr, TODAY))


_SUMMARY = f"""
SELECT (SELECT count(*) FROM held_view WHERE current_quantity > 0) AS total_products,
 CAST((SELECT sum(current_quantity) FROM held_view WHERE current_quantity > 0) AS BIGINT) AS total_quantity,
 COST AS total_cost_basis, {_money('market')} AS current_market_value,
 {_money('market - cost')} AS unrealized_pnl, {_money('profit')} AS cumulative_realized_pnl
FROM series WHERE date = (SELECT max(date) FROM calendar)"""


@query("portfolio_summary", "ledger", "pr", often=("ledger",), sql=_SUMMARY.replace("COST", _money("cost")))
def _(ledger, pr):
    return reports.portfolio_summary(holdings.current_holdings(ledger, TODAY),
                                     timeseries.daily_portfolio_value(ledger, pr, TODAY))


@query("portfolio_summary_held", "ledger", "pr", often=("ledger",), sql=_SUMMARY.replace(
    "COST", "CAST((SELECT sum(basis) FROM held_view WHERE current_quantity > 0) AS DOUBLE)"))
def _(ledger, pr):
    return reports.portfolio_summary(holdings.current_holdings(ledger, TODAY),
                                     timeseries.daily_portfolio_value(ledger, pr, TODAY), cost_source="holdings")


@query("portfolio_return", "ledger", "pr", often=("ledger",), sql=f"""
SELECT {_money('cost')} AS total_cost_basis, {_money('market - cost')} AS unrealized_pnl,
 CASE WHEN cost > 0 THEN {_money(f"{_money('market - cost')}/{_money('cost')}*100")} END AS return_percent
FROM series WHERE date = (SELECT max(date) FROM calendar)""")
def _(ledger, pr):
    summary = reports.portfolio_summary(holdings.current_holdings(ledger, TODAY),
                                        timeseries.daily_portfolio_value(ledger, pr, TODAY))
    return reports.portfolio_return(summary)


@query("value_holdings", "ledger", "pr", sql="""
SELECT product_id, product_name, current_quantity, CAST(average AS DOUBLE) AS average_cost_per_unit,
 CAST(basis AS DOUBLE) AS total_cost_basis, CAST(coalesce(price, 0) AS DOUBLE) AS current_price_per_unit,
 CAST(coalesce(current_quantity*price, 0) AS DOUBLE) AS total_current_value
FROM (SELECT *, (SELECT market_price FROM pr WHERE pr.product_id=h.product_id
   AND snapshot_date=(SELECT max(snapshot_date) FROM pr)) AS price FROM held_view h) x
WHERE current_quantity > 0 ORDER BY product_name, product_id""")
def _(ledger, pr):
    return reports.value_holdings(holdings.current_holdings(ledger, TODAY), pr)


_HISTORY = f"""
SELECT transaction_id, {_day('transaction_date')} AS transaction_date, product_name, transaction_type, quantity,
 CAST(price_per_unit AS DOUBLE) AS price_per_unit, CAST(total_amount AS DOUBLE) AS total_amount,
 CASE WHEN notes IS NULL THEN '' ELSE notes END AS notes, purchase_method, purchase_location,
 date_adjusted IS NOT NULL AND date_adjusted AS date_adjusted
FROM ledger WHERE_ ORDER BY ledger.transaction_date DESC, created_at DESC, transaction_id DESC"""


@query("ledger_history", "ledger", sql=_HISTORY.replace("WHERE_", ""))
def _(ledger):
    return reports.ledger_history(ledger, "All")


@query("ledger_history_sells", "ledger", sql=_HISTORY.replace("WHERE_", "WHERE transaction_type='SELL'"))
def _(ledger):
    return reports.ledger_history(ledger, "SELL")


# --- Catalogue and snapshots ----------------------------------------------------------

_SEALED = """year(modified_on) >= 2020 AND coalesce(ext_rarity,'') IN ('','None') AND coalesce(ext_number,'') IN ('','None')"""


@query("recent_feed", "feed", sql=f"""
SELECT product_id, set_code, {_day('modified_on')} AS modified_on FROM feed WHERE modified_on >= DATE '2020-01-01'""")
def _(feed):
    return catalogue.recent_only(feed).select("product_id", "set_code", "modified_on")


@query("sealed_catalogue", "feed", sql=f"""
SELECT product_id, name, clean_name, image_url, {_day('modified_on')} AS modified_on,
 {_day('modified_on')} AS earliest_date, set_code, url FROM feed WHERE {_SEALED}""")
def _(feed):
    return catalogue.sealed_catalogue(feed)


@query("catalogue_sample", "feed", sql=f"""
SELECT product_id, name, set_code FROM feed WHERE {_SEALED}
ORDER BY set_code, CAST(product_id AS BIGINT) LIMIT 5""")
def _(feed):
    return catalogue.catalogue_sample(catalogue.sealed_catalogue(feed)).select("product_id", "name", "set_code")


@query("sealed_counts", "feed", sql=f"""
SELECT set_code, CAST(sum(CASE WHEN {_SEALED} THEN 1 ELSE 0 END) AS BIGINT) AS sealed_products
FROM feed WHERE year(modified_on) >= 2020 GROUP BY set_code""")
def _(feed):
    return catalogue.sealed_counts(feed)


@query("sealed_totals", "feed", sql=f"""
SELECT (SELECT count(*) FROM feed WHERE {_SEALED}) AS total_sealed,
 (SELECT count(DISTINCT set_code) FROM feed WHERE year(modified_on) >= 2020) AS sets_processed""")
def _(feed):
    return catalogue.sealed_totals(catalogue.sealed_counts(feed))


@query("tracked_sets", "products", sql="SELECT set_code FROM products GROUP BY set_code ORDER BY set_code")
def _(products):
    return catalogue.tracked_sets(products)


@query("newest_sets", "products", sql="""
SELECT set_code FROM (SELECT DISTINCT set_code FROM products) s
WHERE (SELECT count(DISTINCT set_code) FROM products p WHERE p.set_code > s.set_code) < 10 ORDER BY set_code""")
def _(products):
    return catalogue.tracked_sets(products, newest=10)


@query("snapshot_from_feed", "feed", "products", sql=f"""
SELECT p.product_id, '{AS_OF}' AS snapshot_date, TRY_CAST(f.market_price AS DOUBLE) AS market_price
FROM products p LEFT JOIN feed f ON f.product_id=p.product_id AND f.set_code=p.set_code AND year(f.modified_on) >= 2020""")
def _(feed, products):
    return snapshots.snapshot_from_feed(feed, products, TODAY)


_ARCHIVE_ORDER = ["order_key", "line_number", "supp_key", "ext_price"]


@query("snapshot_from_archive", "raw_prices", "ids", sql=f"""
SELECT product_id, {_day('snapshot_date')} AS snapshot_date,
 CAST(list_extract(list(market_price ORDER BY order_key, line_number, supp_key, ext_price), 1) AS DOUBLE) AS market_price
FROM raw_prices WHERE product_id IN (SELECT product_id FROM ids) GROUP BY product_id, raw_prices.snapshot_date""")
def _(raw, ids):
    """Every raw price becomes a JSON document of the archive's form and is read back."""
    item = F.struct(F.col("product_id").alias("productId"), F.col("market_price").alias("marketPrice"), *_ARCHIVE_ORDER)
    documents = raw.select("snapshot_date", F.to_json(F.struct(F.array(item).alias("results"))).alias("document"))
    keys = "order_key: bigint, line_number: int, supp_key: bigint, ext_price: double"
    parsed = F.from_json("document", f"results array<struct<productId: string, marketPrice: string, {keys}>>")
    rows = (documents.select("snapshot_date", F.explode(parsed["results"]).alias("row"))
            .select("snapshot_date", F.col("row.productId").alias("product_id"),
                    F.col("row.marketPrice").alias("market_price"), *[f"row.{c}" for c in _ARCHIVE_ORDER]))
    return snapshots.snapshot_from_archive(rows, ids, _ARCHIVE_ORDER)


@query("dedupe_snapshot", "raw_prices", sql=f"""
SELECT product_id, {_day('snapshot_date')} AS snapshot_date, CAST(market_price AS DOUBLE) AS market_price FROM raw_prices
QUALIFY row_number() OVER (PARTITION BY product_id, raw_prices.snapshot_date
  ORDER BY order_key, line_number, supp_key, ext_price) = 1""")
def _(raw):
    return (snapshots.dedupe_snapshot(raw, _ARCHIVE_ORDER)
            .select("product_id", "snapshot_date", "market_price"))


@query("keep_tracked", "raw_prices", "ids", sql="""
SELECT product_id, count(*) AS price_rows, CAST(sum(market_price) AS DOUBLE) AS price_sum
FROM raw_prices WHERE product_id IN (SELECT product_id FROM ids) GROUP BY product_id""")
def _(raw, ids):
    return snapshots.keep_tracked(raw, ids).groupBy("product_id").agg(
        F.count("*").alias("price_rows"), F.sum("market_price").alias("price_sum"))


@query("snapshot_stats", "raw_prices", sql=f"""
SELECT {_day('snapshot_date')} AS snapshot_date, count(*) AS total_rows, count(market_price) AS valid_rows,
 CAST(sum(market_price) AS DOUBLE)/count(market_price) AS mean_price, median(CAST(market_price AS DOUBLE)) AS median_price,
 CAST(min(market_price) AS DOUBLE) AS min_price, CAST(max(market_price) AS DOUBLE) AS max_price,
 count(DISTINCT set_code) AS sets_found
FROM raw_prices GROUP BY raw_prices.snapshot_date""")
def _(raw):
    return snapshots.snapshot_stats(raw)


@query("missing_snapshot_dates", "pr", sql=f"""
SELECT {_day('d')} AS snapshot_date
FROM (SELECT unnest(range(DATE '1995-01-01', DATE '2002-01-01', INTERVAL 1 DAY)) AS d) x
WHERE CAST(d AS DATE) NOT IN (SELECT snapshot_date FROM pr)""")
def _(pr):
    return snapshots.missing_snapshot_dates(pr, date(1995, 1, 1), TODAY)


@query("skip_existing", "pr", "tx", sql=f"""
SELECT product_id, {_day('transaction_date')} AS snapshot_date, CAST(price_per_unit AS DOUBLE) AS market_price
FROM tx WHERE transaction_date NOT IN (SELECT snapshot_date FROM pr)""")
def _(pr, tx):
    quotes = tx.select("product_id", F.col("transaction_date").alias("snapshot_date"),
                       F.col("price_per_unit").alias("market_price"))
    return snapshots.skip_existing(quotes, pr)


# --- Ledger changes -------------------------------------------------------------------

@query("clamp_to_earliest", "ledger", "products", sql=f"""
SELECT l.transaction_id, l.product_id, {_day('l.input_date')} AS input_date,
 {_day('CASE WHEN p.earliest_date > l.input_date THEN p.earliest_date ELSE l.input_date END')} AS transaction_date,
 coalesce(p.earliest_date > l.input_date, FALSE) AS date_adjusted
FROM ledger l LEFT JOIN products p ON p.product_id=l.product_id""")
def _(ledger, products):
    entries = ledger.select("transaction_id", "product_id", "input_date")
    return changes.clamp_to_earliest(entries, products)


@query("unknown_products", "changes", "products", sql="""
SELECT seq, product_id FROM changes WHERE product_id NOT IN (SELECT product_id FROM products)""")
def _(batch, products):
    return catalogue.unknown_products(batch, products).select("seq", "product_id")


@query("oversell_flags", "ledger", sql="""
SELECT l.transaction_id, l.product_id, l.transaction_type, l.quantity*2 AS quantity, l.transaction_type='BUY'
 OR (SELECT coalesce(sum(o.signed),0) FROM typed o WHERE o.product_id=l.product_id
   AND o.transaction_id<>l.transaction_id) >= l.quantity*2 AS has_stock
FROM ledger l""")
def _(ledger):
    doubled = ledger.select("transaction_id", "product_id", "transaction_type", (F.col("quantity") * 2).alias("quantity"))
    return changes.oversell_flags(doubled, ledger)


@query("validate_entries", "changes", "products", "ledger", often=("earliest", "ledger"), sql="""
SELECT seq, product_id, transaction_type, quantity, reason FROM checked""")
def _(batch, products, ledger):
    inserts = batch.filter(F.col("op") == "INSERT")
    return (changes.validate_entries(inserts, products, ledger)
            .select("seq", "product_id", "transaction_type", "quantity", "reason"))


@query("change_outcomes", "changes", "products", "ledger", often=("earliest", "ledger"), columns={"ledger": (
    "transaction_id", "product_id", "transaction_type", "quantity", "price_per_unit", "input_date", "notes", "purchase_method",
    "purchase_location")}, sql="""
SELECT s.seq, s.op, s.id AS transaction_id, w.reason FROM steps s JOIN batch_walk w ON w.seq=s.seq
UNION ALL SELECT seq, op, transaction_id, 'not_found' FROM changes WHERE seq NOT IN (SELECT seq FROM steps)""")
def _(batch, products, ledger):
    return changes.change_outcomes(ledger, batch, products)


_SHOWN = f"""product_id, product_name, transaction_type, quantity, CAST(price_per_unit AS DOUBLE) AS price_per_unit,
 CAST(total_amount AS DOUBLE) AS total_amount, {_day('transaction_date')} AS transaction_date,
 {_day('input_date')} AS input_date, date_adjusted, notes, purchase_method, purchase_location,
 strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at"""


@query("apply_changes", "changes", "products", "ledger", often=("earliest", "ledger"), sql=f"""
, ends AS (SELECT lane, arg_max(rows, n) AS rows FROM batch_walk GROUP BY lane),
edited AS (SELECT e.key AS id, e.value AS v FROM (SELECT unnest(map_entries(rows)) AS e FROM ends) u),
result AS (
 SELECT * FROM ledger WHERE transaction_id NOT IN (SELECT id FROM edited)
 UNION ALL BY NAME SELECT l.transaction_id, l.product_id, l.product_name, l.transaction_type, v.q AS quantity,
  v.price AS price_per_unit, v.total AS total_amount, v.day AS transaction_date, v.input AS input_date,
  v.adjusted AS date_adjusted, v.notes AS notes, v.method AS purchase_method, v.location AS purchase_location, l.created_at
 FROM ledger l JOIN edited d ON d.id=l.transaction_id WHERE NOT v.gone
 UNION ALL BY NAME SELECT (SELECT max(transaction_id) FROM ledger) + row_number() OVER (ORDER BY s.seq) AS transaction_id,
  product_id, name AS product_name, kind AS transaction_type, quantity,
  CASE WHEN kind<>'OPEN' THEN price END AS price_per_unit,
  CASE WHEN kind<>'OPEN' THEN CAST(quantity*price AS DECIMAL(18,2)) END AS total_amount,
  CASE WHEN earliest_date > input_date THEN earliest_date ELSE input_date END AS transaction_date, input_date,
  coalesce(earliest_date > input_date, FALSE) AS date_adjusted, coalesce(notes, '') AS notes,
  CASE WHEN kind='BUY' THEN purchase_method END AS purchase_method,
  CASE WHEN kind='BUY' THEN purchase_location END AS purchase_location,
  TIMESTAMP '{ENTERED_AT}' AS created_at
 FROM steps s JOIN batch_walk w ON w.seq=s.seq WHERE s.op='INSERT' AND w.reason IS NULL)
SELECT transaction_id, {_SHOWN} FROM result""")
def _(batch, products, ledger):
    return changes.apply_changes(ledger, batch, products, ENTERED_AT)


@query("admit_sequential", "changes", "products", "ledger", often=("earliest", "ledger"), sql="""
, others AS (SELECT c.*, coalesce(h.current_quantity, 0) AS stock,
  row_number() OVER (PARTITION BY c.product_id ORDER BY c.seq) AS n,
  -- A purchase adds and a sale takes only when no other rule refuses it.
  CASE WHEN transaction_type='BUY' AND c.reason IS NULL THEN quantity ELSE 0 END AS came,
  CASE WHEN transaction_type IN ('SELL','OPEN') AND (transaction_type='OPEN' OR price_per_unit IS NOT NULL)
   AND coalesce(c.reason,'insufficient_stock')='insufficient_stock' THEN quantity ELSE 0 END AS goes,
  transaction_type IN ('SELL','OPEN') AND coalesce(c.reason,'') NOT IN ('missing_field','unknown_product','unknown_type') AS asks
 FROM checked c LEFT JOIN on_hand h ON h.product_id=c.product_id),
walk AS (
 SELECT product_id, n, seq, NOT asks OR stock >= quantity AS fits,
  stock + came - CASE WHEN stock >= quantity THEN goes ELSE 0 END AS stock FROM others WHERE n=1
 UNION ALL SELECT o.product_id, o.n, o.seq, NOT o.asks OR w.stock >= o.quantity,
  w.stock + o.came - CASE WHEN w.stock >= o.quantity THEN o.goes ELSE 0 END
 FROM walk w JOIN others o ON o.product_id=w.product_id AND o.n=w.n+1)
SELECT o.seq, o.product_id, o.transaction_type, o.quantity, CASE WHEN NOT w.fits THEN 'insufficient_stock'
 WHEN o.reason='insufficient_stock' THEN CASE WHEN o.transaction_type='SELL' AND o.price_per_unit IS NULL
  THEN 'missing_price' END ELSE o.reason END AS reason
FROM others o JOIN walk w ON w.seq=o.seq""")
def _(batch, products, ledger):
    inserts = batch.filter(F.col("op") == "INSERT")
    return (changes.validate_entries(inserts, products, ledger, sequential=True)
            .select("seq", "product_id", "transaction_type", "quantity", "reason"))


# --- Search ---------------------------------------------------------------------------

@query("search_words", "phrases", "named", sql="""
, texts AS (SELECT text, arg_min(product_id, id) AS product_id, min(id) AS id FROM
  (SELECT trim(concat_ws(' ', name, clean_name)) AS text, product_id, CAST(product_id AS BIGINT) AS id FROM named) t
  GROUP BY text),
asked AS (SELECT query_id, trim(lower(query)) AS query FROM phrases),
pairs AS (SELECT query_id, product_id, id, contains(lower(text), query) AS whole,
  len(list_filter(string_split_regex(query, '\\s+'), lambda w: contains(lower(text), w))) AS hits,
  len(string_split_regex(query, '\\s+')) AS n FROM asked, texts),
rated AS (SELECT query_id, product_id, id, CASE WHEN whole THEN 100.0 ELSE CAST(hits AS DOUBLE)/n*90.0 END AS score,
  greatest(CASE WHEN whole THEN 100.0*CAST(1.2 AS DOUBLE) ELSE 0 END, CAST(hits AS DOUBLE)/n*90.0) AS weighted_score
  FROM pairs WHERE whole OR CAST(hits AS DOUBLE)/n*90.0 > 25),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weighted_score DESC, score DESC, id) AS place FROM rated)
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(place AS INT) AS place, product_id, CAST(floor(score) AS INT) AS score,
 CAST(weighted_score AS DOUBLE) AS weighted_score, name
FROM placed JOIN named USING (product_id) WHERE place <= 10""")
def _(phrases, named):
    return (search.search_products(phrases, named, limit=10, fuzzy=False)
            .select("query_id", "place", "product_id", "score", "weighted_score", "name"))


# Every query against every text: similarities from the longest common subsequence, found bit by bit
# (one bit per character of ``a``) for all different pairs of strings that a score needs.
@query("search_fuzzy", "phrases", "named", sql=r"""
, texts AS MATERIALIZED (SELECT text, arg_min(product_id, id) AS product_id, min(id) AS id FROM
  (SELECT trim(concat_ws(' ', name, clean_name)) AS text, product_id, CAST(product_id AS BIGINT) AS id FROM named) t
  GROUP BY text),
asked AS MATERIALIZED (SELECT query_id, trim(lower(query)) AS query FROM phrases WHERE trim(query) != ''),
shaped AS MATERIALIZED (SELECT s, trim(regexp_replace(s, '[^\p{L}\p{N}_]', ' ', 'g')) AS plain,
  list_sort(list_filter(string_split_regex(regexp_replace(regexp_replace(s, '[^\x00-\x7F]', '', 'g'), '[^\p{L}\p{N}_]', ' ', 'g'), '\s+'),
   lambda w: w != '')) AS words
  FROM (SELECT query AS s FROM asked UNION SELECT lower(text) FROM texts) u),
q AS MATERIALIZED (SELECT DISTINCT query, plain, words, list_sort(list_distinct(words)) AS uniq FROM asked JOIN shaped ON s = query),
t AS MATERIALIZED (SELECT id, product_id, plain, words, list_sort(list_distinct(words)) AS uniq FROM texts JOIN shaped ON s = lower(text)),
slid AS MATERIALIZED (SELECT DISTINCT q.plain AS qp, t.plain AS tp, length(q.plain) <= length(t.plain) AS over_text
  FROM q, t WHERE q.plain != '' AND t.plain != ''
  UNION SELECT DISTINCT q.plain, t.plain, FALSE FROM q, t WHERE length(q.plain) = length(t.plain) AND q.plain != ''),
cut AS MATERIALIZED (SELECT DISTINCT m, long, substr(long, greatest(e - m, 0) + 1, least(e, length(long)) - greatest(e - m, 0)) AS piece
  FROM (SELECT DISTINCT CASE WHEN over_text THEN tp ELSE qp END AS long, CASE WHEN over_text THEN length(qp) ELSE length(tp) END AS m FROM slid) l,
   unnest(range(1, length(long) + m)) AS u(e)),
sets AS MATERIALIZED (SELECT query, id, length(common_words) AS n, concat_ws(' ', nullif(common_words, ''), nullif(left_, '')) AS a,
   concat_ws(' ', nullif(common_words, ''), nullif(right_, '')) AS b, common_words != '' AND (left_ = '' OR right_ = '') AS inside
  FROM (SELECT query, id, array_to_string(list_sort(list_intersect(q.uniq, t.uniq)), ' ') AS common_words,
    array_to_string(list_filter(q.uniq, lambda w: NOT list_contains(t.uniq, w)), ' ') AS left_,
    array_to_string(list_filter(t.uniq, lambda w: NOT list_contains(q.uniq, w)), ' ') AS right_
   FROM q, t WHERE len(q.uniq) > 0 AND len(t.uniq) > 0) x),
orders AS MATERIALIZED (SELECT query, id, array_to_string(q.words, ' ') AS a, array_to_string(t.words, ' ') AS b
  FROM q, t WHERE len(q.words) > 0 AND len(t.words) > 0),
need AS MATERIALIZED (SELECT a, b FROM sets UNION SELECT a, b FROM orders
  UNION SELECT CASE WHEN over_text THEN qp ELSE tp END, piece FROM slid JOIN cut ON m = least(length(qp), length(tp))
   AND long = CASE WHEN over_text THEN tp ELSE qp END),
bits AS MATERIALIZED (SELECT a, map_from_entries(list((c, b))) AS pos FROM
  (SELECT a, c, sum(1::HUGEINT << (i - 1)) AS b FROM
   (SELECT a, unnest(string_split(a, '')) AS c, unnest(range(1, length(a) + 1)) AS i FROM (SELECT DISTINCT a FROM need) d) e GROUP BY a, c) f GROUP BY a),
lcs AS MATERIALIZED (SELECT need.a, b, length(need.a) - bit_count(list_reduce(list_prepend((1::HUGEINT << length(need.a)) - 1,
   list_transform(string_split(b, ''), lambda c: CAST(coalesce(pos[c], 0) AS HUGEINT))),
   lambda r, h: ((r + (r & h)) | (r - (r & h))) & ((1::HUGEINT << length(need.a)) - 1))) AS common FROM need JOIN bits ON bits.a = need.a),
likeness AS (SELECT query, id, 'token_sort' AS scorer, 200.0::DOUBLE * common / (length(a) + length(b)) AS score FROM orders JOIN lcs USING (a, b)
  UNION ALL SELECT query, id, 'token_set', CASE WHEN inside THEN 100.0::DOUBLE ELSE greatest(200.0::DOUBLE * common / (length(a) + length(b)),
    CASE WHEN n > 0 THEN 200.0::DOUBLE * n / (n + least(length(a), length(b))) ELSE 0 END) END FROM sets JOIN lcs USING (a, b)
  UNION ALL SELECT query, id, 'partial', score FROM (SELECT qp, tp, max(200.0::DOUBLE * common / (length(lcs.a) + length(piece))) AS score
    FROM slid JOIN cut ON m = least(length(qp), length(tp)) AND long = CASE WHEN over_text THEN tp ELSE qp END
    JOIN lcs ON lcs.a = CASE WHEN over_text THEN qp ELSE tp END AND lcs.b = piece GROUP BY qp, tp) p
   JOIN q ON q.plain = qp JOIN t ON t.plain = tp),
pool AS (SELECT query, id, scorer, round_even(score, 0) AS score FROM likeness WHERE score >= 25.5
  QUALIFY row_number() OVER (PARTITION BY query, scorer ORDER BY score DESC, id) <= 30),
direct AS (SELECT query, id, contains(lower(text), query) AS whole,
  CAST(len(list_filter(string_split_regex(query, '\s+'), lambda w: contains(lower(text), w))) AS DOUBLE) / len(string_split_regex(query, '\s+')) * 90.0 AS score
  FROM (SELECT DISTINCT query FROM asked) a, texts),
rated AS (SELECT query, id, max(score) AS score, max(score * weight) AS weighted_score FROM
  (SELECT query, id, score, CASE scorer WHEN 'partial' THEN 0.9::DOUBLE WHEN 'token_sort' THEN 0.8::DOUBLE ELSE 0.7::DOUBLE END AS weight FROM pool
   UNION ALL SELECT query, id, score, 1.0::DOUBLE FROM direct UNION ALL SELECT query, id, 100.0, 1.2::DOUBLE FROM direct WHERE whole) r
  WHERE score > 25 GROUP BY query, id),
placed AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY weighted_score DESC, score DESC, id) AS place FROM rated)
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(place AS INT) AS place, product_id, CAST(floor(score) AS INT) AS score,
 weighted_score, name
FROM placed JOIN asked USING (query) JOIN texts USING (id) JOIN named USING (product_id) WHERE place <= 10""")
def _(phrases, named):
    return (search.search_products(phrases, named, limit=10)
            .select("query_id", "place", "product_id", "score", "weighted_score", "name"))
