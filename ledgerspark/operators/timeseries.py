"""Cost, price and value of a portfolio over time.

Nothing here builds products x days rows unless the caller asks for the dense cost
history. The daily value series works on change points: one window per product turns
ledger days and price days into changes of value, which are then summed per day. A
window never sees more than two rows per product and calendar day (one ledger row,
one price row), however many raw rows a product has.
"""

from datetime import date
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions.cleaning import (cents_as_double, from_cents, ratio, round_price, signed_quantity,
                                            to_millionths)
from ledgerspark.operators.holdings import MEASURES, daily_ledger
from ledgerspark.schemas import PRICE, PROFIT

def _through_today(*keys: str, order: str):
    """Everything up to and including the current date, all rows of that date included."""
    return (Window.partitionBy(*keys).orderBy(order)
            .rangeBetween(Window.unboundedPreceding, Window.currentRow))


def ledger_bounds(ledger: DataFrame) -> DataFrame:
    """First and last transaction date, one row."""
    return ledger.agg(F.min("transaction_date").alias("first_date"),
                      F.max("transaction_date").alias("last_date"))


def _first_date(ledger: DataFrame) -> Column:
    return ledger.agg(F.min("transaction_date")).scalar()


def transaction_dates(ledger: DataFrame) -> DataFrame:
    return ledger.select(F.col("transaction_date").alias("date")).distinct()


def valuation_calendar(snapshots: DataFrame, ledger: DataFrame, as_of: date) -> DataFrame:
    """Days to value: snapshot days, transaction days and ``as_of``, from the first
    transaction on. Ascending order is left to the reader."""
    today = ledger.sparkSession.range(1).select(F.lit(as_of).alias("date"))
    days = (snapshots.select(F.col("snapshot_date").alias("date"))
            .union(ledger.select("transaction_date"))
            .union(today))
    return days.filter(F.col("date") >= _first_date(ledger)).distinct()


def _average_cost(buy_cost: Column, bought: Column) -> Column:
    return ratio(cents_as_double(buy_cost), bought)


def _cumulative(daily: DataFrame) -> DataFrame:
    window = _through_today("product_id", order="transaction_date")
    return daily.select("product_id", "transaction_date",
                        *[F.sum(name).over(window).alias(name) for name in MEASURES])


def _cost_columns() -> list[Column]:
    """The cost-history columns out of running totals."""
    return [
        from_cents(F.col("buy_amount")).alias("cumulative_buy_amt"),
        from_cents(F.col("sell_amount")).alias("cumulative_sell_amt"),
        from_cents(F.col("buy_amount") - F.col("sell_amount")).alias("cumulative_cost_basis"),
        (F.col("bought") - F.col("sold") - F.col("opened")).alias("sealed_quantity"),
        (F.col("bought") - F.col("sold")).alias("cost_basis_quantity"),
        round_price(_average_cost(F.col("buy_cost"), F.col("bought"))).alias("average_cost_per_unit"),
        # Amounts are whole cents, so the rounded cost is the cost itself.
        from_cents(F.col("buy_amount") - F.col("sell_amount")).alias("total_cost_basis"),
    ]


def cost_history(ledger: DataFrame) -> DataFrame:
    """Running cost per product on the days it traded (the sparse form)."""
    return _cumulative(daily_ledger(ledger)).select(
        "product_id", F.col("transaction_date").alias("date"), *_cost_columns())


def densify(history: DataFrame, calendar: DataFrame, start: date | None = None,
            end: date | None = None) -> DataFrame:
    """Repeat each (product_id, date) row on every calendar day until the product's next row.

    A history date that is no calendar day is an error. Days are numbered, so each row expands
    into the run of day numbers it covers and no product is paired with a day it does
    not need. The calendar has one row per day (36,525 rows for a century), which is
    what makes broadcasting it safe. ``start`` and ``end`` limit the days produced.
    """
    numbered = calendar.select("date", F.row_number().over(Window.orderBy("date")).alias("day_no"))
    wanted = numbered.filter(
        (F.lit(True) if start is None else F.col("date") >= F.lit(start))
        & (F.lit(True) if end is None else F.col("date") <= F.lit(end)))
    span = wanted.agg(F.struct(F.min("day_no").alias("lo"), F.max("day_no").alias("hi"))).scalar()
    following = F.lead("day_no").over(Window.partitionBy("product_id").orderBy("day_no"))
    unknown = F.raise_error(F.concat(F.lit("not a calendar day: "), F.col("date").cast("string"))).cast("int")
    runs = (history.join(F.broadcast(numbered), "date", "left")
            .withColumn("day_no", F.coalesce("day_no", unknown))
            .withColumn("span", span)
            .withColumn("first_no", F.greatest("day_no", F.col("span.lo")))
            .withColumn("last_no", F.least(F.coalesce(following - 1, F.col("span.hi")), F.col("span.hi")))
            .filter(F.col("first_no") <= F.col("last_no")))
    days = runs.drop("date", "day_no", "span").withColumn(
        "day_no", F.explode(F.sequence("first_no", "last_no")))
    return (days.join(F.broadcast(wanted), "day_no")
            .select("product_id", "date", *[c for c in history.columns if c not in ("product_id", "date")]))


def dense_cost_history(ledger: DataFrame, calendar: DataFrame, start: date | None = None,
                       end: date | None = None) -> DataFrame:
    """One row per product and calendar day from the product's first transaction on."""
    return densify(cost_history(ledger), calendar, start, end)


def running_avg_cost(ledger: DataFrame) -> DataFrame:
    """Mean unit price of everything bought so far; sales never change it. Purchases made
    on the same day count."""
    return _cumulative(daily_ledger(ledger)).select(
        "product_id", F.col("transaction_date").alias("date"),
        F.col("bought").alias("quantity_bought"),
        _average_cost(F.col("buy_cost"), F.col("bought")).alias("average_cost"))


def _profit(sell_amount: Column, sold: Column, average_cost: Column) -> Column:
    """Profit of one product's sales on one day, fixed to six places before it is summed
    so that the total does not depend on task order."""
    return (cents_as_double(sell_amount) - sold.cast("double") * average_cost).cast(PROFIT)


def realized_pnl(ledger: DataFrame) -> DataFrame:
    """Profit of each day's sales against the average cost of the day, and its running total.

    A day's sales of one product share one average cost, so the profit is worked out on
    the product-day totals and nothing is joined back to the single sales.
    """
    window = _through_today("product_id", order="transaction_date")
    average = _average_cost(F.sum("buy_cost").over(window), F.sum("bought").over(window))
    by_product = (daily_ledger(ledger)
                  .withColumn("average_cost", average)
                  .filter(F.col("sold") != 0)
                  .withColumn("profit", _profit(F.col("sell_amount"), F.col("sold"), F.col("average_cost"))))
    by_day = by_product.groupBy(F.col("transaction_date").alias("date")).agg(F.sum("profit").alias("profit"))
    # One row per day that saw a sale: small enough for a single ordered window.
    total = F.sum("profit").over(Window.orderBy("date"))
    return by_day.select("date", round_price(F.col("profit")).alias("realized_pnl"),
                         round_price(total).alias("cumulative_realized_pnl"))


def asof_price(requests: DataFrame, prices: DataFrame, not_before: Column | date | None = None) -> DataFrame:
    """Latest known price at or before each (product_id, date), with the day it is from.

    ``prices`` holds one row per product and snapshot date. Requests are reduced to
    distinct (product, date) pairs before the window, so repeated requests for one
    product cost one row per day; they meet their price again in an equi-join, which
    AQE splits when a single pair is requested very often.
    """
    known = prices.filter(F.col("market_price").isNotNull())
    if not_before is not None:
        bound = not_before if isinstance(not_before, Column) else F.lit(not_before)
        known = known.filter(F.col("snapshot_date") >= bound)
    asked = requests.select("product_id", "date").distinct()
    points = (asked.withColumn("quote", F.lit(None).cast("struct<price_date:date,price:decimal(18,6)>"))
              .withColumn("asked", F.lit(True))
              .union(known.select("product_id", F.col("snapshot_date").alias("date"),
                                  F.struct(F.col("snapshot_date").alias("price_date"),
                                           F.col("market_price").cast(PRICE).alias("price")).alias("quote"),
                                  F.lit(False).alias("asked"))))
    window = _through_today("product_id", order="date")
    answers = (points.withColumn("quote", F.last("quote", ignorenulls=True).over(window))
               .filter("asked")
               .select("product_id", "date", F.col("quote.price").alias("market_price"),
                       F.col("quote.price_date").alias("price_date")))
    return requests.join(answers, ["product_id", "date"], "left")


def exact_price(requests: DataFrame, prices: DataFrame) -> DataFrame:
    """Price on the very day of each (product_id, date), null where there is none."""
    quotes = prices.select("product_id", F.col("snapshot_date").alias("date"),
                           F.col("market_price").cast(PRICE).alias("market_price"))
    return requests.join(quotes, ["product_id", "date"], "left")


def _change_points(ledger: DataFrame, snapshots: DataFrame, since: Column) -> DataFrame:
    """Ledger days and price days of every product, one shape, ready for one window. Ledger
    money is in cents, prices are in millionths. No price is from before ``since``."""
    daily = daily_ledger(ledger).select(
        "product_id", F.col("transaction_date").alias("date"), "bought", "sold", "buy_cost", "sell_amount",
        (F.col("bought") - F.col("sold") - F.col("opened")).alias("d_quantity"),
        (F.col("buy_amount") - F.col("sell_amount")).alias("d_basis"),
        F.lit(None).cast("bigint").alias("price"))
    none = [F.lit(0).cast("bigint").alias(c) for c in
            ("bought", "sold", "buy_cost", "sell_amount", "d_quantity", "d_basis")]
    # Days whose prices are all missing still belong to the calendar, so nulls stay in.
    quotes = (snapshots.filter(F.col("snapshot_date") >= since)
              .select("product_id", F.col("snapshot_date").alias("date"), *none,
                      to_millionths(F.col("market_price")).alias("price")))
    return daily.unionByName(quotes)


def product_changes(ledger: DataFrame, snapshots: DataFrame, since: Column) -> DataFrame:
    """Per product and day (one row for its trades, one for its price): how much its cost (cents), market
    value (millionths) and realized profit changed, and where it stands after that day: ``stock``,
    ``price`` (0 before the first one), ``bought`` and ``buy_cost`` so far.

    ``since`` is the first transaction date of the whole portfolio, which the ledger given here need not hold.
    """
    window = _through_today("product_id", order="date")
    previous = Window.partitionBy("product_id").orderBy("date")
    price = F.coalesce(F.last("price", ignorenulls=True).over(window), F.lit(0))
    states = _change_points(ledger, snapshots, since).select(
        "product_id", "date", "d_basis", "sold", "sell_amount",
        F.sum("d_quantity").over(window).alias("stock"), price.alias("price"),
        F.sum("buy_cost").over(window).alias("buy_cost"), F.sum("bought").over(window).alias("bought"))
    # Rows of one day carry the same value, so their order does not change the day's sum.
    profit = _profit(F.col("sell_amount"), F.col("sold"), _average_cost(F.col("buy_cost"), F.col("bought")))
    return (states.withColumn("value", stock_value(F.col("stock"), F.col("price")))
            .select("product_id", "date", "d_basis",
                    (F.col("value") - F.lag("value", 1, 0).over(previous)).alias("d_value"),
                    F.when(F.col("sold") != 0, profit).alias("profit"), "stock", "price", "bought", "buy_cost"))


def stock_value(stock: Column, price: Column) -> Column:
    """Oversold products are worth nothing."""
    return F.greatest(stock, F.lit(0)) * price


def summed_changes(moves: DataFrame, *keys: str) -> DataFrame:
    """The changes of all products together, per day or other keys."""
    # The value of all products together may outgrow a bigint of millionths.
    return moves.groupBy(*keys).agg(
        F.sum("d_basis").alias("d_basis"),
        F.sum(F.col("d_value").cast("decimal(28,0)")).alias("d_value"),
        F.coalesce(F.sum("profit"), F.lit(0).cast(PROFIT)).alias("profit"))


def daily_changes(ledger: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Per day: how much cost (cents), market value (millionths) and realized profit changed.

    One shuffle by product for the window, one small shuffle by day for the sums.
    """
    return summed_changes(product_changes(ledger, snapshots, _first_date(ledger)), "date")


def daily_portfolio_value(ledger: DataFrame, snapshots: DataFrame, as_of: date) -> DataFrame:
    """Cost, market value, unrealized and cumulative realized profit per calendar day.

    A product without a price on a day keeps its latest earlier one, but never one from
    before the first transaction of the whole ledger. Sale proceeds already lower the
    cost, so unrealized and realized profit overlap and must not be added up.
    ``snapshots`` holds one row per product and snapshot date.
    """
    return value_series(daily_changes(ledger, snapshots), as_of, _first_date(ledger))


def value_series(changes: DataFrame, as_of: date, since: Column) -> DataFrame:
    """Daily values out of daily changes (one or more rows per day); ``as_of`` is a day of its own
    if it is not before ``since``."""
    nothing = [F.lit(0).cast(f.dataType).alias(f.name) for f in changes.schema if f.name != "date"]
    today = (changes.sparkSession.range(1).select(F.lit(as_of).alias("date"), *nothing)
             .filter(F.col("date") >= since))
    days = changes.unionByName(today).groupBy("date").agg(*[
        F.sum(c).alias(c) for c in ("d_basis", "d_value", "profit")])
    # One row per calendar day: the only window without a key, and it stays small.
    window = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cost, value, profit = (F.sum(c).over(window) for c in ("d_basis", "d_value", "profit"))
    market = (value * F.lit(Decimal("0.000001"))).cast("decimal(32,6)")
    return days.select("date", from_cents(cost).alias("cost"), market.alias("market"), profit.alias("profit")).select(
        "date", F.col("cost").alias("total_cost_basis"),
        round_price(F.col("market")).alias("total_market_value"),
        unrealized_pnl(F.col("market"), F.col("cost")).alias("unrealized_pnl"),
        round_price(F.col("profit")).alias("cumulative_realized_pnl"))


def unrealized_pnl(market_value: Column, cost: Column) -> Column:
    """Market value minus cost, rounded after the subtraction."""
    return round_price(market_value - cost)


def daily_totals(history: DataFrame) -> DataFrame:
    """Per day: cost and stock summed over the products of a dense cost history."""
    return history.groupBy("date").agg(
        F.count("*").alias("products"),
        F.sum("total_cost_basis").alias("total_cost_basis"),
        F.sum("sealed_quantity").alias("sealed_quantity"),
        F.sum("average_cost_per_unit").alias("average_cost_sum"))


def latest_by_date(df: DataFrame, date_col: str = "date") -> DataFrame:
    """The newest row; Spark keeps one row per task and never sorts the whole table."""
    return df.orderBy(F.col(date_col).desc()).limit(1)


def price_staleness(ledger: DataFrame, snapshots: DataFrame, as_of: date) -> DataFrame:
    """How old the carried-forward prices are on the last calendar day.

    Looks at products in stock that have no price on that very day. One row, with a null
    date when no product fell back on an older price.
    """
    first = _first_date(ledger)
    moved = ledger.select(
        "product_id", F.col("transaction_date").alias("date"), F.lit(None).cast("date").alias("priced_on"),
        signed_quantity().alias("d_quantity"))
    quoted = (snapshots.filter(F.col("snapshot_date") >= first)
              .select("product_id", F.col("snapshot_date").alias("date"),
                      F.when(F.col("market_price").isNotNull(), F.col("snapshot_date")).alias("priced_on"),
                      F.lit(None).cast("bigint").alias("d_quantity")))
    per_product = moved.union(quoted).groupBy("product_id").agg(
        F.sum("d_quantity").alias("stock"), F.max("priced_on").alias("priced_on"), F.max("date").alias("last_seen"))
    last_day = F.greatest(F.max("last_seen"), F.lit(as_of))
    # Days without any fallback are told apart only after the last day is known, so the
    # products are first counted per price day: one small row per day.
    by_day = per_product.groupBy("priced_on").agg(
        F.max("last_seen").alias("last_seen"), F.count_if(F.col("stock") > 0).alias("in_stock"))
    end = by_day.select("*", F.max("last_seen").over(Window.partitionBy()).alias("newest"))
    return (end.agg(last_day.alias("last_day"),
                    F.max(F.when((F.col("in_stock") > 0)
                                 & (F.col("priced_on") < F.greatest("newest", F.lit(as_of))),
                                 F.col("priced_on"))).alias("latest_price_date"))
            .filter(F.col("last_day").isNotNull())
            .select("last_day", "latest_price_date",
                    F.date_diff(F.lit(as_of), "latest_price_date").alias("days_behind"),
                    F.coalesce(F.col("latest_price_date") < F.lit(as_of), F.lit(False)).alias("is_stale")))
