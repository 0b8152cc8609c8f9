"""Read-side reports over holdings, the daily series, snapshots and the ledger."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.cleaning import round_price
from ledgerspark.operators.holdings import active_holdings
from ledgerspark.schemas import MONEY, PRICE, QUANTITY


def portfolio_summary(holdings: DataFrame, daily: DataFrame, cost_source: str = "daily") -> DataFrame:
    """One row of headline figures.

    Counts cover products in stock. ``cost_source="daily"`` takes the cost from the
    newest day, which includes sold-out products, and falls back on the holdings when
    there is no day; ``"holdings"`` always sums the products in stock.
    """
    if cost_source not in ("daily", "holdings"):
        raise ValueError(f"unknown cost source: {cost_source}")
    zero = F.lit(0).cast(MONEY)
    newest = daily.agg(F.max_by(F.struct("total_cost_basis", "total_market_value", "unrealized_pnl",
                                         "cumulative_realized_pnl"), "date")).scalar()
    stock = active_holdings(holdings).agg(
        F.count("*").alias("total_products"),
        F.coalesce(F.sum("current_quantity"), F.lit(0)).alias("total_quantity"),
        F.coalesce(F.sum("total_cost_basis"), zero).alias("held_cost")).withColumn("newest", newest)
    cost = F.col("held_cost")
    if cost_source == "daily":
        cost = F.coalesce(F.col("newest.total_cost_basis"), cost)
    return stock.select(
        "total_products", "total_quantity", cost.alias("total_cost_basis"),
        F.coalesce("newest.total_market_value", zero).alias("current_market_value"),
        F.coalesce("newest.unrealized_pnl", zero).alias("unrealized_pnl"),
        F.coalesce("newest.cumulative_realized_pnl", zero).alias("cumulative_realized_pnl"))


def portfolio_return(summary: DataFrame) -> DataFrame:
    """Unrealized profit in percent of the cost; null without a positive cost."""
    percent = F.col("unrealized_pnl").cast("double") / F.col("total_cost_basis").cast("double") * 100
    return summary.select(
        "total_cost_basis", "unrealized_pnl",
        F.when(F.col("total_cost_basis") > 0, round_price(percent)).alias("return_percent"))


def newest_snapshot(snapshots: DataFrame) -> DataFrame:
    """Rows of the newest snapshot day. On a table partitioned by day the subquery prunes
    the scan to that one partition."""
    return snapshots.filter(F.col("snapshot_date") == snapshots.agg(F.max("snapshot_date")).scalar())


def value_holdings(holdings: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Products in stock at the prices of the newest snapshot; no price there counts as 0.
    Ordered by name."""
    prices = newest_snapshot(snapshots).select("product_id", round_price(F.col("market_price")).alias("price"))
    price = F.coalesce(F.col("price"), F.lit(0).cast(MONEY))
    return (active_holdings(holdings).join(prices, "product_id", "left")
            .select("product_id", "product_name", "current_quantity", "average_cost_per_unit", "total_cost_basis",
                    price.alias("current_price_per_unit"),
                    round_price(F.col("current_quantity").cast(QUANTITY) * price).alias("total_current_value"))
            .orderBy("product_name", "product_id"))


def chart_series(daily: DataFrame) -> DataFrame:
    """Market value and cost per day, ready to plot: text dates, gaps as 0, oldest first."""
    zero = F.lit(0).cast(PRICE)
    return (daily.select(F.date_format("date", "yyyy-MM-dd").alias("date"),
                         F.coalesce("total_market_value", zero).cast("double").alias("market_value"),
                         F.coalesce("total_cost_basis", zero).cast("double").alias("cost_basis"))
            .orderBy("date"))


def ledger_view(ledger: DataFrame) -> DataFrame:
    """The columns a reader of the ledger sees, with notes and the adjusted mark filled in."""
    return ledger.select(
        "transaction_id", "transaction_date", "product_name", "transaction_type", "quantity",
        round_price(F.col("price_per_unit")).alias("price_per_unit"),
        round_price(F.col("total_amount")).alias("total_amount"),
        F.coalesce("notes", F.lit("")).alias("notes"), "purchase_method", "purchase_location",
        F.coalesce("date_adjusted", F.lit(False)).alias("date_adjusted"))


def ledger_history(ledger: DataFrame, transaction_type: str | None = None) -> DataFrame:
    """The ledger newest first, of one type or (``None``, ``""`` or ``"All"``) whole."""
    if transaction_type and transaction_type != "All":
        ledger = ledger.filter(F.col("transaction_type") == transaction_type)
    newest_first = [F.col(c).desc() for c in ("transaction_date", "created_at", "transaction_id")]
    return ledger_view(ledger.orderBy(*newest_first))
