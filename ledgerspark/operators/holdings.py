"""Stock and cost per product."""

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.cleaning import (cents_as_double, effective_cents, from_cents, ratio, round_price,
                                            signed_quantity, unit_cents)
from ledgerspark.schemas import BUY, OPEN, SELL


MEASURES = ("bought", "sold", "opened", "buy_amount", "sell_amount", "buy_cost")


def _measured_rows(ledger: DataFrame, *others: str) -> DataFrame:
    """Ledger rows with one bigint column per measure; money in cents, 0 where a row does
    not count. A missing amount counts as 0."""
    kind = F.col("kind")
    rows = ledger.select("product_id", "transaction_date", *others, F.col("transaction_type").alias("kind"), "quantity",
                         effective_cents().alias("amount"), unit_cents().alias("unit"))

    def of(wanted: str, column: str):
        return F.when((kind == wanted) & F.col(column).isNotNull(), F.col(column)).otherwise(F.lit(0).cast("bigint"))
    return rows.select("product_id", "transaction_date", *others,
                       of(BUY, "quantity").alias("bought"), of(SELL, "quantity").alias("sold"),
                       of(OPEN, "quantity").alias("opened"), of(BUY, "amount").alias("buy_amount"),
                       of(SELL, "amount").alias("sell_amount"), of(BUY, "unit").alias("buy_cost"))


def _sums() -> list:
    return [F.sum(name).alias(name) for name in MEASURES]


def daily_ledger(ledger: DataFrame) -> DataFrame:
    """One row per product and transaction date with the measures summed, money in cents.

    Plain sums combine on the map side, so a product that owns a third of the ledger still
    shuffles as a few rows per task and day. The result has at most one row per product
    and day, which bounds every per-product window built on top of it.
    """
    return _measured_rows(ledger).groupBy("product_id", "transaction_date").agg(*_sums())


def on_hand(ledger: DataFrame, exclude_id: int | None = None) -> DataFrame:
    """Bought - sold - opened per product over all dates, future ones included."""
    if exclude_id is not None:
        ledger = ledger.filter(F.col("transaction_id") != exclude_id)
    quantity = F.coalesce(F.sum(signed_quantity()), F.lit(0).cast("bigint"))
    return ledger.groupBy("product_id").agg(quantity.alias("current_quantity"))


def holdings_at(ledger: DataFrame, as_of: date) -> DataFrame:
    """Quantities and cost per product from the rows dated up to ``as_of``.

    The name comes from the earliest row, the id settling ties. Cost basis is what was
    paid minus what was received; OPEN lowers the stock but not the cost.
    """
    order = F.struct("transaction_date", "created_at", "transaction_id")
    rows = _measured_rows(ledger.filter(F.col("transaction_date") <= F.lit(as_of)),
                          "product_name", "created_at", "transaction_id")
    totals = rows.groupBy("product_id").agg(F.min_by("product_name", order).alias("product_name"), *_sums())
    return totals.select(
        "product_id", "product_name",
        F.col("bought").alias("total_bought"),
        F.col("sold").alias("total_sold"),
        F.col("opened").alias("total_opened"),
        (F.col("bought") - F.col("sold") - F.col("opened")).alias("sealed_quantity"),
        (F.col("bought") - F.col("sold")).alias("cost_basis_quantity"),
        from_cents(F.col("buy_amount") - F.col("sell_amount")).alias("total_cost_basis"),
        round_price(ratio(cents_as_double(F.col("buy_cost")), F.col("bought"))).alias("average_cost_per_unit"),
    )


def current_holdings(ledger: DataFrame, as_of: date) -> DataFrame:
    """The holdings table: sold-out and oversold products stay in it."""
    return holdings_at(ledger, as_of).select(
        "product_id", "product_name",
        F.col("total_bought").alias("total_quantity_bought"),
        F.col("total_sold").alias("total_quantity_sold"),
        F.col("total_opened").alias("total_quantity_opened"),
        F.col("sealed_quantity").alias("current_quantity"),
        "total_cost_basis", "average_cost_per_unit",
        F.lit(as_of).alias("last_updated"),
    )


def active_holdings(holdings: DataFrame) -> DataFrame:
    """Products still in stock."""
    return holdings.filter(F.col("current_quantity") > 0)


def product_detail(products: DataFrame, ledger: DataFrame) -> DataFrame:
    """Catalogue rows with the quantity on hand, 0 where nothing was ever traded."""
    return (products.join(on_hand(ledger), "product_id", "left")
            .select("product_id", "name", "clean_name", "earliest_date",
                    F.coalesce("current_quantity", F.lit(0)).alias("current_quantity")))
