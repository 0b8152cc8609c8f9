"""Whole jobs put together from the operators."""

from datetime import date
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from ledgerspark.operators.catalogue import require_columns, sealed_catalogue
from ledgerspark.operators.holdings import current_holdings
from ledgerspark.operators.reports import portfolio_summary
from ledgerspark.operators.snapshots import snapshot_from_archive, snapshot_from_feed, snapshot_stats
from ledgerspark.operators.timeseries import cost_history, daily_portfolio_value
from ledgerspark.sources.archive import read_price_archive_json
from ledgerspark.sources.catalogue import read_id_list, read_products, write_id_list, write_products_csv
from ledgerspark.sources.feeds import read_price_feed_csv
from ledgerspark.sources.snapshots import read_snapshot_table, write_price_snapshot
from ledgerspark.sources.tables import read_ledger, read_table, replace_table


class Portfolio(NamedTuple):
    holdings: DataFrame
    cost_history: DataFrame
    daily: DataFrame
    summary: DataFrame


def rebuild(ledger: DataFrame, snapshots: DataFrame, as_of: date) -> Portfolio:
    """Everything that follows from the ledger and the snapshots, as lazy frames."""
    holdings = current_holdings(ledger, as_of)
    daily = daily_portfolio_value(ledger, snapshots, as_of)
    return Portfolio(holdings, cost_history(ledger), daily, portfolio_summary(holdings, daily))


def rebuild_tables(spark: SparkSession, ledger_root: str, snapshot_table: str, out: str, as_of: date) -> DataFrame:
    """Recompute and store the derived tables; returns the summary of what was stored."""
    built = rebuild(read_ledger(spark, ledger_root), read_snapshot_table(spark, snapshot_table), as_of)
    for name in ("holdings", "cost_history", "daily"):
        replace_table(getattr(built, name), f"{out}/{name}")
    return portfolio_summary(read_table(spark, f"{out}/holdings"), read_table(spark, f"{out}/daily"))


def discover_catalogue(spark: SparkSession, feed_glob: str, products_csv: str, id_list: str) -> DataFrame:
    """Landed feeds to catalogue CSV and id list; sets without the needed columns are left out."""
    catalogue = sealed_catalogue(require_columns(read_price_feed_csv(spark, feed_glob)))
    write_products_csv(catalogue, products_csv)
    write_id_list(catalogue, id_list)
    return catalogue


def collect_daily_prices(spark: SparkSession, feed_glob: str, products_csv: str, snapshot_table: str,
                         snapshot_date: date, force: bool = False) -> DataFrame:
    """Landed feeds to the snapshot of one day; returns the statistics of that day."""
    snapshot = snapshot_from_feed(read_price_feed_csv(spark, feed_glob), read_products(spark, products_csv),
                                  snapshot_date)
    write_price_snapshot(snapshot, snapshot_table, force)
    stored = read_snapshot_table(spark, snapshot_table)
    return snapshot_stats(stored.filter(stored.snapshot_date == snapshot_date))


def collect_and_rebuild(spark: SparkSession, feed_glob: str, products_csv: str, snapshot_table: str,
                        ledger_root: str, out: str, as_of: date, force: bool = False) -> DataFrame:
    """The day's prices collected, then every derived table stored anew; returns the summary."""
    collect_daily_prices(spark, feed_glob, products_csv, snapshot_table, as_of, force)
    return rebuild_tables(spark, ledger_root, snapshot_table, out, as_of)


def backfill_prices(spark: SparkSession, archive_root: str, id_list: str, snapshot_table: str) -> None:
    """Unpacked archives to snapshots; days that are stored already stay as they are and days
    without a tracked product are not stored."""
    rows = snapshot_from_archive(read_price_archive_json(spark, archive_root), read_id_list(spark, id_list),
                                 ["set_code", "position"])
    write_price_snapshot(rows, snapshot_table)
