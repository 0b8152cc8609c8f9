"""Cost history and daily values kept up to date without a rebuild.

Daily changes of value add up over products, so they are stored per bucket of products, along with where
each product stands. A batch of ledger changes works out the buckets of its products anew and reads no
others. Prices of later days than a product has seen go on from where it stands; earlier days, or days sent
again, make their buckets anew. A price that moves the first day of the whole portfolio, before which no price
counts, makes every bucket anew.

Every step can be run again after a failure: ledger rows replace rows with the same id, price rows are a log in
which the newest row of a product and day counts, and a bucket's state is replaced in one piece.
"""

from datetime import date
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerspark.functions.cleaning import to_millionths
from ledgerspark.functions.state import cut_lineage
from ledgerspark.operators.timeseries import (cost_history, product_changes, stock_value, summed_changes,
                                              value_series)
from ledgerspark.schemas import LEDGER
from ledgerspark.sources.tables import BucketTable

BUCKETS = 64

_PRICES = "product_id string, snapshot_date date, market_price double, sent long"
# A product's row says where it stands after ``date``; a row without product, what changed in the bucket on ``date``.
_STATE = ("product_id string, date date, since date, first_date date, stock long, price long, bought long, buy_cost long, "
          "d_basis long, d_value decimal(30,0), profit decimal(34,6)")


def _ddl(schema) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)


class PortfolioStore:
    """Ledger, prices, cost history and daily changes under ``root``, all in buckets by product.

    ``buckets`` is set once and for all; a bucket should hold some million rows at most. One writer
    at a time.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root, buckets

    def _table(self, name: str, schema: str) -> BucketTable:
        return BucketTable(self.spark, f"{self.root}/{name}", schema, ("product_id",), self.buckets)

    @cached_property
    def ledger(self) -> BucketTable:
        return self._table("ledger", _ddl(LEDGER))

    @cached_property
    def prices(self) -> BucketTable:
        return self._table("prices", _PRICES)

    @cached_property
    def state(self) -> BucketTable:
        return self._table("state", _STATE)

    @cached_property
    def history(self) -> BucketTable:
        return self._table("cost_history", _ddl(cost_history(self.ledger.read()).schema))

    def _products(self) -> DataFrame:
        return self.state.read().filter(F.col("product_id").isNotNull())

    def _since(self) -> date | None:
        """The first transaction date that the stored state counts prices from."""
        return self.state.read().agg(F.max("since")).first()[0]

    def apply_ledger(self, rows: DataFrame, deleted: DataFrame | None = None) -> list[int]:
        """Insert or replace ledger rows by transaction_id and take out ``deleted`` (product_id, transaction_id).

        A row's product never changes. Returns the buckets that were made anew.
        """
        touched = self.ledger.upsert(rows, ["transaction_id"], deleted)
        return self._remade(touched)

    def add_prices(self, snapshots: DataFrame, sent: int | Column) -> list[int]:
        """Take in price rows (one per product and day). ``sent``, a number or a column of ``snapshots``, orders what
        is taken in: of rows for the same product and day that with the highest counts. Returns the buckets that were made anew; the
        others went on from where their products stood.
        """
        rows = cut_lineage(snapshots.select("product_id", "snapshot_date", F.col("market_price").cast("double").alias("market_price"),
                                            (sent if isinstance(sent, Column) else F.lit(sent)).cast("bigint").alias("sent")))
        self.prices.append(rows)
        since = self._since()
        if since is None:  # without a ledger there is nothing to value
            return []
        counted = rows.filter(F.col("snapshot_date") >= F.lit(since))
        stands = self._products().select("product_id", "stock", "price", F.col("date").alias("last_date"))
        met = cut_lineage(counted.join(stands, "product_id", "left").withColumn("bucket", self.prices.bucket()))
        late = sorted(r[0] for r in met.filter("snapshot_date <= last_date").select("bucket").distinct().collect())
        later = met if not late else met.filter(~F.col("bucket").isin(late))
        self._carried_on(later, since)
        return self._remade(late)

    def _carried_on(self, later: DataFrame, since: date) -> None:
        """Move products on by prices of days after their last one."""
        touched = sorted(r[0] for r in later.select("bucket").distinct().collect())
        if not touched:
            return
        days = Window.partitionBy("product_id").orderBy("snapshot_date")
        none, zero = F.lit(None), F.lit(0).cast("bigint")
        stock, start = F.coalesce("stock", zero), F.coalesce("price", zero)
        quote = to_millionths(F.col("market_price"))
        price = F.coalesce(F.last(quote, ignorenulls=True).over(days.rowsBetween(Window.unboundedPreceding, 0)), start)
        moved = (later.select("bucket", "product_id", F.col("snapshot_date").alias("date"), stock.alias("stock"), start.alias("start"),
                              price.alias("now"))
                 .withColumn("d_value", stock_value(F.col("stock"), F.col("now"))
                             - stock_value(F.col("stock"), F.coalesce(F.lag("now").over(Window.partitionBy("product_id").orderBy("date")), "start")))
                 .withColumns({"d_basis": zero, "profit": none.cast("decimal(34,6)")}))
        old = self.state.read(touched)
        kept = old.filter(F.col("product_id").isNotNull())
        newest = moved.groupBy("bucket", "product_id").agg(F.max(F.struct("date", "now")).alias("newest"))
        stands = (kept.join(newest, ["bucket", "product_id"], "full")
                  .withColumns({"date": F.coalesce("newest.date", "date"), "price": F.coalesce("newest.now", "price"), "since": F.lit(since),
                                **{c: F.coalesce(c, zero) for c in ("stock", "bought", "buy_cost")}}))
        changes = summed_changes(
            old.filter(F.col("product_id").isNull()).select("bucket", "date", "d_basis", "d_value", "profit")
            .unionByName(moved.select("bucket", "date", "d_basis", F.col("d_value").cast("decimal(30,0)").alias("d_value"), "profit")),
            "bucket", "date")
        self.state.replace(self._state_rows(stands, changes, since), touched)

    def _state_rows(self, stands: DataFrame, changes: DataFrame, since: date | None) -> DataFrame:
        names = [f.split()[0] for f in _STATE.split(", ")]
        types = {f.split()[0]: f.split()[1] for f in _STATE.replace("(30,0)", "(30;0)").replace("(34,6)", "(34;6)").split(", ")}

        def shaped(df: DataFrame) -> DataFrame:
            df = df.withColumn("since", F.lit(since))
            return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(types[c].replace(";", ",")).alias(c) for c in names], "bucket")
        stands = stands.drop("d_basis", "d_value", "profit")
        return shaped(stands).unionByName(shaped(changes.drop("product_id")))

    def _remade(self, touched: list[int]) -> list[int]:
        """Work out state and cost history of these buckets from their ledger and prices, and of all buckets if
        the first day of the portfolio has moved."""
        if not touched:
            return touched
        first = F.min("transaction_date")
        here = self.ledger.read(touched).agg(first).first()[0]
        others = self._products().filter(~F.col("bucket").isin(touched)).agg(F.min("first_date")).first()[0]
        since = min((d for d in (here, others) if d is not None), default=None)
        if since != self._since():
            touched = list(range(self.buckets))
        ledger, prices = self.ledger.read(touched), self.prices.read(touched)
        newest = prices.groupBy("product_id", "snapshot_date").agg(F.max_by("market_price", "sent").alias("market_price"))
        moves = cut_lineage(product_changes(ledger, newest, F.lit(since)).withColumn("bucket", self.state.bucket()))
        # Both rows of a product's day say the same.
        stands = moves.groupBy("bucket", "product_id").agg(F.max_by(F.struct("date", "stock", "price", "bought", "buy_cost"), "date").alias("at"))
        traded = ledger.groupBy("product_id").agg(first.alias("first_date"))
        stands = stands.select("bucket", "product_id", "at.*").join(traded, "product_id", "left")
        self.state.replace(self._state_rows(stands, summed_changes(moves, "bucket", "date"), since), touched)
        self.history.replace(cost_history(ledger).withColumn("bucket", self.history.bucket()), touched)
        return touched

    def daily(self, as_of: date) -> DataFrame:
        """The daily value series, as ``daily_portfolio_value`` over the whole ledger and all prices gives it."""
        changes = self.state.read().filter(F.col("product_id").isNull())
        return value_series(summed_changes(changes, "date"), as_of, F.lit(self._since()))

    def cost_history(self) -> DataFrame:
        """The cost history, as ``cost_history`` over the whole ledger gives it."""
        return self.history.read().drop("bucket")
