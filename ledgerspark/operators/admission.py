"""Exact one-after-the-other stock checks for a batch of ledger changes.

Whether a sale fits depends on which earlier changes were let through, so the changes of
one product are strictly sequential. A task walks the changes of many products, each from its stock on.
The changes of a product that has too many for that are settled in parallel for the most part. Each
ledger row has a quantity that the batch may set again and again; before any change that
quantity lies between the least and the most that the undecided changes allow:

* a sale that fits the least possible stock is accepted;
* a sale that does not fit even the most possible stock is refused.

Both bounds are running totals. What lies in between is walked in ``seq`` order. The walk of a product
is cut into blocks that tasks work on at the same time, each from a guess of what the block before it
hands on: the stock and the rows that later changes name again. Blocks whose guess was wrong walk again
from what was really handed on, until nothing changes. The first block starts right, so every round
settles at least one more; in practice stocks soon agree whatever they started from.
"""

from collections.abc import Iterator
from itertools import repeat

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions.cleaning import is_stock_out, signed_quantity
from ledgerspark.functions.state import cut_lineage
from ledgerspark.operators.holdings import on_hand
from ledgerspark.operators.running import BITS, running_totals, spread

# Changes of a product that one task walks.
BLOCK = 1 << 15
# Changes are counted in this many groups of products before they are counted by product.
_CELLS = 1 << 15
# What every stock covers.
_NOTHING = -(1 << 62)

_STATE = "product_id string, block bigint, shift bigint, waiting array<struct<row:bigint,shift:bigint>>"


class _Stock:
    """What contested grants have done so far: ``shift`` is what they have added to the stock, ``rows``
    the part of it that later changes of the same row take back."""

    def __init__(self, shift: int = 0, waiting=()):
        self.shift, self.rows = int(shift), {int(w["row"]): int(w["shift"]) for w in waiting}

    def meet(self, row: int | None, opened: bool, free: int, wanted: int, takes: bool, step: int, again: bool) -> bool:
        """Grant what fits. ``free`` is the stock without the changed row and any contested grant."""
        own = self.rows.pop(row, 0)
        if not opened:  # decided beforehand: the row's quantity no longer depends on the walk
            self.shift -= own
            return True
        fits = free + self.shift - own >= wanted
        if fits and takes:
            self.shift += step - own
            own = step
        if again and own:
            self.rows[row] = own
        return fits


def _walk(decide: bool):
    """Walk blocks that arrive sorted by product, block and seq, each led by its start state if it has one.
    Without a column ``waiting`` no start has rows that are named again.

    Yields (seq, granted) of the contested changes, or per block the state that the next one starts from.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, stock = None, _Stock()
        for batch in batches:
            seqs, granted, ends = [], [], []
            held = batch["waiting"].tolist() if "waiting" in batch else repeat(())
            for product, block, leads, seq, named, row, opened, free, wanted, takes, step, again, waiting in zip(*(batch[c].tolist() for c in (
                    "product_id", "block", "leads", "seq", "named", "row", "contested", "free", "quantity", "takes", "step", "again")), held):
                if (product, block) != current:
                    if current:
                        ends.append((current, stock))
                    current, stock = (product, block), _Stock()
                if leads:
                    stock = _Stock(step, waiting)
                    continue
                fits = stock.meet(row if named else None, opened, free, wanted, takes, step, again)
                if opened and decide:
                    seqs.append(seq)
                    granted.append(fits)
            yield decisions(seqs, granted) if decide else states(ends)
        if current and not decide:
            yield states([(current, stock)])

    def decisions(seqs: list, granted: list) -> pd.DataFrame:
        return pd.DataFrame({"seq": pd.Series(seqs, dtype="int64"), "granted": pd.Series(granted, dtype=bool)})

    def states(ends: list) -> pd.DataFrame:
        return pd.DataFrame([(product, block + 1, stock.shift, [{"row": int(r), "shift": int(v)} for r, v in sorted(stock.rows.items())])
                             for (product, block), stock in ends], columns=["product_id", "block", "shift", "waiting"])

    return run


def _walked(events: DataFrame, starts: DataFrame | None, decide: bool) -> DataFrame:
    """The walk over ``events``; blocks without a row in ``starts`` begin with nothing granted. Events without a column
    ``block`` are walked by product, all of them contested."""
    key = [c for c in ("product_id", "block") if c in events.columns]
    whole, named = len(key) == 1, F.col("row").isNotNull()
    rows = events.withColumn("leads", F.lit(False))
    if not whole:
        rows = rows.withColumn("waiting", F.array().cast("array<struct<row:bigint,shift:bigint>>"))
    if starts is not None:
        # A start stands before its block, its shift in the place of a step.
        leads = starts.withColumnRenamed("shift", "step").withColumn("leads", F.lit(True))
        rows = rows.unionByName(leads, allowMissingColumns=True)
    # By a hash of the key: Spark leaves a shuffle by the key out over a union of joins by it, whose partitions need not match.
    rows = rows.repartition(F.xxhash64(*key)).sortWithinPartitions(*key, F.desc("leads"), "seq")
    if whole:  # What follows from other columns does not have to travel.
        rows = rows.withColumns({"block": F.lit(0).cast("bigint"), "named": named, "again": named, "contested": F.lit(True)})
    # No column has nulls: in a task they would turn whole numbers into floats.
    rows = rows.fillna(0, ["seq", "row", "free", "quantity"]).fillna(False, ["named", "contested", "takes", "again"])
    return rows.mapInPandas(_walk(decide), "seq bigint, granted boolean" if decide else _STATE)


def _walked_whole(events: DataFrame, stock: DataFrame) -> DataFrame:
    """(seq, granted) of products that each fit one task, which walks all of their events from the stock on."""
    asked = events.select("product_id", "seq", "row", (-F.col("own")).alias("free"), (F.col("after") - F.col("own")).alias("step"),
                          F.when(F.col("checks"), F.col("quantity")).otherwise(F.lit(_NOTHING)).alias("quantity"), "takes")
    return _walked(asked, stock.select("product_id", F.col("current_quantity").alias("shift")), decide=True)


def _block_starts(events: DataFrame) -> DataFrame | None:
    """What every block but the first of its product starts from; None if no product has two blocks."""
    if not events.agg(F.max("block")).first()[0]:
        return None
    long_ = events.groupBy("product_id").agg(F.max("block").alias("last_block")).filter("last_block > 0")
    handing = cut_lineage(events.join(long_, "product_id").filter("block < last_block").drop("last_block"))
    # The first guess: contested changes leave nothing in stock.
    first = events.filter("block > 0").groupBy("product_id", "block").agg(F.min_by("free", "seq").alias("free"))
    starts = cut_lineage(first.select("product_id", "block", (-F.greatest("free", F.lit(0))).alias("shift"),
                                      F.array().cast("array<struct<row:bigint,shift:bigint>>").alias("waiting")))
    todo, leads, key = handing, starts, ["product_id", "block"]
    while True:
        ends = _walked(todo, leads, decide=False).select(*key, F.struct("shift", "waiting").alias("handed"))
        now = cut_lineage(starts.select(*key, F.struct("shift", "waiting").alias("guess")).join(ends, key, "left"))
        wrong = now.filter(F.col("handed").isNotNull() & (F.col("handed") != F.col("guess")))
        starts = now.select(*key, F.inline(F.array(F.coalesce("handed", "guess"))))
        if wrong.isEmpty():
            return starts
        # Only blocks that start otherwise than they did walk again.
        todo, leads = (df.join(wrong.select(*key), key, "left_semi") for df in (handing, starts))


def stock_ranges(events: DataFrame) -> DataFrame:
    """Events of named rows with what ``settle`` must know of the changes of a row before each: ``high`` and ``low``, the
    most and the least that the row can add then, ``up`` and ``down``, by how much the event can move both.

    ``events`` has the columns of ``settle``; rows that neither check nor take change nothing.
    """
    earlier = Window.partitionBy("row").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    firm, soft = F.col("takes") & ~F.col("checks"), F.col("takes") & F.col("checks")
    none, after = F.lit(0).cast("bigint"), F.col("after")

    def since(bound: Column) -> Column:
        """The greatest value of the soft events since the last firm one: running maxima of (number of firm ones before, value)."""
        most = F.max(F.when(soft, F.struct("part", bound.alias("value")))).over(earlier)
        return F.when(most["part"] == F.col("part"), most["value"])

    # Since the last firm change of its row, a row's quantity is that one or one of the soft ones after it.
    return _moved(events.withColumn("part", F.coalesce(F.sum(firm.cast("bigint")).over(earlier), none))
                  .withColumn("start", F.coalesce(F.last(F.when(firm, after), ignorenulls=True).over(earlier), "own"))
                  .withColumn("high", F.greatest("start", since(after)))
                  .withColumn("low", F.least("start", -since(-after)))
                  .drop("part", "start"))


def fresh_ranges(events: DataFrame) -> DataFrame:
    """``stock_ranges`` of events without a row: nothing was there before them."""
    none = F.lit(0).cast("bigint")
    return _moved(events.withColumn("high", none).withColumn("low", none))


def _moved(events: DataFrame) -> DataFrame:
    firm, soft = F.col("takes") & ~F.col("checks"), F.col("takes") & F.col("checks")
    none, after = F.lit(0).cast("bigint"), F.col("after")
    return (events.withColumn("up", F.when(firm, after - F.col("high")).when(soft, F.greatest(after - F.col("high"), none))
                              .otherwise(none))
            .withColumn("down", F.when(firm, after - F.col("low")).when(soft, F.least(after - F.col("low"), none))
                        .otherwise(none)))


def _ranged(events: DataFrame, stock: DataFrame) -> DataFrame:
    rows = (stock_ranges(spread(events.filter(F.col("row").isNotNull()), "row"))
            .unionByName(fresh_ranges(events.filter(F.col("row").isNull()))))
    return cut_lineage(rows.join(stock, "product_id", "left")
                       .withColumn("base", F.coalesce("current_quantity", F.lit(0).cast("bigint"))).drop("current_quantity"))


def _frequent(events: DataFrame, most: int) -> DataFrame | None:
    """The products with more than ``most`` events; None if there are none. Only groups of products that have more
    together are counted by product, so the products themselves hardly travel."""
    cells = events.select("product_id", F.pmod(F.xxhash64("product_id"), F.lit(_CELLS)).alias("cell"))
    more = F.col("count") > most
    full = cut_lineage(cells.groupBy("cell").count().filter(more).select("cell"))
    if full.isEmpty():
        return None
    products = cells.join(full, "cell", "left_semi").groupBy("product_id").count().filter(more)
    products = cut_lineage(products.select("product_id"))
    return None if products.isEmpty() else products


def settle(events: DataFrame, ledger: DataFrame, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """(seq, granted) for every event, as if they came one after the other in ``seq`` order.

    Columns: ``seq`` (unique), ``product_id``, ``row`` (the ledger row that is changed, null
    for a new one), ``own`` (what that row adds to the stock now, 0 for a new one),
    ``after`` (what it adds afterwards), ``quantity`` (what the stock must cover),
    ``checks`` (is the stock asked at all?) and ``takes`` (does the row change if it passes?).
    None but ``row`` may be null. ``events`` are read several times and had better be stored. A task walks
    up to ``block`` events of a product, only products with more are settled by bounds first.
    """
    events, stock = events.filter(F.col("seq").isNotNull()), cut_lineage(on_hand(ledger))
    frequent = _frequent(events, block)
    if frequent is None:
        return _walked_whole(events, stock)
    whole = _walked_whole(events.join(frequent, "product_id", "left_anti"), stock.join(frequent, "product_id", "left_anti"))
    return whole.unionByName(_bounded(events.join(frequent, "product_id", "left_semi"), stock, bits, block))


def _bounded(events: DataFrame, stock: DataFrame, bits: int, block: int) -> DataFrame:
    """``settle`` by bounds and blocks. A row that very many events name is sorted by one task, which spills; it is
    not held in memory. A task walks ``block`` contested events of a product."""
    earlier = Window.partitionBy("row").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    none, after = F.lit(0).cast("bigint"), F.col("after")
    ranged = _ranged(events, stock)
    least = F.col("base") + F.col("down_before") - F.col("low")
    most = F.col("base") + F.col("up_before") - F.col("high")
    granted = (F.when(~F.col("checks") | (least >= F.col("quantity")), F.lit(True))
               .when(most < F.col("quantity"), F.lit(False)))
    bounded = cut_lineage(
        running_totals(ranged, ["product_id"], "seq", {"up": "up_before", "down": "down_before"}, bits)
        .select("seq", "product_id", "row", "own", "after", "quantity", "takes", "base", granted.alias("granted")))

    # Only products with a contested change go on. Their stock as it is when every contested change is
    # refused; the walk adds the rest.
    contested = F.col("granted").isNull()
    decided = F.col("takes") & F.coalesce("granted", F.lit(False))
    open_ = bounded.join(bounded.filter(contested).select("product_id").distinct(), "product_id", "left_semi")
    named = (spread(open_.filter(F.col("row").isNotNull()), "row")
             .withColumn("before", F.coalesce(F.last(F.when(decided, after), ignorenulls=True).over(earlier), "own"))
             .withColumn("waits", F.coalesce(F.max(contested & F.col("takes")).over(earlier), F.lit(False))))
    fresh = open_.filter(F.col("row").isNull()).withColumn("before", none).withColumn("waits", F.lit(False))
    standing = cut_lineage(
        named.unionByName(fresh).withColumn("sure", F.when(decided, after - F.col("before")).otherwise(none))
        .withColumn("listed", (contested | (F.col("waits") & decided)).cast("bigint")))
    placed = running_totals(standing, ["product_id"], "seq", {"sure": "sure_before", "listed": "listed_before"}, bits)
    later = F.lead("seq").over(Window.partitionBy("row").orderBy("seq")).isNotNull()
    listed = placed.filter("listed = 1").select(
        "product_id", F.floor(F.col("listed_before") / block).cast("bigint").alias("block"), "seq", "row",
        contested.alias("contested"), "quantity", "takes", (F.col("base") + F.col("sure_before") - F.col("before")).alias("free"),
        (after - F.col("before")).alias("step"))
    listed = cut_lineage(listed.filter(F.col("row").isNotNull()).withColumn("named", F.lit(True)).withColumn("again", later)
                         .unionByName(listed.filter(F.col("row").isNull()).withColumn("row", none)
                                      .withColumns({"named": F.lit(False), "again": F.lit(False)})))
    walked = _walked(listed, _block_starts(listed), decide=True)
    return bounded.filter(~contested).select("seq", "granted").unionByName(walked)


def admit_sequential(entries: DataFrame, ledger: DataFrame, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """Add ``has_stock``: would this entry pass if the batch were entered in ``seq`` order?

    ``entries`` needs seq (unique), product_id, transaction_type and quantity. Where it
    has a boolean ``valid``, rows without it are checked but change no stock. Stock left
    over in ``ledger`` is what the batch starts from; purchases always pass, stock-outs
    without a product or a quantity never do.
    """
    takes = F.col("valid") if "valid" in entries.columns else F.lit(True)
    none = F.lit(None).cast("bigint")
    events = cut_lineage(entries.filter(F.col("product_id").isNotNull() & F.col("quantity").isNotNull()).select(
        "seq", "product_id", none.alias("row"), F.lit(0).cast("bigint").alias("own"), signed_quantity().alias("after"),
        "quantity", F.coalesce(is_stock_out(), F.lit(False)).alias("checks"), takes.alias("takes")))
    return (entries.join(settle(events, ledger, bits, block), "seq", "left")
            .withColumn("has_stock", F.coalesce("granted", ~is_stock_out(), F.lit(False))).drop("granted"))
