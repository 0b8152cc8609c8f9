from datetime import datetime
from decimal import Decimal

import pytest
from helpers import D, model, prices, random_case, tx
from pyspark.sql import functions as F

from ledgerspark.functions.cleaning import round_price
from ledgerspark.operators import holdings, reports, timeseries
from ledgerspark.plans.rebuild import rebuild


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_series_matches_plain_model(spark, seed):
    ledger, quotes = random_case(seed)
    series, dense = model(ledger, quotes, "2024-04-20")
    frame, snaps = tx(spark, ledger), prices(spark, quotes)
    got = rows(timeseries.daily_portfolio_value(frame, snaps, D("2024-04-20")))
    assert [r[0].isoformat() for r in got] == [s[0] for s in series]
    for mine, theirs in zip(got, series):
        assert [float(x) for x in mine[1:4]] == list(theirs[1:4])
        assert float(mine[4]) == pytest.approx(theirs[4], abs=0.011)
    calendar = timeseries.valuation_calendar(snaps, frame, D("2024-04-20"))
    full = timeseries.dense_cost_history(frame, calendar).select("product_id", "date", "total_cost_basis",
                                                                 "sealed_quantity")
    assert [(p, d.isoformat(), float(b), q) for p, d, b, q in rows(full)] == sorted(dense)


def test_dense_history_can_be_limited_to_a_range(spark):
    ledger, quotes = random_case(4)
    frame, snaps = tx(spark, ledger), prices(spark, quotes)
    calendar = timeseries.valuation_calendar(snaps, frame, D("2024-04-20"))
    whole = timeseries.dense_cost_history(frame, calendar)
    part = timeseries.dense_cost_history(frame, calendar, D("2024-03-10"), D("2024-03-15"))
    assert rows(part) == rows(whole.filter("date between '2024-03-10' and '2024-03-15'"))
    sparse = timeseries.cost_history(frame)
    assert rows(whole.join(sparse.select("product_id", "date"), ["product_id", "date"], "left_semi")
                .select(*sparse.columns)) == rows(sparse)


def test_dense_history_refuses_days_that_are_not_in_the_calendar(spark):
    history = timeseries.cost_history(tx(spark, [(1, "a", "BUY", 2, 5, 10, "2024-01-05"), (2, "a", "BUY", 1, 5, 5, "2024-01-09")]))
    calendar = spark.sql("SELECT explode(sequence(date'2024-01-05', date'2024-01-08')) date")
    with pytest.raises(Exception, match="not a calendar day: 2024-01-09"):
        timeseries.densify(history, calendar).collect()


def test_invariants(spark):
    ledger, quotes = random_case(5, n=80)
    frame, snaps = tx(spark, ledger), prices(spark, quotes)
    built = rebuild(frame, snaps, D("2024-12-31"))
    held = built.holdings.collect()
    stock = {r.product_id: r.current_quantity for r in holdings.on_hand(frame).collect()}
    for r in held:
        assert r.current_quantity == r.total_quantity_bought - r.total_quantity_sold - r.total_quantity_opened
        assert stock[r.product_id] == r.current_quantity
    last = timeseries.latest_by_date(built.daily).first()
    assert last.total_cost_basis == sum(r.total_cost_basis for r in held)
    sells = {r[6] for r in ledger if r[2] == "SELL"}
    previous = Decimal(0)
    for r in sorted(built.daily.collect()):
        if r.date.isoformat() not in sells:
            assert r.cumulative_realized_pnl == previous
        previous = r.cumulative_realized_pnl


def test_holdings_rules(spark):
    ledger = tx(spark, [
        (1, "a", "BUY", 2, 10, 19.5, "2024-01-02", "late", datetime(2024, 1, 2)),
        (2, "a", "BUY", 1, 13, None, "2024-01-02", "first", datetime(2024, 1, 1)),
        (3, "a", "SELL", 1, 20, 18, "2024-01-03", "other"),
        (4, "a", "OPEN", 1, None, None, "2024-01-04", "other"),
        (5, "a", "BUY", 5, 1, 5, "2025-01-01", "future"),
        (6, "b", "SELL", 3, 2, None, "2024-01-01"),
        (7, "c", "BUY", 4, None, None, "2024-01-01"),
    ])
    got = {r.product_id: r for r in holdings.current_holdings(ledger, D("2024-06-01")).collect()}
    a = got["a"]
    assert (a.product_name, a.total_quantity_bought, a.total_quantity_sold, a.total_quantity_opened) == \
        ("first", 3, 1, 1)
    # Totals where recorded, unit prices for the average; opening changes stock but not cost.
    assert (a.current_quantity, a.total_cost_basis, a.average_cost_per_unit) == (1, Decimal("14.50"), Decimal("11.00"))
    assert (got["b"].current_quantity, got["b"].total_cost_basis, got["b"].average_cost_per_unit) == (-3, -6, 0)
    assert (got["c"].total_cost_basis, got["c"].average_cost_per_unit) == (0, 0)
    assert {r.product_id for r in holdings.active_holdings(holdings.current_holdings(ledger, D("2024-06-01"))).collect()} \
        == {"a", "c"}
    assert {r.product_id: r.current_quantity for r in holdings.on_hand(ledger, exclude_id=5).collect()}["a"] == 1


def test_prices_before_the_first_transaction_are_ignored(spark):
    ledger = tx(spark, [(1, "a", "BUY", 2, 5, 10, "2024-01-05"), (2, "b", "BUY", 1, 5, 5, "2024-01-07")])
    snaps = prices(spark, [("a", "2024-01-01", 99), ("b", "2024-01-06", 3), ("a", "2024-01-09", None)])
    daily = {r.date.isoformat(): r for r in timeseries.daily_portfolio_value(ledger, snaps, D("2024-01-10")).collect()}
    assert sorted(daily) == ["2024-01-05", "2024-01-06", "2024-01-07", "2024-01-09", "2024-01-10"]
    assert daily["2024-01-05"].total_market_value == 0
    assert daily["2024-01-10"].total_market_value == 3
    stale = timeseries.price_staleness(ledger, snaps, D("2024-01-10")).first()
    assert (stale.latest_price_date, stale.days_behind, stale.is_stale) == (D("2024-01-06"), 4, True)


def test_sub_cent_prices_are_rounded_once(spark):
    ledger = tx(spark, [(i, f"p{i}", "BUY", 1, 1, 1, "2024-01-01") for i in range(10)])
    snaps = prices(spark, [(f"p{i}", "2024-01-01", 0.004) for i in range(10)])
    assert timeseries.daily_portfolio_value(ledger, snaps, D("2024-01-01")).first().total_market_value == Decimal("0.04")


def test_empty_ledger(spark):
    ledger, snaps = tx(spark, []), prices(spark, [("a", "2024-01-01", 1)])
    built = rebuild(ledger, snaps, D("2024-01-02"))
    assert built.holdings.count() == built.cost_history.count() == built.daily.count() == 0
    assert tuple(built.summary.first()) == (0, 0, 0, 0, 0, 0)
    assert timeseries.price_staleness(ledger, snaps, D("2024-01-02")).first().is_stale is False


def test_summary_sources(spark):
    ledger = tx(spark, [(1, "a", "BUY", 2, 5, 10, "2024-01-05"), (2, "b", "BUY", 1, 8, 8, "2024-01-05"),
                        (3, "b", "SELL", 1, 3, 3, "2024-01-06")])
    built = rebuild(ledger, prices(spark, [("a", "2024-01-06", 6)]), D("2024-01-07"))
    assert built.summary.first().total_cost_basis == 15
    held = reports.portfolio_summary(built.holdings, built.daily, "holdings").first()
    assert (held.total_cost_basis, held.total_products, held.total_quantity) == (10, 1, 2)
    none = reports.portfolio_summary(built.holdings, built.daily.filter("false")).first()
    assert (none.total_cost_basis, none.current_market_value) == (10, 0)
    assert reports.portfolio_return(built.summary).first().return_percent == Decimal("-20.00")
    with pytest.raises(ValueError):
        reports.portfolio_summary(built.holdings, built.daily, "guess")


def test_value_holdings_uses_only_the_newest_snapshot(spark):
    ledger = tx(spark, [(1, "a", "BUY", 2, 5, 10, "2024-01-05"), (2, "b", "BUY", 3, 8, 24, "2024-01-05")])
    snaps = prices(spark, [("a", "2024-01-05", 9), ("b", "2024-01-06", 2.345), ("a", "2024-01-06", None)])
    got = {r.product_id: (r.current_price_per_unit, r.total_current_value)
           for r in reports.value_holdings(holdings.current_holdings(ledger, D("2024-02-01")), snaps).collect()}
    assert got == {"a": (0, 0), "b": (Decimal("2.35"), Decimal("7.05"))}


def test_asof_price_keeps_every_request(spark):
    asked = spark.createDataFrame([("a", D("2024-01-03"), 1), ("a", D("2024-01-03"), 2), ("a", D("2024-01-01"), 3),
                                   ("z", D("2024-01-03"), 4)], "product_id string, date date, n int")
    snaps = prices(spark, [("a", "2024-01-02", 1.5), ("a", "2024-01-03", None), ("a", "2024-01-04", 2)])
    got = {r.n: (r.market_price, r.price_date) for r in timeseries.asof_price(asked, snaps).collect()}
    hit = (Decimal("1.500000"), D("2024-01-02"))
    assert got == {1: hit, 2: hit, 3: (None, None), 4: (None, None)}
    late = timeseries.asof_price(asked, snaps, D("2024-01-03")).filter("price_date is not null")
    assert late.count() == 0


def test_half_up_rounding(spark):
    probes = [1.005, 2.675, 0.285, 1.255, 0.125, -1.005]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in probes], "p double")
           .select(round_price(F.col("p"))).collect()]
    assert got == [Decimal(x) for x in ("1.01", "2.68", "0.29", "1.26", "0.13", "-1.01")]


def test_history_filter_and_defaults(spark):
    ledger = tx(spark, [(1, "a", "BUY", 2, 5, 10, "2024-01-05"), (2, "a", "SELL", 1, 8, 8, "2024-01-06"),
                        (3, "a", "BUY", 1, 8, 8, "2024-01-06")])
    assert [r.transaction_id for r in reports.ledger_history(ledger).collect()] == [3, 2, 1]
    assert [r.transaction_id for r in reports.ledger_history(ledger, "All").collect()] == [3, 2, 1]
    only = reports.ledger_history(ledger, "SELL").collect()
    assert [(r.transaction_id, r.notes) for r in only] == [(2, "")]
