import os
import random
from datetime import date, timedelta

import pytest
from helpers import D, prices, tx
from pyspark.sql import functions as F

from ledgerspark.operators import timeseries
from ledgerspark.plans.incremental import PortfolioStore

AS_OF = D("2024-06-30")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def same_as_rebuild(spark, store, ledger, quotes):
    frame, snaps = tx(spark, list(ledger.values())), prices(spark, [(p, d, v) for (p, d), v in quotes.items()])
    assert rows(store.daily(AS_OF)) == rows(timeseries.daily_portfolio_value(frame, snaps, AS_OF))
    whole = timeseries.cost_history(frame)
    assert rows(store.cost_history().select(*whole.columns)) == rows(whole)


def some_rows(rng, ids, products, day):
    made = {}
    for i in ids:
        kind = rng.choice(["BUY", "BUY", "SELL", "OPEN"])
        price = None if kind == "OPEN" else rng.randint(100, 999) / 100
        when = day + timedelta(days=rng.randint(0, 20))
        made[i] = (i, products[i % len(products)], kind, rng.randint(1, 9), price, None, when.isoformat())
    return made


@pytest.mark.parametrize("seed", [1, 2])
def test_random_batches_end_as_a_rebuild(spark, folder, seed):
    rng, store, products = random.Random(seed), PortfolioStore(spark, f"{folder}/s", 5), [f"p{i}" for i in range(9)]
    start, ledger, quotes, sent = date(2024, 3, 1), {}, {}, 0

    def send(days, some):
        nonlocal sent
        sent += 1
        new = {(p, d.isoformat()): rng.choice([None, rng.randint(0, 9999) / 100]) for d in days for p in some if rng.random() < 0.9}
        quotes.update(new)
        return store.add_prices(prices(spark, [(p, d, v) for (p, d), v in new.items()]), sent)

    send([start - timedelta(days=1), start], products)  # before any ledger
    ledger = some_rows(rng, range(10, 60), products, start)
    ledger[9] = (9, "p0", "BUY", 2, 1.5, None, start.isoformat())  # nothing below changes the first day
    store.apply_ledger(tx(spark, list(ledger.values())))
    same_as_rebuild(spark, store, ledger, quotes)
    # Days later than all others: no bucket is made anew, whatever the number of days.
    assert send([start + timedelta(days=d) for d in (30, 31, 33)], [*products, "never traded"]) == []
    same_as_rebuild(spark, store, ledger, quotes)
    # A batch of changes on two products: edits, new rows and deletions.
    touched = [i for i in ledger if ledger[i][1] in ("p2", "p7")]
    changed = some_rows(rng, rng.sample(touched, 5), products, start + timedelta(days=5)) | some_rows(rng, [902, 907, 911], products, start)
    gone = [i for i in touched if i not in changed][:3]
    deleted = spark.createDataFrame([(ledger[i][1], i) for i in gone], "product_id string, transaction_id bigint")
    ledger = {i: r for i, r in (ledger | changed).items() if i not in gone}
    made = store.apply_ledger(tx(spark, list(changed.values())), deleted)
    assert 1 <= len(made) <= 2
    same_as_rebuild(spark, store, ledger, quotes)
    # Days sent again and days in between, next to a new day.
    assert send([start + timedelta(days=d) for d in (4, 31, 40)], ["p1", "p3"])
    same_as_rebuild(spark, store, ledger, quotes)
    # The portfolio's first day moves both ways.
    ledger[1] = (1, "p4", "BUY", 3, 2.5, None, (start - timedelta(days=1)).isoformat())
    assert store.apply_ledger(tx(spark, [ledger[1]])) == list(range(5))
    same_as_rebuild(spark, store, ledger, quotes)
    del ledger[1]
    store.apply_ledger(tx(spark, []), spark.createDataFrame([("p4", 1)], "product_id string, transaction_id bigint"))
    same_as_rebuild(spark, store, ledger, quotes)


def test_steps_can_be_run_again_and_untouched_buckets_stay(spark, folder):
    store, quotes = PortfolioStore(spark, f"{folder}/s", 8), {}
    ledger = some_rows(random.Random(3), range(40), [f"p{i}" for i in range(8)], date(2024, 3, 1))

    def files():
        return {d: sorted(os.listdir(f"{folder}/s/{d}")) for t in ("ledger", "state", "cost_history", "prices")
                for d in (f"{t}/{b}" for b in os.listdir(f"{folder}/s/{t}") if "=" in b)}

    store.apply_ledger(tx(spark, list(ledger.values())))
    day = {(f"p{i}", "2024-05-01"): 1.0 + i for i in range(8)}
    quotes |= day
    for _ in range(2):  # the second time as after a failure
        store.add_prices(prices(spark, [(*k, v) for k, v in day.items()]), 1)
        same_as_rebuild(spark, store, ledger, quotes)
    before = files()
    ledger[41] = (41, "p1", "BUY", 2, 3.0, None, "2024-04-01")
    for _ in range(2):
        made = store.apply_ledger(tx(spark, [ledger[41]]))
        same_as_rebuild(spark, store, ledger, quotes)
    now = files()
    assert len(made) == 1 and {d for d in now if now[d] != before.get(d)} == {f"{t}/bucket={made[0]}" for t in ("ledger", "state", "cost_history")}
    # Everything deleted leaves nothing to value.
    everything = spark.createDataFrame([(r[1], i) for i, r in ledger.items()], "product_id string, transaction_id bigint")
    store.apply_ledger(tx(spark, []), everything)
    assert store.daily(AS_OF).count() == 0 and store.cost_history().count() == 0
    assert store.state.read().filter(F.col("product_id").isNotNull()).count() == 0
