import functools
import random
from datetime import datetime
from decimal import Decimal

import pytest
from helpers import D, money, tx
from pyspark.sql import functions as F

from ledgerspark.operators import admission, changes
from ledgerspark.operators.admission import admit_sequential
from ledgerspark.operators.running import running_totals
from ledgerspark.schemas import CHANGES

NOW = datetime(2024, 5, 1)


def batch(spark, rows):
    names = CHANGES.fieldNames()
    return spark.createDataFrame([tuple(row.get(n) for n in names) for row in rows], CHANGES)


@pytest.fixture(scope="module")
def products(spark):
    return spark.createDataFrame([("a", "Alpha", D("2024-02-01")), ("b", "Beta", None)],
                                 "product_id string, name string, earliest_date date")


@pytest.fixture(scope="module")
def ledger(spark):
    return tx(spark, [(1, "a", "BUY", 5, 10, 50, "2024-02-02"), (2, "a", "SELL", 2, 12, 24, "2024-02-03"),
                      (3, "b", "BUY", 1, 4, 4, "2024-02-04"), (4, "a", "OPEN", 1, None, None, "2024-02-05")])


def entry(seq, **fields):
    base = dict(seq=seq, op="INSERT", product_id="a", transaction_type="BUY", quantity=1, price_per_unit=money(1),
                input_date=D("2024-03-01"), purchase_method="Online", purchase_location="Shop")
    return base | fields


def test_each_rule_has_its_reason(spark, products, ledger):
    rows = [entry(1), entry(2, product_id="zz", quantity=-1, price_per_unit=None), entry(3, transaction_type="GIFT"),
            entry(4, transaction_type="SELL", quantity=3, price_per_unit=None),
            entry(5, transaction_type="SELL", quantity=2, price_per_unit=None),
            entry(6, price_per_unit=None), entry(7, purchase_method=""), entry(8, purchase_location="  "),
            entry(9, transaction_type="OPEN", quantity=2, price_per_unit=None, purchase_method=None),
            entry(10, quantity=None), entry(11, transaction_type="SELL", quantity=2, purchase_location=None)]
    got = {r.seq: r.reason for r in changes.validate_entries(batch(spark, rows), products, ledger).collect()}
    assert got == {1: None, 2: "unknown_product", 3: "unknown_type", 4: "insufficient_stock", 5: "missing_price",
                   6: "missing_price", 7: "missing_method", 8: "missing_location", 9: None, 10: "missing_field",
                   11: None}


def test_inserts_are_dated_normalized_and_numbered(spark, products, ledger):
    rows = [entry(20, transaction_type="OPEN", price_per_unit=money(3), input_date=D("2024-01-01")),
            entry(10, product_id="b", quantity=3, price_per_unit=money("2.55"), input_date=D("2023-01-01")),
            entry(15, product_id="nope")]
    after = changes.apply_inserts(ledger, batch(spark, rows), products, NOW)
    new = {r.transaction_id: r for r in after.filter("transaction_id > 4").collect()}
    assert sorted(new) == [5, 6]
    b, a = new[5], new[6]
    assert (b.product_name, b.total_amount, b.transaction_date, b.date_adjusted, b.notes) == \
        ("Beta", Decimal("7.65"), D("2023-01-01"), False, "")
    assert (a.price_per_unit, a.total_amount, a.purchase_method, a.purchase_location) == (None, None, None, None)
    assert (a.transaction_date, a.input_date, a.date_adjusted) == (D("2024-02-01"), D("2024-01-01"), True)


def test_update_replaces_fields_and_ignores_its_own_stock(spark, products, ledger):
    def change(seq, i, **fields):
        return entry(seq, op="UPDATE", transaction_id=i, product_id=None, transaction_type=None, **fields)
    rows = [change(1, 2, quantity=4, price_per_unit=money(3)), change(2, 4, quantity=4), change(3, 99)]
    outcome = {r.seq: r.reason for r in changes.change_outcomes(ledger, batch(spark, rows), products).collect()}
    assert outcome == {1: None, 2: "insufficient_stock", 3: "not_found"}
    after = {r.transaction_id: r for r in changes.apply_updates(ledger, batch(spark, rows), products).collect()}
    assert (after[2].quantity, after[2].total_amount, after[2].transaction_type, after[2].product_id) == \
        (4, 12, "SELL", "a")
    assert (after[2].purchase_method, after[2].transaction_date) == (None, D("2024-03-01"))
    assert after[4].quantity == 1 and len(after) == 4


def test_patch_changes_only_what_is_given(spark, products, ledger):
    rows = [dict(seq=1, op="PATCH", transaction_id=1, quantity=7), dict(seq=2, op="PATCH", transaction_id=2, notes="n"),
            dict(seq=3, op="PATCH", transaction_id=3, quantity=2, price_per_unit=money(5))]
    new = {r.transaction_id: r for r in changes.apply_patches(ledger, batch(spark, rows), products).collect()}
    assert (new[1].quantity, new[1].price_per_unit, new[1].total_amount) == (7, 10, 70)
    assert (new[2].notes, new[2].total_amount) == ("n", 24)
    assert (new[3].quantity, new[3].total_amount) == (2, 10)
    old = {r.transaction_id: r for r in changes.apply_patches(ledger, batch(spark, rows), products, True).collect()}
    assert (old[1].quantity, old[1].total_amount) == (7, 50)
    assert (old[3].quantity, old[3].total_amount) == (2, 5)


def test_changes_come_one_after_the_other(spark, products, ledger):
    rows = [dict(seq=1, op="PATCH", transaction_id=1, price_per_unit=money(9)),
            dict(seq=2, op="PATCH", transaction_id=1, notes="kept"),
            entry(3, op="UPDATE", transaction_id=2, quantity=4, price_per_unit=money(3)),
            entry(4, op="UPDATE", transaction_id=2, quantity=40, price_per_unit=money(3)),
            entry(5, op="UPDATE", transaction_id=4, quantity=2),
            dict(seq=6, op="DELETE", transaction_id=3), dict(seq=7, op="PATCH", transaction_id=3, notes="late"),
            dict(seq=8, op="DELETE", transaction_id=77), dict(seq=9, op="DELETE"), dict(seq=10, transaction_id=1),
            entry(11, transaction_type="SELL", quantity=1), entry(12, quantity=2), entry(13, transaction_type="SELL"),
            dict(seq=14, op="MOVE", transaction_id=1)]
    outcome = {r.seq: r.reason for r in changes.change_outcomes(ledger, batch(spark, rows), products).collect()}
    assert outcome == {1: None, 2: None, 3: None, 4: "insufficient_stock", 5: "insufficient_stock", 6: None,
                       7: "not_found", 8: "not_found", 9: "not_found", 10: "unknown_operation",
                       11: "insufficient_stock", 12: None, 13: None, 14: "unknown_operation"}
    after = {r.transaction_id: r for r in
             changes.apply_changes(ledger, batch(spark, rows), products, NOW).collect()}
    assert sorted(after) == [1, 2, 4, 5, 6]
    assert (after[1].price_per_unit, after[1].total_amount, after[1].notes) == (9, 45, "kept")
    assert (after[2].quantity, after[4].quantity, after[5].quantity, after[6].transaction_type) == (4, 1, 2, "SELL")
    kept, unknown = changes.apply_deletes(ledger, spark.createDataFrame([(3,), (8,)], "transaction_id bigint"))
    assert kept.count() == 3 and [r[0] for r in unknown.collect()] == [8]
    nothing = batch(spark, [])
    assert changes.apply_changes(ledger, nothing, products, NOW).count() == 4
    assert changes.change_outcomes(ledger.limit(0), nothing, products).count() == 0


def one_by_one(base, rows, legacy):
    """The batch applied by a plain loop: outcomes per seq, and quantity, price, total and notes per row."""
    stored = {r[0]: dict(product=r[1], kind=r[2], quantity=r[3], price=money(r[4]), total=money(r[5]), notes=None)
              for r in base}
    outcomes, fresh = {}, []

    def refusal(c, product, kind, own):
        stock = sum((1 if r["kind"] == "BUY" else -1) * r["quantity"] for r in [*stored.values(), *fresh]
                    if r["product"] == product and r is not own)
        if kind != "BUY" and stock < c["quantity"]:
            return "insufficient_stock"
        return "missing_price" if kind != "OPEN" and c.get("price_per_unit") is None else None

    def values(c, kind):
        price = None if kind == "OPEN" else c["price_per_unit"]
        return dict(quantity=c["quantity"], price=price, total=None if price is None else price * c["quantity"],
                    notes=c.get("notes") or "")

    for c in sorted(rows, key=lambda c: c["seq"]):
        row = stored.get(c.get("transaction_id"))
        if c["op"] == "INSERT":
            outcomes[c["seq"]] = refusal(c, c["product_id"], c["transaction_type"], None)
            if not outcomes[c["seq"]]:
                fresh.append(dict(product=c["product_id"], kind=c["transaction_type"]) | values(c, c["transaction_type"]))
            continue
        outcomes[c["seq"]] = "not_found" if row is None else None
        if row and c["op"] == "UPDATE":
            outcomes[c["seq"]] = refusal(c, row["product"], row["kind"], row)
            if not outcomes[c["seq"]]:
                row.update(values(c, row["kind"]))
        elif row and c["op"] == "DELETE":
            del stored[c["transaction_id"]]
        elif row:
            quantity, price = c.get("quantity"), c.get("price_per_unit")
            base_quantity = row["quantity"] if legacy or quantity is None else quantity
            base_price = row["price"] if price is None else price
            if price is not None or (quantity is not None and not legacy):
                row["total"] = row["total"] if base_price is None else base_quantity * base_price
            row.update({k: v for k, v in (("quantity", quantity), ("price", price), ("notes", c.get("notes")))
                        if v is not None})
    first = max(r[0] for r in base) + 1
    left = stored | {first + i: r for i, r in enumerate(fresh)}
    return outcomes, {i: (r["quantity"], r["price"], r["total"], r["notes"]) for i, r in left.items()}


@pytest.mark.parametrize("seed,legacy,block", [(1, False, 1 << 15), (2, True, 10), (3, False, 30)])
def test_batches_match_a_loop(spark, products, seed, legacy, block, monkeypatch):
    # Small blocks hand stock and rows that are named again from one to the next.
    monkeypatch.setattr(changes, "settle", functools.partial(admission.settle, block=block))
    rng = random.Random(seed)
    base = [(i, rng.choice("aab"), rng.choice(["BUY", "BUY", "SELL", "OPEN"]), rng.randint(1, 9), 2, None, "2024-03-01")
            for i in range(1, 13)]
    rows = []
    for seq in rng.sample(range(1000), 150):
        op = rng.choice(["INSERT", "UPDATE", "UPDATE", "UPDATE", "PATCH", "PATCH"] + ["DELETE"] * (rng.random() < 0.3))
        full = op in ("INSERT", "UPDATE")
        row = entry(seq, op=op, product_id=rng.choice("aab"), transaction_type=rng.choice(["BUY", "SELL", "OPEN"]),
                    quantity=rng.randint(1, 9) if full or rng.random() < 0.5 else None,
                    price_per_unit=money(rng.randint(1, 9)) if rng.random() < (0.9 if full else 0.4) else None,
                    notes=rng.choice([None, f"n{seq}"]))
        rows.append(row if op == "INSERT" else row | dict(transaction_id=rng.randint(1, 14)))
    outcomes, left = one_by_one(base, rows, legacy)
    changed = batch(spark, rows)
    got = changes.change_outcomes(tx(spark, base), changed, products)
    assert {r.seq: r.reason for r in got.collect()} == outcomes
    after = changes.apply_changes(tx(spark, base), changed, products, NOW, legacy_total=legacy).collect()
    assert {r.transaction_id: (r.quantity, r.price_per_unit, r.total_amount, r.notes) for r in after} == left
    assert {"insufficient_stock", None, "not_found"} <= set(outcomes.values())


@pytest.mark.parametrize("bits,levels", [(2, 0), (2, 1), (2, 2), (4, 3)])
def test_running_totals(spark, bits, levels):
    rng = random.Random(bits + levels)
    data = [("hot" if rng.random() < 0.6 else f"k{rng.randint(1, 3)}", s, rng.randint(-5, 9))
            for s in rng.sample(range(-500, 500), 150)]
    df = spark.createDataFrame(data, "k string, seq bigint, v bigint")
    got = {(r.k, r.seq): r.t for r in running_totals(df, ["k"], "seq", {"v": "t"}, bits, levels).collect()}
    assert got == {(k, s): sum(v for k2, s2, v in data if k2 == k and s2 < s) for k, s, _ in data}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sequential_admission_matches_a_loop(spark, seed):
    rng = random.Random(seed)
    base = [(i, rng.choice("abc"), "BUY", rng.randint(1, 20), 1, None, "2024-01-01") for i in range(6)]
    entries = [(2000, None, "SELL", 1, False), (2001, "a", "OPEN", None, False), (2002, None, "BUY", 1, False)]
    entries += [(s, "a" if rng.random() < 0.6 else rng.choice("abcd"), rng.choice(["BUY", "SELL", "SELL", "OPEN"]),
                rng.randint(1, 12), rng.random() < 0.8) for s in rng.sample(range(1000), 60)]
    stock = {}
    for row in base:
        stock[row[1]] = stock.get(row[1], 0) + row[3]
    expected = {}
    for s, product, kind, quantity, valid in sorted(entries, key=lambda e: e[0]):
        fits = kind == "BUY" or (None not in (product, quantity) and stock.get(product, 0) >= quantity)
        expected[s] = fits
        if fits and valid:
            stock[product] = stock.get(product, 0) + (quantity if kind == "BUY" else -quantity)
    df = spark.createDataFrame(entries, "seq bigint, product_id string, transaction_type string, quantity bigint, "
                                        "valid boolean")
    got = {r.seq: r.has_stock for r in admit_sequential(df, tx(spark, base), bits=3).collect()}
    assert got == expected
    assert False in expected.values() and True in expected.values()


@pytest.mark.parametrize("block", [50, 100_000])
def test_a_product_with_a_third_of_all_changes_is_walked_in_blocks(spark, block, monkeypatch):
    rng = random.Random(9)
    base = [(1, "hot", "BUY", 40, 1, None, "2024-01-01"), *((i, f"p{i}", "BUY", 9, 1, None, "2024-01-01") for i in range(2, 40))]
    events, stock, rows = [], {r[1]: r[3] for r in base}, {}
    for s in range(3000):
        product = "hot" if rng.random() < 0.4 else f"p{rng.randrange(2, 40)}"
        row = rng.randrange(5) * 1000 + int(product[1:] if product != "hot" else 0) if rng.random() < 0.3 else None
        if rng.random() < 0.35:
            events.append((s, product, row, 0, rng.randint(1, 9), 0, False, True))
        else:
            wanted = rng.randint(1, 12)
            events.append((s, product, row, 0, -wanted, wanted, True, rng.random() < 0.9))
    want = {}
    for s, product, row, _, after, wanted, checks, takes in events:
        own = rows.get((product, row), 0) if row is not None else 0
        want[s] = not checks or stock[product] - own >= wanted
        if want[s] and takes:
            stock[product] += after - own
            if row is not None:
                rows[product, row] = after
    walked, plain = [], admission._walked

    def counted(rows, starts, decide):
        walked.append((decide, rows.count()))
        return plain(rows, starts, decide)

    monkeypatch.setattr(admission, "_walked", counted)
    df = spark.createDataFrame(events, "seq bigint, product_id string, row bigint, own bigint, after bigint, quantity bigint, "
                                       "checks boolean, takes boolean")
    assert {r.seq: r.granted for r in admission.settle(df, tx(spark, base), bits=6, block=block).collect()} == want
    assert {True, False} == set(want.values()) and walked[-1][0]
    rounds = [n for decide, n in walked if not decide]
    # In blocks, only wrong guesses are walked again: fewer changes in every round, and fewer rounds than blocks.
    assert bool(rounds) == (block == 50) and rounds == sorted(rounds, reverse=True)
    assert block != 50 or (len(rounds) < rounds[0] / block and sum(rounds) < 5 * rounds[0])


def test_products_that_fit_a_task_are_walked_without_bounds(spark, monkeypatch):
    monkeypatch.setattr(admission, "running_totals", None)
    base = [(1, "a", "BUY", 5, 1, None, "2024-01-01"), (2, "a", "SELL", 2, 1, None, "2024-01-01")]
    # The refused sale of seq 2 hides nothing; row 2 gives its 2 pieces back at seq 3; nothing is known of product c.
    events = [(1, "a", None, 0, -1, 1, True, True), (2, "a", None, 0, -3, 3, True, True), (3, "a", 2, -2, 0, 0, False, True),
              (4, "a", None, 0, -4, 4, True, False), (5, "a", 2, -2, -4, 4, True, True), (6, "a", 2, -2, -9, 9, True, True),
              (7, "a", 1, 5, 4, 0, False, True), (8, "a", None, 0, -1, 1, True, True), (9, "c", None, 0, -1, 1, True, True),
              (10, "c", None, 0, 1, 0, False, True), (11, "c", None, 0, -1, 1, True, True), (None, "c", None, 0, 1, 0, False, True)]
    df = spark.createDataFrame(events, "seq bigint, product_id string, row bigint, own bigint, after bigint, quantity bigint, "
                                       "checks boolean, takes boolean")
    got = {r.seq: r.granted for r in admission.settle(df, tx(spark, base)).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: True, 6: False, 7: True, 8: False, 9: False, 10: True, 11: True}


def test_stock_and_events_meet_where_many_products_are_frequent(spark):
    base = [(i, f"p{i}", "BUY", 2, 1, None, "2024-01-01") for i in range(400)]
    events = [(i * 10 + n, f"p{i}", None, 0, -1, 1, True, True) for i in range(400) for n in range(3 + i % 4)]
    df = spark.createDataFrame(events, "seq bigint, product_id string, row bigint, own bigint, after bigint, quantity bigint, "
                                       "checks boolean, takes boolean")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "3000", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        settled = admission.settle(df, tx(spark, base), block=4)
        plan = settled._jdf.queryExecution().executedPlan().toString()
        got = {r.seq: r.granted for r in settled.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {seq: seq % 10 < 2 for seq, *_ in events}
    # The shuffle that brings them together is there though both come from joins by product.
    assert "hashpartitioning(xxhash64(product_id" in plan


def test_outcomes_of_products_that_the_catalogue_has_not_once(spark, products):
    base = [(1, "a", "BUY", 5, 1, None, "2024-01-01"), (2, "zz", "BUY", 5, 1, None, "2024-01-01"), (3, None, "BUY", 5, 1, None, "2024-01-01")]
    edit = lambda seq, i: entry(seq, op="UPDATE", transaction_id=i, product_id=None, transaction_type=None)
    rows = [edit(1, 1), edit(2, 2), edit(3, 3), entry(4), entry(5, product_id="zz"), entry(6, product_id=None), entry(7, product_id="b"),
            dict(seq=8, op="DELETE", transaction_id=2), dict(seq=9, op="Move", transaction_id=1)]
    twice = products.union(products.filter("product_id = 'a'"))
    lacks, odd = "unknown_product", "unknown_operation"
    for catalogue, copies in ((products, 1), (twice, 2)):
        got = changes.change_outcomes(tx(spark, base), batch(spark, rows), catalogue).collect()
        assert {(r.seq, r.op, r.transaction_id, r.reason) for r in got} == {
            (1, "UPDATE", 1, None), (2, "UPDATE", 2, lacks), (3, "UPDATE", 3, lacks), (4, "INSERT", None, None), (5, "INSERT", None, lacks),
            (6, "INSERT", None, lacks), (7, "INSERT", None, None), (8, "DELETE", 2, None), (9, "Move", 1, odd)}
        # As in a join with the catalogue every copy of a product counts, and a repeated seq meets all of its answers.
        # Only changes that move the stock have answers.
        assert {s: sum(r.seq == s for r in got) for s in range(1, 10)} == {s: {1: copies ** 2, 4: copies ** 2, 9: copies}.get(s, 1)
                                                                           for s in range(1, 10)}
    nothing = changes.change_outcomes(tx(spark, base), batch(spark, rows), products.limit(0)).collect()
    assert {r.seq: r.reason for r in nothing} == {1: None, 2: None, 3: None, 4: lacks, 5: lacks, 6: lacks, 7: lacks, 8: None, 9: odd}


def test_clamp(spark, products):
    df = spark.createDataFrame([(1, "a", D("2024-01-01")), (2, "a", D("2024-02-01")), (3, "b", D("2020-01-01")),
                                (4, "zz", D("2020-01-01"))], "n int, product_id string, input_date date")
    got = {r.n: (r.transaction_date, r.date_adjusted) for r in changes.clamp_to_earliest(df, products).collect()}
    assert got == {1: (D("2024-02-01"), True), 2: (D("2024-02-01"), False), 3: (D("2020-01-01"), False),
                   4: (D("2020-01-01"), False)}
    empty = changes.clamp_to_earliest(df, products.filter(F.lit(False)))
    assert not any(r.date_adjusted for r in empty.collect())
