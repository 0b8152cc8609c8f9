"""Small ledgers and an independent, loop-by-loop model of the portfolio arithmetic."""

import random
from datetime import date, datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal

from ledgerspark.schemas import LEDGER

D = date.fromisoformat


def money(value) -> Decimal | None:
    return None if value is None else Decimal(str(value)).quantize(Decimal("0.01"), ROUND_HALF_UP)


def tx(spark, rows):
    """Ledger from (id, product, type, quantity, price, total, date[, name[, created_at]])."""
    full = []
    for row in rows:
        i, product, kind, quantity, price, total, day, *more = row
        name = more[0] if more else f"name {product}"
        created = more[1] if len(more) > 1 else datetime(2024, 1, 1)
        full.append((i, product, name, kind, quantity, money(price), money(total), D(day), D(day), False, None,
                     None, None, created))
    return spark.createDataFrame(full, LEDGER)


def prices(spark, rows):
    return spark.createDataFrame([(p, D(d), None if v is None else float(v)) for p, d, v in rows],
                                 "product_id string, snapshot_date date, market_price double")


def random_case(seed, n=50):
    """Random ledger and price rows in the short form the builders above take."""
    rng = random.Random(seed)
    start = date(2024, 3, 1)
    ledger = []
    for i in range(1, n + 1):
        kind = rng.choice(["BUY", "BUY", "BUY", "SELL", "OPEN", "GIFT"])
        price = None if kind == "OPEN" or rng.random() < 0.1 else rng.randint(100, 9999) / 100
        quantity = rng.randint(1, 9)
        total = None if price is None or rng.random() < 0.4 else round(price * quantity, 2)
        day = start + timedelta(days=rng.randint(0, 25))
        ledger.append((i, f"p{rng.randint(1, 4)}", kind, quantity, price, total, day.isoformat()))
    quotes = {}
    for _ in range(60):
        day = start + timedelta(days=rng.randint(-5, 35))
        quotes[(f"p{rng.randint(1, 5)}", day.isoformat())] = rng.choice([None, rng.randint(0, 9999) / 100])
    return ledger, [(p, d, v) for (p, d), v in quotes.items()]


def model(ledger, quotes, as_of):
    """Per calendar day: cost, market value and running realized profit, plus the dense cost rows."""
    first = min(r[6] for r in ledger)
    days = sorted(d for d in {r[6] for r in ledger} | {q[1] for q in quotes} | {as_of} if d >= first)
    price_of = {(p, d): v for p, d, v in quotes}
    series, dense, realized = [], [], Decimal(0)

    def amount(row):
        if row[5] is not None:
            return money(row[5])
        return Decimal(0) if row[4] is None else money(row[4]) * row[3]

    for day in days:
        cost, market = Decimal(0), Decimal(0)
        for product in sorted({r[1] for r in ledger if r[6] <= day}):
            rows = [r for r in ledger if r[1] == product and r[6] <= day]
            bought, sold, opened = ([r for r in rows if r[2] == k] for k in ("BUY", "SELL", "OPEN"))
            stock = sum(r[3] for r in bought) - sum(r[3] for r in sold) - sum(r[3] for r in opened)
            basis = sum(map(amount, bought), Decimal(0)) - sum(map(amount, sold), Decimal(0))
            cost += basis
            dense.append((product, day, float(basis), stock))
            seen = [price_of[(product, d)] for d in days if d <= day and price_of.get((product, d)) is not None]
            if stock > 0 and seen:
                market += stock * Decimal(str(seen[-1]))
        for row in ledger:
            if row[6] == day and row[2] == "SELL":
                buys = [r for r in ledger if r[1] == row[1] and r[2] == "BUY" and r[6] <= day]
                quantity = sum(r[3] for r in buys)
                spent = sum((money(r[4]) * r[3] for r in buys if r[4] is not None), Decimal(0))
                realized += amount(row) - row[3] * (spent / quantity if quantity else Decimal(0))
        series.append((day, float(money(cost)), float(money(market)), float(money(market - cost)), float(realized)))
    return series, dense
