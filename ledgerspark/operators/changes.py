"""Checking a batch of ledger changes and applying it.

A batch has one row per change: INSERT adds an entry, UPDATE replaces the editable
fields of a row, PATCH changes only the fields that are given, DELETE removes the row.
A batch is applied as if its changes came one after the other in ``seq`` order. The checks
of new entries alone (``validate_entries``, ``apply_inserts``) look at the ledger as stored
before the batch unless ``sequential=True``.
"""

from collections.abc import Callable
from datetime import datetime
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.cleaning import (is_blank, is_stock_out, round_price, signed_quantity)
from ledgerspark.functions.state import cut_lineage
from ledgerspark.operators.admission import admit_sequential, settle
from ledgerspark.operators.catalogue import lookup_product
from ledgerspark.operators.holdings import on_hand
from ledgerspark.operators.running import running_totals
from ledgerspark.schemas import BUY, CHANGES, LEDGER, MONEY, OPEN, QUANTITY, SELL

_EDITED = ("quantity", "price_per_unit", "total_amount", "transaction_date", "input_date", "date_adjusted",
           "notes", "purchase_method", "purchase_location")
_PATCHED = ("quantity", "price_per_unit", "notes", "purchase_method", "purchase_location")


def clamp_to_earliest(entries: DataFrame, products: DataFrame) -> DataFrame:
    """Add ``transaction_date`` (never before the product's first day) and ``date_adjusted``."""
    dated = entries.drop("transaction_date", "date_adjusted").join(
        products.select("product_id", "earliest_date"), "product_id", "left")
    return _dated(dated).drop("earliest_date")


def _dated(df: DataFrame) -> DataFrame:
    return (df.withColumn("transaction_date", F.greatest("input_date", "earliest_date"))
            .withColumn("date_adjusted", F.coalesce(F.col("input_date") < F.col("earliest_date"), F.lit(False))))


def normalize_entry(entries: DataFrame) -> DataFrame:
    """Field rules of a stored entry: rounded price and total, no price for OPEN, purchase
    details only for BUY, empty instead of missing notes."""
    kind = F.col("transaction_type")
    price = F.when(kind != OPEN, round_price(F.col("price_per_unit")))
    bought = kind == BUY
    return (entries.withColumn("price_per_unit", price)
            .withColumn("total_amount", _total(F.col("quantity"), F.col("price_per_unit")))
            .withColumn("purchase_method", F.when(bought, F.col("purchase_method")))
            .withColumn("purchase_location", F.when(bought, F.col("purchase_location")))
            .withColumn("notes", F.coalesce("notes", F.lit(""))))


def _total(quantity: Column, price: Column) -> Column:
    return (quantity.cast(QUANTITY) * price).cast(MONEY)


def _field_reasons(stock_reason: Column, known: Column) -> Column:
    """The first rule an entry breaks, null when it breaks none."""
    kind = F.col("transaction_type")
    complete = kind.isNotNull() & F.col("quantity").isNotNull() & F.col("input_date").isNotNull()
    method = F.col("purchase_method")
    return (F.when(~complete, "missing_field")
            .when(~known, "unknown_product")
            .when(~kind.isin(BUY, SELL, OPEN), "unknown_type")
            .when(stock_reason, "insufficient_stock")
            .when(kind.isin(BUY, SELL) & F.col("price_per_unit").isNull(), "missing_price")
            .when((kind == BUY) & (method.isNull() | (method == "")), "missing_method")
            .when((kind == BUY) & is_blank(F.col("purchase_location")), "missing_location"))


def oversell_flags(entries: DataFrame, ledger: DataFrame) -> DataFrame:
    """Add ``has_stock``: does the stored stock, without the entry's own row, cover it?

    An entry that names an existing ``transaction_id`` does not compete with itself.
    Purchases always pass. The stock has one row per product; entries of one very
    frequent product are spread by Spark's broadcast or skew join.
    """
    stock = on_hand(ledger)
    checked = entries.join(stock, "product_id", "left")
    available = F.coalesce("current_quantity", F.lit(0))
    if "transaction_id" in entries.columns:
        own = ledger.select("transaction_id", "product_id", signed_quantity().alias("own_quantity"))
        checked = checked.join(own, ["transaction_id", "product_id"], "left")
        available = available - F.coalesce("own_quantity", F.lit(0))
    passes = ~is_stock_out() | (available >= F.col("quantity"))
    return checked.select(*entries.columns, passes.alias("has_stock"))


def _validated(entries: DataFrame, products: DataFrame, ledger: DataFrame, sequential: bool) -> DataFrame:
    facts = lookup_product(entries, products)
    if sequential:
        valid = _field_reasons(F.lit(False), F.col("known")).isNull()
        checked = admit_sequential(facts.withColumn("valid", valid), ledger).drop("valid")
    else:
        checked = oversell_flags(facts.drop("transaction_id"), ledger)
    return checked.withColumn("reason", _field_reasons(~F.col("has_stock"), F.col("known")))


def validate_entries(entries: DataFrame, products: DataFrame, ledger: DataFrame,
                     sequential: bool = False) -> DataFrame:
    """One row per entry with the ``reason`` it is refused for, null when accepted."""
    names = [c for c in entries.columns if c != "transaction_id"]
    return _validated(entries, products, ledger, sequential).select(*names, "reason")


def _new_rows(accepted: DataFrame, ledger: DataFrame, entered_at: datetime) -> DataFrame:
    """Accepted entries as ledger rows, numbered on from the highest id in ``seq`` order."""
    highest = ledger.agg(F.coalesce(F.max("transaction_id"), F.lit(0).cast("bigint"))).scalar()
    numbered = running_totals(accepted.withColumn("one", F.lit(1).cast("bigint")), [], "seq", {"one": "earlier"})
    rows = (normalize_entry(_dated(numbered))
            .withColumn("transaction_id", highest + F.col("earlier") + 1)
            .withColumn("product_name", F.col("name"))
            .withColumn("created_at", F.lit(entered_at).cast("timestamp_ntz")))
    return rows.select("seq", *LEDGER.fieldNames())


def apply_inserts(ledger: DataFrame, entries: DataFrame, products: DataFrame, entered_at: datetime,
                  sequential: bool = False) -> DataFrame:
    """The ledger with the accepted entries appended."""
    checked = _validated(entries, products, ledger, sequential)
    rows = _new_rows(checked.filter(F.col("reason").isNull()), ledger, entered_at)
    return ledger.select(*LEDGER.fieldNames()).unionByName(rows.drop("seq"))


_OPS = ("UPDATE", "PATCH", "DELETE")


def _packed(edits: DataFrame) -> DataFrame:
    """``edits`` with one small number for their operation and for what the rules ask of price, date and purchase."""
    asked = (F.col("price_per_unit").isNotNull(), F.col("input_date").isNotNull(), F.col("purchase_method") != "",
             ~is_blank(F.col("purchase_location")))
    bits = [F.when(asks, 1 << i).otherwise(0) for i, asks in enumerate(asked)]
    bits += [F.when(F.col("op") == op, i << len(asked)).otherwise(0) for i, op in enumerate(_OPS, 1)]
    return edits.select("seq", "transaction_id", "quantity", sum(bits, F.lit(0)).cast("tinyint").alias("code"),
                        F.when(~F.col("op").isin(*_OPS), F.col("op")).alias("other_op"))


def _unpacked(edits: DataFrame) -> DataFrame:
    """The edits that ``_packed`` was given, with some value where it saw one."""
    there = (("price_per_unit", F.lit(0).cast(MONEY)), ("input_date", F.lit("2000-01-01").cast("date")), ("purchase_method", F.lit("x")),
             ("purchase_location", F.lit("x")))
    code = F.col("code").cast("int")
    ops = [F.when(F.shiftright(code, len(there)) == i, op) for i, op in enumerate(_OPS, 1)]
    return (edits.withColumns({c: F.when(code.bitwiseAND(1 << i) != 0, value) for i, (c, value) in enumerate(there)})
            .withColumns({"op": F.coalesce("other_op", *ops), "notes": F.lit(None).cast("string")}).drop("code", "other_op"))


def _known_products(products: DataFrame, *asking: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """``lookup_product`` without names and days, for rows whose products are those of ``asking``. What the catalogue has
    exactly once needs no lookup: only the products that it lacks or has several times are stored and joined."""
    found = products.groupBy("product_id").agg(F.count("*").cast("int").alias("times"))
    named = reduce(DataFrame.union, [rows.select("product_id") for rows in asking]).filter("product_id IS NOT NULL").distinct()
    odd = named.join(found, "product_id", "left").filter("times IS NULL OR times > 1")
    odd = cut_lineage(odd.select("product_id", F.explode(F.array_repeat(F.col("times").isNotNull(), F.coalesce("times", F.lit(1)))).alias("listed")))

    def lookup(rows: DataFrame) -> DataFrame:
        known = F.col("product_id").isNotNull() & F.coalesce("listed", F.lit(True))
        return rows.join(odd, "product_id", "left").withColumns({
            "name": F.lit(None).cast("string"), "earliest_date": F.lit(None).cast("date"), "known": known}).drop("listed")
    return lookup


def _judged(ledger: DataFrame, changes: DataFrame, products: DataFrame, reasons_only: bool = False) -> DataFrame:
    """Every change with the ``reason`` it is refused for, the changes taken in ``seq`` order.

    Product and type of an edit always come from the stored row. An edit of a row that an
    earlier change deleted, or that the stored ledger never had, is ``not_found``; so is
    one without an id. The ids that the batch's own inserts get cannot be named in it. With ``reasons_only``
    the values of the changes are lost on the way.
    """
    given = changes.select(*CHANGES.fieldNames())
    insert, named = F.coalesce(F.col("op") == "INSERT", F.lit(False)), F.col("transaction_id").isNotNull()
    none = F.lit(0).cast("bigint")
    edits = given.filter(~insert & named).drop("product_id", "transaction_type")
    inserts = given.filter(insert | ~named)
    lookup = _known_products(products, ledger, inserts) if reasons_only else partial(lookup_product, products=products)
    gone = edits.filter(F.col("op") == "DELETE").groupBy("transaction_id").agg(F.min("seq").alias("deleted_at"))
    # What an edit needs of its product comes with the few columns of its stored row: edits travel to their row only.
    stored = ledger.select("transaction_id", "product_id", "transaction_type", signed_quantity().alias("own"))
    stored = lookup(stored).drop("name")
    edits = (_packed(edits) if reasons_only else edits).join(stored, "transaction_id", "left").join(gone, "transaction_id", "left")
    edits = ((_unpacked(edits) if reasons_only else edits)
             .withColumn("found", F.col("own").isNotNull() & F.coalesce(F.col("seq") <= F.col("deleted_at"), F.lit(True)))
             .withColumn("known", F.coalesce("known", F.lit(False))).withColumn("name", F.lit(None).cast("string"))
             .drop("deleted_at"))
    # Rows without an id never meet the join: they would all share its null key.
    others = lookup(inserts.withColumn("transaction_id", F.lit(None).cast("bigint")).withColumn("own", none).withColumn("found", insert))
    update, whole = F.col("op") == "UPDATE", F.col("op").isin("INSERT", "UPDATE")
    # Without any catalogue there is nothing to check the product of a stored row against.
    no_catalogue = products.limit(1).agg(F.count("*") == 0).scalar()
    counted = F.col("quantity").isNotNull()

    def reason(lacks: Column) -> Column:
        return (F.when(~F.col("found"), "not_found")
                .when(whole, _field_reasons(lacks, F.col("known")))
                .when(F.coalesce(~F.col("op").isin("PATCH", "DELETE"), F.lit(True)), "unknown_operation"))

    def facts_of(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("known", F.col("known") | (update & no_catalogue))
        rules = F.when(whole, _field_reasons(F.lit(False), F.col("known")).isNull()).otherwise(F.col("op").isin("PATCH", "DELETE"))
        moves = F.col("found") & rules & ((F.col("op") == "DELETE") | counted)
        held = F.col("product_id").isNotNull()
        # What cannot be asked of the stock has none; all else is judged as if it had, and as if it had not.
        asked = held & F.col("seq").isNotNull()
        return (rows.withColumn("takes", F.coalesce(held & moves, F.lit(False)))
                .withColumn("checks", F.coalesce(held & whole & F.col("found") & counted & is_stock_out(), F.lit(False)))
                .withColumn("reason", reason(~asked & is_stock_out())).withColumn("refusal", reason(is_stock_out()))
                .withColumn("own", F.coalesce("own", none))
                .withColumn("after", F.when(F.col("op") == "DELETE", none).otherwise(signed_quantity()))
                .drop("found", "known"))

    facts = facts_of(edits).unionByName(facts_of(others))
    if reasons_only:
        facts = facts.select("seq", "op", "transaction_id", "product_id", "quantity", "own", "after", "checks", "takes", "reason", "refusal")
    facts = cut_lineage(facts)
    events = facts.filter("takes OR checks").select("seq", "product_id", F.col("transaction_id").alias("row"), "own", "after",
                                                    F.coalesce("quantity", none).alias("quantity"), "checks", "takes")
    return _ruled(facts.drop("own", "after", "takes"), cut_lineage(settle(events, ledger)))


def _ruled(facts: DataFrame, settled: DataFrame) -> DataFrame:
    """``facts`` with the answers of the stock worked into their reasons. Only changes that ask the stock travel to the
    refusals. A ``seq`` that comes several times meets all of its answers."""
    repeated = cut_lineage(settled.groupBy("seq").agg(F.count("*").alias("answers")).filter("answers > 1").select("seq"))
    once, twice = facts.join(repeated, "seq", "left_anti"), facts.join(repeated, "seq", "left_semi")
    refused = settled.filter(~F.col("granted"))
    asking = once.filter("checks").join(refused, "seq", "left")
    rows = (once.filter("NOT checks").withColumn("granted", F.lit(None).cast("boolean")).unionByName(asking)
            .unionByName(twice.join(settled.join(repeated, "seq", "left_semi"), "seq", "left")))
    return (rows.withColumn("reason", F.when(F.coalesce("granted", F.lit(True)), F.col("reason")).otherwise(F.col("refusal")))
            .drop("granted", "refusal", "checks"))


def _folded(accepted: DataFrame, legacy_total: bool) -> DataFrame:
    """One row per edited transaction with what its accepted edits leave behind.

    A replacement sets every field, a patch those it gives, so the last setting of a field
    is all that counts: ``new_<field>`` is a struct with it, null where the field was never
    set. ``touched`` says that a patch after the last replacement calls for a new total.
    The choices are made on the map side: an id that is edited over and over does not
    gather in one place.
    """
    update, patch = F.col("op") == "UPDATE", F.col("op") == "PATCH"
    full = normalize_entry(_dated(accepted.withColumn("given", F.struct(*_PATCHED))))
    given = lambda c: F.col(f"given.{c}")
    sets = {c: update | (patch & given(c).isNotNull()) if c in _PATCHED else update for c in _EDITED}
    value = {c: F.when(patch, given(c)).otherwise(F.col(c)) if c in _PATCHED else F.col(c) for c in _EDITED}
    last = {c: F.max_by(F.struct(value[c].alias("value")), F.when(sets[c], F.col("seq"))) for c in _EDITED}
    amounts = given("price_per_unit").isNotNull()
    if not legacy_total:
        amounts = amounts | given("quantity").isNotNull()
    folded = full.groupBy("transaction_id").agg(
        F.max(F.col("op") == "DELETE").alias("deleted"), F.max(F.when(update, F.col("seq"))).alias("updated_at"),
        F.max(F.when(patch & amounts, F.col("seq"))).alias("touched_at"),
        *[column.alias(f"new_{c}") for c, column in last.items()])
    later = F.col("updated_at").isNull() | (F.col("touched_at") > F.col("updated_at"))
    folded = folded.withColumn("touched", F.col("touched_at").isNotNull() & later)
    if not legacy_total:
        return folded.withColumn("counted", F.col("new_quantity"))
    # The total of the last priced patch comes from the quantity that was there before it.
    before = (full.join(folded.select("transaction_id", "touched_at"), "transaction_id")
              .filter(F.col("seq") < F.col("touched_at")).groupBy("transaction_id")
              .agg(last["quantity"].alias("counted")))
    return folded.join(before, "transaction_id", "left")


def _edited(ledger: DataFrame, judged: DataFrame, legacy_total: bool) -> DataFrame:
    """The ledger with the accepted edits of ``judged`` worked in."""
    good = judged.filter(F.col("reason").isNull() & F.col("op").isin("UPDATE", "PATCH", "DELETE"))
    joined = (ledger.select(*LEDGER.fieldNames()).join(_folded(good, legacy_total), "transaction_id", "left")
              .filter(~F.coalesce("deleted", F.lit(False))))

    def now(field: str, struct: str | None = None) -> Column:
        struct = struct or f"new_{field}"
        return F.when(F.col(struct).isNotNull(), F.col(f"{struct}.value")).otherwise(F.col(field))

    fresh = F.when(F.col("touched"), _total(now("quantity", "counted"), now("price_per_unit")))
    values = {c: now(c) for c in _EDITED} | {"total_amount": F.coalesce(fresh, now("total_amount"))}
    return joined.select(*[values.get(c, F.col(c)).alias(c) for c in LEDGER.fieldNames()])


def apply_edits(ledger: DataFrame, edits: DataFrame, products: DataFrame, legacy_total: bool = False) -> DataFrame:
    """The ledger after UPDATE, PATCH and DELETE changes, one after the other in ``seq`` order.

    ``legacy_total`` keeps the old habit of patches: a new price is multiplied with the
    quantity before the patch, and a new quantity leaves the total as it was.
    """
    return _edited(ledger, _judged(ledger, edits, products), legacy_total)


def apply_updates(ledger: DataFrame, updates: DataFrame, products: DataFrame) -> DataFrame:
    return apply_edits(ledger, updates.withColumn("op", F.lit("UPDATE")), products)


def apply_patches(ledger: DataFrame, patches: DataFrame, products: DataFrame,
                  legacy_total: bool = False) -> DataFrame:
    return apply_edits(ledger, patches.withColumn("op", F.lit("PATCH")), products, legacy_total)


def apply_deletes(ledger: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ledger without the given ids, and the ids it never had."""
    return (ledger.join(ids, "transaction_id", "left_anti"),
            ids.join(ledger, "transaction_id", "left_anti"))


def change_outcomes(ledger: DataFrame, changes: DataFrame, products: DataFrame) -> DataFrame:
    """(seq, op, transaction_id, reason) per change; a null reason means it took effect."""
    return _judged(ledger, changes, products, reasons_only=True).select("seq", "op", "transaction_id", "reason")


def apply_changes(ledger: DataFrame, changes: DataFrame, products: DataFrame, entered_at: datetime,
                  legacy_total: bool = False) -> DataFrame:
    """The ledger after the whole batch, as if its changes came one by one in ``seq`` order:
    every stock check sees what the accepted changes before it did, a refused change hides
    nothing, and nothing follows a delete."""
    judged = _judged(ledger, changes, products)
    rows = _new_rows(judged.filter((F.col("op") == "INSERT") & F.col("reason").isNull()), ledger, entered_at)
    return _edited(ledger, judged, legacy_total).unionByName(rows.drop("seq"))
