"""Column expressions that clean ids, prices, dates and ledger fields."""

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerspark.schemas import BUY, MONEY, OPEN, PRICE, PROFIT, SELL

# What counts as a number in a text price; the JVM parser alone would also take "1.5d".
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

# White space in the sense of Unicode, with the four ASCII separators.
_BLANKS = r"[\s\x1C-\x1F\p{IsWhite_Space}]+"


def strip(text: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(text, f"^{_BLANKS}|{_BLANKS}$", "")


def normalize_product_id(col: Column) -> Column:
    """Ids arrive as numbers or text; the engine only knows text."""
    return col.cast("string")


def clean_price(col: Column) -> Column:
    """A text price as a double; blank, ``NaN`` and unreadable values become null."""
    text = strip(col.cast("string"))
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def finite_price(col: Column) -> Column:
    """A numeric price with ``NaN`` turned into null."""
    return F.when(~F.isnan(col), col)


def round_price(col: Column) -> Column:
    """Half-up to cents. Going through six decimal places first makes 1.005 round to 1.01."""
    return F.round(col.cast(PROFIT), 2).cast(MONEY)


def is_blank(col: Column) -> Column:
    return col.isNull() | (strip(col) == "")


def is_sealed(rarity: Column, number: Column) -> Column:
    """Sealed goods carry neither a rarity nor a number."""
    def absent(col: Column) -> Column:
        return col.isNull() | col.isin("", "None")
    return absent(rarity) & absent(number)


def is_stock_out() -> Column:
    return F.col("transaction_type").isin(SELL, OPEN)


def signed_quantity() -> Column:
    """What a ledger row does to the sealed stock; unknown types do nothing."""
    return (F.when(F.col("transaction_type") == BUY, F.col("quantity"))
            .when(is_stock_out(), -F.col("quantity"))
            .otherwise(F.lit(0).cast("bigint")))


def to_cents(money: Column) -> Column:
    """Whole cents as a bigint. Sums of them are exact and several times cheaper than wide
    decimal sums; ANSI mode raises an error should one ever overflow. Amounts finer than a
    cent are rounded half-up, whatever their size.
    """
    return (money.cast(MONEY) * 100).cast("bigint")


def to_millionths(price: Column) -> Column:
    """A price in millionths as a bigint, rounded half-up at every size."""
    return (price.cast(PRICE) * 1_000_000).cast("bigint")


def unit_cents() -> Column:
    """quantity x unit price in cents."""
    return F.col("quantity") * to_cents(F.col("price_per_unit"))


def effective_cents() -> Column:
    """The recorded total, or quantity x unit price where none was recorded, in cents."""
    return F.coalesce(to_cents(F.col("total_amount")), unit_cents())


def from_cents(cents: Column) -> Column:
    return (cents * F.lit(Decimal("0.01"))).cast(MONEY)


def cents_as_double(cents: Column) -> Column:
    return cents.cast("double") / F.lit(100.0)


def local_date(instant: Column, zone: str = "America/Los_Angeles") -> Column:
    """The calendar day of an instant as seen in ``zone``, whatever zone the session has.

    Timestamps without a zone are taken as UTC.
    """
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    utc = (F.when(F.typeof(instant) == "timestamp_ntz", instant.cast("timestamp_ntz"))
           .otherwise(F.timestamp_add("MICROSECOND", F.unix_micros(instant.cast("timestamp")), epoch)))
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), utc))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Guarded division in doubles; 0 when there is nothing to divide by."""
    return F.when(denominator > 0, numerator.cast("double") / denominator.cast("double")).otherwise(0.0)
