"""Column types shared by every reader, operator and writer.

Ledger money is whole cents (``DECIMAL(18,2)``), so a sum never depends on the
order in which tasks deliver rows. Market prices keep six places while they are
multiplied and are rounded once, at the end.
"""

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
PRICE = T.DecimalType(18, 6)
QUANTITY = T.DecimalType(12, 0)
PROFIT = T.DecimalType(24, 6)

BUY, SELL, OPEN = "BUY", "SELL", "OPEN"

LEDGER = T.StructType([
    T.StructField("transaction_id", T.LongType()),
    T.StructField("product_id", T.StringType()),
    T.StructField("product_name", T.StringType()),
    T.StructField("transaction_type", T.StringType()),
    T.StructField("quantity", T.LongType()),
    T.StructField("price_per_unit", MONEY),
    T.StructField("total_amount", MONEY),
    T.StructField("transaction_date", T.DateType()),
    T.StructField("input_date", T.DateType()),
    T.StructField("date_adjusted", T.BooleanType()),
    T.StructField("notes", T.StringType()),
    T.StructField("purchase_method", T.StringType()),
    T.StructField("purchase_location", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

CHANGES = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("op", T.StringType()),
    T.StructField("transaction_id", T.LongType()),
    T.StructField("product_id", T.StringType()),
    T.StructField("transaction_type", T.StringType()),
    T.StructField("quantity", T.LongType()),
    T.StructField("price_per_unit", MONEY),
    T.StructField("input_date", T.DateType()),
    T.StructField("notes", T.StringType()),
    T.StructField("purchase_method", T.StringType()),
    T.StructField("purchase_location", T.StringType()),
])

SNAPSHOTS = T.StructType([
    T.StructField("product_id", T.StringType()),
    T.StructField("snapshot_date", T.DateType()),
    T.StructField("market_price", T.DoubleType()),
])

# Header names of the catalogue CSV, in file order.
CATALOGUE_CSV = ("productId", "name", "cleanName", "imageUrl", "modifiedOn",
                 "earliestDate", "set_code", "url")

PRODUCTS = T.StructType([
    T.StructField("product_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("clean_name", T.StringType()),
    T.StructField("image_url", T.StringType()),
    T.StructField("modified_on", T.DateType()),
    T.StructField("earliest_date", T.DateType()),
    T.StructField("set_code", T.IntegerType()),
    T.StructField("url", T.StringType()),
])

# Feed header name -> column name used by the operators.
FEED_COLUMNS = {
    "productId": "product_id",
    "name": "name",
    "cleanName": "clean_name",
    "imageUrl": "image_url",
    "url": "url",
    "modifiedOn": "modified_on",
    "marketPrice": "market_price",
    "extRarity": "ext_rarity",
    "extNumber": "ext_number",
}
