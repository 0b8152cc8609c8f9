import json
import os
import shutil
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
import pytest
from helpers import D, prices, tx
from pyspark.sql import functions as F

from ledgerspark.functions.cleaning import clean_price, is_blank, local_date, strip, to_cents, to_millionths
from ledgerspark.operators import catalogue, snapshots, timeseries
from ledgerspark.plans import rebuild as plans
from ledgerspark.plans.incremental import PortfolioStore
from ledgerspark.sources import archive, feeds, files, tables
from ledgerspark.sources import catalogue as catalogue_files
from ledgerspark.sources import snapshots as snapshot_files
from ledgerspark.streaming.ingest import ingest_snapshots_stream


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as handle:
        handle.write(text)


HEADER = "productId,name,cleanName,imageUrl,url,modifiedOn,marketPrice,extRarity,extNumber"


@pytest.fixture
def feed(folder):
    put(f"{folder}/in/101/feed.csv", HEADER + "\n"
        '1,"Box, ""big""",Box big,i1,u1,2021-05-01T10:00:00,10.5,,\n'
        "1,Box again,Box,i1,u1,2021-05-01,99,,\n"
        "2,Card,Card,i2,u2,2022-01-01,3.25,Rare,12\n"
        "3,Old tin,Old tin,i3,u3,2019-12-31,5,,\n"
        "4,Odd date,Odd,i4,u4,someday,6,None,\n")
    put(f"{folder}/in/102/feed.csv", "marketPrice,productId,extNumber,extRarity,cleanName,imageUrl,modifiedOn,name\n"
        "n/a,5,,,Pack,i5,2020-01-01,Pack\n,6,None,None,Case,i6,2023-07-07,Case\n")
    put(f"{folder}/in/103/feed.csv", "productId,name,marketPrice\n7,Loose,1.5\n")
    return f"{folder}/in/*/feed.csv"


def test_feed_columns_are_matched_by_name(spark, feed):
    rows = {(r.set_code, r.product_id, r.name): r for r in feeds.read_price_feed_csv(spark, feed).collect()}
    assert rows[(101, "1", 'Box, "big"')].market_price == "10.5"
    assert rows[(102, "5", "Pack")].ext_rarity is None and rows[(102, "5", "Pack")].market_price == "n/a"
    assert rows[(103, "7", "Loose")].modified_on is None
    assert rows[(101, "4", "Odd date")].modified_on is None
    assert len(rows) == 8


def test_values_of_feeds_in_quotes_and_of_many_headers(spark, folder):
    put(f"{folder}/in/7/feed.csv", "\ufeffname, productId ,\"marketPrice\"\r\n\"a, \"\"b\"\"\nc\",1,3\r\n\r\n\"\",2\r\n,3,4,5,6\r\n")
    columns = ["productId", "name", "marketPrice"]
    for i in range(40):  # as many headers as files
        names = [*columns[i % 3:], *columns[:i % 3], f"extra{i}"]
        value = {"productId": str(1000 + i), "name": f"n{i}", "marketPrice": str(i)}
        put(f"{folder}/in/{100 + i}/feed.csv", ",".join(names) + "\n" + ",".join(value.get(n, "x") for n in names))
    put(f"{folder}/in/99/feed.csv", "productId,name\n")
    found = {(r.set_code, r.product_id): r for r in feeds.read_price_feed_csv(spark, f"{folder}/in/*/feed.csv").collect()}
    assert len(found) == 43
    assert all((found[100 + i, str(1000 + i)].name, found[100 + i, str(1000 + i)].market_price) == (f"n{i}", str(i)) for i in range(40))
    one, two, three = (found[7, str(k)] for k in (1, 2, 3))
    assert (one.name, one.market_price, one.clean_name) == ('a, "b"\nc', "3", None)
    assert (two.name, two.market_price, three.name, three.market_price) == ("", None, None, "4")
    assert one.row_no < two.row_no < three.row_no and one.feed_columns == ["name", "productId", "marketPrice"]


def test_catalogue_from_feeds(spark, feed, folder):
    frame = feeds.read_price_feed_csv(spark, feed)
    missing = catalogue.missing_columns(feeds.read_feed_headers(spark, feed)).collect()
    assert [(r.set_code, sorted(r.missing)) for r in missing] == \
        [(103, ["cleanName", "extNumber", "extRarity", "imageUrl", "modifiedOn"])]
    recent = {r.product_id for r in catalogue.recent_only(frame).collect()}
    assert recent == {"1", "2", "5", "6", "7"}
    plans.discover_catalogue(spark, feed, f"{folder}/catalogue", f"{folder}/ids")
    back = catalogue_files.read_products(spark, f"{folder}/catalogue")
    got = {(r.product_id, r.name, str(r.earliest_date), r.set_code) for r in back.collect()}
    assert got == {("1", 'Box, "big"', "2021-05-01", 101), ("1", "Box again", "2021-05-01", 101),
                   ("5", "Pack", "2020-01-01", 102), ("6", "Case", "2023-07-07", 102)}
    assert {r.product_id for r in catalogue_files.read_id_list(spark, f"{folder}/ids").collect()} == {"1", "5", "6"}
    counts = catalogue.sealed_counts(catalogue.require_columns(frame))
    assert {r.set_code: r.sealed_products for r in counts.collect()} == {101: 2, 102: 2}
    assert tuple(catalogue.sealed_totals(counts).first()) == (4, 2)


def test_missing_catalogue_is_empty(spark, folder):
    assert catalogue_files.read_products(spark, f"{folder}/none.csv").count() == 0


def test_catalogue_columns_are_found_by_name(spark, folder):
    put(f"{folder}/products.csv", "url,set_code,productId,name,earliestDate\nu,7,1,\"Box, big\",2024-01-02\n,x,2,,soon\n")
    got = {r.product_id: r for r in catalogue_files.read_products(spark, f"{folder}/products.csv").collect()}
    assert (got["1"].name, got["1"].set_code, got["1"].earliest_date, got["1"].clean_name) == ("Box, big", 7, D("2024-01-02"), None)
    assert (got["2"].set_code, got["2"].earliest_date) == (None, None)


def test_id_list_is_trimmed_and_distinct(spark, folder):
    put(f"{folder}/ids.txt", " 12 \n\n13\n12\n   \n14")
    assert sorted(r[0] for r in catalogue_files.read_id_list(spark, f"{folder}/ids.txt").collect()) == ["12", "13", "14"]


def test_daily_prices_end_to_end(spark, feed, folder):
    catalogue_files.write_products_csv(
        spark.createDataFrame([("1", 101), ("3", 101), ("6", 102), ("7", 103), ("8", 999)],
                              "product_id string, set_code int")
        .selectExpr("product_id", "'n' name", "'c' clean_name", "'' image_url", "'2021-01-01' modified_on",
                    "'2021-01-01' earliest_date", "set_code", "'' url"), f"{folder}/catalogue")
    table = f"{folder}/prices"
    stats = plans.collect_daily_prices(spark, feed, f"{folder}/catalogue", table, D("2024-01-01")).first()
    stored = {r.product_id: r.market_price for r in snapshot_files.read_snapshot_table(spark, table).collect()}
    # The first feed row of a product counts; an old row and a set without a feed give no price.
    assert stored == {"1": 10.5, "3": None, "6": None, "7": 1.5, "8": None}
    assert (stats.total_rows, stats.valid_rows, stats.median_price) == (5, 2, 6.0)


def test_archive_backfill(spark, folder):
    def day(date, set_code, body):
        put(f"{folder}/arc/{date}/3/{set_code}/prices", body if isinstance(body, str) else json.dumps(body))
    day("2024-01-01", 11, {"results": [{"productId": 1, "marketPrice": 2.5}, {"productId": 1, "marketPrice": 9},
                                       {"productId": 2, "marketPrice": "3.75"}, {"productId": 5, "marketPrice": 1}]})
    day("2024-01-01", 12, {"results": [{"productId": 3, "marketPrice": None}, {"productId": 4, "marketPrice": ""}]})
    day("2024-01-02", 11, {"results": "none"})
    day("2024-01-03", 11, {"other": 1})
    day("2024-01-04", 11, {"results": [{"productId": 9, "marketPrice": 1}]})
    put(f"{folder}/ids.txt", "1\n2\n3\n4\n")
    rows = archive.read_price_archive_json(spark, f"{folder}/arc")
    assert rows.count() == 7
    table = f"{folder}/prices"
    plans.backfill_prices(spark, f"{folder}/arc", f"{folder}/ids.txt", table)
    stored = snapshot_files.read_snapshot_table(spark, table)
    assert {(str(r.snapshot_date), r.product_id): r.market_price for r in stored.collect()} == {
        ("2024-01-01", "1"): 2.5, ("2024-01-01", "2"): 3.75, ("2024-01-01", "3"): None, ("2024-01-01", "4"): None}
    missing = snapshots.missing_snapshot_dates(stored, D("2023-12-31"), D("2024-01-02"))
    assert sorted(str(r[0]) for r in missing.collect()) == ["2023-12-31", "2024-01-02"]


def test_snapshot_files_with_both_id_types(spark, folder):
    pd.DataFrame({"productId": ["1", "2"], "marketPrice": [1.5, None]}).to_parquet(
        f"{folder}/market_prices_2024-01-01.parquet")
    pd.DataFrame({"productId": [1, 3], "marketPrice": [2.5, float("nan")]}, index=[4, 7]).to_parquet(
        f"{folder}/market_prices_2024-01-02.parquet")
    pd.DataFrame({"productId": ["1"], "marketPrice": [9.0]}).to_parquet(f"{folder}/market_prices_latest.parquet")
    pd.DataFrame({"productId": ["1"], "marketPrice": [9.0]}).to_parquet(f"{folder}/other_2024-01-03.parquet")
    got = {(r.product_id, str(r.snapshot_date)): r.market_price
           for r in snapshot_files.read_price_snapshots(spark, folder).collect()}
    assert got == {("1", "2024-01-01"): 1.5, ("2", "2024-01-01"): None, ("1", "2024-01-02"): 2.5,
                   ("3", "2024-01-02"): None}


def test_snapshot_files_count_the_first_row_and_skip_other_names(spark, folder):
    pd.DataFrame({"productId": ["1", "1", "2"], "marketPrice": [None, 8.0, 3.0]}).to_parquet(
        f"{folder}/market_prices_2024-01-01.parquet")
    pd.DataFrame({"other": [1]}).to_parquet(f"{folder}/market_prices_backup.parquet")
    rows = snapshot_files.read_price_snapshots(spark, folder)
    assert sorted((r.product_id, r.market_price) for r in rows.collect()) == [("1", None), ("2", 3.0)]


def test_snapshots_are_skipped_or_replaced_by_day(spark, folder):
    table = f"{folder}/prices"
    snapshot_files.write_price_snapshot(prices(spark, [("a", "2024-01-01", 1), ("b", "2024-01-01", 2)]), table)
    more = prices(spark, [("a", "2024-01-01", 5), ("a", "2024-01-02", 6)])
    snapshot_files.write_price_snapshot(more, table)
    read = lambda: sorted((r.product_id, str(r.snapshot_date), r.market_price)
                          for r in snapshot_files.read_snapshot_table(spark, table).collect())
    assert read() == [("a", "2024-01-01", 1), ("a", "2024-01-02", 6), ("b", "2024-01-01", 2)]
    snapshot_files.write_price_snapshot(more, table, force=True)
    assert read() == [("a", "2024-01-01", 5), ("a", "2024-01-02", 6)]


def test_tables_are_replaced_and_cleared(spark, folder):
    root = f"{folder}/ledger"
    assert tables.read_ledger(spark, root).count() == 0
    ledger = tx(spark, [(1, "a", "BUY", 2, 5, 10, "2024-01-05")])
    assert tables.replace_table(ledger, root) == 1
    assert tables.replace_table(tables.read_ledger(spark, root).withColumn("quantity", F.lit(3)), root) == 2
    assert tables.read_ledger(spark, root).first().quantity == 3
    # A version whose write did not come to its end is not read, and written over.
    shutil.copytree(f"{root}/version=2", f"{root}/version=3", ignore=lambda _, names: {n for n in names if "_SUCCESS" in n})
    assert tables.newest_version(spark, root) == 2
    tables.replace_table(ledger.filter("false"), root)
    assert tables.newest_version(spark, root) == 3
    assert tables.read_ledger(spark, root).count() == 0


def test_upsert(spark):
    base = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    change = spark.createDataFrame([("z", 2), ("w", 3)], "v string, k int")
    assert sorted(map(tuple, tables.upsert_by_key(base, change, ["k"]).collect())) == [(1, "x"), (2, "z"), (3, "w")]
    base = spark.createDataFrame([(None, "x"), (2, "y")], "k int, v string")
    change = spark.createDataFrame([(None, "z")], "k int, v string")
    assert sorted(tables.upsert_by_key(base, change, ["k"]).collect(), key=repr) == [(2, "y"), (None, "z")]


def test_rebuild_tables(spark, folder):
    tables.replace_table(tx(spark, [(1, "a", "BUY", 2, 5, 10, "2024-01-05")]), f"{folder}/ledger")
    snapshot_files.write_price_snapshot(prices(spark, [("a", "2024-01-06", 7)]), f"{folder}/prices")
    summary = plans.rebuild_tables(spark, f"{folder}/ledger", f"{folder}/prices", f"{folder}/out", D("2024-01-07"))
    assert (summary.first().current_market_value, summary.first().unrealized_pnl) == (14, 4)
    assert tables.read_table(spark, f"{folder}/out/daily").count() == 3


def test_collect_and_rebuild(spark, feed, folder):
    catalogue_files.write_products_csv(
        spark.sql("SELECT '1' product_id, 'n' name, 'c' clean_name, '' image_url, '2021-01-01' modified_on,"
                  " '2021-01-01' earliest_date, 101 set_code, '' url"), f"{folder}/catalogue")
    tables.replace_table(tx(spark, [(1, "1", "BUY", 2, 5, 10, "2024-01-05")]), f"{folder}/ledger")
    summary = plans.collect_and_rebuild(spark, feed, f"{folder}/catalogue", f"{folder}/prices", f"{folder}/ledger",
                                        f"{folder}/out", D("2024-01-06"))
    assert (summary.first().current_market_value, summary.first().unrealized_pnl) == (21, 11)


def test_stream_carries_on_into_the_daily_values(spark, folder):
    source, table, state = f"{folder}/in", f"{folder}/prices", f"{folder}/state"
    ledger = tx(spark, [(1, "1", "BUY", 2, 5, 10, "2024-01-01"), (2, "2", "BUY", 3, 1, 3, "2024-01-02"), (3, "1", "SELL", 1, 9, 9, "2024-01-04")])
    store = PortfolioStore(spark, f"{folder}/store", 3)
    store.apply_ledger(ledger)

    def run(name, rows, modified):
        os.makedirs(os.path.dirname(f"{source}/{name}"), exist_ok=True)
        pd.DataFrame(rows, columns=["productId", "marketPrice"]).to_parquet(f"{folder}/tmp.parquet")
        shutil.copyfile(f"{folder}/tmp.parquet", f"{source}/{name}")
        os.utime(f"{source}/{name}", (modified, modified))
        assert ingest_snapshots_stream(spark, source, table, state, store=store).awaitTermination(120)
        whole = timeseries.daily_portfolio_value(ledger, snapshot_files.read_snapshot_table(spark, table), D("2024-01-09"))
        assert sorted(map(tuple, store.daily(D("2024-01-09")).collect())) == sorted(map(tuple, whole.collect()))
        return {str(r.date): float(r.total_market_value) for r in whole.collect()}

    run("a/market_prices_2024-01-03.parquet", [("1", 7.0), ("2", 2.0)], 1_700_000_000)
    assert run("a/market_prices_2024-01-05.parquet", [("1", 8.0), ("2", 3.0)], 1_700_000_100)["2024-01-05"] == 17
    # A day that arrives late, and one that is sent again without a product it had.
    assert run("b/market_prices_2024-01-02.parquet", [("2", 1.5)], 1_700_000_200)["2024-01-02"] == 4.5
    assert run("c/market_prices_2024-01-05.parquet", [("1", 4.0)], 1_700_000_300)["2024-01-05"] == 10


def test_stream_takes_each_file_once_and_replaces_days(spark, folder):
    source, table, state = f"{folder}/in", f"{folder}/prices", f"{folder}/state"

    def arrive(name, rows, modified):
        os.makedirs(os.path.dirname(f"{source}/{name}"), exist_ok=True)
        pd.DataFrame(rows, columns=["productId", "marketPrice"]).to_parquet(f"{folder}/tmp.parquet")
        shutil.copyfile(f"{folder}/tmp.parquet", f"{source}/{name}")
        os.utime(f"{source}/{name}", (modified, modified))

    def run(max_files=None):
        query = ingest_snapshots_stream(spark, source, table, state, max_files)
        assert query.awaitTermination(120)
        return sorted((r.product_id, str(r.snapshot_date), r.market_price)
                      for r in snapshot_files.read_snapshot_table(spark, table).collect())

    arrive("one/market_prices_2024-01-01.parquet", [("1", 1.0), ("1", 8.0), ("2", float("nan"))], 1_700_000_000)
    arrive("one/market_prices_notes.parquet", [("1", 1.0)], 1_700_000_000)
    first = [("1", "2024-01-01", 1.0), ("2", "2024-01-01", None)]
    assert run() == first
    assert run() == first
    arrive("two/market_prices_2024-01-01.parquet", [("1", 3.0)], 1_700_000_100)
    arrive("three/market_prices_2024-01-01.parquet", [("1", 2.0)], 1_700_000_050)
    arrive("two/market_prices_2023-12-31.parquet", [("1", 0.5)], 1_700_000_100)
    assert run() == [("1", "2023-12-31", 0.5), ("1", "2024-01-01", 3.0)]
    # Integer ids, one file a batch, and a file that comes last but is older than what is stored.
    arrive("four/market_prices_2024-01-02.parquet", [(5, 1.0), (6, 2.0)], 1_700_000_300)
    arrive("five/market_prices_2024-01-02.parquet", [("5", 9.0)], 1_700_000_200)
    arrive("six/market_prices_2024-01-01.parquet", [("1", 7.0)], 1_700_000_060)
    assert run(1) == [("1", "2023-12-31", 0.5), ("1", "2024-01-01", 3.0), ("5", "2024-01-02", 1.0), ("6", "2024-01-02", 2.0)]


def test_clean_price(spark):
    probes = ["1.5", " 2 ", "", "NaN", "abc", "1.5d", "1e2", "-.5", None, "inf", "1,5"]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in probes], "p string")
           .select(clean_price(F.col("p"))).collect()]
    assert got == [1.5, 2.0, None, None, None, None, 100.0, -0.5, None, None, None]


def test_local_date(spark):
    df = spark.createDataFrame([(datetime(2024, 7, 1, 6, 59),), (datetime(2024, 7, 1, 7, 0),),
                                (datetime(2024, 1, 1, 7, 59),)], "t timestamp_ntz")
    got = [str(r[0]) for r in df.select(local_date(F.col("t"))).collect()]
    assert got == ["2024-06-30", "2024-07-01", "2023-12-31"]


def test_amounts_are_rounded_alike_at_every_size(spark):
    given = [0.125, 2.675, 99999999999.125, 12345678901234.375, -0.125]
    got = spark.createDataFrame([(x,) for x in given], "x double").select(to_cents(F.col("x"))).collect()
    want = [int(Decimal(repr(x)).quantize(Decimal("0.01"), ROUND_HALF_UP) * 100) for x in given]
    assert [r[0] for r in got] == want
    given = ["0.0000005", "1000000001.0000005"]
    got = spark.createDataFrame([(Decimal(x),) for x in given], "x decimal(20,7)").select(to_millionths(F.col("x"))).collect()
    assert [r[0] for r in got] == [1, 1_000_000_001_000_001]


def test_snapshot_stats_median(spark):
    rows = [("a", "2024-01-01", v) for v in (1.1, 1.2, 5, 5, 5)] + [("a", "2024-01-02", v) for v in (3, 1, None, 10, 2.5)] \
        + [("a", "2024-01-03", None), ("b", "2024-01-03", None)]
    got = {str(r.snapshot_date): r for r in snapshots.snapshot_stats(prices(spark, rows)).collect()}
    assert (got["2024-01-01"].median_price, got["2024-01-02"].median_price) == (5.0, 2.75)
    assert (got["2024-01-02"].valid_rows, got["2024-01-02"].max_price) == (4, Decimal("10.000000"))
    assert (got["2024-01-03"].valid_rows, got["2024-01-03"].median_price, got["2024-01-03"].mean_price) == (0, None, None)


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles", "Asia/Tokyo"])
def test_local_date_in_any_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        days = spark.range(1).select(local_date(F.timestamp_seconds(F.lit(1704189600))).alias("day"),  # 2024-01-02 10:00 UTC
                                     local_date(F.timestamp_seconds(F.lit(1704178800))).alias("before")).collect()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [str(d) for d in days] == ["2024-01-02", "2024-01-01"]


def test_strip_knows_all_white_space(spark):
    df = spark.createDataFrame([("\t a b \n",), ("\u00a0\u2003x\u2028",), (" \t\u00a0",), ("\x1cy",)], "t string")
    assert [r[0] for r in df.select(strip(F.col("t"))).collect()] == ["a b", "x", "", "y"]
    assert [r[0] for r in df.select(is_blank(F.col("t"))).collect()] == [False, False, True, False]


def test_one_of_two_writers_fails_and_old_versions_go(spark, folder):
    root, ledger = f"{folder}/ledger", tx(spark, [(1, "a", "BUY", 2, 5, 10, "2024-01-05")])
    assert tables.replace_table(ledger, root, based_on=0) == 1
    more = ledger.withColumn("quantity", F.lit(7))

    def write(quantity):
        try:
            return tables.replace_table(ledger.withColumn("quantity", F.lit(quantity)), root, based_on=1)
        except tables.VersionTaken:
            return None

    with ThreadPoolExecutor(4) as pool:
        outcomes = list(pool.map(write, [11, 12, 13, 14]))
    assert [v for v in outcomes if v] == [2]
    assert tables.read_ledger(spark, root).first().quantity == 11 + outcomes.index(2)
    with pytest.raises(tables.VersionTaken):
        tables.replace_table(more, root, based_on=1)
    # Writers that do not say what they build on come one after the other.
    with ThreadPoolExecutor(3) as pool:
        assert sorted(pool.map(lambda q: tables.replace_table(more, root), range(3))) == [3, 4, 5]
    assert tables.replace_table(more, root, keep=1) == 6
    assert sorted(os.listdir(root)) == ["version=6"] and tables.read_ledger(spark, root).first().quantity == 7
    # The rename is what decides: whoever comes second does not touch the first one's folder.
    for name in ("one", "two"):
        more.write.parquet(f"{root}/_writing-{name}")
    assert files.move_folder(spark, f"{root}/_writing-one", f"{root}/version=7")
    assert not files.move_folder(spark, f"{root}/_writing-two", f"{root}/version=7")
    assert tables.read_ledger(spark, root).count() == 1


def test_an_upsert_leaves_untouched_buckets_alone(spark, folder):
    table = tables.BucketTable(spark, f"{folder}/t", "product_id string, n bigint, v string", ("product_id",), 8)

    def names():
        return {d: sorted(f for f in os.listdir(f"{folder}/t/{d}") if f.startswith("part")) for d in os.listdir(f"{folder}/t") if "=" in d}

    def rows():
        return sorted(tuple(r)[:3] for r in table.read().collect())

    data = {(f"p{i % 20}", i): "old" for i in range(100)}
    assert table.read().count() == 0
    table.upsert(spark.createDataFrame([(*k, v) for k, v in data.items()], "product_id string, n bigint, v string"), ["product_id", "n"])
    before = names()
    assert rows() == sorted((*k, v) for k, v in data.items()) and len(before) == 8
    change = {("p3", 3): "new", ("p3", 1000): "new"}
    touched = table.upsert(spark.createDataFrame([(v, *reversed(k)) for k, v in change.items()], "v string, n bigint, product_id string"),
                           ["product_id", "n"], deleted=spark.createDataFrame([("p4", 4), ("p4", 5)], "product_id string, n bigint"))
    del data["p4", 4]
    assert rows() == sorted((*k, v) for k, v in (data | change).items()) and 1 <= len(touched) <= 2
    now = names()
    assert {b for b in now if now[b] != before[b]} == {f"bucket={b}" for b in touched}
    # A bucket that is emptied is gone; nothing else moves.
    gone = table.read([touched[0]]).select("product_id", "n")
    table.upsert(table.read().limit(0), ["product_id", "n"], deleted=gone)
    assert table.read([touched[0]]).count() == 0 and f"bucket={touched[0]}" not in names()
    assert table.read([touched[0]]).columns == ["product_id", "n", "v", "bucket"]
