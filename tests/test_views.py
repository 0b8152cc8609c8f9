"""The forms of the views that Spark runs, and how often the queries over them read and shuffle the tables."""

import re
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerspark import fixtures, registry
from ledgerspark.functions import state
from ledgerspark.operators import admission, changes

LINES = ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
         "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Few rows with nulls, copies, line numbers that reach into the next order and keys without a partner."""
    at = str(tmp_path_factory.mktemp("tables"))
    day = lambda n: datetime(1996, 1 + n % 12, 1 + n % 28)

    def put(name, schema, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    lines = [(o, p, 1, n, 5.0 + 7 * n, 10.5 * (o + n), 0.05 * (n % 2), 0.0, "NRA"[(o + n) % 3], "OF"[n % 2], day(o + n))
             for o in range(1, 7) for n in range(1, 5) for p in [1 + (o * n) % 4]]
    lines += [lines[3], (2, 3, 1, 13, 4.0, 9.0, 0.0, 0.0, "N", "F", day(3)), (9, 1, 1, 1, 4.0, 9.0, 0.0, 0.0, "R", "F", day(3)),
              (1, 9, 1, 9, 4.0, 9.0, 0.0, 0.0, "N", "O", day(4)), (None, 1, 1, 1, 4.0, 9.0, 0.0, 0.0, "N", "O", day(4)),
              (3, 1, 1, None, 4.0, 9.0, 0.0, 0.0, "N", "O", day(4)), (3, None, 1, 7, 4.0, 9.0, 0.0, 0.0, "N", "O", day(5)),
              (4, 2, None, 8, None, None, None, 0.0, None, None, None), (4, 2, 2, 8, 3.0, 6.0, 0.0, 0.0, "A", None, day(6))]
    put("lineitem", LINES, lines)
    put("orders", "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp, o_orderpriority string",
        [(1, 1, day(1), "5-LOW"), (2, 2, day(2), "1-URGENT"), (3, 1, day(2), None), (4, 2, None, "2-HIGH"), (5, None, day(5), "5-LOW"),
         (6, 1, day(9), "1-URGENT"), (6, 1, day(9), "1-URGENT"), (None, 1, day(1), "5-LOW")])
    put("customer", "c_custkey bigint, c_nationkey int, c_mktsegment string", [(1, 1, "BUILDING"), (2, 1, None), (None, 1, "X")])
    put("nation", "n_nationkey int, n_name string", [(1, "PERU"), (None, "CHAD")])
    put("part", "p_partkey bigint, p_name string, p_type string, p_brand string, p_size int, p_retailprice double",
        [(1, "a", "T", "Brand#1", 1, 1.0), (2, "b", "T", "Brand#2", 1, 1.0), (3, None, "T", "Brand#3", 1, 1.0),
         (4, "d", "T", "Brand#4", 1, 1.0), (5, "e", "T", "Brand#5", 1, 1.0), (None, "f", "T", "Brand#6", 1, 1.0)])
    return at


@pytest.mark.parametrize("name", sorted(fixtures.SHUFFLED))
def test_spark_form_has_the_rows_of_the_sql(spark, tables, name, monkeypatch):
    now = fixtures.view(spark, tables, name)
    monkeypatch.setattr(fixtures, "SHUFFLED", {})
    plain = fixtures.view(spark, tables, name)
    assert now.dtypes == plain.dtypes and plain.count() > 10
    assert now.exceptAll(plain).isEmpty() and plain.exceptAll(now).isEmpty()


def test_changes_over_a_stored_ledger(spark, tables):
    plain = fixtures.view(spark, tables, "changes")
    stored, = fixtures.views(spark, tables, ("changes",), often=("earliest", "ledger"))
    assert plain.count() > 10 and stored.exceptAll(plain).isEmpty() and plain.exceptAll(stored).isEmpty()
    assert "lineitem" not in _plan(stored)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# How often the plan reads the lines, and its shuffles when every join is shuffled.
@pytest.mark.parametrize("name,reads,shuffles", [("portfolio_summary", 1, 9), ("portfolio_summary_held", 1, 9), ("portfolio_return", 1, 9),
                                                 ("value_holdings", 3, 21), ("change_outcomes", 0, 9), ("admit_sequential", 0, 6)])
def test_tables_are_read_and_shuffled_seldom(spark, tables, name, reads, shuffles):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = _plan(registry.QUERIES[name](spark, tables))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(re.findall(r"FileScan.*l_orderkey", plan)) <= reads
    assert len(re.findall(r"Exchange hashpartitioning", plan)) <= shuffles


def test_change_outcomes_stores_and_moves_little(spark, tables, monkeypatch):
    plans, stored = [], []

    def cut(df):
        plans.append(_plan(df))
        stored.append(state.cut_lineage(df))
        return stored[-1]
    for module in (fixtures, admission, changes):
        monkeypatch.setattr(module, "cut_lineage", cut)
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        registry.QUERIES["change_outcomes"](spark, tables)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(plans) == len(stored) <= 8
    # The stored ledger has what the changes read of it, what the judged changes have is free of windows and stock.
    assert max(len(df.columns) for df in stored) <= 14 and "created_at" not in stored[1].columns
    assert sum(len(re.findall("Exchange hashpartitioning", p)) for p in plans) <= 30


def test_shuffle_files_go_when_their_rows_are_stored(spark):
    def files():
        every = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {f for f in every.split("\n") if "shuffle_" in f and f.endswith(".data")}
    setting, before = spark.conf.get(state._FREE), files()
    stored = state.cut_lineage(spark.range(1000).repartition(7).groupBy((F.col("id") % 10).alias("k")).count())
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and stored.count() == 10 and spark.conf.get(state._FREE) == setting
