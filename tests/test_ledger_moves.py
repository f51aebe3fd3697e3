"""Ledgers move their rows once, and accounts of any size get the same balances."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from catalog import accounts
from tidepanel.operators import ledger as le
from tidepanel.session import stored, working_folder

DAY = dt.date(2020, 1, 1)


def _events(spark, seed=3, rows=400):
    rng = random.Random(seed)
    made = []
    for k in range(rows):
        account = rng.choice(["big", "big", "big", "small", "other", None])
        ticker = rng.choice(["AAA", "BBB", None])
        day = None if rng.random() < 0.05 else DAY + dt.timedelta(days=rng.randrange(9))
        made.append((account, ticker, day, rng.choice([0, 1, 2]), f"e{k}", None if rng.random() < 0.3 else rng.randrange(-50, 50)))
    return made, spark.createDataFrame(made, "account_id string, ticker string, event_date date, phase int, entry_id string, delta bigint")


def _plain(made, by):
    """Running sums by a walk; a day has none before its first known value."""
    want = {}
    whole = [r for r in made if all(r[k] is not None for k in by) and r[2] is not None]
    for group in {tuple(r[k] for k in by) for r in whole}:
        total, day, known = 0, None, False
        for r in sorted((r for r in whole if tuple(r[k] for k in by) == group), key=lambda r: (r[2], r[3], r[4])):
            known = known and r[2] == day
            day = r[2]
            if r[5] is not None:
                total, known = total + r[5], True
            want[r[4]] = total if known else None
    return want


@pytest.mark.parametrize("by", [[0], [0, 1]])
@pytest.mark.parametrize("together", [100_000, 120, 1])
def test_running_totals_at_any_size(spark, by, together):
    made, events = _events(spark)
    names = [events.columns[k] for k in by]
    got = le.running_totals(events, {"delta": "total"}, names, "event_date", ["phase", "entry_id"], together)
    assert got.columns == [*events.columns, "total"]
    assert {r["entry_id"]: r["total"] for r in got.collect()} == _plain(made, by)


def test_rows_of_a_ledger_are_moved_once(spark):
    _, events = _events(spark)
    got = le.running_totals(events, {"delta": "total"}, ["account_id"], "event_date", ["phase", "entry_id"])
    plan = got._jdf.queryExecution().sparkPlan().toString() + got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_own_prices_are_those_of_a_join(spark):
    rows = [
        (1, "a", "o1", 5, "2.5"), (1, "a", "o1", 7, "3"), (1, "a", "o1", 7, None), (1, "b", "o1", 2, "1"),
        (2, None, "o2", 1, "1"), (2, "a", None, 1, "1"), (3, "a", "o3", 4, None), (3, "a", "o4", None, "9"),
    ]
    orders = spark.createDataFrame(rows, "line int, account_id string, order_id string, requested_quantity bigint, price string").select(
        "*", F.lit("T").alias("ticker"), F.lit("BUY").alias("side"), F.lit(DAY).alias("intended_execution_date"), F.lit("PENDING").alias("status")
    )
    on = ["account_id", "order_id"]
    price = F.col("price").cast("decimal(18,6)")
    joined = le.price_executions(orders.drop("price"), orders.select(*on, price.alias("execution_price")), on)
    own = le.price_executions(orders, price, on, dealt_by=["line"])
    assert own.columns == joined.columns and own.dtypes == joined.dtypes
    assert sorted(map(repr, own.collect())) == sorted(map(repr, joined.collect())) and own.count() == 12


def _tables(spark, lines):
    folder = working_folder(spark, "tables")
    day = dt.datetime(2020, 1, 6)
    rows = [(k // 3, k % 5, 1, k % 7 + 1, float(k % 9 + 1), 10.0 * k + 10, day + dt.timedelta(days=k % 20)) for k in range(lines)]
    spark.createDataFrame(
        rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp"
    ).write.parquet(f"{folder}/lineitem.parquet")
    heads = [(k, k % 4, day + dt.timedelta(days=k % 30)) for k in range(lines // 3 + 1)]
    spark.createDataFrame(heads, "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(k, f"Brand#{k}") for k in range(5)], "p_partkey bigint, p_brand string").write.parquet(f"{folder}/part.parquet")
    return folder


def test_executions_move_the_lines_once(spark):
    executions = accounts._executions(spark, _tables(spark, 60))
    plan = executions._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 3 and plan.count("SortMergeJoin") == 1
    # Both sides of the merge lie by order key, nothing is moved by order id.
    assert plan.count("hashpartitioning(l_orderkey") == 2 and "hashpartitioning(account_id" not in plan
    assert executions.count() == 60 + sum(1 for k in range(60) if (k % 7 + 1) % 2 == 0 and k % 9 + 1 >= 2)


def test_totals_of_events_keep_balances_and_positions(spark):
    folder = _tables(spark, 90)
    events = le.account_events(accounts._trades(spark, folder), accounts._asof(spark, folder), accounts._deposits(spark, folder))
    totals = stored(le.event_totals(events), "totals")
    for read in (le.balances, le.share_positions):
        assert sorted(map(repr, read(totals).collect())) == sorted(map(repr, read(events).collect()))


def test_batch_status_counts_repeated_orders_and_ids(spark):
    batch = spark.createDataFrame(
        [("a", "e1", "o1"), ("a", "e1", "o1"), ("a", "e2", "o2"), (None, "e3", "o3"), ("a", "e4", "o4")], "account_id string, execution_id string, order_id string"
    )
    orders = spark.createDataFrame(
        [("a", "o1", "PENDING"), ("a", "o1", "EXECUTED"), ("a", "o2", None), ("a", "o2", "PENDING")], "account_id string, order_id string, status string"
    )
    row = le.batch_status(batch, batch.where("execution_id = 'e2'"), orders).first()
    assert (row["batch_rows"], row["distinct_ids"], row["known_rows"], row["missing_orders"], row["not_pending"]) == (8, 3, 2, 3, 2)
    empty = le.batch_status(batch.limit(0), batch, orders).first()
    assert tuple(empty)[:5] == (0, 0, 0, 0, 0) and empty["decision"] == "no_op"


def test_stored_rows_take_less_room_than_a_checkpoint(spark):
    rows = spark.range(20_000).select(F.concat(F.lit("execution-"), F.col("id").cast("string")).alias("a"), F.lit(1).cast("decimal(38,12)").alias("b"))
    kept = stored(rows)
    path = kept.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    size = sum(f.getLen() for f in spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(spark._jvm.org.apache.hadoop.fs.Path(path)))
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, rows.collect())) and size < 20_000 * 20
