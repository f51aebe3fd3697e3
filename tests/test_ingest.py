from __future__ import annotations

import datetime as dt

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tests.helpers import days, price_panel
from tidepanel.operators import ingest
from tidepanel.operators import quality as qu
from tidepanel.schemas import BAR_COLUMNS, BAR_SCHEMA
from tidepanel.sources import bars as sb
from tidepanel.sources import tables
from tidepanel.streaming import incremental as inc


def _bars(spark, count=20, tickers=2):
    return spark.createDataFrame(price_panel(tickers, count)).select(*BAR_COLUMNS)


def _universe(spark):
    return spark.createDataFrame([("T00",), ("T01",)], "ticker string")


def test_csv_scan_normalises_and_fails_on_bad_numbers(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text(" Date ,Ticker,open,high,low,close,adjusted_close,volume,VALUE_TRADED\n2020-01-02, abc ,1,2,0.5,1.5,1.5,,NaN\n")
    row = sb.read_bars_csv(spark, str(good)).first()
    assert row["ticker"] == "ABC" and row["volume"] is None and row["value_traded"] is None
    bad = tmp_path / "bad.csv"
    bad.write_text("date,ticker,open,high,low,close,adjusted_close,volume,value_traded\n2020-01-02,A,x,2,0.5,1.5,1.5,1,1\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        sb.read_bars_csv(spark, str(bad)).collect()
    short = tmp_path / "short.csv"
    short.write_text("date,ticker\n2020-01-02,A\n")
    with pytest.raises(ValueError, match="adjusted_close"):
        sb.read_bars_csv(spark, str(short))


def test_provider_rows_default_missing_columns(spark):
    raw = spark.createDataFrame([("2020-01-02", "1", "2", "0.5", "oops", "10")], "time string, open string, high string, low string, close string, volume string")
    row = sb.normalise_provider_rows(raw, "abc", strict=False).first()
    assert row["close"] is None and row["ticker"] == "ABC" and row["date"] == dt.date(2020, 1, 2)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        sb.normalise_provider_rows(raw, "abc").collect()


def test_numeric_text_columns_are_cast_when_they_can_be(spark):
    frame = spark.createDataFrame([("A", "1.5", "x"), ("B", None, "2")], "ticker string, a string, b string")
    got = sb.numeric_columns(frame)
    assert dict(got.dtypes) == {"ticker": "string", "a": "double", "b": "string"}


def test_copies_are_counted_once_and_expanded(spark):
    d = days(3)
    row = (d[1], "A", 1.0, 2.0, 0.5, 1.0, 1.0, 10, 10.0)
    rows = [(d[0], *row[1:6], 1.0, 10, 10.0), *[row] * 2500, (d[2], *row[1:6], 2.0, 0, 10.0)]
    issues = qu.data_issues(spark.createDataFrame(rows, BAR_SCHEMA))
    counts = {r["issue"]: r["copies"] for r in issues.groupBy("issue").agg(F.sum("copies").alias("copies")).collect()}
    assert counts == {
        "duplicate_ticker_date": 2500, "stale_adjusted_close": 2501, "suspicious_adjusted_close_jump": 1, "non_positive_volume": 1,
    }
    assert qu.expand_copies(issues).where("issue = 'duplicate_ticker_date'").count() == 2500


def test_row_rules(spark):
    d = days(1)[0]
    rows = [
        (d, "A", 5.0, 4.0, 4.5, 4.2, 4.2, 1, 1.0),
        (d, "B", 1.0, 2.0, 0.5, 3.0, -1.0, 1, 0.0),
        (d, "C", None, 2.0, 0.5, 1.0, 1.0, None, 1.0),
    ]
    got = sorted((r["ticker"], r["issue"]) for r in qu.data_issues(spark.createDataFrame(rows, BAR_SCHEMA)).collect())
    assert got == [
        ("A", "close_outside_daily_range"), ("A", "high_below_low"), ("A", "open_outside_daily_range"),
        ("B", "close_outside_daily_range"), ("B", "non_positive_price"), ("B", "non_positive_value_traded"),
        ("C", "missing_values"),
    ]


def test_missing_prices_never_form_a_stale_run(spark):
    rows = [(d, "A", 1.0, 2.0, 0.5, 1.0, None, 1, 1.0) for d in days(5)]
    issues = qu.data_issues(spark.createDataFrame(rows, BAR_SCHEMA))
    assert issues.where("issue = 'stale_adjusted_close'").count() == 0


def test_completed_day_rules(spark):
    bars = _bars(spark)
    assert qu.completed_day_checks(bars, _universe(spark), days(20)[-1]).count() == 0
    broken = bars.withColumn("high", F.when(F.col("ticker") == "T00", F.col("low") - 1).otherwise(F.col("high")))
    rules = {(r["rule"], r["ticker"]) for r in qu.completed_day_checks(broken.where("ticker = 'T00'"), _universe(spark)).collect()}
    assert rules == {("invalid_range", "T00"), ("missing_ticker", "T01")}
    with pytest.raises(ValueError, match="invalid_range"):
        qu.require_valid_day(qu.completed_day_checks(broken, _universe(spark)))
    twice = qu.completed_day_checks(bars.unionByName(bars.limit(1)), _universe(spark))
    assert [r["rule"] for r in twice.collect()] == ["duplicate_key"]


def test_moves_see_the_row_before_the_start(spark):
    bars = spark.createDataFrame([(d, "A", p) for d, p in zip(days(3), (100.0, 150.0, 150.0))], "date date, ticker string, adjusted_close double")
    assert qu.suspicious_moves(bars, 0.2, days(3)[1]).count() == 1
    assert qu.suspicious_moves(bars, 0.2, days(3)[2]).count() == 0


def test_daily_update_replaces_the_window(spark):
    bars = _bars(spark)
    existing = bars.where(F.col("date") < F.lit(days(20)[15]))
    landed = bars.where(F.col("date") >= F.lit(days(20)[5])).withColumn(
        "close", F.when(F.col("date") == F.lit(days(20)[12]), F.col("close") * 1.01).otherwise(F.col("close"))
    ).withColumn("high", F.greatest("high", "close"))
    update = ingest.daily_update(existing, landed, _universe(spark), days(20)[-1], overlap_days=5)
    merged = update.data.toPandas()
    assert len(merged) == 40 and not merged.duplicated(["date", "ticker"]).any()
    old = existing.where(F.col("date") == F.lit(days(20)[12])).first()["close"]
    new = update.data.where((F.col("date") == F.lit(days(20)[12])) & (F.col("ticker") == "T00")).first()["close"]
    assert new == pytest.approx(old * 1.01) or new != old
    assert update.audit.where("status = 'ok'").count() == 2


@pytest.mark.parametrize(
    ("change", "message"),
    [
        (lambda rows, d: rows.where("ticker = 'T00'"), "without landed rows"),
        (lambda rows, d: rows.withColumn("close", F.col("close") * 2), "disagree"),
        (lambda rows, d: rows.unionByName(rows), "window rules"),
        (lambda rows, d: rows.where((F.col("ticker") != "T00") | (F.col("date") != F.lit(d))), "disagree"),
    ],
)
def test_daily_update_refuses_bad_rows(spark, change, message):
    bars = _bars(spark)
    existing = bars.where(F.col("date") < F.lit(days(20)[15]))
    with pytest.raises(ValueError, match=message):
        ingest.daily_update(existing, change(bars, days(20)[14]), _universe(spark), days(20)[-1], overlap_days=5)


def test_update_window_needs_older_history(spark):
    with pytest.raises(ValueError, match="newer"):
        ingest.window_bounds(_bars(spark), days(20)[3], 5)


def test_staged_write(spark, tmp_path):
    bars = _bars(spark)
    target, staging = str(tmp_path / "bars"), str(tmp_path / "staging")
    assert tables.staged_write(bars, target, staging, dry_run=True)["rows"] == 40
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(target)
    facts = tables.staged_write(bars, target, staging)
    assert facts["rows"] == 40 and spark.read.parquet(target).count() == 40
    with pytest.raises(ValueError, match="duplicate"):
        tables.staged_write(bars.unionByName(bars), target, staging)


def test_stage_tables(spark, tmp_path):
    path = tables.write_stage(_bars(spark), str(tmp_path / "bars"))
    assert tables.read_stage(spark, path, ["date", "close"]).columns == ["date", "close"]
    with pytest.raises(ValueError, match="nothing"):
        tables.read_stage(spark, path, ["nothing"])
    empty = tables.read_stage_if_exists(spark, str(tmp_path / "none"), BAR_SCHEMA)
    assert empty.count() == 0
    both = tables.union_existing(spark, [path, str(tmp_path / "none")], BAR_SCHEMA)
    assert both.count() == 40
    tables.write_report(_bars(spark).limit(3), str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).count() == 3


def test_universe_problems(spark, tmp_path):
    path = tmp_path / "universe.csv"
    path.write_text("ticker,issuer_group,sector\n aaa ,G1,S1\nAAA,G1,S1\nBBB,,S1\n")
    problems = {(r["ticker"], r["problem"]) for r in sb.universe_problems(sb.read_universe_csv(spark, str(path))).collect()}
    assert problems == {("AAA", "duplicate_ticker"), ("BBB", "blank_issuer_group")}


def _land(folder, name, rows):
    text = ",".join(BAR_COLUMNS) + "\n" + "\n".join(",".join(str(v) for v in row) for row in rows) + "\n"
    (folder / name).write_text(text)


def test_landed_files_stream_into_the_table(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    paths = [str(tmp_path / n) for n in ("bars", "staging", "progress")]

    def row(date, ticker, close):
        return (date, ticker, close, close, close, close, close, 10, close * 10)

    def run(end):
        query = inc.run_landing(spark, str(landing), *paths, end=end)
        try:
            query.awaitTermination(120)
        except StreamingQueryException as error:
            return error
        return None

    def table():
        return {(r["date"].isoformat(), r["ticker"]): r["close"] for r in inc.stored_bars(spark, paths[0]).collect()}

    _land(landing, "a.csv", [row("2020-01-30", "A", 10.0), row("2020-01-31", "A", 10.0), row("2019-12-02", "A", 9.0)])
    assert run(dt.date(2020, 1, 31)) is None and len(table()) == 3
    # A small correction and a new month arrive; the old December row is frozen.
    overlap = row("2020-01-30", "A", 10.0)
    _land(landing, "b.csv", [overlap, row("2020-01-31", "A", 10.2), row("2020-02-03", "A", 10.4), row("2019-12-02", "A", 5.0)])
    assert run(dt.date(2020, 2, 3)) is None
    second = table()
    assert second["2020-01-31", "A"] == 10.2 and second["2019-12-02", "A"] == 9.0 and len(second) == 4
    assert run(dt.date(2020, 2, 3)) is None and table() == second
    # A jump beyond the tolerance refuses the whole batch, and the batch comes again.
    kept = [overlap, row("2020-01-31", "A", 10.2)]
    _land(landing, "c.csv", [*kept, row("2020-02-03", "A", 99.0), row("2020-02-04", "A", 10.5)])
    assert "breaks 1 rules" in str(run(dt.date(2020, 2, 4))) and table() == second
    _land(landing, "c.csv", [*kept, row("2020-02-03", "A", 10.5), row("2020-02-04", "A", 10.5)])
    assert run(dt.date(2020, 2, 4)) is None
    assert table()["2020-02-04", "A"] == 10.5


@pytest.mark.parametrize(
    "change,problem",
    [
        (lambda bars: bars.unionByName(bars.where(F.col("date") == F.lit(days(60)[59]))), "duplicate_key"),
        (lambda bars: bars.where(~((F.col("ticker") == "T01") & (F.col("date") == F.lit(days(60)[57])))), "missing_from_update"),
        (lambda bars: bars.withColumn("close", F.when(F.col("date") == F.lit(days(60)[58]), F.col("close") * 2).otherwise(F.col("close"))), "close_changed"),
        (lambda bars: bars.withColumn("date", F.when((F.col("date") == F.lit(days(60)[59])) & (F.col("ticker") == "T01"), F.lit(days(61)[60])).otherwise(F.col("date"))), "after_window"),
    ],
)
def test_a_batch_that_breaks_a_rule_is_refused_as_a_whole(spark, tmp_path, change, problem):
    target = str(tmp_path / "bars")
    bars = _bars(spark, 60)
    first = bars.where(F.col("date") <= F.lit(days(60)[58]))
    assert inc.apply_batch(first, target, str(tmp_path / "s0"), days(60)[58])["written"] == 118
    counts = inc.apply_batch(change(bars), target, str(tmp_path / "s1"), days(60)[59], overlap_days=5)
    assert counts["written"] == 0 and counts["refused"] > 0
    assert {r["problem"] for r in spark.read.parquet(str(tmp_path / "s1" / "problems")).collect()} == {problem}
    assert inc.stored_bars(spark, target).exceptAll(first).count() == 0
    counts = inc.apply_batch(bars, target, str(tmp_path / "s2"), days(60)[59], overlap_days=5)
    assert counts["refused"] == 0 and counts["written"] + counts["frozen"] == 120
    assert inc.stored_bars(spark, target).count() == 120


def test_a_staged_batch_is_published_again_unchanged(spark, tmp_path):
    target, staging = str(tmp_path / "bars"), str(tmp_path / "staging")
    bars = _bars(spark, 60)
    end = days(60)[-1]
    assert inc.apply_batch(bars, target, staging, end) == {"written": 120, "frozen": 0, "refused": 0}
    # The same batch once more, as after a lost driver: nothing is merged a second time.
    changed = bars.withColumn("close", F.col("close") * 1.01)
    assert inc.apply_batch(changed, target, staging, end)["written"] == 0
    assert inc.stored_bars(spark, target).exceptAll(bars).count() == 0


def test_event_bars_agree_between_stream_and_table(spark, tmp_path):
    events = spark.createDataFrame(
        [(i, dt.datetime(2024, 1, 1 + i // 10, i % 10, 0), "view" if i % 2 else "click", float(i)) for i in range(40)],
        "event_id bigint, ts timestamp, event_type string, value double",
    )
    path = str(tmp_path / "events")
    events.write.parquet(path)
    table = sorted(map(tuple, inc.event_bars(spark.read.parquet(path)).collect()))
    stream = inc.event_bars(spark.readStream.schema(events.schema).parquet(path))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("bars").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("bars").collect())) == table
