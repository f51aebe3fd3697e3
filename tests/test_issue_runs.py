"""Runs of equal prices that go on over days, against a plain walk."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter

from tidepanel.operators import quality as qu
from tidepanel.schemas import BAR_COLUMNS

DAY = dt.date(2020, 1, 1)


def _bars(spark):
    rng = random.Random(4)
    rows = []
    for ticker in ("A", "B", None):
        for _ in range(160):
            price = rng.choice([10.0, 10.0, 10.0, 11.0, None])
            values = {"date": DAY + dt.timedelta(days=rng.randrange(25)), "ticker": ticker, "open": 1.0, "high": 2.0, "low": 0.5}
            values |= {"close": float(rng.randrange(1, 3)), "adjusted_close": price, "volume": 5, "value_traded": 7.0}
            rows.append(tuple(values[c] for c in BAR_COLUMNS))
    kinds = {"date": "date", "ticker": "string", "volume": "bigint"}
    return rows, spark.createDataFrame(rows, ", ".join(f"{c} {kinds.get(c, 'double')}" for c in BAR_COLUMNS))


def test_runs_over_days_have_their_whole_length(spark):
    rows, bars = _bars(spark)
    at = {c: k for k, c in enumerate(BAR_COLUMNS)}
    tie = [c for c in BAR_COLUMNS if c not in ("date", "ticker")]
    want = Counter()
    for ticker in ("A", "B"):
        counted = Counter(r for r in rows if r[at["ticker"]] == ticker)
        order = sorted(counted, key=lambda r: (r[at["date"]], *[(r[at[c]] is not None, r[at[c]] or 0) for c in tie]))
        runs, last = [], None
        for r in order:
            price = r[at["adjusted_close"]]
            if not runs or price is None or price != last:
                runs.append([])
            runs[-1].append(r)
            last = price
        for run in runs:
            length = sum(counted[r] for r in run)
            if run[0][at["adjusted_close"]] is not None and length >= 3:
                for r in run:
                    want[(r[at["date"]], ticker, f"10.0, {length}" if r[at["adjusted_close"]] == 10.0 else f"11.0, {length}")] += counted[r]
    found = qu.data_issues(bars).where("issue = 'stale_adjusted_close'").collect()
    got = Counter()
    for r in found:
        got[(r["date"], r["ticker"], r["details"])] += r["copies"]
    assert got == want and max(int(k[2].split(", ")[1]) for k in want) >= 8


def test_the_rows_are_moved_once_after_they_are_counted(spark):
    _, bars = _bars(spark)
    plan = qu.data_issues(bars)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
