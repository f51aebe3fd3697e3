"""Plans of small accounts go without blocks and rounds, and read the bars once."""

from __future__ import annotations

import pytest

from catalog import accounts
from catalog.registry import QUERIES
from tidepanel.operators import orders as om


@pytest.mark.parametrize("query", ["m08_order_plan", "m08_plan_summary"])
def test_plans_of_small_accounts_take_no_blocks_and_one_pass_over_the_bars(spark, query, monkeypatch):
    calls = []
    bars = accounts.panel.bars
    monkeypatch.setattr(accounts.panel, "bars", lambda *args: calls.append("bars") or bars(*args))
    for name in ("in_blocks", "numbered"):
        monkeypatch.setattr(om, name, lambda *args, name=name: pytest.fail(f"{name} for small accounts"))
    assert QUERIES[query](spark, "/root/testdata/sf0.001").count() > 0
    assert calls == ["bars"]
