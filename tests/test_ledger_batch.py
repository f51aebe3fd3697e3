"""A batch of ledger rows is checked and compared in one look."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidepanel.schemas import LEDGERS
from tidepanel.sources import ledgers as sl


def test_a_batch_meets_its_ledger_in_one_look(spark, tmp_path, monkeypatch):
    def batch(*ids):
        fields = LEDGERS["orders"].fields
        return spark.createDataFrame([(k,) for k in ids], "id string").select(
            *[F.col("id").alias(f.name) if f.name in ("account_id", "order_id") else F.lit(None).cast(f.dataType).alias(f.name) for f in fields]
        )

    path = str(tmp_path / "orders")
    sl.create_ledger(spark, "orders", path)
    looks = []
    problems = sl.row_problems
    monkeypatch.setattr(sl, "row_problems", lambda *args: looks.append(1) or problems(*args))
    monkeypatch.setattr(sl, "append_status", lambda *args: looks.append(1))
    assert sl.append_rows("orders", batch("a", "b"), path) and not sl.append_rows("orders", batch("b", "a"), path)
    assert not sl.append_rows("orders", batch(), path) and sl.append_rows("orders", batch("c"), path)
    with pytest.raises(ValueError, match="1 of 2 keys"):
        sl.append_rows("orders", batch("c", "d"), path)
    assert not looks
    for wrong in (batch("e", "e"), batch("e", None), batch("e", " ")):
        with pytest.raises(ValueError, match="Invalid orders batch"):
            sl.append_rows("orders", wrong, path)
    assert sl.read_ledger(spark, "orders", path).count() == 3


def test_keys_are_compared_only_where_hashes_meet(spark, tmp_path, monkeypatch):
    def batch(*ids):
        fields = LEDGERS["orders"].fields
        return spark.createDataFrame(ids, "account string, id string").select(
            *[F.col({"account_id": "account", "order_id": "id"}[f.name]).alias(f.name) if f.name in ("account_id", "order_id") else F.lit(None).cast(f.dataType).alias(f.name) for f in fields]
        )

    path = str(tmp_path / "orders")
    sl.create_ledger(spark, "orders", path)
    compared = []
    whole = sl._compared
    monkeypatch.setattr(sl, "_compared", lambda *args: compared.append(1) or whole(*args))
    first, second = [("a", f"o{k}") for k in range(50)], [("b", f"o{k}") for k in range(50)]
    assert sl.append_rows("orders", batch(*first), path) and sl.append_rows("orders", batch(*second), path) and not compared
    assert not sl.append_rows("orders", batch(*second[::-1]), path) and len(compared) == 1
    # Equal hashes of other keys decide nothing.
    monkeypatch.setattr(sl.F, "xxhash64", lambda *keys: F.lit(7).cast("bigint"))
    assert sl.append_rows("orders", batch(("c", "o1"), ("c", "o2")), path) and len(compared) == 2
    with pytest.raises(ValueError, match="1 of 2 keys"):
        sl.append_rows("orders", batch(("d", "o1"), ("c", "o2")), path)
    with pytest.raises(ValueError, match="Invalid orders batch"):
        sl.append_rows("orders", batch(("d", "o1"), ("d", "o1")), path)
    monkeypatch.undo()
    for wrong in ([("d", "o1"), ("d", "o1")], [("d", "o1"), ("d", " ")], [(None, "o1")]):
        with pytest.raises(ValueError, match="Invalid orders batch"):
            sl.append_rows("orders", batch(*wrong), path)
    assert sl.read_ledger(spark, "orders", path).count() == 102
