from __future__ import annotations

import re

import pytest
from check_queries import comparable, connect

from tidepanel.llm import quality
from tidepanel.llm.queries import ORACLES, QUERIES


def plain_measures(text: str | None) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    covered = {p for k, w in enumerate(windows) if windows.count(w) > 1 for p in range(k, k + 3)}
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", line)]
    again = sum(line in lines[:k] for k, line in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered)


@pytest.mark.parametrize(
    "text",
    [None, "", " \n\t \n", "one", "a b c a b c", "a b c d a b c", "a a a a", "é ü\x1cß\x85 x", "| | |\n| | |\n#*$", "l 1\n\nl 1\nl 1 \n \n", "x y z " * 50],
)
def test_measures(text):
    assert quality.measures(None if text is None else text.encode()) == plain_measures(text)


def test_a_very_long_text_is_measured_as_a_whole():
    """A million different words, and three that come again at the far end."""
    body = " ".join(f"w{k}" for k in range(1_000_000))
    got = quality.measures(f"{body}\nw0 w1 w2\n#".encode())
    assert (got[0], got[2], got[3], got[4]) == (1_000_004, 1, 0, 6)


def documents(spark):
    good = " ".join(f"w{k}" for k in range(60))
    rows = [(k, good, "fine", "x") for k in range(40)] + [(100 + k, "short", "bad", "x") for k in range(38)]
    rows += [(200, good, "bad", "x"), (201, good, "bad", None), (202, "short", "tiny", "x"), (203, good, "tiny", "x")]
    rows += [(204, None, None, "x"), (None, good, None, "x"), (204, "a b c " * 30, "fine", "x"), (0, good, "fine", "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_words string")


def test_hosts_are_judged_by_shrunken_rates(spark):
    got = quality.quality_verdicts(documents(spark)).collect()
    assert len(got) == 86
    assert {r["doc_id"] for r in got if r["host"] == "bad" and r["kept"]} == set()
    assert all(r["host_rejected"] == (r["host"] == "bad") for r in got)
    # One failure of two says little about a host: its other document stays.
    assert [r["kept"] for r in got if r["doc_id"] == 203] == [True]
    assert [(r["base_failed"], r["n_repeat_words"]) for r in got if r["doc_id"] == 204 and r["n_words"]] == [(True, 90)]
    assert [(r["host"], r["host_docs"]) for r in got if r["doc_id"] is None] == [(None, 2)]
    assert quality.quality_verdicts(documents(spark).limit(0)).count() == 0


def test_prior_is_drawn_from_the_hosts(spark):
    same = spark.createDataFrame([("a", 100, 10), ("b", 100, 10)], "host string, docs bigint, bad bigint")
    a, b = quality.beta_prior(same, "bad", "docs")
    assert (a, b) == pytest.approx((20, 180))  # no spread: all documents together
    apart = spark.createDataFrame([("a", 1000, 0), ("b", 1000, 1000)], "host string, docs bigint, bad bigint")
    a, b = quality.beta_prior(apart, "bad", "docs")
    assert a == pytest.approx(b) and a < 1.1
    none = spark.createDataFrame([("a", 10, 0)], "host string, docs bigint, bad bigint")
    assert quality.beta_prior(none, "bad", "docs") == (0.5, 1.5)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    got = QUERIES[name](spark, folder).toPandas()
    want = connect(folder).execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert comparable(got) == comparable(want)
