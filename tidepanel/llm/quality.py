"""Host-level quality rules.

Every document is measured once.  Rule failures are summed by host, each host's failure rate
is drawn towards the rate of all hosts by a beta prior fitted to the hosts themselves, and the
verdict on the host is joined back to its documents.  A host with few documents thus cannot
be condemned by two bad ones, and one with many is judged by its own record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import picked, stored, utf8

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
MAX_HOST_RATE = 0.5
SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\v\f\r"

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: list[bytes]) -> int:
    """Words covered by three-word windows that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict[tuple, int] = {}
    again = set()
    for window in windows:
        if window in seen:
            again.add(window)
        seen[window] = 1
    covered = np.zeros(len(words), dtype=bool)
    for place, window in enumerate(windows):
        if window in again:
            covered[place : place + 3] = True
    return int(covered.sum())


def measures(text: bytes | None) -> tuple[int, int, int, int, int]:
    """Words, their code points, symbols, repeated lines and repeated words of one text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.split()  # on bytes: exactly the ASCII white space 09-0D and 20
    solid = np.frombuffer(text.translate(None, WHITE), dtype=np.uint8)
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words),
        int(np.count_nonzero((solid & 0xC0) != 0x80)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def document_measures(documents: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """doc_id, host and the five measures, one row per document.

    A null or blank text has no words and all measures zero.  Rows are measured one by one, so
    repeated rows and ids stay as they are.
    """
    given = picked(documents, doc_id=id, host=host, text=text)
    given = given.select("doc_id", F.col("host").cast("string").alias("host"), utf8(F.col("text")).alias("text"))
    fields = [given.schema["doc_id"], given.schema["host"]]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + "".join(f", {m} bigint" for m in MEASURES)

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [measures(value.as_buffer().to_pybytes()) for value in part.column("text")]
            columns = list(zip(*found, strict=True)) or [()] * len(MEASURES)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("host"), *(pa.array(c, type=pa.int64()) for c in columns)],
                names=["doc_id", "host", *MEASURES],
            )

    return given.mapInArrow(work, schema)


def beta_prior(hosts: DataFrame, failures: str, total: str) -> tuple[float, float]:
    """Beta parameters by moments over the hosts: their mean rate and how far rates spread.

    One row comes to the driver.  Where hosts differ no more than chance allows, or there is
    one host only, the prior is as strong as all documents together: every host gets the
    common rate.
    """
    rate = F.col(failures) / F.col(total)
    row = hosts.agg(
        F.count("*").alias("hosts"),
        F.sum(failures).alias("bad"),
        F.sum(total).alias("all"),
        F.sum(F.col(total) * rate * rate).alias("square"),
    ).first()
    if not row["all"]:
        return 1.0, 1.0
    mean = row["bad"] / row["all"]
    inside = mean * (1 - mean)
    if inside == 0:
        # no host fails, or all do: one pseudo-document of each kind keeps the rates off 0 and 1
        return mean + 0.5, 1.5 - mean
    between = row["square"] / row["all"] - mean * mean  # rate variance, weighted by documents
    chance = inside * row["hosts"] / row["all"]  # what sampling alone would give
    true = between - chance
    strength = inside / true - 1 if 0 < true < inside else float(row["all"])
    strength = max(strength, 1.0)
    return mean * strength, (1 - mean) * strength


def host_verdicts(measured: DataFrame, failed: dict[str, F.Column], max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """host, host_docs, host_failed (any rule), host_rate (worst shrunken rate), host_rejected.

    ``failed`` names boolean columns over the measures.  The sums are partial before the
    shuffle, so a host with a third of all rows is one row per task there.  A null host is a
    host of its own.
    """
    any_rule = F.lit(False)
    for rule in failed.values():
        any_rule = any_rule | rule
    flags = measured.select("host", any_rule.alias("any_rule"), *(rule.alias(f"rule_{k}") for k, rule in enumerate(failed.values())))
    hosts = stored(
        flags.groupBy("host").agg(
            F.count("*").alias("host_docs"),
            F.sum(F.col("any_rule").cast("long")).alias("host_failed"),
            *(F.sum(F.col(f"rule_{k}").cast("long")).alias(f"bad_{k}") for k in range(len(failed))),
        ),
        "hosts",
    )
    rates = []
    for k in range(len(failed)):
        a, b = beta_prior(hosts, f"bad_{k}", "host_docs")
        rates.append((F.col(f"bad_{k}") + F.lit(a)) / (F.col("host_docs") + F.lit(a + b)))
    worst = F.greatest(*rates) if len(rates) > 1 else rates[0]
    return hosts.select("host", "host_docs", "host_failed", worst.alias("host_rate")).withColumn(
        "host_rejected", F.col("host_rate") > max_rate
    )


def rules() -> dict[str, F.Column]:
    """The rules counted by host."""
    return {
        "too_short": F.col("n_words") < MIN_WORDS,
        "repetitive": 100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"),
    }


def quality_verdicts(
    documents: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    max_rate: float = MAX_HOST_RATE,
) -> DataFrame:
    """One row per document: measures, base_failed, its host's record and whether it is kept.

    A document goes if it fails a rule itself or if more than ``max_rate`` of its host's
    documents are expected to fail one.  The join back has no hint: the table of hosts grows
    with the web, so Spark broadcasts it only when its measured size is small and splits the
    rows of a large host otherwise.  An empty table gives no rows; other columns are ignored.
    """
    measured = stored(document_measures(documents, id, text, host), "measures")
    failed = rules()
    hosts = host_verdicts(measured, failed, max_rate).withColumnRenamed("host", "other_host")
    bad = failed["too_short"] | failed["repetitive"]
    joined = measured.withColumn("base_failed", bad).join(hosts, F.col("host").eqNullSafe(F.col("other_host")), "left")
    return joined.select(
        "doc_id",
        *MEASURES,
        "base_failed",
        (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"),
        "host",
        "host_docs",
        "host_failed",
        "host_rejected",
    )
