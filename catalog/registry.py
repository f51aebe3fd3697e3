"""Registry of named queries: a Spark frame, an output shape and an independent SQL text.

The shape lists the output columns.  ``name`` passes a column on, ``name:6`` rounds it to
six places, ``name:6s`` does so after a multiplication that moves exact halves off the
rounding edge, ``name:6l`` rounds sign(x) * ln(1 + |x|) of a compounded figure that may be
very large, and ``name:i`` makes it a 64-bit integer; both engines get the same treatment.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Frame = Callable[[SparkSession, str], DataFrame]

SCALE = 0.7310585786300049

QUERIES: dict[str, Frame] = {}
SQL_TEXTS: dict[str, tuple[str, str]] = {}
RELATIONS: dict[str, str] = {}


def relation(name: str, sql: str) -> None:
    """A named subquery other oracle texts may use."""
    RELATIONS[name] = sql


def _columns(shape: str) -> list[tuple[str, str]]:
    return [tuple((item + ":").split(":")[:2]) for item in shape.split()]


def shaped(frame: DataFrame, shape: str) -> DataFrame:
    columns = []
    for name, kind in _columns(shape):
        column = F.col(name)
        if kind == "i":
            column = column.cast("bigint")
        elif kind.endswith("s"):
            column = F.round(column.cast("double") * SCALE, int(kind[:-1]))
        elif kind.endswith("l"):
            column = F.round(F.signum(column) * F.log1p(F.abs(column)), int(kind[:-1]))
        elif kind:
            column = F.round(column.cast("double"), int(kind))
        columns.append(column.alias(name))
    return frame.select(*columns)


def _used(sql: str, seen: list[str], inside: tuple[str, ...] = ()) -> list[str]:
    for name, text in RELATIONS.items():
        if name not in seen and name not in inside and re.search(rf"\b{name}\b", sql):
            _used(text, seen, (*inside, name))
            if name not in seen:
                seen.append(name)
    return seen


def _defined(name: str) -> str:
    text = RELATIONS[name]
    recursive = re.search(rf"\b{name}\b", text)
    return f"{name} AS {'' if recursive else 'MATERIALIZED '}({text})"


def oracle(sql: str, shape: str) -> str:
    columns = []
    for name, kind in _columns(shape):
        if kind == "i":
            columns.append(f"CAST({name} AS BIGINT) AS {name}")
        elif kind.endswith("s"):
            columns.append(f"round(CAST({name} AS DOUBLE) * {SCALE}::DOUBLE, {kind[:-1]}) + 0.0 AS {name}")
        elif kind.endswith("l"):
            columns.append(f"round(sign({name}) * ln(1 + abs({name})), {kind[:-1]}) + 0.0 AS {name}")
        elif kind:
            columns.append(f"round(CAST({name} AS DOUBLE), {kind}) + 0.0 AS {name}")
        else:
            columns.append(name)
    body = f"final_rows AS ({sql})"
    parts = [_defined(name) for name in _used(sql, [])] + [body]
    return "WITH RECURSIVE " + ",\n".join(parts) + f"\nSELECT {', '.join(columns)} FROM final_rows"


def query(name: str, shape: str, sql: str | None = None) -> Callable[[Frame], Frame]:
    def register(frame: Frame) -> Frame:
        QUERIES[name] = lambda spark, folder: shaped(frame(spark, folder), shape)
        if sql is not None:
            SQL_TEXTS[name] = (sql, shape)
        return frame

    return register


def oracles() -> dict[str, str]:
    """SQL text per query; call after every catalogue module is imported."""
    return {name: oracle(sql, shape) for name, (sql, shape) in SQL_TEXTS.items()}
