"""Small frames for tests."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd


def days(count: int, start: str = "2020-01-01") -> list[dt.date]:
    return [d.date() for d in pd.bdate_range(start, periods=count)]


def price_panel(tickers: int, dates: int, seed: int = 0, gaps: float = 0.0) -> pd.DataFrame:
    """Random-walk bars, optionally with missing rows."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(tickers):
        price = 20.0 + k
        for date in days(dates):
            price *= 1 + rng.normal(0, 0.02)
            if rng.random() < gaps:
                continue
            spread = abs(rng.normal(0, 0.01)) * price
            rows.append(
                (date, f"T{k:02d}", price, price + spread, price - spread, price, price, int(rng.integers(100, 1000)))
            )
    frame = pd.DataFrame(
        rows, columns=["date", "ticker", "open", "high", "low", "close", "adjusted_close", "volume"]
    )
    frame["value_traded"] = frame["close"] * frame["volume"]
    return frame


def predictions(dates: int, tickers: int, models=("a", "b"), seed: int = 1) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    rows = []
    for date in days(dates):
        actual = rng.normal(0, 0.05, tickers)
        for model in models:
            score = actual * 0.3 + rng.normal(0, 0.05, tickers)
            rows += [
                (date, f"T{k:02d}", model, float(score[k]), float(actual[k])) for k in range(tickers)
            ]
    return pd.DataFrame(rows, columns=["date", "ticker", "model_name", "predicted_return", "actual_return"])


def by_key(frame: pd.DataFrame, *keys: str) -> pd.DataFrame:
    return frame.sort_values(list(keys)).reset_index(drop=True)
