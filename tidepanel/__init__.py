"""Panel research and portfolio analytics expressed as Spark DataFrame operators.

A panel is a DataFrame with one row per (``date``, ``ticker``).  Three facts about it
shape every operator here:

* one ticker has at most one row per date, so a per-ticker window is bounded by the
  length of the calendar;
* one date can hold any number of tickers, so cross-sections are never pulled into one
  task: they go through partial aggregates or the bucketed ranks of
  ``functions.ranking``;
* a table with one row per date is bounded by the calendar and may be broadcast.
"""
