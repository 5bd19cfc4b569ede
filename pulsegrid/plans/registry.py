"""Queries by name, each with SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The trains that the SQL starts from: spikes in order with their intervals, flags and labels.
TRAINS = """
WITH base AS (
  SELECT user_id AS train, event_id, epoch_us(ts) - 1704067200000000 AS us, event_type AS kind, value FROM events
), timed AS (
  SELECT *, us / 1e12 AS t, row_number() OVER w AS idx, (us - lag(us) OVER w) / 1e12 AS isi
  FROM base WINDOW w AS (PARTITION BY train ORDER BY us, event_id)
), s AS (
  SELECT *, coalesce(isi >= 0.0009, false) AS valid, coalesce(isi < 0.0009 - 9e-10, false) AS artifact,
         coalesce(isi >= 0.0009 - 9e-10 AND isi < 0.002 - 9e-10, false) AS suspect,
         CASE WHEN isi IS NULL THEN '' WHEN isi < 0.008 AND kind IN ('click', 'view') THEN 'burst' WHEN isi > 0.08 AND kind = 'click' THEN 'pause'
              WHEN isi BETWEEN 0.02 AND 0.05 AND kind = 'purchase' THEN 'tonic' ELSE '' END AS manual,
         CASE WHEN isi IS NULL THEN '' WHEN isi < 0.01 THEN 'burst' WHEN isi < 0.02 THEN 'possible_burst'
              WHEN isi BETWEEN 0.02 AND 0.05 THEN 'tonic' WHEN isi > 0.07 THEN 'pause' ELSE '' END AS auto
  FROM timed
)"""


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name. SQL that starts with a comma or SELECT goes on after TRAINS."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            text = sql.strip()
            ORACLE_SQL[key] = text if text.upper().startswith("WITH") else f"{TRAINS}\n{text}"
        return f

    return add


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """df with its doubles rounded, so that sums in any order agree."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(c: Column | str, digits: int = 9) -> Column:
    return F.round(c, digits)
