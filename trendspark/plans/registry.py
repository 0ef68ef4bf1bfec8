"""Registry pairing a Spark query ``(spark, sf_dir) -> DataFrame`` with oracle SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendspark.fixtures import duck_with

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def _utc(fn: QueryFn) -> QueryFn:
    """The stored DATETIME columns are UTC wall times: pin the session zone, and hand
    timestamps out as TIMESTAMP_NTZ so collecting them does not depend on the
    caller's process time zone (DuckDB's TIMESTAMP is zone-less too)."""

    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        df = fn(spark, sf_dir)
        if any(isinstance(f.dataType, T.TimestampType) for f in df.schema.fields):
            df = df.select(*[F.col(f.name).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType)
                             else F.col(f.name) for f in df.schema.fields])
        return df

    return run


def query(name: str, sql: str | None = None, fx: tuple[str, ...] = ()):
    """Register ``fn`` under ``name``; ``sql`` is the DuckDB oracle, run after a
    ``WITH`` of the fixture views ``fx`` (None = rows-only check)."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = _utc(fn)
        if sql is not None:
            body = sql.strip()
            if fx:
                head = duck_with(*fx).rstrip()
                # merge the query's own WITH list into the fixture WITH list
                if re.match(r"(?i)WITH\s+RECURSIVE\s", body):
                    head, body = head.replace("WITH", "WITH RECURSIVE", 1), re.sub(r"(?i)^WITH\s+RECURSIVE", "WITH", body)
                body = head + ",\n" + body[5:] if re.match(r"(?i)WITH\s", body) else head + "\n" + body
            ORACLE[name] = body
        return fn

    return deco
