"""How the engine's queries are registered: a name, a function of the tables, and SQL for DuckDB."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_FROM = re.compile(r"\b(FROM|JOIN)\s+(" + "|".join(TABLES) + r")\b")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of one folder as DataFrames (``t.orders``), and inputs derived from them in SQL."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str, **given: DataFrame) -> DataFrame:
        """``given``: tables to be read instead of the folder's."""
        used = {m[1] for m in _FROM.findall(text)}
        plain = text.replace("{", "{{").replace("}", "}}")
        return self.spark.sql(_FROM.sub(r"\1 {\2}", plain), **{n: given[n] if n in given else getattr(self, n) for n in used})


def query(name: str, sql: str | None = None):
    """Register ``f(tables)`` as a query; without ``sql`` only its rows are checked (and tests hold it)."""

    def put(f: Callable[[Tables], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put
