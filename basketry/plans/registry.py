"""Query registry: name -> (Spark builder, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    build: Builder
    sql: str | None
    note: str = ""


REGISTRY: dict[str, Entry] = {}


def _bigint_count_if(sql: str) -> str:
    """Wrap every ``count_if(...)`` in a BIGINT cast (DuckDB returns HUGEINT;
    Spark's ``count_if`` is a bigint)."""
    out, i, token = [], 0, "count_if("
    while True:
        j = sql.find(token, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 1, j + len(token)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        inner = _bigint_count_if(sql[j + len(token):k - 1])   # nested calls inside the argument
        out.append(f"{sql[i:j]}CAST({token}{inner}) AS BIGINT)")
        i = k


def register(name: str, sql: str | None = None, note: str = ""):
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, fn, _bigint_count_if(sql) if sql else None, note)
        return fn
    return deco


def decimals_to_double(df: DataFrame) -> DataFrame:
    """Output boundary: exact decimals become doubles (nearest double of the exact value)."""
    cols = [F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
            for f in df.schema.fields]
    return df.select(*cols)
