"""Registered queries and the SQL each is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, "Registered"] = {}


@dataclass(frozen=True)
class Registered:
    run: Query
    sql: str | None
    covers: tuple[str, ...]


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register ``fn`` under ``name``; ``covers`` lists the inventory ids it answers."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Registered(fn, oracle(sql) if sql else None, tuple(covers.split()))
        return fn

    return add


# Named sub-queries shared by the check SQL; used ones are prepended to a statement in this order.
CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body


def _used(text: str, found: set[str]) -> set[str]:
    for name, body in CTES.items():
        if name not in found and re.search(rf"\b{name}\b", text):
            found.add(name)
            _used(body, found)
    return found


def oracle(sql: str) -> str:
    """Prepend the shared sub-queries a statement uses and expand ``R[expr]`` to a rounded double."""
    found = _used(sql, set())
    parts = [f"{n} AS ({CTES[n]})" for n in CTES if n in found]
    body = sql.strip()
    if parts:
        recursive = any(re.search(rf"\bFROM {n}\b", CTES[n]) for n in found)
        head = ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts)
        body = f"{head},\n{body[4:].strip()}" if body.upper().startswith("WITH") else f"{head}\n{body}"
    return re.sub(r"\bR\[(.*?)\]", r"(round(CAST(\1 AS DOUBLE), 6) + 0e0)", body, flags=re.S)


def rounded(df: DataFrame, scale: int = 6) -> DataFrame:
    """Round every double column so that both engines print the same digits."""

    def fix(f: T.StructField) -> Column:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return (F.round(F.col(f.name).cast("double"), scale) + F.lit(0.0)).alias(f.name)
        return F.col(f.name)

    return df.select(*[fix(f) for f in df.schema.fields])


def joined(df: DataFrame) -> DataFrame:
    """Print array columns as comma-separated text, which both engines compare alike."""

    def text(f: T.StructField) -> Column:
        if isinstance(f.dataType, T.ArrayType):
            return F.array_join(F.col(f.name).cast("array<string>"), ",").alias(f.name)
        return F.col(f.name)

    return df.select(*[text(f) for f in df.schema.fields])
