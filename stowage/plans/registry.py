"""Queries by name, each with the SQL that another engine runs for it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stowage.sources.views import Tables, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def sha256_pad(secret: str, pad: int) -> str:
    """In hex, the block that the SHA-256 of a secret, as an HMAC key, makes with a pad byte."""
    return bytes(b ^ pad for b in hashlib.sha256(secret.encode()).digest().ljust(64, b"\0")).hex().upper()


def query(sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Register a function of the tables under its name. sql may refer to the views of sources/views.py."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = with_views(sql)
        return f

    return register
