"""Every query of the library by name, with its SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules of this package with a dict QUERIES: name -> (function, SQL or None).
FAMILIES = ("spectral", "keyed", "arrays", "estimates", "flows", "further", "records")


def _all() -> dict[str, tuple]:
    found: dict[str, tuple] = {}
    for name in FAMILIES:
        found |= importlib.import_module(f"{__package__}.{name}").QUERIES
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for name, (q, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["tf01_stft"](spark, sf_dir)
