"""Sources by name. A source has name, display_name, requires_network, available_sets(), set_meta() and fetch()."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_factories: dict[str, Callable] = {}


def register(name: str, factory: Callable) -> None:
    _factories[name] = factory


def available() -> list[str]:
    return sorted(_factories)


def get(name: str, *args, **kwargs):
    if name not in _factories:
        raise LookupError(f"no source {name!r}; there are {', '.join(available()) or 'none'}")
    return _factories[name](*args, **kwargs)


def as_table(spark: SparkSession) -> DataFrame:
    """The registry as the preserved side of the health report."""
    return spark.createDataFrame([(n,) for n in available()], "source string")
