"""Query registry: name -> Spark callable, name -> oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _plain(df: DataFrame) -> DataFrame:
    """Widen small integers and floats, so both engines report the same types."""
    wide = {T.ByteType: "bigint", T.ShortType: "bigint", T.IntegerType: "bigint", T.FloatType: "double"}
    return df.select(*[
        F.col(f"`{f.name}`").cast(wide[type(f.dataType)]).alias(f.name) if type(f.dataType) in wide else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _plain(fn(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add
