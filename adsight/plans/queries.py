"""One query per operator over the test tables; names follow the operator inventory."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def flat(frame: DataFrame) -> DataFrame:
    """Result columns in comparable types: doubles, bigints, joined arrays, JSON structs."""
    out = []
    for field in frame.schema.fields:
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.DecimalType, T.FloatType)):
            column = column.cast("double")
        elif isinstance(kind, (T.IntegerType, T.ShortType)):
            column = column.cast("bigint")
        elif isinstance(kind, T.ArrayType):
            simple = isinstance(kind.elementType, (T.StringType, T.DateType))
            column = F.array_join(column.cast("array<string>"), ",") if simple else (
                F.to_json(column))
        elif isinstance(kind, (T.StructType, T.MapType)):
            column = F.to_json(column)
        out.append(column.alias(field.name))
    return frame.select(*out)


def query(name: str) -> Callable[[Query], Query]:
    """Register a query under an operator's name; its result columns are flattened."""

    def register(build: Query) -> Query:
        REGISTRY[name] = lambda spark, sf: flat(build(spark, sf))
        return build

    return register


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)
