"""Extra columns of a table, kept out of an operator's way."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame


def extras_aside(*used: str) -> Callable:
    """For operators that return their table's columns: all but the used ones bear a neutral name inside, so none can clash."""

    def around(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(operator)
        def inner(docs: DataFrame, *args, **kwargs) -> DataFrame:
            names = [c if c in used else f"_extra_{k}" for k, c in enumerate(docs.columns)]
            return operator(docs.toDF(*names), *args, **kwargs).toDF(*docs.columns)

        return inner

    return around
