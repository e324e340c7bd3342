"""Text functions in Python as columns: an Arrow batch at a time, each distinct value of a batch once."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def per_text(fn: Callable, returns: str | T.DataType) -> Callable[..., Column]:
    """A function of text columns (null comes as None) that gives fn of their values.

    Equal rows of a batch are read once and spread again by their number in it. No row is shuffled for that: a batch's dictionary is
    small, and a text that a third of all rows hold costs one call for each batch, wherever its rows are."""

    def column(*columns: Column) -> Column:
        kind = T._parse_datatype_string(returns) if isinstance(returns, str) else returns

        def run(*columns: pa.Array) -> pa.Array:
            from pyspark.sql.pandas.types import to_arrow_type

            if len(columns) == 1:
                coded = pc.dictionary_encode(columns[0], null_encoding="encode")
                values = [(v,) for v in coded.dictionary.to_pylist()]
                numbers = coded.indices
            else:
                rows = list(zip(*(c.to_pylist() for c in columns), strict=True))
                of = {r: i for i, r in enumerate(dict.fromkeys(rows))}
                values, numbers = list(of), pa.array([of[r] for r in rows], pa.int32())
            return pa.array([fn(*v) for v in values], to_arrow_type(kind)).take(numbers)

        return F.arrow_udf(run, kind)(*[c.cast("string") for c in columns])

    return column
