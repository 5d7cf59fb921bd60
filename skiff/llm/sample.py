"""Adding Python-made columns to documents, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of an Arrow batch that are Python objects at one time.
SLICE = 512


def with_scores(docs: DataFrame, text_col: str, make: Callable[[pa.Array], list[pa.Array]], fields: list[T.StructField]) -> DataFrame:
    """``docs`` plus columns that ``make`` computes from the texts of a slice of rows.

    The other columns travel as one struct, so their names cannot clash; a column of
    ``docs`` that has a new column's name is replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    new = {f.name for f in fields}
    keep = [c for c in docs.columns if c not in new]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([packed.schema["row"], *fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(arrow.field(0).type), *make(part.column(1))], schema=arrow)

    out = packed.mapInArrow(run, schema)
    return out.select(*[F.col("row")[c].alias(c) for c in keep], *[f.name for f in fields])
