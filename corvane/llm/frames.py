"""Small DataFrame helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corvane.llm.kernel import tidy
from corvane.runtime import arrow_rows, ship_package


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df without columns of these names, whatever their case."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def append_columns(df: DataFrame, fields: list[T.StructField], make: Callable) -> DataFrame:
    """df with columns that ``make`` computes from each Arrow batch; columns of the same names are replaced.

    make: called once in each task, gives the function (RecordBatch) -> list of Arrow arrays.
    """
    spark = df.sparkSession
    ship_package(spark)
    arrow_rows(spark)
    kept = without(df, [f.name for f in fields])
    keep = [i for i, c in enumerate(df.columns) if c in set(kept.columns)]
    schema = T.StructType([*kept.schema.fields, *fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        function = None
        for batch in batches:
            if not batch.num_rows:
                continue
            function = function or make()
            new = [pa.array(x, type=arrow.field(len(keep) + i).type) if not isinstance(x, pa.Array) else x for i, x in enumerate(function(batch))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).cast(arrow.field(k).type) for k, i in enumerate(keep)), *new], schema=arrow)

    return df.mapInArrow(tidy(run), schema)


def id_crc(column: str = "doc_id"):
    """crc32 of an id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))
