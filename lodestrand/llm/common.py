"""Helpers shared by the corpus operators: table names, names of helper columns,
and Arrow plumbing for map-only operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import ship, spread

#: Arrow batches leave a worker at about this many bytes of text.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; a small one is dealt over all cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def free_name(taken: list[str], wish: str) -> str:
    """``wish``, with underscores in front until no column has the name in any case."""
    low = {x.lower() for x in taken}
    while wish.lower() in low:
        wish = "_" + wish
    return wish


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns, equal for equal rows."""
    plain = lambda f: F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`")
    return F.xxhash64(*[x for f in df.schema.fields for x in (plain(f), F.isnull(f"`{f.name}`"))])


def map_batches(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], dict[str, pa.Array]]],
    added: str,
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """Append the columns of the DDL string ``added``, made by a batch function.

    Columns in ``drop`` are not sent back from the workers.

    ``make`` runs once in each task and returns the batch function.  A column of
    the input that has the name of an added one is replaced.  Large inputs are
    cut into slices, so what a task holds does not depend on the table.
    """
    ship(df.sparkSession)
    new = T._parse_datatype_string(added)
    names = {f.name.lower() for f in new.fields}
    keep = [f for f in df.schema.fields if f.name.lower() not in names and f.name not in drop]
    kept_names = [f.name for f in keep]
    schema = T.StructType(keep + new.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for part in slices(batch):
                made = fn(part)
                arrays = [part.column(part.schema.get_field_index(n)) for n in kept_names] + [made[f.name] for f in new.fields]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``size`` bytes; a longer row is a slice of its own."""
    if not batch.num_rows:
        return
    step = max(1, int(batch.num_rows * size / max(1, batch.nbytes)))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)
