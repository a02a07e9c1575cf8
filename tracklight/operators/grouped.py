"""A function of each group's rows, for many small groups.

Rows are dealt by key and sorted in their partitions, and an Arrow function reads one group after the other, so a group
costs no more than its rows. A group is held whole; callers bound groups by their keys.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

ROWS_OUT = 10_000


#: Rows that a task is dealt where their number is known.
ROWS_A_TASK = 500_000


def shuffle_partitions(spark: SparkSession, rows: int = 0) -> int:
    """Twice as many partitions as the session shuffles to, or more for very many rows. A number that is named isn't coalesced, as few bytes can be very many rows, and one that is not the session's is dealt by itself, in a stage of its own."""
    return max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_TASK))


def per_group(df: DataFrame, keys: list[str], order: list[str], function: Callable[[list], Iterable[tuple]], schema: str) -> DataFrame:
    """The tuples that function gives for each group's rows (named tuples, in order), as rows of the schema."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(StructType.fromDDL(schema))
    names, n_keys = [*keys, *[c for c in df.columns if c not in keys]], len(keys)

    def run(batches):
        import pyarrow as pa

        row_type = namedtuple("Row", names)

        def batch(rows):
            columns = list(zip(*rows, strict=True)) or [[] for _ in kind]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)

        held, out = [], []
        for b in batches:
            for row in map(row_type._make, zip(*[b.column(k).to_pylist() for k in range(b.num_columns)], strict=True)):
                if held and row[:n_keys] != held[0][:n_keys]:
                    out += function(held)
                    held = []
                    if len(out) >= ROWS_OUT:
                        yield batch(out)
                        out = []
                held.append(row)
        if held:
            out += function(held)
        yield batch(out)

    return df.select(*names).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
