"""Groups of rows that one task reads, and the connected components of edges."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklight.llm.common import Scratch, slices


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[dict[str, list]]:
    """The rows of each group, from rows sorted by its keys."""
    held: dict[str, list] = {}
    last = None
    for batch in slices(batches):
        cols = {n: batch.column(k).to_pylist() for k, n in enumerate(batch.schema.names)}
        keys = list(zip(*[cols[n] for n in by], strict=True))
        start = 0
        for k in range(1, len(keys) + 1):
            if k == len(keys) or keys[k] != keys[start]:
                if keys[start] != last:
                    if held:
                        yield held
                    held, last = {n: [] for n in cols}, keys[start]
                for n, v in cols.items():
                    held[n] += v[start:k]
                start = k
    if held:
        yield held


def in_groups(rows: DataFrame, by: list[str], schema: str, one: Callable[[dict[str, list]], dict[str, list]]) -> DataFrame:
    """Applies one to each group's rows, of a number that the caller bounds. Rows are dealt by group; a partition is sorted, and read one group at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        out, held = {f.name: [] for f in kind}, 0
        for g in _groups(batches, by):
            for n, v in one(g).items():
                out[n] += v
            held = len(next(iter(out.values())))
            if held > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in kind], schema=kind)
                out = {f.name: [] for f in kind}
        yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in kind], schema=kind)

    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, schema)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node and label, the smallest node of its component, for edges (u, v) in both directions. Labels spread and then jump to their labels' labels."""
    labels = scratch.save(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")).select("node", F.least("node", "v").alias("label")), "labels-0")
    k = 0
    while True:
        k += 1
        around = edges.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        nearer = labels.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = nearer.join(labels.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left")
        new = scratch.save(jump.select("node", "old", F.least("label", "next").alias("label")), f"labels-{k}")
        scratch.drop(f"labels-{k - 1}")
        labels = new.select("node", "label")
        if new.where("label != old").isEmpty():
            return labels
