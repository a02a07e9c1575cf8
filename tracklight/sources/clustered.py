"""Copies of a listing in the order of a sort, so that a page reads the parts that hold it and not the library.

A copy is cut by ranges of (sorted column, id) into parts, sorted in each; an index has a row for each part: how many rows it has
and lie before it, and its last row. A cursor's or offset's parts are looked up there, by a query that returns no more rows than
a page may need. Ids are part of the ranges, so a value that a third of all rows have is cut like any other. A copy is what the
rows were when it was written; put it anew to bring it up to date. A version counts once its index, which is written last, is whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklight.functions.scalars import Cursor
from tracklight.operators.library import SORTS, page
from tracklight.sources.sinks import _remove, _store


class ClusteredCopy:
    """A copy of a listing (as with_totals gives it) in a shared folder, in the order of one sort.

    Null values come last in either direction, ids break ties; ids are not null. Other columns are kept as they are, whatever
    their names. An empty listing has empty pages. Pages are those of operators.library.page over the same rows.
    """

    def __init__(self, spark: SparkSession, folder: str, sort_by: str = "last_played_desc", id_column: str = "track_id") -> None:
        self.spark, self.folder, self.sort_by, self.id = spark, folder, sort_by, id_column
        self.column, self.down = SORTS.get(sort_by, SORTS["last_played_desc"])

    def _versions(self, whole: bool = True) -> list[int]:
        p, store = _store(self.spark, self.folder)
        names = [x.getPath().getName() for x in store.listStatus(p)] if store.exists(p) else []
        numbers = sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())
        return [n for n in numbers if not whole or store.exists(_store(self.spark, f"{self.folder}/v{n}/index/_SUCCESS")[0])]

    def put(self, rows: DataFrame, parts: int = 200) -> None:
        """A new version of the copy in so many parts; the one before stays for its readers, older ones go."""
        known, begun = self._versions(), self._versions(False)
        at, name = f"{self.folder}/v{begun[-1] + 1 if begun else 1}", "part"
        while name in rows.columns:
            name += "_"
        value, id = F.col(self.column), F.col(self.id)
        order = [value.desc_nulls_last(), id.desc()] if self.down else [value.asc_nulls_last(), id.asc()]
        rows.limit(0).write.parquet(f"{at}/columns")
        cut = rows.repartitionByRange(parts, *order).withColumn(name, F.spark_partition_id())
        cut.sortWithinPartitions(name, *order).write.partitionBy(name).parquet(f"{at}/rows")
        last = F.min if self.down else F.max
        found = self.spark.read.schema(cut.schema).parquet(f"{at}/rows") if self._has_parts(at, name) else cut.limit(0)
        index = found.groupBy(F.col(name).alias("part")).agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(value.isNull()).alias("nulls"),
            last(F.when(value.isNotNull(), F.struct(value.alias("value"), id.alias("id")))).alias("last"),
            last(F.when(value.isNull(), id)).alias("last_null"),
        )
        # one row for each part
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        index = index.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("folder", F.concat(F.lit(f"{name}="), "part"))
        index.coalesce(1).write.parquet(f"{at}/index")
        for old in known[:-1]:
            _remove(self.spark, f"{self.folder}/v{old}")

    def _has_parts(self, at: str, name: str) -> bool:
        p, store = _store(self.spark, f"{at}/rows")
        return any(x.getPath().getName().startswith(f"{name}=") for x in store.listStatus(p))

    def _current(self) -> str:
        known = self._versions()
        if not known:
            raise ValueError(f"no copy in {self.folder}")
        return f"{self.folder}/v{known[-1]}"

    def total(self) -> int:
        """How many rows the copy has, by its index."""
        return self.spark.read.parquet(f"{self._current()}/index").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def page(self, limit: int = 50, offset: int = 0, after: Cursor | None = None) -> DataFrame:
        """One page by offset or, with a cursor of this copy's column, after it; reads the parts that hold it."""
        at = self._current()
        index = self.spark.read.parquet(f"{at}/index")
        if after is None:
            near = index.where((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset))
        else:
            mark = F.lit(after.id).cast(index.schema["last_null"].dataType)
            beyond = lambda a, b: a < b if self.down else a > b
            if after.value is None:
                rest = beyond(F.col("last_null"), mark)
            else:
                value = F.lit(after.value).cast(index.schema["last"].dataType["value"].dataType)
                rest = (F.col("nulls") > 0) | beyond(F.col("last.value"), value) | (F.col("last.value") == value) & beyond(F.col("last.id"), mark)
            near = index.where(rest)
        # a part has a row at least, so a page needs no more parts than it has rows
        taken, have = [], 0
        for part in near.select("folder", "n", "before").orderBy("part").limit(limit + 1).collect():
            taken.append(part)
            # of a cursor's first part some rows may lie before it
            have += part.n if after is None or len(taken) > 1 else 0
            if have >= limit + (offset - taken[0].before if after is None else 0):
                break
        schema = self.spark.read.parquet(f"{at}/columns").schema
        if not taken:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*[f"{at}/rows/{part.folder}" for part in taken])
        return page(rows, self.sort_by, limit, offset - taken[0].before if after is None else 0, after, self.id)
