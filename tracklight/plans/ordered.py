"""Ordered lists of tracks as lazy DataFrames.

A list is a DataFrame and the keys that order it, the newest first. Filters and joins leave the keys alone; a sorter puts
its key in front, which is what a stable sort does; nothing is sorted until an operator needs positions.

A list that a caller's limit bounds gets positions from one ordered window. Any other is sorted by ranges over all tasks and
written to the checkpoint folder; each partition's rows are numbered from the count of those before it, and what reaches
the driver is a count for each partition.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklight.sources.scratch import shared_folder

#: The most that a caller's limit may be; lists without one have all their rows.
MAX_LIST = 1_000_000
#: Columns that enrichers add start with these; combiners drop them.
ADDED = ("m_", "x_")
#: Columns that sorters and combiners add start with these; numbering drops them.
SORTS = ("_k", "_c")


@dataclass(frozen=True)
class Key:
    column: str
    descending: bool = False
    nulls_first: bool = False

    def order(self) -> Column:
        c = F.col(self.column)
        if self.descending:
            return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()
        return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()

    def flipped(self) -> Key:
        return Key(self.column, not self.descending, not self.nulls_first)


@dataclass(frozen=True)
class TrackList:
    """most: a proven bound of the list's length, from a caller's limit; None if there is none."""

    df: DataFrame
    keys: tuple[Key, ...]
    scalars: dict = field(default_factory=dict)
    most: int | None = None

    @classmethod
    def source(cls, df: DataFrame, *keys: Key, limit: int | None = None, **scalars) -> TrackList:
        """All rows, or the first `limit`; keys must order them totally."""
        own = cls(df, keys, scalars)
        return own if limit is None else own.head(limit)

    def in_order(self) -> DataFrame:
        return self.df.orderBy(*[k.order() for k in self.keys])

    def with_df(self, df: DataFrame) -> TrackList:
        return replace(self, df=df)

    def where(self, predicate: Column) -> TrackList:
        """Rows for which the predicate is true."""
        return self.with_df(self.df.where(predicate))

    def sort(self, key: Column, descending: bool = False, nulls_first: bool = False) -> TrackList:
        """A stable sort; ties keep their order in either direction."""
        name = f"_k{len(self.keys)}"
        return replace(self, df=self.df.withColumn(name, key), keys=(Key(name, descending, nulls_first), *self.keys))

    def reverse(self) -> TrackList:
        return replace(self, keys=tuple(k.flipped() for k in self.keys))

    def _positions(self, name: str) -> tuple[DataFrame, Column]:
        """The rows with their positions from 0 in place of sort columns, and the list's length."""
        order = [k.order() for k in self.keys]
        dropped = lambda df: df.drop(*[c for c in df.columns if c.startswith(SORTS) or c in ("_pos", name)])
        if self.most is not None:
            df = dropped(self.df.withColumn("-new", F.row_number().over(Window.orderBy(*order)) - 1))
            return df.withColumnRenamed("-new", name), F.count(F.lit(1)).over(Window.partitionBy())
        shared_folder(self.df.sparkSession)
        # the low bits count within a partition, the high ones are the partition's number
        df = dropped(self.df.orderBy(*order).withColumn("-at", F.monotonically_increasing_id())).checkpoint()
        part = F.shiftright("-at", 33).cast("int")
        starts, total = {}, 0
        for r in sorted(df.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()):
            starts[r.part], total = total, total + r.n
        lookup = F.array(*[F.lit(starts.get(p, 0)).cast("long") for p in range(max(starts, default=-1) + 1)]) if starts else F.array(F.lit(0).cast("long"))
        at = F.get(lookup, part) + F.col("-at").bitwiseAND(F.lit((1 << 33) - 1))
        return df.withColumn(name, at).drop("-at"), F.lit(total).cast("long")

    def numbered(self, name: str = "_pos") -> TrackList:
        """Positions from 0 take the place of all keys."""
        return replace(self, df=self._positions(name)[0], keys=(Key(name),))

    def counted(self) -> TrackList:
        """numbered, with the list's length in _n."""
        df, n = self._positions("_pos")
        return replace(self, df=df.withColumn("_n", n), keys=(Key("_pos"),))

    def head(self, n: int) -> TrackList:
        n = max(0, n)
        return replace(self, df=self.in_order().limit(n), most=n if self.most is None else min(n, self.most))

    def transform(self, step: Callable[..., TrackList], *args, **kwargs) -> TrackList:
        """step(self, ...), for chains."""
        return step(self, *args, **kwargs)

    def result(self, *columns: str) -> DataFrame:
        """The list with its positions from 0, for output. Columns named by text are all that is sorted, besides the keys."""
        own = self
        if columns and all(isinstance(c, str) for c in columns):
            own = self.with_df(self.df.select(*dict.fromkeys([*columns, *[k.column for k in self.keys]])))
        own = own.numbered("position").df.withColumn("position", F.col("position").cast("long"))
        return own.select("position", *columns) if columns else own


def curried(step: Callable[..., TrackList], *args, **kwargs) -> Callable[[TrackList], TrackList]:
    """A step with its configuration, to be applied to lists later."""
    return lambda tracks: step(tracks, *args, **kwargs)
