"""Joins by ranges of time, which Spark has no operator of its own for.

Times fall into bins as wide as the range, so that a row's range lies in one bin or two; it meets their rows by an equi-join, and
the exact condition follows. Rows without a partner are added back where they are to stay.

An equi-join gives one task all pairs of a key, however few bytes its rows have. Where a key has many rows, block_join and
pairs_within cut them into blocks and deal pairs of blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklight.functions.scalars import micros

#: So many rows of a key meet as many of the other side in one piece of work.
BLOCK = 2048


def _dealt(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The pairs of equal keys and of equal pieces, _i and _j. Pieces are dealt by their number, as their bytes say nothing of the pairs that they make."""
    on = [*keys, "_i", "_j"]
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return left.repartition(n, *on).hint("merge").join(right.repartition(n, *on), on)


def _block(id: str, n: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(7), id), F.coalesce(n, F.lit(1))).cast("int")


def _blocks(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))


def block_join(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str) -> DataFrame:
    """An inner equi-join. A key of many rows is cut into blocks by the ids on either side, and each block meets each one of the other side by itself, so a row is sent once for every BLOCK rows of its key over there."""
    # so few keys: each has more than BLOCK rows
    many = F.broadcast(_blocks(left, keys, "_n").join(_blocks(right, keys, "_m"), keys).where("_n > 1 or _m > 1"))
    to = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    a = left.join(many, keys, "left").withColumn("_i", _block(left_id, "_n")).withColumn("_j", to("_m")).drop("_n", "_m")
    b = right.join(many, keys, "left").withColumn("_j", _block(right_id, "_m")).withColumn("_i", to("_n")).drop("_n", "_m")
    return _dealt(a, b, keys).drop("_i", "_j")


def pairs_within(df: DataFrame, keys: list[str], id: str = "id") -> DataFrame:
    """Each two rows of equal keys once, as a (the smaller id) and b, structs of the other columns. Ids are different within a key."""
    many = F.broadcast(_blocks(df, keys, "_n").where("_n > 1"))
    row = F.struct(id, *[c for c in df.columns if c not in (id, *keys)])
    own = df.select(*keys, row.alias("_row")).join(many, keys, "left").withColumn("_at", _block(f"_row.{id}", "_n"))
    last = F.coalesce("_n", F.lit(1)) - 1
    x = own.select(*keys, F.col("_at").alias("_i"), F.explode(F.sequence("_at", last)).alias("_j"), F.col("_row").alias("_x"))
    y = own.select(*keys, F.explode(F.sequence(F.lit(0), F.col("_at"))).alias("_i"), F.col("_at").alias("_j"), F.col("_row").alias("_y"))
    both = _dealt(x, y, keys)
    # within a block each two rows meet in both orders, across blocks in one
    first = F.col(f"_x.{id}") < F.col(f"_y.{id}")
    kept = both.where((F.col("_i") < F.col("_j")) | first)
    return kept.select(*keys, F.when(first, F.col("_x")).otherwise(F.col("_y")).alias("a"), F.when(first, F.col("_y")).otherwise(F.col("_x")).alias("b"))


def range_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, before_s: float, after_s: float, condition: Column | None = None) -> DataFrame:
    """Pairs of equal keys with right_time - left_time from -before_s to after_s seconds, and delta_s. Columns other than keys must differ in name."""
    width = int(max(1, before_s + after_s) * 1_000_000)
    bin = lambda c, shift_s=0: F.floor((micros(F.col(c)) + int(shift_s * 1_000_000)) / width)
    bins = F.array_distinct(F.array(bin(left_time, -before_s), bin(left_time, after_s)))
    both = left.withColumn("_bin", F.explode(bins)).join(right.withColumn("_bin", bin(right_time)), [*keys, "_bin"]).drop("_bin")
    delta = (micros(F.col(right_time)) - micros(F.col(left_time))) / 1_000_000
    out = both.withColumn("delta_s", delta).where(F.col("delta_s").between(-before_s, after_s))
    return out if condition is None else out.where(condition)


def nearest(left: DataFrame, right: DataFrame, branches: list[list[str]], id: str, right_id: str, left_time: str, right_time: str, before_s: float, after_s: float) -> DataFrame:
    """An as-of join: each left row with its nearest right row of equal keys in any branch (ties: the smaller right id), or alone.

    Each branch is a list of key columns that both sides have; OR between branches is a union of equi-joins.
    """
    own = [c for c in right.columns if c not in left.columns]
    parts = []
    for keys in branches:
        extra = [c for c in own if c not in keys]
        slim = left.select(id, left_time, *[k for k in keys if k not in (id, left_time)])
        found = range_join(slim, right.select(*keys, *extra), keys, left_time, right_time, before_s, after_s)
        parts.append(found.select(id, "delta_s", *[c for c in own if c in extra]))
    pairs = parts[0]
    for p in parts[1:]:
        pairs = pairs.unionByName(p)
    best = pairs.groupBy(id).agg(F.min_by(F.struct("delta_s", *own), F.struct(F.abs("delta_s"), right_id)).alias("_best"))
    return left.join(best, id, "left").select(*left.columns, "_best.*") if own else left
