"""Balanced label propagation: linked documents move towards the shards of their neighbours, under capacity quotas.

Law of the sizes: `rows`; the shards' counts differ by one at most. Documents are linked by equal texts, or by any table
of (doc_id, key) pairs in which equal keys link documents. Each linked row starts in a shard of its own; in each round the
rows of a key vote for the shard that holds most of them, each row follows its heaviest key, and a shard takes no more
rows than it has room for (a key's rows move or wait together, by a hash against the room's share of the demand). A last
round has no quota, so that every key comes together; what is too much in a shard then leaves it key by key, in order, and
fills the room of others in the same order, so that a key is cut only where a shard is full, once for each shard at most. A key
with more rows than a quarter of a shard is split into blocks of about that size, so that it is spread over as few shards
as its size needs and no task or vote gathers it. Rows without links fill up each shard exactly.

Everything is DataFrame operations on slim rows: texts are read once and never shuffled. What reaches the driver are
counts for each shard; the table of row offsets that is broadcast has a row for each partition of a sort.

Null texts have size 16 and a null checksum and link to nothing; empty texts are equal texts. Repeated rows are placed
each. With fewer rows than shards some shards stay empty, and an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklight.llm.common import Scratch

SHARDS, ROUNDS, OVERHEAD = 40, 5, 16


def _ranked(df: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """Adds rank, gapless from 0 in the given order: a range sort numbers rows in each partition, whose counts give offsets."""
    sorted_rows = scratch.save(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), name)
    part = F.shiftright("at", 33)
    counts = sorted_rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each partition
    offsets, total = [], 0
    for r in sorted(counts):
        offsets.append((r.part, total))
        total += r.n
    if not offsets:
        return sorted_rows.select("*", F.lit(0).cast("long").alias("rank")).drop("at")
    table = F.map_from_arrays(F.array(*[F.lit(p).cast("long") for p, _ in offsets]), F.array(*[F.lit(o).cast("long") for _, o in offsets]))
    one = df.sparkSession.range(1).select(F.explode(table).alias("part", "offset"))
    return sorted_rows.withColumn("part", part).join(F.broadcast(one), "part").withColumn("rank", F.col("offset") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "offset", "at")


def _by_shard(df: DataFrame, column: str, shards: int) -> list[int]:
    found = {r[0]: r[1] for r in df.groupBy(column).agg(F.count(F.lit(1))).collect()}
    return [found.get(s, 0) for s in range(shards)]


def _of(values: list[float], index: Column, kind: str = "long") -> Column:
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), index.cast("int") + 1)


def _spread(*cols) -> Column:
    """A hash as a number from 0 to 1."""
    return (F.xxhash64(*cols).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))).cast("double")


def propagate(members: DataFrame, rows: DataFrame, quota: list[int], rounds: int, scratch: Scratch) -> DataFrame:
    """row and shard of each of rows (row), moved in rounds along members (row, key); the round after the last has no quota."""
    shards = len(quota)
    labels = scratch.save(rows.select("row", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard")), "labels-0")
    for k in range(1, rounds + 2 if rounds else 1):
        votes = members.join(labels, "row").groupBy("key", "shard").agg(F.count(F.lit(1)).alias("n"))
        prefer = votes.groupBy("key").agg(F.max(F.struct("n", F.xxhash64("key", "shard").alias("tie"), "shard")).alias("best")).select("key", F.col("best.n").alias("weight"), F.col("best.shard").alias("target"))
        heaviest = members.join(prefer, "key").groupBy("row").agg(F.max(F.struct("weight", "key", "target")).alias("best"))
        wish = scratch.save(labels.join(heaviest, "row").select("row", "shard", F.col("best.key").alias("key"), F.col("best.target").alias("target")), f"wish-{k}")
        move = wish.where("shard != target")
        load, demand, leaving = _by_shard(wish, "shard", shards), _by_shard(move, "target", shards), _by_shard(move, "shard", shards)
        if not sum(demand):
            break  # every key is together
        share = [min(1.0, max(0.0, quota[s] - load[s] + 0.5 * leaving[s]) / max(1, demand[s])) if k <= rounds else 1.0 for s in range(shards)]
        goes = (F.col("shard") != F.col("target")) & (_spread("key", F.lit(k)) < _of(share, F.col("target"), "double"))
        labels = scratch.save(wish.select("row", F.when(goes, F.col("target")).otherwise(F.col("shard")).alias("shard")), f"labels-{k}")
        scratch.drop(f"wish-{k}")
        scratch.drop(f"labels-{k - 1}")
    return labels


def shard(docs: DataFrame, shards: int = SHARDS, links: DataFrame | None = None, rounds: int = ROUNDS, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null under this law) of every row.

    links: pairs (doc_id, key); without it, rows of equal text are linked.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    text = F.col("text")
    own = docs.select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"), text.isNotNull().alias("linkable"))
    rows = scratch.save(own.withColumn("row", F.monotonically_increasing_id()), "rows")
    total = rows.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    block = max(1, total // shards // 4)
    keyed = rows.where("linkable").select("row", F.col("text_hash").alias("key")) if links is None else rows.select("row", "doc_id").join(links.select("doc_id", F.xxhash64("key").alias("key")).distinct(), "doc_id").select("row", "key")
    # written first, so that the join's sides are both shuffled for it and a hot key can be split
    sizes = scratch.save(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    blocks = F.ceil(F.col("n") / block)
    part = F.when(blocks > 1, F.pmod(F.xxhash64("row"), blocks)).otherwise(F.lit(0).cast("long"))
    members = scratch.save(keyed.join(sizes, "key").select("row", F.xxhash64("key", part).alias("key")), "members")
    linked = members.groupBy("row").agg(F.min("key").alias("key"))
    labels = propagate(members, linked, quota, rounds, scratch)
    placed = rows.drop("text_hash", "linkable").join(labels.join(linked, "row"), "row", "left")
    placed = scratch.save(placed, "placed")

    load = _by_shard(placed.where("shard is not null"), "shard", shards)
    starts = [sum(load[:s]) for s in range(shards)]
    ranked = _ranked(placed.where("shard is not null"), ["shard", "key", "doc_id", "text_crc32", "row"], scratch, "ranked").withColumn("slot", F.col("rank") - _of(starts, F.col("shard")))
    stays = F.col("slot") < _of(quota, F.col("shard"))
    kept = [min(load[s], quota[s]) for s in range(shards)]
    upto = [sum(quota[t] - kept[t] for t in range(s + 1)) for s in range(shards)]
    rest = placed.where("shard is null").unionByName(ranked.where(~stays).select(*placed.columns))
    rest = _ranked(rest.withColumn("single", F.col("shard").isNull()), ["single", "key", "doc_id", "text_crc32", "row"], scratch, "rest")
    where = F.size(F.filter(F.array(*[F.lit(u).cast("long") for u in upto]), lambda u: u <= F.col("rank")))
    filled = rest.withColumn("shard", where).withColumn("slot", F.col("rank") - _of([0, *upto[:-1]], F.col("shard")) + _of(kept, F.col("shard")))
    scratch.keep("ranked", "rest")
    columns = ["doc_id", "size", "text_crc32", "shard", "slot"]
    out = ranked.where(stays).select(*columns).unionByName(filled.select(*columns))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
