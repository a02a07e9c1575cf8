"""Nearest neighbours by collision-counting hashing with query-aware windows.

Vectors are scaled to length one, so that the nearest by cosine are the nearest by distance. Each of PROJECTIONS random
directions gives each vector one number, and each block of vectors keeps those numbers in arrays that are sorted once. A
query looks at the LOOKED directions in which its own number is farthest out: few vectors lie there, and its neighbours are
over-represented among them. Its window lies around its own number and is widened step by step (virtual rehashing, each step
counts only what is new in it); a vector inside the windows of at least THRESHOLD of these directions collides often enough
to be verified by its exact cosine in double precision. Windows grow until no nearer vector is likely to be left out: in a direction
where the query's number is a, a vector of cosine c has c a and a normal deviate of variance 1 - c^2 for its own, so the chance is
known with which one as near as the query's k-th best so far would have collided often enough, and that must be CONFIDENCE.
There is no budget of candidates and no size at which this changes. With exact=True every vector is verified; `recall` compares
both on some of the queries.

Of equal vectors only the k + 1 of smallest ids are looked at, and of equal rows k, as no others can be among a query's k
nearest; so a vector that a third of all rows repeat is no hot spot. Rows are dealt to blocks by a hash, and blocks are bounded in numbers (BLOCK of
them). The queries, a stated set, meet all blocks: a task builds a block's arrays once and streams the queries by. Each
block gives its best k for each query, and the best of those are the result. So memory is bounded, and the work is the
product of queries and vectors all the same, at a small number of counts for each pair.

Null vectors, zero vectors, and those with null or non-finite components take no part, as neither do rows with a null
vec_id. Vectors of another dimension are no candidates. Of rows with a query's vec_id none is its candidate; of query rows
that share a vec_id the one of the smallest vector is asked. Vectors are scaled by a power of two before lengths are taken,
so that neither tiny nor huge ones lose anything. Equal vectors get equal scores, as a row's sum has one order; ties go to
the smaller vec_id. Repeated rows are found repeatedly. Extra columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklight.llm.common import slices

PROJECTIONS, LOOKED, THRESHOLD = 512, 64, 0.25
#: The chance with which a vector as near as the k-th found has been verified.
CONFIDENCE = 0.98
#: The first half-width of a window, and the factor by which it grows; numbers of unit vectors spread with deviation 1.
HALF, GROWTH = 0.3, 1.15
#: Numbers of a block's vectors, at most; a vector of more is a block of its own.
BLOCK = 1 << 20
SEED = 20_240_607


def valid(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row times a power of two, which changes no cosine and no bit of one, and its length then."""
    vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1))[1][:, None])
    return vectors, np.sqrt((vectors * vectors).sum(1))


class Arrays:
    """The sorted arrays of one block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids = ids
        self.vectors, self.norms = scaled(vectors)
        self.directions = np.random.default_rng(SEED).standard_normal((vectors.shape[1], PROJECTIONS)).astype(np.float32)
        values = np.ascontiguousarray(self._numbers(self.vectors, self.norms).T)
        self.order = np.argsort(values, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(values, self.order, 1)

    def _numbers(self, vectors: np.ndarray, norms: np.ndarray) -> np.ndarray:
        return (vectors / norms[:, None]).astype(np.float32) @ self.directions

    def nearest(self, own: np.ndarray, queries: np.ndarray, k: int, exact: bool) -> list[tuple[int, int, float]]:
        """(query's id, vector's id, cosine) of up to k vectors for each query."""
        queries, lengths = scaled(queries)
        at, out = self._numbers(queries, lengths), []
        for q, (query_id, query, length) in enumerate(zip(own, queries, lengths, strict=True)):
            found, cosines = np.zeros(0, np.int64), np.zeros(0)
            for more, half, looked in [(np.arange(len(self.ids)), np.inf, None)] if exact else self._colliding(at[q]):
                more = more[self.ids[more] != query_id]
                found = np.concatenate([found, more])
                cosines = np.concatenate([cosines, (self.vectors[more] * query).sum(1) / (self.norms[more] * length)])
                if len(found) >= k and half < np.inf and collides(np.abs(at[q][looked]), float(np.partition(cosines, -k)[-k]), half) >= CONFIDENCE:
                    break
            out += [(int(query_id), int(self.ids[found[b]]), float(cosines[b])) for b in np.lexsort((self.ids[found], -cosines))[:k]]
        return out

    def _colliding(self, at: np.ndarray) -> Iterator[tuple[np.ndarray, float, np.ndarray]]:
        """As windows grow, the vectors that have come to be in those of enough directions, the half-width and the directions; at last all that are left."""
        n = len(self.ids)
        looked = np.argsort(-np.abs(at), kind="stable")[:LOOKED]
        low = np.array([np.searchsorted(self.sorted[j], at[j]) for j in looked])
        high, counts, known, half = low.copy(), np.zeros(n, np.int64), np.zeros(n, bool), HALF
        while True:
            rings = []
            for k, j in enumerate(looked):
                a, b = np.searchsorted(self.sorted[j], at[j] - half), np.searchsorted(self.sorted[j], at[j] + half, "right")
                rings += [self.order[j, a : low[k]], self.order[j, high[k] : b]]
                low[k], high[k] = min(a, low[k]), max(b, high[k])
            counts += np.bincount(np.concatenate(rings), minlength=n)
            found = (counts >= THRESHOLD * LOOKED) & ~known
            known |= found
            if known.all() or (high - low).min() == n:
                yield np.flatnonzero(found | ~known), np.inf, looked
                return
            yield np.flatnonzero(found), half, looked
            half *= GROWTH


def collides(at: np.ndarray, cosine: float, half: float) -> float:
    """The chance with which a vector of this cosine with the query is within half of the query's numbers (their sizes: at) in THRESHOLD of the directions: they are independent, and their sum is close to normal."""
    spread = math.sqrt(max(1 - cosine * cosine, 1e-12))
    share = np.array([math.erf((half - (1 - cosine) * a) / (spread * math.sqrt(2))) - math.erf((-half - (1 - cosine) * a) / (spread * math.sqrt(2))) for a in at]) / 2
    deviation = math.sqrt(max(float((share * (1 - share)).sum()), 1e-12))
    return 0.5 * (1 + math.erf((float(share.sum()) - THRESHOLD * len(at) + 0.5) / (deviation * math.sqrt(2))))


FOUND = "query_id long, vec_id long, score double"


def _searched(rows: DataFrame, k: int, exact: bool) -> DataFrame:
    """Each block's best for each query, from rows of block, dimension, asks, vec_id and v: a block's vectors come before the queries that meet it."""
    kind = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, ids, vectors, arrays = None, [], [], None
        for batch in slices(batches):
            blocks, dimensions, asks = (batch.column(n).to_pylist() for n in range(3))
            vec_ids = batch.column(3).to_numpy()
            numbers = batch.column(4).flatten().to_numpy()
            ends = np.cumsum(dimensions)
            keys = list(zip(blocks, dimensions, asks, strict=True))
            start = 0
            for end in range(1, len(keys) + 1):
                if end < len(keys) and keys[end] == keys[start]:
                    continue
                block, dimension, ask = keys[start]
                part = numbers[ends[start] - dimension : ends[end - 1]].reshape(-1, dimension)
                if (block, dimension) != place:
                    place, ids, vectors, arrays = (block, dimension), [], [], None
                if not ask:
                    ids.append(vec_ids[start:end])
                    vectors.append(part.copy())
                elif ids:
                    arrays = arrays or Arrays(np.concatenate(ids), np.concatenate(vectors))
                    found = arrays.nearest(vec_ids[start:end], part, k, exact)
                    columns = zip(*found, strict=True) if found else ([], [], [])
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)
                start = end

    dealt = rows.repartition("block", "dimension").sortWithinPartitions("block", "dimension", "asks")
    return dealt.select("block", "dimension", "asks", "vec_id", "v").mapInArrow(run, FOUND)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_column: str = "vec_id", column: str = "embedding", exact: bool = False) -> DataFrame:
    """query_id, rank (from 1), vec_id and score, the cosine, of each query's k nearest found."""
    named = lambda df: df.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & valid(F.col("v")))
    rows = named(vectors)
    asked = named(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    numbers = rows.agg(F.coalesce(F.sum(F.size("v")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-numbers // BLOCK))
    smallest = Window.partitionBy("v").orderBy("vec_id")
    # k repeats of a row, and k + 1 ids of a vector, are all that can be among a query's k nearest
    few = rows.groupBy("v", "vec_id").agg(F.count(F.lit(1)).alias("times")).withColumn("copy", F.row_number().over(smallest)).where(F.col("copy") <= k + 1)
    few = few.select("v", "vec_id", F.explode(F.sequence(F.lit(1), F.least("times", F.lit(k)).cast("int"))).alias("repeat"))
    data = few.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_blocks)).cast("int").alias("block"), F.lit(False).alias("asks"), "vec_id", "v")
    ask = asked.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), F.lit(True).alias("asks"), "vec_id", "v")
    found = _searched(data.unionByName(ask).withColumn("dimension", F.size("v")), k, exact)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def recall(vectors: DataFrame, queries: DataFrame, k: int = 5, asked: int = 50, **named) -> float:
    """The share of the k nearest that a search finds, over this many of the queries (by a hash of their ids), against a search that verifies every vector; 1 without any."""
    id_column = named.get("id_column", "vec_id")
    some = queries.orderBy(F.xxhash64(id_column), id_column).limit(asked)
    found, truth = (search(vectors, some, k, exact=e, **named).select("query_id", "vec_id", "rank") for e in (False, True))
    hits = truth.join(found.select("query_id", "vec_id").distinct(), ["query_id", "vec_id"], "left_semi").count()
    return hits / total if (total := truth.count()) else 1.0
