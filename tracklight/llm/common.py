"""What several corpus operators share: tables, scratch tables in the shared folder, words and shingles."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words in a shingle, and the similarity from which two documents count as near copies.
SHINGLE_WORDS = 5
NEAR = 0.8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, local mode gets a folder of its own; a cluster must name one."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        current = sc._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else None
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tracklight-")
        sc.setCheckpointDir(found)
    return found


class Scratch:
    """Tables written to the shared folder to cut lineage; they outlive executors. drop() removes one or all, once no result is to be computed from them any more; keep() all but some."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/tracklight-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _at(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def drop(self, name: str = "") -> None:
        path, store = self._at(name)
        store.delete(path, True)

    def keep(self, *names: str) -> None:
        path, store = self._at("")
        for x in store.listStatus(path):
            if x.getPath().getName() not in names:
                store.delete(x.getPath(), True)


#: Rows that a task holds as Python values at once.
SLICE = 256


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], rows: int = SLICE) -> DataFrame:
    """Applies make()'s function to the columns of each slice of an Arrow batch, of so many rows, as lists; make runs once in each task."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for part in slices(batches, rows):
            out = one({n: part.column(k).to_pylist() for k, n in enumerate(part.schema.names)})
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in kind], schema=kind)

    return df.mapInArrow(run, schema)


def word_hashes(text: str) -> np.ndarray:
    """A 32-bit hash of each lower-case word; words are what white space separates."""
    words = text.lower().split()
    return np.fromiter(map(zlib.crc32, map(str.encode, words)), np.uint64, len(words))


_MIX1, _MIX2, _P = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
_S33 = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over the whole range."""
    x = x ^ (x >> _S33)
    x = x * _MIX1
    x = x ^ (x >> _S33)
    x = x * _MIX2
    return x ^ (x >> _S33)


def shingles(text: str | None, n: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted set of hashes of all runs of n words; one run of all words where there are fewer; none without words."""
    w = word_hashes(text or "")
    if not len(w):
        return w
    w = mix(w + _P)
    n = min(n, len(w))
    h = np.zeros(len(w) - n + 1, np.uint64)
    for k in range(n):
        h = h * _P + w[k : len(w) - n + 1 + k]
    return np.unique(mix(h))


def fresh(df: DataFrame, name: str) -> str:
    """A name for a working column that none of df's own has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def as_text(c) -> "F.Column":
    return F.coalesce(c, F.lit(""))


#: Characters that one call handles at once, which bounds what a task holds besides its batch.
CHUNK_CHARS = 1_000_000


def chunks(texts: list[str]) -> Iterator[list[str]]:
    """Slices of about CHUNK_CHARS characters, of whole texts always."""
    start = held = 0
    for k, text in enumerate(texts):
        held += len(text)
        if held >= CHUNK_CHARS:
            yield texts[start : k + 1]
            start, held = k + 1, 0
    if start < len(texts):
        yield texts[start:]


def add_columns(docs: DataFrame, more: list, make: Callable[[], Callable[[list], list[tuple]]], column: str | list[str] = "text", rows: int = SLICE) -> DataFrame:
    """Adds columns computed from one column, or from several as tuples; columns of the same name, in any case, are replaced. make()'s function turns a list of values into a row each."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    names = [f.name for f in more]
    taken = {n.lower() for n in names}
    kept = docs.select(*[f"`{c}`" for c in docs.columns if c.lower() not in taken])
    schema = StructType([*kept.schema.fields, *more])
    at = kept.columns.index(column) if isinstance(column, str) else [kept.columns.index(c) for c in column]
    n, kind = len(kept.columns), to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for part in slices(batches, rows):
            found = one(part.column(at).to_pylist() if isinstance(at, int) else list(zip(*[part.column(k).to_pylist() for k in at], strict=True)))
            extra = [pa.array([r[k] for r in found], type=kind.field(n + k).type) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*[part.column(k).cast(kind.field(k).type) for k in range(n)], *extra], schema=kind)

    return kept.mapInArrow(run, schema)
