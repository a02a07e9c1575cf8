"""Near duplicates by SimHash fingerprints of 64 bits, found by pigeonhole blocks.

A fingerprint has the majority bit, in each of 64 places, of the hashes of all shingles of a text, repeats included. Words
are what ASCII white space separates, A-Z count as a-z. Two texts link if their fingerprints differ in DISTANCE bits at most.

Equal fingerprints become one node first, so copies, however many, are one row. The 64 bits are cut into BLOCKS blocks;
DISTANCE differing bits leave BLOCKS - DISTANCE of them untouched, so every close pair agrees on some choice of that many
blocks. A node is dealt to a bucket for each choice, (mask, value of the masked bits). A bucket of more than LIMIT nodes is cut
on: its free bits are cut into DISTANCE + 1 parts, of which a close pair agrees on one, and so on, until buckets are small
or no more than DISTANCE bits are free, where all nodes are close to each other and the smallest stands for them (a sum of
minima, of any number of rows). So no pair is lost, and no task holds more than LIMIT nodes of a bucket.

In a bucket distances are verified from one node to all that aren't reached yet, as a search through the bucket's links
goes: a group of near copies is reached in a few steps, and pairs are never listed. What leaves a bucket is an edge
from each node to the smallest that it reaches. Components are those of all edges.

Null and empty texts, and those of white space, have no words: their fingerprint is zero, and they link like any other.
Texts of fewer words than a shingle's are one shingle. Very long texts are read in pieces. Repeated rows, and rows that
share a doc_id, each give a row. Rows with a null doc_id have a fingerprint, link to nothing, and their component is null.
Empty tables give no rows. Extra columns are dropped.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklight.llm.common import Scratch, map_rows
from tracklight.llm.graph import components, in_groups

SHINGLE_WORDS, DISTANCE, BLOCKS, SEED = 4, 4, 6, 42
#: Nodes of a bucket that one task compares.
LIMIT = 32768
#: Bytes of a text that are cut into words at once.
PIECE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def pieces(text: bytes, size: int = PIECE) -> Iterator[bytes]:
    """A text's parts of about this size, cut at white space."""
    start = 0
    while len(text) - start > size and (space := _SPACE.search(text, start + size)):
        yield text[start : space.start()]
        start = space.start()
    yield text[start:] if start else text


def shingle_hashes(text: str | None, n: int = SHINGLE_WORDS, size: int = PIECE) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles, in arrays of bounded size."""
    carried: list[bytes] = []
    fewer = True
    for piece in pieces((text or "").encode().lower(), size):
        words = carried + piece.split()
        if len(words) >= n:
            fewer = False
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate([[0], ends[: len(words) - n] + 1]).tolist()
            digest = xxhash.xxh64_intdigest
            yield np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[n - 1 :].tolist(), strict=True)), np.uint64, len(starts))
            carried = words[len(words) - n + 1 :] if n > 1 else []
        else:
            carried = words
    if fewer and carried:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carried), SEED)], np.uint64)


def fingerprint(text: str | None, n: int = SHINGLE_WORDS, size: int = PIECE) -> int:
    """The bits set in over half of the hashes, as a signed 64-bit number."""
    ones, total = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, n, size):
        total += len(h)
        for k in range(0, len(h), 1 << 14):
            part = h[k : k + (1 << 14)]
            ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, n: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and bits, the fingerprint as a signed long."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs.select("doc_id", "text"), f"doc_id {kind}, bits long", lambda: lambda c: {"doc_id": c["doc_id"], "bits": [fingerprint(t, n) for t in c["text"]]})


def _parts(mask: int, n: int) -> list[int]:
    """The bits that a mask leaves free, cut into n runs of almost equal length, as masks."""
    free = [k for k in range(64) if not mask >> k & 1]
    cuts = [len(free) * k // n for k in range(n + 1)]
    return [sum(1 << k for k in free[a:b]) for a, b in itertools.pairwise(cuts)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def first_masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """The masks of all choices of blocks that a close pair may agree on."""
    return [_signed(sum(chosen)) for chosen in itertools.combinations(_parts(0, blocks), blocks - distance)]


@functools.lru_cache(maxsize=1 << 16)
def next_masks(mask: int, distance: int = DISTANCE) -> list[int]:
    """The masks of a bucket's children."""
    own = mask & (1 << 64) - 1
    return [_signed(own | part) for part in _parts(own, distance + 1)]


def free_bits(mask: int) -> int:
    return 64 - (mask & (1 << 64) - 1).bit_count()


def reached(values: np.ndarray, distance: int) -> np.ndarray:
    """For each of these different values the index of the smallest that a chain of links leads to."""
    order = np.argsort(values)
    bits, root = values.view(np.uint64)[order], np.arange(len(values))
    left = np.arange(len(values))
    while len(left):
        first, left, queue = left[0], left[1:], [left[0]]
        while queue and len(left):
            near = np.bitwise_count(bits[left] ^ bits[queue.pop()]) <= distance
            if near.any():
                new, left = left[near], left[~near]
                root[new] = first
                queue += new.tolist()
    out = np.empty(len(values), np.int64)
    out[order] = order[root]
    return out


def links(nodes: DataFrame, scratch: Scratch, distance: int = DISTANCE, blocks: int = BLOCKS, limit: int = LIMIT) -> DataFrame:
    """Edges (u, v), v smaller, whose components are those of all pairs of bits that differ in distance bits at most. nodes: bits, each once."""
    masks = first_masks(blocks, distance)
    dealt = nodes.select("bits", F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask"))
    dealt = dealt.select("bits", "mask", F.col("bits").bitwiseAND(F.col("mask")).alias("value"))

    def search(g: dict[str, list]) -> dict[str, list]:
        values = np.array(g["bits"], np.int64)
        root = reached(values, distance)
        more = np.flatnonzero(root != np.arange(len(values)))
        return {"u": values[more].tolist(), "v": values[root[more]].tolist()}

    def split(c: dict[str, list]) -> dict[str, list]:
        rows = [(b, m) for b, mask in zip(c["bits"], c["mask"], strict=True) for m in next_masks(mask, distance)]
        return {"bits": [b for b, _ in rows], "mask": [m for _, m in rows], "value": [b & m for b, m in rows]}

    edges, level = None, 0
    while True:
        # written first, so that both sides of the join are shuffled for it and a hot bucket can be cut
        dealt = scratch.save(dealt, f"dealt-{level}")
        sizes = scratch.save(dealt.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("size"), F.min("bits").alias("least")).where("size > 1"), f"sizes-{level}")
        held = dealt.join(sizes, ["mask", "value"])
        free = 64 - F.bit_count("mask")
        small = in_groups(held.where((F.col("size") <= limit) & (free > distance)).select("mask", "value", "bits"), ["mask", "value"], "u long, v long", search)
        star = held.where((free <= distance) & (F.col("bits") != F.col("least"))).select(F.col("bits").alias("u"), F.col("least").alias("v"))
        found = scratch.save(small.unionByName(star).distinct(), f"edges-{level}")
        edges = found if edges is None else edges.unionByName(found)
        large = held.where((F.col("size") > limit) & (free > distance))
        if sizes.where((F.col("size") > limit) & (free > distance)).isEmpty():
            for k in range(level + 1):
                scratch.drop(f"dealt-{k}")
                scratch.drop(f"sizes-{k}")
            return edges
        # children of two buckets may be the same one
        dealt = map_rows(large.select("bits", "mask"), "bits long, mask long, value long", lambda: split).distinct()
        level += 1


def near_duplicates(docs: DataFrame, scratch: Scratch | None = None, n: int = SHINGLE_WORDS, distance: int = DISTANCE, limit: int = LIMIT) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id, the smallest doc_id that links lead to, of every row of docs (doc_id, text)."""
    scratch = scratch or Scratch(docs.sparkSession)
    own = scratch.save(fingerprints(docs, n), "fingerprints")
    nodes = scratch.save(own.where("doc_id is not null").groupBy("bits").agg(F.min("doc_id").alias("least")), "nodes")
    edges = links(nodes.select("bits"), scratch, distance, limit=limit)
    both = scratch.save(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "both")
    labels = components(both, scratch).withColumnRenamed("node", "bits")
    grouped = nodes.join(labels, "bits", "left").withColumn("label", F.coalesce("label", "bits"))
    named = grouped.groupBy("label").agg(F.min("least").alias("component_id"))
    named = scratch.save(grouped.select("bits", "label").join(named, "label").select("bits", "component_id"), "named")
    scratch.keep("fingerprints", "named")
    out = own.join(named, "bits", "left")
    shown = F.lpad(F.lower(F.hex("bits")), 16, "0")
    return out.select("doc_id", shown.alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
