"""Similarity join of documents by the Jaccard measure of their sets of word shingles, by chosen paths.

Rows with equal sets first become one class representative, so copies are never paired. A set is represented by
COORDINATES minimum hashes. In each run a set starts at the run's root and follows paths: at a node, one or two
coordinates (1 / NEAR on average) are drawn by a hash of the path, the same for all sets there, and each set goes on to
the child named by its own value in that coordinate. Sets that share a child share a sampled token. A node with at most
BUCKET sets is a bucket; larger ones are split on, until they are small enough, or no longer shrink because their sets
are alike, or are DEPTH deep: the last two are worked off exactly, block against block. So every node ends in an exact
comparison and none is capped. A pair of similarity 0.8 shares a child with probability 0.84 in each run, and less often a
grandchild, so runs are repeated, RUNS at a time, until the recall is TARGET at least. It is measured on all links: runs with
even and odd numbers find theirs independently, so of the links that one half finds the other finds its own share of all
(capture and recapture). It also ends when further runs find no link that wasn't known.

In a bucket, pairs of similar minimum hashes are checked on their whole sets; a pair in several buckets counts in the first
only, and what leaves a bucket is a row for each set, with its number of links and one edge to its group. Pairs are
never emitted. Classes are the connected components of all edges.

Texts are shuffled once, for the documents that have a candidate; otherwise slim rows are.

doc_id is an integer; it is cast to long. Of very long texts all shingles are hashed, one text at a time; an empty table gives
no rows. Null and empty texts have no shingles, link to nothing and are classes of their own; texts of less than five words are
one shingle. Repeated rows are copies of each other. Rows that share a doc_id but not a text are told apart by class_no, and by
text_hash where that is null; class_id, a doc_id, can't tell their classes apart. Rows with a null doc_id take no part:
their class is null, and they have no links. Extra columns are dropped.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklight.llm.common import NEAR, Scratch, fresh, map_rows, mix, shingles
from tracklight.llm.graph import components, in_groups

COORDINATES, RUNS, BUCKET, DEPTH, BLOCK = 64, 12, 96, 10, 256
#: The share of links that are to be found.
TARGET = 0.99
#: Share of equal coordinates below which no pair of similarity NEAR lies: five standard deviations less.
SKETCH = NEAR - 5 * (NEAR * (1 - NEAR) / COORDINATES) ** 0.5
#: A child with this share of its parent's sets holds sets that are alike.
ALIKE = 0.6
_RNG = np.random.default_rng(11)
_A = _RNG.integers(1, 1 << 63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, COORDINATES, np.uint64)
_U = np.uint64


def signature(found: np.ndarray) -> np.ndarray:
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint64)
    for k in range(0, len(found), 2048):
        out = np.minimum(out, ((found[k : k + 2048, None] * _A + _B) >> _U(32)).min(0))
    return out.astype(np.uint32)


def children(paths: np.ndarray, signatures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row of each child's parent, and the child's path. The lowest bit of a path is that of its run's number."""
    rows = np.arange(len(paths))
    first = (mix(paths + _U(0x51)) % _U(COORDINATES)).astype(np.int64)
    second = (first + 1 + (mix(paths + _U(0x52)) % _U(COORDINATES - 1)).astype(np.int64)) % COORDINATES
    twice = np.flatnonzero((mix(paths + _U(0x53)) >> _U(11)) / float(1 << 53) < 1 / NEAR - 1)
    row, at = np.concatenate([rows, twice]), np.concatenate([first, second[twice]])
    path = mix(mix(paths[row] ^ _U(0xA5A5)) + (at.astype(np.uint64) << _U(32) | signatures[row, at].astype(np.uint64)))
    return row, path & ~_U(1) | paths[row] & _U(1)


def roots(runs: range) -> np.ndarray:
    numbers = np.array(runs, np.uint64)
    return mix(numbers) & ~_U(1) | numbers & _U(1)


def _signatures(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint32).reshape(-1, COORDINATES)


def sets(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, set_key (null without shingles or doc_id), n (shingles) and sig (the minimum hashes)."""

    def one(cols):
        out = {"doc_id": cols["doc_id"], "text_hash": cols["text_hash"], "set_key": [], "n": [], "sig": []}
        for doc_id, text in zip(cols["doc_id"], cols["text"], strict=True):
            s = shingles(text if doc_id is not None else None)
            out["set_key"].append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            out["n"].append(len(s))
            out["sig"].append(signature(s).tobytes() if len(s) else None)
        return out

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text"), "doc_id long, text_hash long, set_key binary, n int, sig binary", lambda: one)


def representatives(all_sets: DataFrame) -> DataFrame:
    """rep (a number of its own), doc_id (the smallest), set_key, n, copies and sig of each different set."""
    keyed = all_sets.where("set_key is not null")
    found = keyed.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    own = keyed.join(found, ["set_key", "doc_id"]).dropDuplicates(["set_key"])
    return own.select(F.monotonically_increasing_id().alias("rep"), "doc_id", "set_key", "n", "copies", "sig")


def buckets(reps: DataFrame, scratch: Scratch, runs: range = range(1, RUNS + 1)) -> DataFrame:
    """path, rep and size of the nodes of these runs that are split no further and hold two sets or more."""
    name = f"{runs.start}-{{}}-{{}}".format

    def start(cols):
        sig = _signatures(cols["sig"])
        m = len(sig)
        row, path = children(np.repeat(roots(runs), m), np.tile(sig, (len(runs), 1)))
        return {"rep": np.array(cols["rep"])[row % m], "path": path.view(np.int64), "parent": np.full(len(path), 1 << 62)}

    def split(cols):
        row, path = children(np.array(cols["path"], np.int64).view(np.uint64), _signatures(cols["sig"]))
        return {"rep": np.array(cols["rep"])[row], "path": path.view(np.int64), "parent": np.array(cols["size"])[row]}

    schema, out, k = "rep long, path long, parent long", None, 1
    nodes = map_rows(reps.select("rep", "sig"), schema, lambda: start)
    while True:
        nodes = scratch.save(nodes, name("nodes", k))
        # written first, so that the join's sides are both shuffled for it and a hot path can be split
        sizes = scratch.save(nodes.groupBy("path").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), name("sizes", k))
        kept = scratch.save(nodes.join(sizes, "path").select("rep", "path", "parent", "size"), name("kept", k))
        scratch.drop(name("nodes", k))
        scratch.drop(name("sizes", k))
        goes_on = (F.col("size") > BUCKET) & (F.col("size") < ALIKE * F.col("parent")) & F.lit(k < DEPTH)
        ended = kept.where(~goes_on).select("path", "rep", "size")
        out = ended if out is None else out.unionByName(ended)
        large = kept.where(goes_on)
        if k == DEPTH or large.isEmpty():
            return out
        nodes = map_rows(large.join(reps.select("rep", "sig"), "rep").select("rep", "path", "size", "sig"), schema, lambda: split)
        k += 1


def blocks(found: DataFrame, reps: DataFrame) -> DataFrame:
    """Rows of the tasks that compare buckets: a task has one bucket, or a pair of a large bucket's blocks. paths lists a set's buckets, the largest first: a pair counts in the first that both have, so that few buckets count for many pairs."""
    listed = found.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("order"), "path", "size"))).alias("nodes"))
    own = reps.join(listed, "rep").select("rep", "n", "copies", "sig", F.col("nodes.path").alias("paths"), F.explode("nodes").alias("node"))
    parts = F.ceil(F.col("node.size") / BLOCK)
    own = own.withColumn("own", F.pmod(F.xxhash64("rep"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))))
    return own.select(F.col("node.path").alias("path"), F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "rep", "n", "copies", "sig", "paths")


ROW = "path long, a int, b int, own int, rep long, n int, copies long, sig binary, paths array<long>"


def candidates(g: dict[str, list]) -> np.ndarray:
    """Which pairs of a task's rows have similar signatures and meet in no bucket before this one; upper triangle."""
    m, sig = len(g["rep"]), _signatures(g["sig"])
    like = np.empty((m, m), bool)
    for k in range(m):
        like[k] = (sig == sig[k]).sum(1) >= SKETCH * COORDINATES
    like = np.triu(like, 1)
    if g["a"][0] != g["b"][0]:
        own = np.array(g["own"])
        like &= own[:, None] != own[None, :]
    if like.any():
        rows = np.flatnonzero(like.any(0) | like.any(1))
        earlier: dict[int, int] = {}
        at = [(r, earlier.setdefault(p, len(earlier))) for r in rows for p in g["paths"][r][: g["paths"][r].index(g["path"][0])]]
        if at:
            member = np.zeros((m, len(earlier)), np.float32)
            member[tuple(np.array(at).T)] = 1
            like &= member @ member.T == 0
    return like


def overlaps(found: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    _, number, count = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(found)), [len(s) for s in found])
    new = np.cumsum(count > 1) - 1
    shared = count[number] > 1
    row, column = row[shared], new[number[shared]]
    out, step = np.zeros((len(found), len(found)), np.float32), 4096
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for k in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, [k, k + step])
        part = np.zeros((len(found), step), np.float32)
        part[row[a:b], column[a:b] - k] = 1
        out += part @ part.T
    return out


def links(g: dict[str, list]) -> np.ndarray:
    """Which pairs of a task's rows are links that count here; upper triangle."""
    like = candidates(g)
    if not like.any():
        return like
    rows = np.flatnonzero(like.any(0) | like.any(1))
    both = overlaps([np.frombuffer(g["set"][r], np.uint64) for r in rows])
    n = np.array(g["n"])[rows]
    near = both >= NEAR * (n[:, None] + n[None, :] - both) - 1e-6
    like[np.ix_(rows, rows)] &= near
    return like


def recaptured(g: dict[str, list], like: np.ndarray) -> tuple[int, int, int]:
    """How many of a task's links runs of even numbers find, those of odd numbers, and both."""
    rows = np.flatnonzero(like.any(0) | like.any(1))
    if not len(rows):
        return 0, 0, 0
    pair = like[np.ix_(rows, rows)]
    row = np.repeat(np.arange(len(rows)), [len(g["paths"][r]) for r in rows])
    path = np.concatenate([np.array(g["paths"][r]) for r in rows])
    _, number, count = np.unique(path, return_inverse=True, return_counts=True)
    found = []
    for bit in (0, 1):
        own = (count[number] > 1) & (path & 1 == bit)
        _, column = np.unique(number[own], return_inverse=True)
        member = np.zeros((len(rows), int(column.max()) + 1 if len(column) else 1), np.float32)
        member[row[own], column] = 1
        found.append((member @ member.T > 0) & pair)
    return int(found[0].sum()), int(found[1].sum()), int((found[0] & found[1]).sum())


def _in_tasks(rows: DataFrame, schema: str, one) -> DataFrame:
    """Applies one to each task's rows."""
    return in_groups(rows, ["path", "a", "b"], schema, one)


def _needed(g):
    like = candidates(g)
    rows = np.flatnonzero(like.any(0) | like.any(1)).tolist()
    return {n: [g[n][r] for r in rows] for n in g}


LINKED = "rep long, root long, links long, even long, odd long, both long"


def _linked(g):
    like = links(g)
    counts = recaptured(g, like)
    like |= like.T
    rows = np.flatnonzero(like.any(0))
    rep, copies = np.array(g["rep"]), np.array(g["copies"])
    root = rep.copy()
    while len(rows):
        new = np.array([min(root[r], root[like[r]].min()) for r in rows])
        if (new == root[rows]).all():
            break
        root[rows] = new
    out = {"rep": rep[rows].tolist(), "root": root[rows].tolist(), "links": (like[rows] @ copies).astype(int).tolist()}
    return out | {name: [n, *[0] * (len(rows) - 1)] if len(rows) else [] for name, n in zip(("even", "odd", "both"), counts, strict=True)}


def _compare(docs: DataFrame, reps: DataFrame, found: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The links within buckets: rep, root, links, and the counts of recaptured, of each task's sets."""
    needed = scratch.save(_in_tasks(blocks(found, reps), ROW, _needed), f"needed-{name}")

    def whole(cols):
        return {"rep": cols["rep"], "set_key": cols["set_key"], "set": [shingles(t).tobytes() for t in cols["text"]]}

    asked = needed.select("rep").distinct().join(reps.select("rep", "doc_id", "set_key"), "rep")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(asked, "doc_id").select("rep", "set_key", "text")
    sets_of = map_rows(texts, "rep long, set_key binary, set binary", lambda: _own(whole))
    sets_of = scratch.save(sets_of.dropDuplicates(["rep"]), f"whole-sets-{name}")
    full = needed.join(sets_of.select("rep", "set"), "rep")
    linked = scratch.save(_in_tasks(full.select("path", "a", "b", "own", "rep", "n", "copies", "sig", "paths", "set"), LINKED, _linked), f"linked-{name}")
    scratch.drop(f"needed-{name}")
    scratch.drop(f"whole-sets-{name}")
    return linked


def recall(even: int, odd: int, both: int) -> float:
    """The share of all links that two independent halves of the runs have found together; 1 without links."""
    return 1.0 if not even and not odd else (even + odd - both) * both / (even * odd) if both else 0.0


def _links_at_target(docs: DataFrame, reps: DataFrame, scratch: Scratch, runs: int, target: float) -> DataFrame:
    """Repeats runs until enough links are found."""
    found, known, first = None, -1, 1
    while True:
        more = buckets(reps, scratch, range(first, first + runs))
        found = more if found is None else found.unionByName(more)
        linked = _compare(docs, reps, found, scratch, str(first))
        counts = linked.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("even", "odd", "both")]).first()
        links = counts.even + counts.odd - counts.both
        if recall(*counts) >= target or links == known:
            return linked
        known, first = links, first + runs


def join(docs: DataFrame, scratch: Scratch | None = None, runs: int = RUNS, target: float = TARGET) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class), n_links (other documents of similarity NEAR or more, copies included), copies (of its set, itself included), text_hash and class_no (a number of the class's own; null without shingles)."""
    scratch = scratch or Scratch(docs.sparkSession)
    all_sets = scratch.save(sets(docs), "sets")
    reps = scratch.save(representatives(all_sets), "reps")
    linked = _links_at_target(docs, reps, scratch, runs, target)
    edges = linked.where("rep != root").select(F.col("rep").alias("u"), F.col("root").alias("v"))
    edges = scratch.save(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = components(edges, scratch)
    counted = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    named = labels.join(reps.select(F.col("rep").alias("node"), "doc_id"), "node").groupBy("label").agg(F.min("doc_id").alias("class_id"))
    named = labels.join(named, "label").select(F.col("node").alias("rep"), F.col("label").alias("class_no"), "class_id")
    classes = reps.select("rep", "doc_id", "set_key", "copies").join(named, "rep", "left").join(counted, "rep", "left")
    classes = scratch.save(classes.select("set_key", F.coalesce("class_no", "rep").alias("class_no"), F.coalesce("class_id", "doc_id").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links")), "classes")
    scratch.keep("sets", "classes")
    out = all_sets.select("doc_id", "text_hash", "set_key").join(classes, "set_key", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), "text_hash", "class_no")


def _own(whole):
    """Of rows that share a doc_id but not a text, those of the class's own set."""

    def one(cols):
        out = whole(cols)
        keep = [k for k, (s, key) in enumerate(zip(out["set"], out["set_key"], strict=True)) if xxhash.xxh3_128_digest(s) == key]
        return {n: [v[k] for k in keep] for n, v in out.items()}

    return one


def keep_one(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One row of docs for each class, that of the smallest doc_id (and then of the smallest hash of its text). Rows with a null doc_id all stay. Of the scratch tables only that of the keys which stay is left."""
    scratch = scratch or Scratch(docs.sparkSession)
    found, text_hash = join(docs, scratch), fresh(docs, "text_hash")
    alone = [F.when(F.col("class_no").isNull(), F.col(c)).alias(f"alone_{c}") for c in ("doc_id", "text_hash")]
    stays = found.where("class_id is not null").groupBy("class_no", *alone).agg(F.min(F.struct("doc_id", "text_hash")).alias("first")).select(F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias(text_hash))
    stays = scratch.save(stays, "stays")
    scratch.keep("stays")
    hashed = docs.withColumn(text_hash, F.xxhash64("text"))
    one = hashed.join(stays, ["doc_id", text_hash], "left_semi").dropDuplicates(["doc_id", text_hash])
    return one.select(*[f"`{c}`" for c in docs.columns]).unionByName(docs.where("doc_id is null"))
