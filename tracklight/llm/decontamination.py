"""Benchmark decontamination by latent semantic retrieval.

Benchmark passages are TF-IDF vectors over hashed words (FEATURES of them). A randomised SVD, whose products with the
matrix of passages run on the executors, gives the space of its RANK strongest directions. Every text is covered by
half-overlapping windows, of WINDOWS words, whose vectors in that space are sums over blocks of half a window; a window is a
candidate for a passage of its length where their cosine there is at least NEAR_SPACE of what a verbatim copy would have.
Passages longer than the longest window are cut into half-overlapping parts of its length, any of which makes a candidate.
A candidate counts as a leak if the longest common subsequence of its surroundings and the passage has at least ALL of
the passage's words, or HALF of them and ANSWER of its answer, which is its last sentence. So reordered or reworded
copies are found as well as verbatim ones, and windows that only share a topic are not. Places that have GRAM words in a
row in common with a passage (all words of a shorter one) are verified too, whatever their vectors say, so no verbatim copy
depends on the space: neither one of frequent words nor one of a passage whose vector there is 0.

A passage of fewer than GRAM words says little: its words may come together by chance. It is a leak where it stands as a whole
sentence or line of the text, and a mention elsewhere; one of fewer than LEAST words is a mention always. Mentions
are listed, but no document goes for them.

The executors get the space (FEATURES x RANK numbers at most) and PASSAGES passages at a time, however large the
benchmark is; texts are scanned once for each such block and never shuffled.

Null and empty texts leak nothing; passages without words are left out. Each distinct text of the benchmark is looked up once
and stands for all its item_ids, null among them; an item_id with several texts has all of them, and is named once for a
document, with its best one. Repeated documents give repeated results. An empty benchmark finds nothing. Input columns stay,
but one named leaks is replaced.
"""

from __future__ import annotations

import itertools
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from tracklight.llm.common import add_columns, fresh, map_rows

BITS, RANK, EXTRA, POWER = 16, 64, 10, 2
FEATURES = 1 << BITS
#: Each twice the one before.
WINDOWS = (4, 8, 16, 32, 64, 128)
#: About how many words are looked up at once; a longer text is one look-up of its own.
PART = 1 << 16
#: Words whose vectors are held at once.
GATHER = 1 << 12
PASSAGES = 4096
NEAR_SPACE, ALL, HALF, ANSWER = 0.5, 0.75, 0.5, 0.8
#: Words in more than this share of distinct passages have this small weight: they say little about a topic.
COMMON, FREQUENT = 0.1, 0.25
#: Words in a row that make a place a candidate.
GRAM = 8
#: Words that a passage must have to be a leak.
LEAST = 3
_STEP, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
SEED = 7
WORD = re.compile(r"\w+")
SENTENCE, LINE = re.compile(r"[.!?\n]+"), re.compile(r"\n+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def number(word: str) -> int:
    return zlib.crc32(word.encode()) & (FEATURES - 1)


def places_of(a: list) -> dict:
    """For each word of a, a number with a bit for each of its places."""
    out: dict = {}
    for k, x in enumerate(a):
        out[x] = out.get(x, 0) | 1 << k
    return out


def common_subsequence(a: list, b: list, places: dict | None = None, least: float = 0) -> int:
    """The length of the longest one, with a column of the table in the bits of a number; 0 if fewer than `least` words of b are in a."""
    places = places_of(a) if places is None else places
    held = [places[y] for y in b if y in places]
    if len(held) < least:
        return 0
    row = full = (1 << len(a)) - 1
    for h in held:
        match = row & h
        row = ((row + match) | (row - match)) & full
    return len(a) - row.bit_count()


def _pairs(x: np.ndarray, step: int) -> np.ndarray:
    """Sums of neighbouring rows, from each row or each second one on; a last row without a neighbour stands for itself where it starts a pair."""
    if step == 1:
        return x[:-1] + x[1:] if len(x) > 1 else x
    out = x[::2].copy()
    out[: len(x) // 2] += x[1::2]
    return out


def grams(codes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n words in a row."""
    out = np.zeros(max(0, len(codes) - n + 1), np.uint64)
    for k in range(n if len(out) else 0):
        out = out * _STEP + codes[k : k + len(out)]
    return (out ^ (out >> np.uint64(32))) * _SPREAD


def answer(text: str) -> list[str]:
    """The words of the last sentence of at least three words; else the last eight."""
    for s in reversed(re.split(r"[.!?\n]+", text)):
        if len(w := words(s)) >= 3:
            return w
    return words(text)[-8:]


def parts(f: np.ndarray) -> list[np.ndarray]:
    """f, or its half-overlapping parts if it is longer than the longest window; the last one ends where f does."""
    n = WINDOWS[-1]
    if len(f) <= n:
        return [f]
    return [f[k : k + n] for k in [*range(0, len(f) - n, n // 2), len(f) - n]]


@dataclass
class Space:
    """idf of each feature, and the right singular vectors of the passages' matrix as rows by feature."""

    idf: np.ndarray
    vectors: np.ndarray
    most: float


def _counts(passages: DataFrame) -> DataFrame:
    """The words' numbers of each passage, once for passages of the same words: copies make no word frequent."""

    def one(cols):
        return {"features": [[number(w) for w in words(t)] for t in cols["text"]]}

    return map_rows(passages.select("text"), "features array<int>", lambda: one).distinct()


def latent_space(passages: DataFrame, rank: int = RANK) -> Space:
    """Only sums over the passages come to the driver: FEATURES rows at most."""
    counts = _counts(passages).cache()
    total = counts.count()
    df = counts.select(F.explode(F.array_distinct("features")).alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n")).collect()
    most = float(np.log(max(2, total))) + 1
    idf = np.full(FEATURES, most)
    seen = np.array([r.f for r in df], int)
    for r in df:
        idf[r.f] = FREQUENT if r.n > max(3, COMMON * total) else np.log(total / r.n) + 1
    wide = min(rank + EXTRA, max(1, total), max(1, len(seen)))
    basis = np.zeros((FEATURES, wide), np.float32)
    basis[seen] = np.random.default_rng(SEED).standard_normal((len(seen), wide))
    for _ in range(POWER + 1):
        basis = np.linalg.qr(_gram_product(counts, idf, basis, wide))[0].astype(np.float32)
    small = _gram(counts, idf, basis)
    values, turn = np.linalg.eigh(small)
    keep = [k for k in np.argsort(values)[::-1][:rank] if values[k] > 1e-6 * max(values.max(), 1e-12)]
    counts.unpersist()
    return Space(idf, (basis @ turn[:, keep]).astype(np.float32) if keep else np.zeros((FEATURES, 1), np.float32), most)


def _weights(features: list[int], idf: np.ndarray) -> np.ndarray:
    w = idf[features]
    return w / max(1e-12, np.sqrt((w * w).sum()))


def _gram_product(counts: DataFrame, idf: np.ndarray, basis: np.ndarray, wide: int) -> np.ndarray:
    """A'A times basis, where A has a row for each passage: each task sums its rows' parts, and Spark the tasks'."""
    shared = counts.sparkSession.sparkContext.broadcast((idf, basis))

    def run(cols):
        weight, right = shared.value
        out = np.zeros((FEATURES, wide))
        for f in cols["features"]:
            if f:
                w = _weights(f, weight)
                np.add.at(out, f, np.outer(w, w @ right[f]))
        used = np.flatnonzero(np.abs(out).sum(1))
        return {"f": used, "v": list(out[used])}

    parts = map_rows(counts, "f int, v array<double>", lambda: run)
    found = parts.groupBy("f").agg(F.array(*[F.sum(F.col("v")[k]) for k in range(wide)]).alias("v")).collect()
    out = np.zeros((FEATURES, wide))
    for r in found:
        out[r.f] = r.v
    shared.unpersist()
    return out


def _gram(counts: DataFrame, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    product = _gram_product(counts, idf, basis, basis.shape[1])
    return basis.T @ product


@dataclass
class Grams:
    """Hashes of all passages' words in a row, sorted, with the passage and the place there of each; a passage has each hash once. Bits of seen are those of hashes."""

    hashes: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    shift: np.uint64
    seen: np.ndarray

    @classmethod
    def of(cls, own: list[tuple[int, np.ndarray]]) -> Grams:
        owner, place, hashes = [], [], []
        for k, h in own:
            first = np.sort(np.unique(h, return_index=True)[1])
            owner.append(np.full(len(first), k, np.int32))
            place.append(first.astype(np.int32))
            hashes.append(h[first])
        owner, place, hashes = (np.concatenate(x) for x in (owner, place, hashes))
        order = np.argsort(hashes, kind="stable")
        shift = np.uint64(64 - min(26, max(12, len(hashes).bit_length() + 3)))
        seen = np.zeros(1 << (64 - int(shift)), bool)
        seen[hashes >> shift] = True
        return cls(hashes[order], owner[order], place[order], shift, seen)

    def find(self, h: np.ndarray):
        """The passage, its place there and the place in h, of each hash that a passage has."""
        some = np.flatnonzero(self.seen[h >> self.shift])
        first, last = (np.searchsorted(self.hashes, h[some], side) for side in ("left", "right"))
        for k in np.flatnonzero(last > first):
            for i in range(first[k], last[k]):
                yield int(self.owner[i]), int(self.place[i]), int(some[k])


@dataclass
class Items:
    """Passages of one block, by window length, and by how many words in a row are looked up. ids are the item_ids of each passage."""

    ids: list[list[int | None]] = field(default_factory=list)
    words: list[list[str]] = field(default_factory=list)
    places: list[dict] = field(default_factory=list)
    answers: list[list[str]] = field(default_factory=list)
    groups: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    grams: dict[int, Grams] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: list, space: Space) -> Items:
        out, own, runs = cls(), {}, {}
        for r in sorted(rows, key=lambda r: r.text):
            w = words(r.text)
            if not w:
                continue
            c = np.array([zlib.crc32(x.encode()) for x in w], np.uint64)
            runs.setdefault(min(GRAM, len(w)), []).append((len(out.ids), grams(c, min(GRAM, len(w)))))
            f = (c & np.uint64(FEATURES - 1)).astype(np.int64)
            window = min(WINDOWS, key=lambda n: abs(np.log(n / len(w))))
            for part in parts(f):
                v = space.idf[part] @ space.vectors[part]
                if length := np.sqrt(v @ v):
                    bound = NEAR_SPACE * length / np.sqrt((space.idf[part] ** 2).sum())
                    own.setdefault(window, []).append((len(out.ids), v / length / bound))
            out.ids.append(sorted(r.item_ids) + [None] * r.unnamed)
            out.words.append(w)
            out.places.append(places_of(w))
            out.answers.append(answer(r.text))
        out.grams = {n: Grams.of(x) for n, x in runs.items()}
        out.groups = {n: (np.array([k for k, _ in x]), np.array([v for _, v in x], np.float32).T) for n, x in own.items()}
        return out


class Finder:
    """Looks texts up many at a time: their words lie one text after the other, with empty blocks between texts, so that no window reaches from one into the next."""

    def __init__(self, space: Space, items: Items) -> None:
        self.items = items
        #: The shortest and the longest window that a passage has: texts are summed in blocks of half the shortest.
        self.least, self.most = min(items.groups, default=WINDOWS[0]), max(items.groups, default=WINDOWS[0])
        used = np.flatnonzero(np.abs(space.vectors).sum(1) * space.idf)
        self.row = np.full(FEATURES, -1)
        self.row[used] = np.arange(len(used))
        self.latent = space.vectors[used] * space.idf[used, None].astype(np.float32)
        self.energy = (space.idf**2).astype(np.float32)

    def leaks(self, text: str) -> list[dict]:
        return self.each([text])[0]

    def _stands(self, text: str) -> set[tuple[str, ...]]:
        """The sentences and lines of a text, as words."""
        return {tuple(words(x)) for split in (SENTENCE, LINE) for x in split.split(text)}

    def each(self, texts: list[str]) -> list[list[dict]]:
        """For each text, item_id, the cosine as a share of a verbatim copy's, and the common subsequence, of each passage in it, once."""
        found = [words(t) for t in texts]
        out: list[list[dict]] = []
        start = held = 0
        for k, w in enumerate(found):
            held += len(w)
            if held >= PART or k == len(found) - 1:
                out += self._part(found[start : k + 1], texts[start : k + 1])
                start, held = k + 1, 0
        return out

    def _part(self, found: list[list[str]], texts: list[str]) -> list[list[dict]]:
        sizes = np.array([len(w) for w in found])
        best: list[dict[int, tuple[float, float | None]]] = [{} for _ in found]
        if sizes.sum() and self.items.ids:
            flat = itertools.chain.from_iterable(found)
            codes = np.fromiter(map(zlib.crc32, map(str.encode, flat)), np.uint64, sizes.sum())
            self._look_up(found, np.cumsum(sizes), codes, best)
            if self.items.groups:
                self._windows(found, sizes, (codes & np.uint64(FEATURES - 1)).astype(np.int64), best)
        return [self._named(b, t) for b, t in zip(best, texts, strict=True)]

    def _named(self, best: dict[int, tuple[float, float | None]], text: str) -> list[dict]:
        out: dict[int | None, dict] = {}
        stands = self._stands(text) if any(LEAST <= len(self.items.words[i]) < GRAM for i in best) else set()
        for i, (common, share) in best.items():
            own = self.items.words[i]
            mention = len(own) < LEAST or len(own) < GRAM and tuple(own) not in stands
            for item_id in self.items.ids[i]:
                if item_id not in out or (not out[item_id]["mention"], out[item_id]["common"]) < (not mention, common):
                    out[item_id] = {"item_id": item_id, "share": share, "common": common, "mention": mention}
        return [out[k] for k in sorted(out, key=lambda k: (k is None, k or 0))]

    def _look_up(self, found: list[list[str]], ends: np.ndarray, codes: np.ndarray, best: list[dict]) -> None:
        """Verifies the places that have words in a row in common with a passage; of those that would start it within an eighth of its length only the first."""
        for n, known in self.items.grams.items():
            last: dict[tuple[int, int], int] = {}
            for i, place, at in known.find(grams(codes, n)):
                t = int(np.searchsorted(ends, at, "right"))
                if at + n > ends[t]:
                    continue
                w, size = found[t], len(self.items.words[i])
                start = at - int(ends[t]) + len(w) - place
                if (t, i) not in last or abs(start - last[t, i]) > size // 8:
                    last[t, i] = start
                    slack = size // 4
                    self._verify(w[max(0, start - slack) : max(0, start + size + slack)], i, None, best[t])

    def _windows(self, found: list[list[str]], sizes: np.ndarray, f: np.ndarray, best: list[dict]) -> None:
        """Verifies the windows near a passage in the space."""
        size, wide = self.least // 2, self.most // 2
        # each text starts at a block of the longest window's half, after an empty one
        starts = np.concatenate([[0], np.cumsum((-(-sizes // wide) + 1) * wide)])
        at = np.arange(len(f)) + np.repeat(starts[:-1] - (np.cumsum(sizes) - sizes), sizes)
        sums, energy, held = self._block_sums(f, at // size, int(starts[-1]) // size)
        checked: set[tuple[int, int, int]] = set()
        enough: dict[tuple[int, int], bool] = {}
        n = self.least
        while n <= self.most:
            if n in self.items.groups:
                index, latent = self.items.groups[n]
                some = np.flatnonzero(_pairs(held, 1))
                share = (sums[some] + sums[some + 1]) @ latent
                share /= np.sqrt(np.maximum(energy[some] + energy[some + 1], 1e-9))[:, None]
                for k, i in zip(*np.nonzero(share >= 1.0), strict=True):
                    place, own = int(some[k]) * (n // 2), int(index[i])
                    if (own, n, place) in checked:
                        continue
                    checked.add((own, n, place))
                    # an empty block and a text's first one are a window of that text
                    t = min(int(np.searchsorted(starts, place + n // 2, "right")) - 1, len(found) - 1)
                    if (t, own) not in enough:
                        enough[t, own] = self._has_half(found[t], own)
                    if enough[t, own]:
                        w, start = found[t], max(0, place - int(starts[t]))
                        end = min(place - int(starts[t]) + n, len(w))
                        reach = max(n // 2, len(self.items.words[own]) - (end - start) // 2)
                        self._verify(w[max(0, start - reach) : end + reach], own, float(share[k, i]) * NEAR_SPACE, best[t])
            sums, energy, held = _pairs(sums, 2), _pairs(energy, 2), _pairs(held, 2)
            n *= 2

    def _has_half(self, w: list[str], i: int) -> bool:
        """Whether the text has enough of the passage's words anywhere."""
        own = self.items.words[i]
        there = self.items.places[i].keys() & w if len(w) < 1000 else self.items.places[i].keys() & set(w)
        return sum(x in there for x in own) >= HALF * len(own)

    def _block_sums(self, f: np.ndarray, block: np.ndarray | None = None, n: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each of n blocks: its vector in the space, its energy, and how many of its words have a vector; block is that of each word, ascending. Without it, those of one text."""
        if block is None:
            size = self.least // 2
            block, n = np.arange(len(f)) // size, -(-len(f) // size)
        sums, held = np.zeros((n, self.latent.shape[1]), np.float32), np.zeros(n, np.int32)
        for start in range(0, len(f), GATHER):
            rows = self.row[f[start : start + GATHER]]
            at = np.flatnonzero(rows >= 0)
            if len(at):
                own = block[at + start]
                first = np.flatnonzero(np.diff(own, prepend=-1))
                sums[own[first]] += np.add.reduceat(self.latent[rows[at]], first, axis=0)
                held[own[first]] += np.diff(first, append=len(own)).astype(np.int32)
        return sums, np.bincount(block, self.energy[f], n), held

    def _verify(self, near: list[str], i: int, share: float | None, best: dict[int, tuple[float, float | None]]) -> None:
        if best.get(i, (0,))[0] >= 1 and (share is None or best[i][1] is not None):
            return
        own, places = self.items.words[i], self.items.places[i]
        common = common_subsequence(own, near, places, HALF * len(own)) / len(own)
        if common >= ALL or common >= HALF and common_subsequence(self.items.answers[i], near) >= ANSWER * len(self.items.answers[i]):
            held, before = best.get(i, (0.0, None))
            if common > held or before is None:
                best[i] = max(common, held), share


LEAK = StructType([StructField("item_id", LongType()), StructField("share", DoubleType()), StructField("common", DoubleType()), StructField("mention", BooleanType())])


def find_leaks(docs: DataFrame, benchmark: DataFrame, block: int = PASSAGES, column: str = "leaks") -> DataFrame:
    """Adds leaks (or another column), an array of struct(item_id, share, common, mention): the benchmark passages that the text holds. share is null for those found by words in a row only; mention is true for short ones that are no leak."""
    named = benchmark.where("length(text) > 0").select(F.col("item_id").cast("long").alias("item_id"), "text")
    passages = named.groupBy("text").agg(F.collect_set("item_id").alias("item_ids"), F.max(F.col("item_id").isNull()).alias("unnamed"))
    space = latent_space(passages)
    n = max(1, -(-passages.count() // block))
    out = docs.drop(column)
    names = [column]
    while len(names) < n:
        names.append(fresh(out.select("*", *[F.lit(0).alias(x) for x in names]), column))
    for k in range(n):
        items = Items.of(passages.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).collect() if n > 1 else passages.collect(), space)
        shared = docs.sparkSession.sparkContext.broadcast((space, items))

        def make(shared=shared):
            own = Finder(*shared.value)
            return lambda texts: [(found,) for found in own.each([t or "" for t in texts])]

        out = add_columns(out, [StructField(names[k], ArrayType(LEAK))], make)
    if n > 1:
        out = out.withColumn(column, F.concat(*[f"`{x}`" for x in names])).drop(*names[1:])
        # the texts of one item_id may lie in several blocks
        ordered = F.array_sort(F.transform(column, lambda x: F.struct(x.item_id.isNull().alias("unnamed"), x.item_id.alias("item_id"), x.mention.alias("mention"), (-x.common).alias("less"), x.share.alias("share"), x.common.alias("common"))))
        out = out.withColumn(column, ordered)
        first = F.filter(column, lambda x, k: (k == 0) | ~x.item_id.eqNullSafe(F.get(f"`{column}`", k - 1).item_id))
        out = out.withColumn(column, F.transform(first, lambda x: F.struct(x.item_id.alias("item_id"), x.share.alias("share"), x.common.alias("common"), x.mention.alias("mention"))))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without a leak; mentions stay."""
    column = fresh(docs, "leaks")
    return find_leaks(docs, benchmark, column=column).where(~F.exists(column, lambda x: ~x.mention)).select(*[f"`{c}`" for c in docs.columns])
