"""SimHash near duplicates against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from tests.llm.conftest import SCHEMA, prose
from tracklight.llm import simhash
from tracklight.llm.common import Scratch

ODD = [None, "", " \n", "x", "X", "one two three", "ONE two\tthree", "É ünï 日本 🎉 é", "a" * 50_000, "a b c d\x0be\x0cf", " a b", None]


def plain(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(values, distance):
    """The root of each value by all pairs."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if ((values[i] ^ values[j]) & (1 << 64) - 1).bit_count() <= distance:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(values))]


def check(rows, texts, ids):
    values = [plain(t) for t in texts]
    root = closure(values, 4)
    least = {}
    for k, d in zip(root, ids, strict=True):
        least[k] = min(d, least.get(k, d))
    want = sorted((d, f"{v:016x}", least[k]) for d, v, k in zip(ids, values, root, strict=True))
    assert sorted(map(tuple, rows)) == want


def variants(seed, n):
    r = random.Random(seed)
    out = []
    for k in range(n):
        words = prose(seed, 150).split()
        for _ in range(r.randint(0, 6)):
            words[r.randrange(len(words))] = "new" + str(r.randrange(999))
        out.append(" ".join(words))
    return out


def test_equals_all_pairs(documents):
    texts = ODD + [t for k in range(6) for t in variants(k, 25)] + [prose(77, 60)] * 40
    check(simhash.near_duplicates(documents(texts)).collect(), texts, range(len(texts)))


def ball(r, centre, n, flips):
    out = set()
    while len(out) < n:
        v = centre
        for b in r.sample(range(64), r.randint(0, flips)):
            v ^= 1 << b
        out.add(v)
    return out


@pytest.mark.parametrize("limit", [60, 8192])
def test_links_of_sparse_and_dense_groups(spark, limit):
    r = random.Random(5)
    values = {r.getrandbits(64) for _ in range(200)} | ball(r, r.getrandbits(64), 300, 3) | ball(r, 0, 60, 2)
    near = r.getrandbits(64)  # a chain, of links of exactly four bits
    values |= {near ^ (1 << 4 * k) - 1 for k in range(10)}
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    nodes = spark.createDataFrame([(v,) for v in values], "bits long")
    edges = simhash.links(nodes, Scratch(spark), limit=limit).collect()
    assert all(e.v < e.u for e in edges)
    at = {v: k for k, v in enumerate(values)}
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for e in edges:
        a, b = sorted((find(at[e.u]), find(at[e.v])))
        root[b] = a
    assert [find(i) for i in range(len(values))] == closure(values, 4)


def test_masks_leave_no_close_pair_apart():
    r = random.Random(2)
    for _ in range(500):
        x = sum(1 << b for b in r.sample(range(64), 4))
        assert any(x & m == 0 for m in simhash.first_masks())
        own = next(m for m in simhash.first_masks() if x & m == 0)
        while simhash.free_bits(own) > 4:
            own = next(m for m in simhash.next_masks(own) if x & m == 0)
    assert len(simhash.first_masks()) == 15


def test_long_texts_are_read_in_pieces():
    text = prose(3, 4000) + "\n\t" + "z" * 3000 + "  " + prose(4, 500)
    want = plain(text) - (1 << 64) * (plain(text) >> 63)
    assert {simhash.fingerprint(text, size=s) for s in (10, 64, 1000, 1 << 20)} == {want}


def test_odd_tables(spark, documents):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b c", 1), (7, "a b c", 1), (7, "quite another text than that one is", 2), (7, "a b c", 3), (9, "A b C", 4)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id int")).collect()
    assert len(got) == 5 and {(r.doc_id, r.component_id) for r in got} == {(None, None), (7, 7), (9, 7)}
    assert np.unique([r.fingerprint for r in got]).size == 2
