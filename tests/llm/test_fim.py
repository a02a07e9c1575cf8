"""Fill-in-middle against a plain version, for whole texts and texts of many chunks."""

import hashlib
import random

import numpy as np
import pytest

from tests.llm.conftest import SCHEMA, prose
from tracklight.llm import automaton, fim
from tracklight.llm.queries import FILL_IN_MIDDLE_SQL

ODD = [None, "", " ", "x", "<P>", "a<S", "S>b<", "<<M>", "É ünï 日本 🎉", "🎉" * 300, "a" * 900, "<" * 50, "\x00\n", None, "x", prose(1, 90), prose(2, 400) + "é<M", "日" * 255 + "<S>" + "本" * 99]


def plain(text, doc_id):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    p, m, s = t[:a], t[a:b], t[b:]
    spm = h4 % 100 < 20
    return n, "spm" if spm else "psm", a, b - a, f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("chunk", [7, 300, fim.CHUNK_BYTES])
def test_equals_a_plain_version(documents, chunk):
    texts = ODD + [prose(k, 40) + "🎉é"[k % 2] for k in range(40)]
    rows = fim.transform(documents(texts), chunk_bytes=chunk).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(texts[r.doc_id], r.doc_id), r.doc_id
        assert fim.restore(fim.Form(), r.form, r.output) == (texts[r.doc_id] or "")
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    got = {r.doc_id: r for r in fim.digests(fim.transform(documents(texts), chunk_bytes=chunk)).collect()}
    for k, t in enumerate(texts):
        assert got[k].output_sha256 == hashlib.sha256(plain(t, k)[-1].encode()).hexdigest() and got[k].restored_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_odd_tables(spark, documents):
    assert fim.digests(fim.transform(spark.createDataFrame([], SCHEMA))).count() == 0
    rows = spark.createDataFrame([(None, "abc", 1, "own"), (3, "same", 2, "a"), (3, "same", 3, "b"), (None, "z" * 40, 4, "c")], "doc_id long, text string, N long, key string")
    out = fim.transform(rows, chunk_bytes=16)
    assert out.columns == ["doc_id", "text", "key", "n", "form", "prefix_chars", "middle_chars", "output"]
    found = out.collect()
    assert sorted(r.key for r in found) == ["a", "b", "c", "own"] and len({r.output for r in found if r.doc_id == 3}) == 1
    assert all((r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.text, r.doc_id) for r in found)


def test_a_text_of_many_blocks_of_chunks(spark):
    text = "".join(random.Random(3).choices("aé日🎉<PSM> ", k=9000))
    text = text.replace("<P>", "").replace("<S>", "").replace("<M>", "")
    r = fim.transform(spark.createDataFrame([(5, text)], "doc_id long, text string"), chunk_bytes=11).first()
    assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(text, 5)
    for unit in ("word", "line"):
        body = prose(4, 3000).replace(". ", ".\n")
        form = fim.Form(unit=unit)
        one = fim.transform(spark.createDataFrame([(5, body)], "doc_id long, text string"), form, chunk_bytes=57).first()
        two = fim.transform(spark.createDataFrame([(5, body)], "doc_id long, text string"), form).first()
        assert one == two and one.n == (len(body.split()) if unit == "word" else len(body.splitlines()))
        assert fim.restore(form, one.form, one.output) == body


def test_functions_of_chunks_compose():
    r = random.Random(1)
    own, raw = automaton.code_points(), ("aé日🎉" * 300).encode()
    cut = sorted(r.sample(range(len(raw)), 9))
    parts = [raw[a:b] for a, b in zip([0, *cut], [*cut, len(raw)])]
    states, counts = automaton.scan(own, parts)
    state = n = 0
    for k in range(len(parts)):
        n += counts[k, state]
        state = states[k, state]
    assert (state, n) == (0, 1200) and counts.shape == (10, 4)
    looking, seen = automaton.contains([b"aab", b"bb"])
    for _ in range(300):
        t = bytes(r.choices(b"ab", k=r.randint(0, 9)))
        assert (automaton.scan(looking, [t])[0][0, 0] == seen) == (b"aab" in t or b"bb" in t)
    assert automaton.place(own, "aé日".encode(), 0, 2) == 3 and automaton.place(own, b"", 0, 0) == 0
    assert np.array_equal(automaton.scan(own, [b""])[0][0], np.arange(4))


def test_query_equals_sql(spark):
    import duckdb

    from tracklight.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{folder}/documents.parquet'")
    want = c.sql(FILL_IN_MIDDLE_SQL)
    got = QUERIES["op11_fill_in_middle"](spark, folder)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
