"""Fill-in-middle: texts are cut in three and put in another order around sentinels, by a parallel automaton scan.

An automaton over bytes finds where units (code points, words or lines) begin; another one whether a text holds a sentinel.
Texts of at most chunk_bytes are one chunk, scanned where they lie, many at once. Larger ones are cut into chunks of
bytes, anywhere, and dealt over the cluster: each chunk gives the automata's functions from the state it is entered in to
the state it leaves in and the number of units that begin. Functions compose in blocks of FAN chunks and blocks in their
text, which gives the number of units of the whole and the state and number that each chunk is entered with; the chunks that
hold a cut, two of a text at most, look up its byte. Only then is the text itself put together, in one cell as it came.

A unit goes on to where the next one begins; cut 0 is the text's start and cut n its end. Where cuts fall, and in which form
a text is given, is decided by a hash of seed and doc_id, so it is the same in every run: the same for rows that share a
doc_id and have as many units, and a null doc_id counts as the empty string. Null and empty texts, and those that hold a
sentinel, stay plain. Very long texts are cut into chunks as said. Ties of both cuts give an empty middle. Repeated rows give
repeated results, empty tables none. Other columns are kept; those named as a result, in any case, are replaced.
"""

from __future__ import annotations

import functools
import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField

from tracklight.llm import automaton
from tracklight.llm.common import Scratch, add_columns, chunks, fresh, map_rows

CHUNK_BYTES, FAN = 1 << 16, 64


@dataclass(frozen=True)
class Form:
    """Sentinels, and of a hundred texts how many are rearranged, and of a hundred of those how many as suffix, prefix, middle."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    rate: int = 90
    spm: int = 20
    seed: int = 1
    unit: str = "code_point"


@functools.lru_cache(maxsize=8)
def automata(form: Form) -> tuple[automaton.Automaton, automaton.Automaton, int]:
    return automaton.UNITS[form.unit](), *automaton.contains([s.encode() for s in (form.prefix, form.suffix, form.middle)])


def draws(form: Form, doc_id) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{form.seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def cuts(form: Form, doc_id, n: int) -> tuple[int, int]:
    """The units after which the prefix and the middle end."""
    a, b = sorted(h % (n + 1) for h in draws(form, doc_id)[:2])
    return a, b


def kind_of(form: Form, doc_id, plain: bool) -> str:
    _, _, h3, h4 = draws(form, doc_id)
    return "plain" if plain or h3 % 100 >= form.rate else "spm" if h4 % 100 < form.spm else "psm"


def arrange(form: Form, kind: str, text: str, prefix: str, middle: str, suffix: str) -> str:
    if kind == "psm":
        return f"{form.prefix}{prefix}{form.suffix}{suffix}{form.middle}{middle}"
    return f"{form.suffix}{suffix}{form.prefix}{prefix}{form.middle}{middle}" if kind == "spm" else text


def restore(form: Form, kind: str, output: str) -> str:
    """The text that an output was made of."""
    if kind == "plain":
        return output
    first, second = (form.prefix, form.suffix) if kind == "psm" else (form.suffix, form.prefix)
    a, _, rest = output[len(first) :].partition(second)
    b, _, middle = rest.partition(form.middle)
    prefix, suffix = (a, b) if kind == "psm" else (b, a)
    return prefix + middle + suffix


RESULT = [StructField("n", LongType()), StructField("form", StringType()), StructField("prefix_chars", LongType()), StructField("middle_chars", LongType()), StructField("output", StringType())]


def _row(form: Form, doc_id, raw: bytes, n: int, plain: bool, place) -> tuple:
    """place gives the byte with which a unit begins."""
    kind = kind_of(form, doc_id, plain)
    if kind == "plain":
        return n, kind, None, None, raw.decode()
    prefix, middle, suffix = (x.decode() for x in _split(raw, *(place(k) for k in cuts(form, doc_id, n))))
    return n, kind, len(prefix), len(middle), arrange(form, kind, "", prefix, middle, suffix)


def _split(raw: bytes, a: int, b: int) -> tuple[bytes, bytes, bytes]:
    return raw[:a], raw[a:b], raw[b:]


def _whole(form: Form, rows: list[tuple]) -> list[tuple]:
    """Texts of one chunk each, for (doc_id, text)."""
    unit, looking, seen = automata(form)
    out = []
    for part in chunks([text or "" for _, text in rows]):
        raw = [t.encode() for t in part]
        states, counts, first = automaton.scan_lanes(unit, raw)
        totals = automaton.compose(states, counts, first)[1]
        held = automaton.scan(looking, raw)[0][:, 0] == seen
        for k, text in enumerate(raw):
            lanes = states[first[k] : first[k + 1]], counts[first[k] : first[k + 1]]
            n = int(totals[k, 0])
            at = lambda j, text=text, lanes=lanes, n=n: 0 if j == 0 else len(text) if j == n else automaton.place(unit, text, 0, j, lanes)
            out.append(_row(form, rows[len(out)][0], text, n, not text or bool(held[k]), at))
    return out


def _compose(parts: Column) -> Column:
    """The function of a run of chunks in order: structs of unit and look (arrays of next states) and n (counts by state)."""
    zero = F.element_at(parts, 1)
    return F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.struct(zero.unit.alias("unit"), zero.look.alias("look"), zero.n.alias("n")), lambda f, g: F.struct(
        F.transform(f.unit, lambda s: F.get(g.unit, s)).alias("unit"),
        F.transform(f.look, lambda s: F.get(g.look, s)).alias("look"),
        F.transform(f.n, lambda x, i: x + F.get(g.n, F.get(f.unit, i))).alias("n"),
    ))


def _entered(parts: Column, state: Column, before: Column) -> Column:
    """For each of the parts (structs of at and a function, in order): at, and the state and the number of units it is entered with."""
    zero = F.struct(state.alias("state"), before.alias("before"), F.array().cast("array<struct<at:int,state:int,before:bigint>>").alias("out"))
    return F.aggregate(parts, zero, lambda acc, p: F.struct(
        F.get(p.unit, acc.state).alias("state"),
        (acc.before + F.get(p.n, acc.state)).alias("before"),
        F.concat(acc.out, F.array(F.struct(p.at.cast("int").alias("at"), acc.state.cast("int").alias("state"), acc.before.cast("bigint").alias("before")))).alias("out"),
    ), lambda acc: acc.out)


def chunk_functions(pieces: DataFrame, form: Form = Form()) -> DataFrame:
    """Of pieces (key, at, raw): key, at, and the automata's functions unit, look (next states) and n (counts), arrays by the state that the piece is entered in."""

    def make():
        unit, looking, _ = automata(form)

        def one(c):
            states, counts = automaton.scan(unit, c["raw"])
            look = automaton.scan(looking, c["raw"])[0]
            return {"key": c["key"], "at": c["at"], "unit": states.tolist(), "n": counts.tolist(), "look": look.tolist()}

        return one

    return map_rows(pieces, "key long, at int, unit array<int>, n array<bigint>, look array<int>", make, rows=16)


def _large(docs: DataFrame, key: str, form: Form, chunk_bytes: int, scratch: Scratch) -> DataFrame:
    """key, total, held and the bytes first and second of both cuts, for texts of many chunks."""

    def cut(c):
        rows = [(k, at, raw[at * chunk_bytes : (at + 1) * chunk_bytes]) for k, raw in zip(c["key"], c["raw"], strict=True) for at in range(-(-len(raw) // chunk_bytes))]
        return {"key": [r[0] for r in rows], "at": [r[1] for r in rows], "raw": [r[2] for r in rows]}

    raw = docs.select(F.col(f"`{key}`").alias("key"), F.col("text").cast(BinaryType()).alias("raw"))
    pieces = scratch.save(map_rows(raw, "key long, at int, raw binary", lambda: cut, rows=1).repartition("key", "at"), "pieces")
    functions = scratch.save(chunk_functions(pieces, form), "functions")
    packed = F.array_sort(F.collect_list(F.struct("at", "unit", "look", "n")))
    blocks = functions.withColumn("block", F.floor(F.col("at") / FAN).cast("int")).groupBy("key", "block").agg(packed.alias("parts"))
    blocks = scratch.save(blocks.withColumn("own", _compose(F.col("parts"))), "blocks")
    outer = blocks.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(F.col("block").alias("at"), "own.unit", "own.look", "own.n"))).alias("parts"))
    zero = lambda: (F.lit(0), F.lit(0).cast("bigint"))
    whole = outer.withColumn("own", _compose(F.col("parts")))
    seen = automata(form)[2]
    totals = scratch.save(whole.select("key", F.get("own.n", F.lit(0)).alias("total"), (F.get("own.look", F.lit(0)) == seen).alias("held"), F.explode(_entered(F.col("parts"), *zero())).alias("entry")).select("key", "total", "held", F.col("entry.at").alias("block"), "entry.state", "entry.before"), "totals")
    entries = blocks.join(totals, ["key", "block"]).select("key", "total", F.explode(_entered(F.col("parts"), F.col("state"), F.col("before"))).alias("entry"))
    entries = entries.select("key", "total", F.col("entry.at").alias("at"), "entry.state", "entry.before")
    # distributed selection: of a text's chunks those stay in which a wished unit begins
    wished = _wished(docs.select(F.col(f"`{key}`").alias("key"), "doc_id"), totals, form)
    counted = entries.join(functions.select("key", "at", "n"), ["key", "at"]).withColumn("after", F.col("before") + F.get("n", F.col("state")))
    asked = counted.join(wished, "key").where((F.col("unit") >= F.col("before")) & (F.col("unit") < F.col("after")))
    asked = asked.select("key", "at", "state", "which", (F.col("unit") - F.col("before")).alias("unit"))

    def find():
        unit, _, _ = automata(form)

        def one(c):
            found = [at * chunk_bytes + automaton.place(unit, r, s, u) for at, r, s, u in zip(c["at"], c["raw"], c["state"], c["unit"], strict=True)]
            return {"key": c["key"], "which": c["which"], "byte": found}

        return one

    found = map_rows(pieces.join(asked, ["key", "at"]).select("key", "at", "raw", "state", "which", "unit"), "key long, which int, byte long", find, rows=16)
    bytes_of = found.groupBy("key").agg(*[F.max(F.when(F.col("which") == k, F.col("byte"))).alias(name) for k, name in enumerate(("first", "second"))])
    ends = totals.select("key", "total", "held").distinct().join(bytes_of, "key", "left")
    out = scratch.save(ends, "cuts")
    for name in ("pieces", "functions", "blocks", "totals"):
        scratch.drop(name)
    return out


def _wished(ids: DataFrame, totals: DataFrame, form: Form) -> DataFrame:
    """key, which (0, 1) and unit: the units that begin right after the prefix and the middle. Cuts at either end need none."""

    def one(c):
        rows = [(k, which, unit) for k, doc_id, n in zip(c["key"], c["doc_id"], c["total"], strict=True) for which, unit in enumerate(cuts(form, doc_id, n)) if 0 < unit < n]
        return {"key": [r[0] for r in rows], "which": [r[1] for r in rows], "unit": [r[2] for r in rows]}

    return map_rows(ids.join(totals.select("key", "total").distinct(), "key").select("key", "doc_id", "total"), "key long, which int, unit long", lambda: one)


def transform(docs: DataFrame, form: Form = Form(), chunk_bytes: int = CHUNK_BYTES, scratch: Scratch | None = None) -> DataFrame:
    """Adds n (units), form (plain, psm or spm), prefix_chars and middle_chars (code points; null if plain) and output to docs (doc_id, text)."""
    names = [f.name for f in RESULT]
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c.lower() not in names])
    large = F.coalesce(F.octet_length("text") > chunk_bytes, F.lit(False))
    out = add_columns(docs.where(~large), RESULT, lambda: lambda rows: _whole(form, rows), ["doc_id", "text"])
    scratch = scratch or Scratch(docs.sparkSession)
    key, cut = fresh(docs, "key"), fresh(docs, "cut")
    long = scratch.save(docs.where(large).withColumn(key, F.monotonically_increasing_id()), "long")
    found = _large(long, key, form, chunk_bytes, scratch)
    joined = long.join(found.select(F.col("key").alias(key), F.struct("total", "held", "first", "second").alias(cut)), key)

    def rows(values):
        for doc_id, text, at in values:
            raw = text.encode()
            known = dict(zip(cuts(form, doc_id, at["total"]), (at["first"], at["second"]), strict=True))
            yield _row(form, doc_id, raw, at["total"], at["held"], lambda j, raw=raw, known=known, n=at["total"]: 0 if j == 0 else len(raw) if j == n else known[j])

    return out.unionByName(add_columns(joined, RESULT, lambda: lambda values: list(rows(values)), ["doc_id", "text", cut], rows=1).drop(key, cut))


def digests(transformed: DataFrame, form: Form = Form()) -> DataFrame:
    """Adds output_sha256, and restored_sha256 of the text that is rebuilt from output and form, to transform's rows; output goes."""

    def one(rows):
        out = []
        for kind, output in rows:
            out.append((hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256(restore(form, kind, output).encode()).hexdigest()))
        return out

    more = [StructField("output_sha256", StringType()), StructField("restored_sha256", StringType())]
    return add_columns(transformed, more, lambda: one, ["form", "output"]).drop("output")
