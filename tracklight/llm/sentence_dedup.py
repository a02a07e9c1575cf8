"""Substring dedup over sliding spans of sentences.

A text is cut into sentences (at line ends and after . ! or ?); a sentence of more than PIECE words is cut again after
words that a hash picks (about one in CUT, and after PIECE words at the latest), so that a copy that starts within a long
sentence is cut at the same words. From every sentence a span of consecutive ones runs on until it has at least SPAN
sentences and SPAN_WORDS words. Spans are hashed (words in lower case) and grouped over the whole corpus; the first place, by doc_id and
position, stays, and every sentence under any other place of a repeated span is removed from its document.

Only hashes and places are shuffled for the search: counting combines in each task first, so a passage in a third of all
documents is no hot key there; the join of places with repeated spans may split hot keys (adaptive skew join).

doc_id is an integer; it is cast to long. Very long texts are cut whole, one at a time; an empty table gives no rows.
Null texts stay null and empty ones empty. Texts without a whole span are left alone. A place belongs to a doc_id and a
text (told apart by a 64-bit hash), so rows that share a doc_id but not a text have places of their own; the same span there
goes from all but the one of smallest hash. Rows with equal doc_id and text count as one place, so such rows stay alike. Rows
with a null doc_id keep their text and serve as nobody's first place. Extra columns are kept, but ones named n_removed,
removed_spans or covered are dropped or replaced.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tracklight.llm.common import Scratch, add_columns, fresh, map_rows, mix

SPAN, SPAN_WORDS, PIECE, CUT = 2, 20, 16, 6
SENTENCE = re.compile(r"[^.!?\n]*[.!?]+|[^.!?\n]+|\n")
WORD = re.compile(r"\S+")
SPANS = StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])
_P = 0x9E3779B97F4A7C15
_BACK = pow(_P, -1, 1 << 64)


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """Start, end and lower-case words of each sentence or piece of one."""
    out = []
    for m in SENTENCE.finditer(text):
        words = m[0].lower().split()
        if len(words) <= PIECE:
            if words:
                out.append((m.start(), m.end(), words))
        else:
            start, held = m.start(), []
            for w in WORD.finditer(text, m.start(), m.end()):
                held.append(w[0].lower())
                if len(held) == PIECE or zlib.crc32(held[-1].encode()) % CUT == 0:
                    out.append((start, w.end(), held))
                    start, held = w.end(), []
            if held:
                out.append((start, m.end(), held))
    return out


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the number of sentences of the span from each sentence on, for as many as have a whole span."""
    found = sentences(text)
    n = len(found)
    if n < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    own = mix(np.fromiter((xxhash.xxh64_intdigest(" ".join(w)) for _, _, w in found), np.uint64, n))
    words = np.concatenate([[0], np.cumsum([len(w) for _, _, w in found])])
    ends = np.maximum(np.arange(n) + SPAN, np.searchsorted(words, words[:-1] + SPAN_WORDS))
    k = np.flatnonzero(ends <= n)
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * _powers(_P, n), dtype=np.uint64)])
    hashes = mix((upto[ends[k]] - upto[k]) * _powers(_BACK, n)[k] + (ends[k] - k).astype(np.uint64))
    return hashes.view(np.int64), (ends[k] - k).astype(np.int32)


def span_places(docs: DataFrame) -> DataFrame:
    """span, doc_id, text_hash, position (of its first sentence) and length (in sentences)."""

    def one(cols):
        found = [spans(text) for text in cols["text"]]
        sizes = [len(h) for h, _ in found]
        return {
            "span": np.concatenate([h for h, _ in found]),
            "doc_id": np.repeat(np.array(cols["doc_id"], np.int64), sizes),
            "text_hash": np.repeat(np.array(cols["text_hash"], np.int64), sizes),
            "position": np.concatenate([np.arange(n, dtype=np.int32) for n in sizes]),
            "length": np.concatenate([n for _, n in found]),
        }

    rows = docs.where("doc_id is not null and length(text) > 0").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return map_rows(rows, "span long, doc_id long, text_hash long, position int, length int", lambda: one)


def repeated_places(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, text_hash and covered (array of struct(position, length)): the places of repeated spans, but for each span's first."""
    places, place = scratch.save(span_places(docs), "places"), F.struct("doc_id", "text_hash", "position")
    first = places.groupBy("span").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    again = scratch.save(first.where("first != last").select("span", "first"), "repeated")
    other = places.join(again, "span").where(place != F.col("first"))
    out = scratch.save(other.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("position", "length")).alias("covered")), "covered")
    scratch.drop("places")
    scratch.drop("repeated")
    return out


def cut(text: str, covered: list[dict]) -> tuple[str, list[dict]]:
    """The text without the covered sentences, and the spans of characters that went."""
    found = sentences(text)
    gone = np.zeros(len(found) + 1, np.int32)
    for c in covered:
        gone[c["position"]] += 1
        gone[min(len(found), c["position"] + c["length"])] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    out, removed, at = [], [], 0
    for (start, end, _), is_gone in zip(found, gone, strict=True):
        if is_gone:
            out.append(text[at:start])
            at = end
            if removed and not text[removed[-1]["end"] : start].strip():
                removed[-1]["end"] = end
            else:
                removed.append({"start": start, "end": end})
    return "".join([*out, text[at:]]), removed


def dedup(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """docs with text cut, and n_removed (sentences' spans of characters that went, joined where adjacent) and removed_spans. The scratch table of covered places is read when the result is."""
    scratch = scratch or Scratch(docs.sparkSession)
    own = docs.drop("n_removed", "removed_spans", "covered")
    key, text_hash, covered = (fresh(own, n) for n in ("place_doc_id", "text_hash", "covered"))
    places = repeated_places(docs, scratch).select(F.col("doc_id").alias(key), F.col("text_hash").alias(text_hash), F.col("covered").alias(covered))
    keyed = own.withColumn(key, F.col("doc_id").cast("long")).withColumn(text_hash, F.xxhash64("text"))
    joined = keyed.join(places, [key, text_hash], "left").select(F.struct(F.col("text").alias("text"), F.col(covered).alias("covered")).alias(covered), *[f"`{c}`" for c in own.columns if c != "text"])
    more = [StructField(text_hash, StringType()), StructField("n_removed", IntegerType()), StructField("removed_spans", ArrayType(SPANS))]

    def one(rows):
        found = [(r["text"], []) if not r["covered"] or r["text"] is None else cut(r["text"], r["covered"]) for r in rows]
        return [(text, len(gone), gone) for text, gone in found]

    out = add_columns(joined, more, lambda: one, covered)
    return out.select(*[F.col(text_hash).alias("text") if c == "text" else f"`{c}`" for c in own.columns], "n_removed", "removed_spans")
