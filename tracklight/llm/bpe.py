"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The vocabulary comes from a file of ranks (token bytes in base64 and rank, a line each). In byte-level BPE each byte of
the UTF-8 text is shown to the library as one printable character; `byte_characters` is that table. A merge of two tokens
ranks as the token that it makes, so the merges are derived from the ranks themselves. Special tokens are never produced.

Decoding looks up the characters of each id and reverses the byte table, so a character whose bytes lie in several tokens
comes out whole, and ids that end inside a character still give their exact bytes.

Nulls count as empty texts; an empty text has no ids. Very long texts are encoded whole, a bounded number of characters at once
otherwise. Repeated rows give repeated results, an empty table none. Other columns are kept, but those named as a result (ids,
n_tokens, decodes, bytes, starts, ends and so on, in any case) are replaced.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os

from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType, StructField

from tracklight.llm.common import add_columns, chunks

#: The pattern that splits texts before merges, a fixed value of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_characters() -> list[str]:
    """The character for each byte: printable ones stand for themselves, the others for code points from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Codec:
    """Encodes and decodes by one rank file."""

    def __init__(self, path: str, pattern: str = PATTERN) -> None:
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        shown = byte_characters()
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.decimal = [str(k).encode() for k in range(len(self.bytes))]
        show = lambda token: "".join(shown[b] for b in token)
        merges = [tuple(map(show, pair)) for token in sorted(ranks, key=ranks.get) if len(token) > 1 and (pair := self._last_merge(token, ranks))]
        self.own = Tokenizer(models.BPE(vocab={show(t): r for t, r in ranks.items()}, merges=merges))
        self.own.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    @staticmethod
    def _last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
        """The two parts that are left when a token is built from its bytes by lower ranks."""
        parts, own = [token[k : k + 1] for k in range(len(token))], ranks[token]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda k: ranks.get(parts[k] + parts[k + 1], own))
            if ranks.get(parts[best] + parts[best + 1], own) >= own:
                return None
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return (parts[0], parts[1])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.own.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_offsets(self, texts: list[str]) -> list[tuple[list[int], list[tuple[int, int]]]]:
        """Ids, and the span of characters that each touches; tokens that share a split character all span it."""
        return [(e.ids, e.offsets) for e in self.own.encode_batch(texts, add_special_tokens=False)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@functools.lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def _each(path: str, make):
    """A task's function over texts, a bounded number of characters at a time."""

    def task():
        own = codec(path)
        return lambda texts: [row for part in chunks([t or "" for t in texts]) for row in make(own, part)]

    return task


def encode(docs: DataFrame, path: str, offsets: bool = False) -> DataFrame:
    """Adds ids (array of int) and, if asked, starts and ends in characters. Null texts count as empty."""
    ints = ArrayType(IntegerType())
    if offsets:
        more = [StructField("ids", ints), StructField("starts", ints), StructField("ends", ints)]
        return add_columns(docs, more, _each(path, lambda own, part: [(ids, [a for a, _ in at], [b for _, b in at]) for ids, at in own.encode_offsets(part)]))
    return add_columns(docs, [StructField("ids", ints)], _each(path, lambda own, part: [(ids,) for ids in own.encode(part)]))


def decode(rows: DataFrame, path: str) -> DataFrame:
    """Adds bytes (binary) and text (string; bytes that are no UTF-8 become replacement characters) for ids; null ids give null."""

    def task():
        own = codec(path)

        def one(ids):
            found = [None if i is None else own.decode(i) for i in ids]
            return [(b, None if b is None else b.decode("utf-8", "replace")) for b in found]

        return one

    return add_columns(rows, [StructField("bytes", BinaryType()), StructField("text", StringType())], task, "ids")


def encode_checked(docs: DataFrame, path: str) -> DataFrame:
    """Adds ids, n_tokens, and decodes: whether the ids decode to the bytes of the text."""

    def rows(own: Codec, part: list[str]):
        for text, ids in zip(part, own.encode(part), strict=True):
            yield ids, len(ids), own.decode(ids) == text.encode()

    more = [StructField("ids", ArrayType(IntegerType())), StructField("n_tokens", LongType()), StructField("decodes", BooleanType())]
    return add_columns(docs, more, _each(path, rows))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per document: n_tokens, ids_sha256 of the decimal ids joined by a space, decoded_sha256 of the bytes that the ids decode to."""

    def digests(own: Codec, part: list[str]):
        for ids in own.encode(part):
            yield len(ids), hashlib.sha256(b" ".join(map(own.decimal.__getitem__, ids))).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()

    more = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    return add_columns(docs, more, _each(path, digests)).drop("text")
