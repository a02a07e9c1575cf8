"""Secret scans by a trigram inverted index.

From each rule's regular expression comes a Boolean query over the trigrams that any match must hold (`trigram_query`).
Texts are indexed in segments of at most 256 texts or about a megabyte, as a search engine's segments are: postings list, for
each ASCII trigram that some query names, the segment's documents holding it. Other trigrams aren't indexed and may be anywhere. Intersecting and uniting postings gives each rule's candidates,
which the regular expression then verifies on their whole texts. A rule without mandatory trigrams scans every text.
Segments never leave their partition, so nothing is shuffled, and a hot source or text is no special case.

Null texts count as empty; empty texts and empty tables hold no secrets; repeated rows are scanned as any others; input
columns stay, but one named secret_spans is replaced. Spans are in code points, end exclusive, per kind leftmost and not
overlapping, ordered by start and then by the order of the rules.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from re import _constants as C, _parser as parser

from tracklight.llm.common import add_columns, chunks, fresh


@dataclass(frozen=True)
class Rule:
    """group must have `least` characters, or the match is dropped."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    either_case: bool = False

    def compiled(self) -> re.Pattern[str]:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.either_case else 0))


#: Fixed values of the contract.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 32),
)
#: Well-known shapes of published token formats.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
)
RULES = BASE + MORE

#: Alternatives of an expression that are told apart before the rest counts as unknown.
MOST_ALTERNATIVES = 24


def _letter(code: int) -> str:
    """A character as the index has it: only ASCII letters lose their case."""
    return chr(code).lower() if code < 128 else chr(code)


def _known(node) -> list[str] | None:
    """All strings that a parsed node can match, if they are few."""
    op, arg = node
    if op is C.LITERAL:
        return [_letter(arg)]
    if op is C.IN:
        found: set[str] = set()
        for kind, value in arg:
            if kind is C.LITERAL:
                found.add(_letter(value))
            elif kind is C.RANGE and value[1] - value[0] < 4:
                found |= {_letter(x) for x in range(value[0], value[1] + 1)}
            else:
                return None
        return sorted(found) if len(found) <= 5 else None
    if op is C.SUBPATTERN:
        return _known_all(arg[-1])
    if op is C.BRANCH:
        parts = [_known_all(x) for x in arg[1]]
        return None if None in parts else sorted(set(itertools.chain(*parts)))
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] <= 2 and (one := _known_all(arg[2])) is not None:
        return sorted({"".join(x) for n in range(arg[0], arg[1] + 1) for x in itertools.product(one, repeat=n)})
    return None


def _known_all(nodes) -> list[str] | None:
    out = [""]
    for node in nodes:
        own = _known(node)
        if own is None or len(out) * len(own) > MOST_ALTERNATIVES:
            return None
        out = [a + b for a in out for b in own]
    return out


def _of_strings(strings: list[str]):
    """any of (all trigrams of each string); True where a string is too short to have one."""
    ways = [frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in strings]
    return True if not ways or not all(ways) else ("or", [("and", sorted(w)) for w in ways])


def trigram_query(pattern: str):
    """A tree of ("and" | "or", parts) over lower-case trigrams, which every text with a match satisfies; True for all texts."""

    def need(nodes) -> list:
        wants, run = [], [""]
        for node in nodes:
            own = _known(node)
            if own is not None and len(run) * len(own) <= MOST_ALTERNATIVES:
                run = [a + b for a in run for b in own]
                continue
            wants.append(_of_strings(run))
            run = own if own is not None else [""]
            op, arg = node
            if op is C.SUBPATTERN:
                wants += need(arg[-1])
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
                wants += need(arg[2])
            elif op is C.BRANCH:
                ways = [need(x) for x in arg[1]]
                wants.append(True if not all(ways) else ("or", [("and", w) for w in ways]))
        return [x for x in [*wants, _of_strings(run)] if x is not True]

    found = need(parser.parse(pattern))
    return ("and", found) if found else True


def named(query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(named, query[1]))


def answer(query, postings: dict[str, set[int]], all_rows: set[int]) -> set[int]:
    """The rows that may satisfy a query: those of the postings for an ASCII trigram, all for another one."""
    if query is True:
        return all_rows
    if isinstance(query, str):
        return postings.get(query, set()) if query.isascii() else all_rows
    parts = [answer(q, postings, all_rows) for q in query[1]]
    return set.intersection(*parts) if query[0] == "and" else set.union(*parts)


class Index:
    """Builds postings of the trigrams that the rules' queries name, for a segment of texts at a time."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = [(r, trigram_query(r.pattern), re.compile(r"[0-9a-f]{%d,}" % r.least) if r.pattern == r"[0-9a-f]+" else r.compiled()) for r in rules]
        self.trigrams = sorted(t for t in set().union(*(named(q) for _, q, _ in self.rules)) if t.isascii())
        self.number = np.zeros(1 << 21, np.uint8 if len(self.trigrams) < 255 else np.uint16)
        for k, t in enumerate(self.trigrams):
            self.number[ord(t[0]) << 14 | ord(t[1]) << 7 | ord(t[2])] = k + 1

    def postings(self, texts: list[str]) -> dict[str, set[int]]:
        """ASCII letters count in lower case, and no trigram spans two texts or holds another byte."""
        raw = [t.encode().lower() for t in texts]
        starts = np.cumsum([0, *[len(x) + 1 for x in raw]])
        b = np.frombuffer(b"\n".join(raw), np.uint8).astype(np.uint32)
        if len(b) < 3:
            return {}
        plain = b < 128
        at = self.number[((b[:-2] << 14) | (b[1:-1] << 7) | b[2:]) & 0x1FFFFF]
        at[~(plain[:-2] & plain[1:-1] & plain[2:])] = 0
        hits = np.flatnonzero(at)
        rows = np.searchsorted(starts, hits, "right") - 1
        pairs = np.unique(at[hits].astype(np.int64) << 32 | rows)
        out: dict[str, set[int]] = {}
        for number, row in zip((pairs >> 32).tolist(), (pairs & 0xFFFFFFFF).tolist(), strict=True):
            out.setdefault(self.trigrams[number - 1], set()).add(row)
        return out

    def spans(self, texts: list[str]) -> list[list[dict]]:
        postings, rows = self.postings(texts), set(range(len(texts)))
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for order, (rule, query, compiled) in enumerate(self.rules):
            for k in answer(query, postings, rows):
                found[k] += [(m.start(), order, m.end()) for m in compiled.finditer(texts[k]) if len(m[rule.group]) >= rule.least]
        return [[{"kind": self.rules[order][0].kind, "start": start, "end": end} for start, order, end in sorted(x)] for x in found]


SPAN = StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds secret_spans, an array of struct(kind, start, end)."""
    return _scan(docs, rules, [StructField("secret_spans", ArrayType(SPAN))], lambda text, spans: (spans,))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Replaces each secret by its kind in brackets; n_chars, if there, is counted anew. Overlapping spans become one."""
    clean = fresh(docs, "clean_text")
    out = _scan(docs, rules, [StructField(clean, StringType())], lambda text, spans: (None if text is None else cut(text, spans),))
    out = out.withColumn("text", F.col(clean))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return out.select(*[f"`{c}`" for c in docs.columns])


def cut(text: str, spans: list[dict]) -> str:
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{s['kind']}]"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def _scan(docs: DataFrame, rules: tuple[Rule, ...], more: list[StructField], make) -> DataFrame:
    def task():
        index = Index(rules)

        def one(texts):
            spans = (s for part in chunks([t or "" for t in texts]) for s in index.spans(part))
            return [make(t, s) for t, s in zip(texts, spans, strict=True)]

        return one

    return add_columns(docs, more, task)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans (kind:start:end, joined by commas) from find_secrets."""
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    base = F.filter("secret_spans", lambda s: s.kind.isin([r.kind for r in BASE]))
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s.kind == kind)).cast("long")
    return found.select("doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in BASE], F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("secret_spans")).alias("spans"))
