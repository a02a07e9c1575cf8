"""Quality by co-training: two classifiers with different views of a document teach each other.

One view is the text's content (shares of kinds of characters, repetition, word lengths, layout of lines), the other the
page's metadata (language, source, declared length) without a look at the text. Both are logistic regressions. In each
round each adds to the other's examples the documents that it is most sure of among all unlabelled ones, ADD at most, as
many for either answer as the labels' shares ask for; equal documents count once. Then each view is calibrated on labelled
rows that it hasn't seen, and a last regression, on other rows, combines the calibrated log-odds; a view that adds nothing
gets no weight.

Models are fitted on the driver on a bounded sample of LABELLED labelled rows, a documented parameter, chosen by hash, and on
the pseudo-labels of the rounds. The search for these goes over every document: feature vectors are written to the shared
folder once and scored in each round where they lie; only the best of each task leave it. All documents are scored, over
their whole texts.

Very long texts are read whole, a document at a time, and an empty table gives no rows. Null texts count as empty, null languages, sources and lengths as values of their own. Without labels of both kinds every
document is accepted with probability 1. Rows of labels with nulls teach nothing; of several labels of a document the
highest holds. Repeated rows get equal scores; columns stay, but those named content, metadata, score or accepted are replaced.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, BooleanType, StructField

from tracklight.llm.common import Scratch, add_columns, fresh

LABELLED, ROUNDS, ADD = 12_000, 4, 300
#: Log-odds from which a view is sure.
SURE = 2.0
SOURCES, LANGS, SIZES = 32, 8, 14
LEAST = 0.5
BEST = pa.schema([("view", pa.int32()), ("answer", pa.int32()), ("content", pa.binary()), ("metadata", pa.binary()), ("sure", pa.float64())])


def content(text: str) -> list[float]:
    """Shares of the text, their roots (which tell small shares apart), and lengths on a log scale."""
    raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    n = max(1, int(raw.sum()))
    words = text.split()
    w = max(1, len(words))
    repeated = sum(map(str.__eq__, words, words[1:]))
    lines = [x for x in text.split("\n") if x]
    upper, lower, digits = int(raw[65:91].sum()), int(raw[97:123].sum()), int(raw[48:58].sum())
    stops = int(raw[44] + raw[46])
    odd = int(raw[33:48].sum() + raw[58:65].sum() + raw[91:97].sum() + raw[123:127].sum()) - stops
    shares = [upper / max(1, upper + lower), odd / n, odd / w, stops / w, digits / n, repeated / w, 1 - len(set(words)) / w, int(raw[124]) / w, int(raw[33]) / w, int(raw[128:].sum()) / n, 1 - len(set(lines)) / max(1, len(lines))]
    mean = sum(map(len, words)) / w
    return [*shares, *[max(0.0, s) ** 0.5 for s in shares], mean / 10, max(map(len, words), default=0) ** 0.5 / 10, np.log1p(len(words)) / 10, np.log1p(len(text)) / 10, np.log1p(len(lines)) / 5, float(not words)]


def metadata(lang: str | None, source: str | None, declared: int | None) -> list[float]:
    """Language and source as hashed indicators, and the declared length on a log scale and by its order of magnitude."""
    spot = lambda x, n: [float(k == (n - 1 if x is None else zlib.crc32(x.encode()) % (n - 1))) for k in range(n)]
    said = np.log1p(max(0, declared or 0))
    return [said / 10, float(declared is None), *[float(k == min(SIZES - 1, int(said))) for k in range(SIZES)], *spot(lang, LANGS), *spot(source, SOURCES)]


def add_features(docs: DataFrame) -> DataFrame:
    """Adds content and metadata, vectors of 32-bit floats as bytes."""
    have = [c if c in docs.columns else None for c in ("text", "lang", "source", "n_chars")]
    name = fresh(docs, "view")
    packed = docs.drop("content", "metadata").withColumn(name, F.struct(*[(F.col(c) if c else F.lit(None)).cast(k).alias(n) for c, n, k in zip(have, ("text", "lang", "source", "n_chars"), ("string", "string", "string", "long"), strict=True)]))

    def make():
        as_bytes = lambda x: np.array(x, np.float32).tobytes()

        def one(views):
            return [(as_bytes(content(v["text"] or "")), as_bytes(metadata(v["lang"], v["source"], v["n_chars"]))) for v in views]

        return one

    return add_columns(packed, [StructField("content", BinaryType()), StructField("metadata", BinaryType())], make, name).drop(name)


class Logistic:
    """Regularised logistic regression by Newton steps on standardised features."""

    def fit(self, x: np.ndarray, y: np.ndarray, decay: float = 1.0) -> Logistic:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        z = np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))])
        self.w = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], decay)
        penalty[-1] = 1e-3
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            s = np.maximum(p * (1 - p), 1e-6)
            step = np.linalg.solve((z * s[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * self.w)
            self.w += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-6:
                break
        return self

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.w[:-1] + self.w[-1], -30, 30)


@dataclass
class Model:
    views: tuple[Logistic, Logistic] | None = None
    scales: tuple[Logistic, Logistic] | None = None
    both: Logistic | None = None

    def scores(self, content: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        """The probability of good quality."""
        if self.views is None:
            return np.ones(len(content))
        odds = np.column_stack([c.odds(v.odds(x)[:, None]) for v, c, x in zip(self.views, self.scales, (content, metadata), strict=True)])
        return 1 / (1 + np.exp(-self.both.odds(odds)))


#: Of the surest documents for an answer: their vectors in both views.
Picked = tuple[np.ndarray, np.ndarray]


def surest_of_arrays(pool: Picked):
    """The function that co_train asks, over a pool in memory."""
    left = np.arange(len(pool[0]))

    def surest(views, n_good, n_bad):
        nonlocal left
        out, gone = [], set()
        for k in (0, 1):
            sure = views[k].odds(pool[k][left]) if len(left) else np.zeros(0)
            order = np.argsort(sure, kind="stable")
            picked = [left[np.array([i for i in order[:n_bad] if sure[i] < -SURE], int)], left[np.array([i for i in order[::-1][:n_good] if sure[i] > SURE], int)]]
            gone |= {int(i) for p in picked for i in p}
            out.append(tuple((pool[0][p], pool[1][p]) for p in picked))
        left = np.array([i for i in left if i not in gone], int)
        return out

    return surest


def co_train(xs: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool, rounds: int = ROUNDS, add: int = ADD) -> Model:
    """y: 1 good, 0 bad. pool: unlabelled vectors of both views, or a function (views, n_good, n_bad) that gives, for each view, its surest bad and its surest good documents that no earlier call gave. Every eighth labelled row is held back for calibration, and another for the combination."""
    surest = pool if callable(pool) else surest_of_arrays(pool)
    if not len(y) or y.min() == y.max():
        return Model()
    part = np.arange(len(y)) % 8
    calibrates, combines = part == 3, part == 7
    if any(len(set(y[p])) < 2 for p in (calibrates, combines, ~(calibrates | combines))):
        calibrates = combines = np.zeros(len(y), bool)
    fit_on = ~(calibrates | combines)
    taught = [[(x[fit_on], y[fit_on])] for x in xs]
    share = y[fit_on].mean()
    fit = lambda: tuple(Logistic().fit(np.vstack([a for a, _ in t]), np.concatenate([b for _, b in t])) for t in taught)
    for _ in range(rounds):
        found = surest(fit(), max(1, round(add * share)), max(1, round(add * (1 - share))))
        for k, answers in enumerate(found):
            for answer, picked in enumerate(answers):
                if len(picked[0]):
                    taught[1 - k].append((picked[1 - k], np.full(len(picked[0]), float(answer))))
        if not any(len(p[0]) for answers in found for p in answers):
            break
    views = fit()
    on = (calibrates, combines) if calibrates.any() else (fit_on, fit_on)
    odds = [v.odds(x) for v, x in zip(views, xs, strict=True)]
    scales = tuple(Logistic().fit(o[on[0]][:, None], y[on[0]]) for o in odds)
    both = Logistic().fit(np.column_stack([c.odds(o[on[1]][:, None]) for c, o in zip(scales, odds, strict=True)]), y[on[1]])
    return Model(views, scales, both)


def _matrix(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32).reshape(len(column), -1).astype(float) if column else np.zeros((0, 1))


def _surest_of(rows: DataFrame, used: set[tuple[bytes, bytes]]):
    """The function that co_train asks: it looks through all rows (content, metadata) but those in used, to which it adds what it gives."""

    def surest(views: tuple[Logistic, Logistic], n_good: int, n_bad: int) -> list[tuple[Picked, Picked]]:
        shared = rows.sparkSession.sparkContext.broadcast((views, used))

        def best(batches):
            """For each view and answer the surest of a task's different documents."""
            own, gone = shared.value
            held: dict[tuple[int, int], dict[tuple[bytes, bytes], float]] = {(k, a): {} for k in (0, 1) for a in (0, 1)}
            for batch in batches:
                pair = [batch.column(k).to_pylist() for k in (0, 1)]
                for k in (0, 1):
                    odds = own[k].odds(_matrix(pair[k]))
                    for answer, n in ((1, n_good), (0, n_bad)):
                        sure = odds if answer else -odds
                        mine = held[k, answer]
                        least = min(mine.values()) if len(mine) >= n else SURE
                        for i in np.flatnonzero(sure > least):
                            if (key := (pair[0][i], pair[1][i])) not in gone:
                                mine[key] = float(sure[i])
                        if len(mine) > n:
                            held[k, answer] = dict(sorted(mine.items(), key=lambda x: (-x[1], x[0]))[:n])
            out = [(k, a, c, m, s) for (k, a), mine in held.items() for (c, m), s in mine.items()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(zip(*out, strict=True) if out else [[]] * 5, BEST, strict=True)], schema=BEST)

        found = rows.select("content", "metadata").mapInArrow(best, "view int, answer int, content binary, metadata binary, sure double").dropDuplicates(["view", "answer", "content", "metadata"])
        rank = F.row_number().over(Window.partitionBy("view", "answer").orderBy(F.col("sure").desc(), "content", "metadata"))
        few = found.withColumn("rank", rank).where(F.col("rank") <= F.when(F.col("answer") == 1, n_good).otherwise(n_bad)).where(F.col("rank") <= max(n_good, n_bad)).collect()
        few.sort(key=lambda r: (r.view, r.answer, r.rank))
        used.update((bytes(r.content), bytes(r.metadata)) for r in few)
        picked = [[[r for r in few if (r.view, r.answer) == (k, a)] for a in (0, 1)] for k in (0, 1)]
        answers = [tuple((_matrix([r.content for r in p]), _matrix([r.metadata for r in p])) for p in of_view) for of_view in picked]
        shared.unpersist()
        return answers

    return surest


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, scratch: Scratch | None = None) -> Model:
    """Broadcasts at most `labelled` ids, and collects the features of these rows and of the pseudo-labelled ones."""
    scratch = scratch or Scratch(docs.sparkSession)
    by_hash = (F.xxhash64("doc_id"), F.col("doc_id"))
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("y")).orderBy(*by_hash).limit(labelled)
    if known.isEmpty():
        return Model()
    used = docs.select("doc_id", *[c for c in ("text", "lang", "source", "n_chars") if c in docs.columns])
    features = scratch.save(add_features(used.join(F.broadcast(known), "doc_id", "left")).select("doc_id", "y", "content", "metadata"), "features")
    seen = sorted(features.where("y is not null").collect(), key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.content))
    if not seen:
        scratch.drop()
        return Model()
    surest = _surest_of(features.where("y is null"), set())
    out = co_train((_matrix([r.content for r in seen]), _matrix([r.metadata for r in seen])), np.array([float(r.y > 0) for r in seen]), surest)
    scratch.drop()
    return out


def score(docs: DataFrame, model: Model, least: float = LEAST, columns: tuple[str, str] = ("score", "accepted")) -> DataFrame:
    """Adds score, the probability of good quality, and accepted (score >= least), or other names in columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ("text", "lang", "source", "n_chars")
    view = F.struct(*[(F.col(n) if n in docs.columns else F.lit(None)).cast("long" if n == "n_chars" else "string").alias(n) for n in names])

    def make():
        own = shared.value

        def one(views):
            out = []
            for start in range(0, len(views), 1000):
                part = views[start : start + 1000]
                p = own.scores(np.array([content(v["text"] or "") for v in part], np.float32), np.array([metadata(v["lang"], v["source"], v["n_chars"]) for v in part], np.float32))
                out += [(float(x), bool(x >= least)) for x in p]
            return out

        return one

    name = fresh(docs, "view")
    return add_columns(docs.withColumn(name, view), [StructField(columns[0], DoubleType()), StructField(columns[1], BooleanType())], make, name).drop(name)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))


def keep_accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The accepted rows of docs, all columns as they were."""
    columns = (fresh(docs, "score"), fresh(docs, "accepted"))
    return score(docs, train(docs, labels), columns=columns).where(F.col(columns[1])).select(*[f"`{c}`" for c in docs.columns])
