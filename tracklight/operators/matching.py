"""Record matching: normal forms once per record, candidate pairs by equal keys, scores and zones per pair."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklight.functions import scoring
from tracklight.functions.scoring import DEFAULT, Settings
from tracklight.functions.text import VARIATIONS, normalize, phonetic_key, strip_parentheticals
from tracklight.operators.joins import pairs_within
from tracklight.sources.scratch import Scope


def prepare(records: DataFrame) -> DataFrame:
    """Adds title_normalized, title_stripped, title_key, artist_normalized and artist_key. Each different text is normalised once."""
    titles = records.select("title").distinct().select("title", normalize(F.col("title")).alias("title_normalized"), normalize(strip_parentheticals(F.col("title"))).alias("title_stripped"), phonetic_key("title").alias("title_key"))
    artists = records.select("artist").distinct().select("artist", normalize(F.col("artist")).alias("artist_normalized"), phonetic_key("artist").alias("artist_key"))
    own = records.drop("title_normalized", "title_stripped", "title_key", "artist_normalized", "artist_key")
    return own.join(titles, "title", "left").join(artists, "artist", "left")


def _settled(df: DataFrame, columns: dict) -> DataFrame:
    """Adds columns that are computed once: expressions over them don't contain theirs, which would grow beyond what Spark compiles."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def score(pairs: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Adds similarities, levels, match_weight, confidence and zone to pairs with columns a_ and b_ of prepare's records, duration_ms and method."""
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    present = lambda c: (a(c) != "") & (b(c) != "")
    title = F.when(present("title"), scoring.title_similarity(a("title"), b("title"), a("title_normalized"), b("title_normalized"), a("title_key"), b("title_key"), s))
    artist = F.when(present("artist"), scoring.artist_similarity(a("artist_normalized"), b("artist_normalized"), a("artist_key"), b("artist_key"), s))
    out = _settled(pairs, {"title_similarity": title, "artist_similarity": artist, "duration_diff_ms": scoring.duration_difference(a("duration_ms"), b("duration_ms"))})
    t, r = F.col("title_similarity"), F.col("artist_similarity")
    matched = F.coalesce(F.col("method").isin("isrc", "mbid"), F.lit(False))
    phonetic = (a("artist_key") == b("artist_key")) & (a("artist_key") != "") & (a("artist_normalized") != b("artist_normalized"))
    out = _settled(
        out,
        {
            "title_level": scoring.title_level(t, t == s.variation, t == s.phonetic, s),
            "artist_level": scoring.artist_level(r, F.coalesce(phonetic, F.lit(False)), s),
            "duration_level": scoring.duration_level(F.col("duration_diff_ms")),
            "isrc_level": scoring.isrc_level(matched, scoring.isrc_suspect(F.col("duration_diff_ms"))),
        },
    )
    out = out.withColumn("match_weight", scoring.weight(F.col("title_level"), F.col("artist_level"), F.col("duration_level"), F.col("isrc_level")))
    out = out.withColumn("confidence", scoring.confidence(F.col("match_weight")))
    return out.withColumn("zone", scoring.zone(F.col("confidence"), F.col("method"), F.col("duration_level") == "missing", s))


def sided(records: DataFrame, side: str) -> DataFrame:
    return records.select(*[F.col(c).alias(f"{side}_{c}") for c in records.columns])


def evaluate(tracks: DataFrame, matches: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Every track with its outcome: accept, review or reject of its raw match (track_id, connector_id, title, artist, duration_ms, method), or none."""
    own = sided(prepare(tracks.select("track_id", "title", "artist", "duration_ms")), "a")
    raw = sided(prepare(matches.drop("method")), "b").join(matches.select(F.col("track_id").alias("b_track_id"), F.col("connector_id").alias("b_connector_id"), "method"), ["b_track_id", "b_connector_id"])
    scored = score(own.join(raw, own.a_track_id == raw.b_track_id), s).select(F.col("a_track_id").alias("track_id"), F.col("b_connector_id").alias("connector_id"), "confidence", "zone")
    return tracks.select("track_id").join(scored, "track_id", "left").withColumn("zone", F.coalesce("zone", F.lit("none")))


def best_by_title(references: DataFrame, candidates: DataFrame, least: float = 0.0, s: Settings = DEFAULT) -> DataFrame:
    """reference_id, candidate_id and similarity of each reference's best candidate (reference_id, position, candidate_id, name), the first on ties (of equal positions the smallest candidate_id), if similar enough."""
    ref = references.select("reference_id", F.col("title").alias("a_title"), normalize(F.col("title")).alias("a_n"), phonetic_key("title").alias("a_k"))
    can = candidates.where("name is not null").select("reference_id", "position", "candidate_id", F.col("name").alias("b_title"), normalize(F.col("name")).alias("b_n"), phonetic_key("name").alias("b_k"))
    c = F.col
    both = ref.join(can, "reference_id").withColumn("similarity", scoring.title_similarity(c("a_title"), c("b_title"), c("a_n"), c("b_n"), c("a_k"), c("b_k"), s))
    w = Window.partitionBy("reference_id").orderBy(c("similarity").desc(), "position", "candidate_id")
    return both.withColumn("_n", F.row_number().over(w)).where((c("_n") == 1) & (c("similarity") >= least)).select("reference_id", "candidate_id", "similarity")


def same_recordings(records: DataFrame, most_ms: int = 10_000) -> DataFrame:
    """Pairs (a_id < b_id) of equal normal title and artist whose known durations differ by at most most_ms.

    Within an identity, durations fall into bins of most_ms, so only neighbours meet.
    """
    own = records.where("duration_ms <> 0").select("id", "title_normalized", "artist_normalized", "duration_ms").withColumn("_bin", F.floor(F.col("duration_ms") / most_ms))
    keys = ["title_normalized", "artist_normalized", "_bin"]
    a = own.select(F.col("id").alias("a_id"), F.col("duration_ms").alias("_a"), *keys[:2], F.explode(F.array(F.col("_bin") - 1, F.col("_bin"), F.col("_bin") + 1)).alias("_bin"))
    b = own.select(F.col("id").alias("b_id"), F.col("duration_ms").alias("_b"), *keys)
    return a.join(b, keys).where((F.col("a_id") < F.col("b_id")) & (F.abs(F.col("_a") - F.col("_b")) <= most_ms)).select("a_id", "b_id")


def same_identity(records: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Pairs (a_id < b_id) with an equal ISRC or any shared (connector, identifier): a union of two equi-joins, each pair once.

    Pairs of equal ISRCs grow with the square of what has one, so they are never shuffled to find the ones that came twice: a pair
    counts by its first common ISRC alone, and identifiers give only pairs that have none.
    """
    coded = records.where("isrc is not null").groupBy("id").agg(F.sort_array(F.collect_set("isrc")).alias("isrcs"))
    by_isrc = pairs_within(coded.select("id", F.explode("isrcs").alias("isrc"), F.when(F.size("isrcs") > 1, F.col("isrcs")).alias("several")), ["isrc"])
    first = F.get(F.array_intersect("a.several", "b.several"), F.lit(0))
    by_isrc = by_isrc.where(F.col("a.several").isNull() | F.col("b.several").isNull() | (first == F.col("isrc")))
    held = identifiers.where("connector is not null and identifier is not null").select("id", "connector", "identifier").distinct().join(coded, "id", "left")
    by_identifier = pairs_within(held, ["connector", "identifier"]).where(~F.coalesce(F.arrays_overlap("a.isrcs", "b.isrcs"), F.lit(False)))
    ids = [F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id")]
    return by_isrc.select(*ids).unionByName(by_identifier.select(*ids).distinct())


def survivors(records: DataFrame) -> DataFrame:
    """Of each group (group_id) the record with the newest ISRC year, else the newest created_at, else the lowest id."""
    from tracklight.functions.scalars import isrc_year

    w = Window.partitionBy("group_id").orderBy(isrc_year(F.col("isrc")).desc_nulls_last(), F.col("created_at").desc_nulls_last(), "id")
    return records.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("group_id", "id")


def resolve_inward(requests: DataFrame, mapped: DataFrame, candidates: DataFrame, unwritten: DataFrame, held: DataFrame, create: Callable[[DataFrame], DataFrame], s: Settings = DEFAULT) -> DataFrame:
    """id, track_id and outcome of each different identifier that is asked for: a cascade in which every step looks at what the ones before left.

    existing: it has a live mapping (mapped: id, track_id). reused: the best of its canonical candidates is accepted by its
    score (candidates: id, track_id, the a_ columns of prepare's canonical records, the b_ ones of what the service says, and method).
    failed: such a mapping couldn't be written (unwritten: id); no second track is made for it. suppressed: the service said lately
    that it knows nothing (held: id). created: what create gives a track_id for, of the identifiers (id) that are left;
    the others failed. requests' id must be in the form that mapped has; null ones are left out.
    """
    scope, kind = Scope(requests.sparkSession), mapped.schema["track_id"].dataType
    # one aggregate by id for all that is known of an identifier, not a join for each: the sorts of joins in a row share a task's memory
    told = {"_asked": requests.select("id"), "_lost": unwritten.select("id"), "_held": held.select("id")}
    rows = mapped.select("id", F.col("track_id").alias("_mapped"), F.lit("_mapped").alias("_of"))
    for name, said in told.items():
        rows = rows.unionByName(said.select("id", F.lit(None).cast(kind).alias("_mapped"), F.lit(name).alias("_of")))
    has = lambda name: F.max(F.col("_of") == name)
    known = rows.where("id is not null").groupBy("id").agg(F.min("_mapped").alias("_mapped"), has("_mapped").alias("_live"), *[has(name).alias(name) for name in told])
    known = scope.written(known.where("_asked").drop("_asked"))
    existing = known.where("_live").select("id", F.col("_mapped").alias("track_id"), F.lit("existing").alias("outcome"))
    missing = known.where("not _live")
    scored = score(candidates.join(missing.select("id"), "id", "left_semi"), s).where("zone = 'accept'")
    # dealt by id before the aggregate, which would else be compiled together with the whole score
    best = scored.select("id", "track_id", "confidence").repartition("id").groupBy("id").agg(F.min_by("track_id", F.struct(-F.col("confidence"), "track_id")).alias("track_id"))
    found = scope.written(missing.drop("_mapped", "_live").join(best.withColumn("_best", F.lit(True)), "id", "left"))
    reused = found.where("_best").select("id", F.when(~F.col("_lost"), F.col("track_id")).alias("track_id"), F.when(~F.col("_lost"), "reused").otherwise("failed").alias("outcome"))
    left = found.where("_best is null").select("id", "_held")
    suppressed = left.where("_held").select("id", F.lit(None).cast(kind).alias("track_id"), F.lit("suppressed").alias("outcome"))
    asked = left.where("not _held").select("id")
    made = asked.join(create(asked).select("id", "track_id"), "id", "left").select("id", "track_id", F.when(F.col("track_id").isNull(), "failed").otherwise("created").alias("outcome"))
    return existing.unionByName(reused).unionByName(suppressed).unionByName(made)


OUTCOMES = ("existing", "reused", "created", "suppressed", "failed")


def outcome_counts(resolved: DataFrame) -> DataFrame:
    """How many identifiers had each outcome, and all of them."""
    return resolved.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES], F.count(F.lit(1)).alias("asked"))


# The best title of a catalogue

#: Similarities that are asked for one after the other; who found one so high is done.
STEPS = (1.0, 0.85, 0.7, 0.5)
SLACK = 1e-9
#: By how many of its first letters a title is looked for in titles that may hold it.
HELD = 6


def _numbered(texts: DataFrame, width: int) -> DataFrame:
    """The runs of width letters of each text (n, padded), numbered where they repeat, so that a set of them is a multiset of runs."""
    text = F.col("padded")
    runs = F.transform(F.sequence(F.lit(1), F.length(text) - width + 1), lambda k: F.substring(text, k, F.lit(width)))
    counted = texts.select("n", F.explode(runs).alias("run")).groupBy("n", "run").agg(F.count(F.lit(1)).alias("times"))
    numbered = counted.select("n", "run", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("time"))
    return numbered.select("n", F.concat_ws("\0", "run", F.col("time").cast("string")).alias("feature"), F.lit(1).alias("weight"))


def _features(titles: DataFrame) -> dict[str, DataFrame]:
    """Of each different n: w (words), p (pairs of letters) and l (letters), as n, feature and weight.

    With a blank on either side of each word, letters and pairs number as many as the joined words have letters, and one more.
    """
    words = F.array_distinct(F.filter(F.split("n", r"(?U)\s+"), lambda w: w != ""))
    own = titles.select("n").distinct().select("n", words.alias("words")).where(F.size("words") > 0)
    own = own.select("n", "words", F.concat(F.lit(" "), F.array_join(F.array_sort("words"), " "), F.lit(" ")).alias("padded"))
    word = own.select("n", F.explode("words").alias("feature")).withColumn("weight", F.length("feature") + 1)
    return {"w": word, "p": _numbered(own, 2), "l": _numbered(own.withColumn("padded", F.substr("padded", F.lit(2))), 1)}


def _postings(features: DataFrame) -> DataFrame:
    """n, feature, ahead (what the title's rarer features weigh) and total (what all do)."""
    counts = features.groupBy("feature").agg(F.count(F.lit(1)).alias("_titles"))
    w = Window.partitionBy("n")
    order = w.orderBy("_titles", "feature").rowsBetween(Window.unboundedPreceding, -1)
    return features.join(counts, "feature").select("n", "feature", F.coalesce(F.sum("weight").over(order), F.lit(0)).alias("ahead"), F.sum("weight").over(w).alias("total"))


def _meet(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return a.join(b, on).select("a_no", "b_no")


def _by_features(a: DataFrame, b: DataFrame, postings: dict[str, DataFrame], keys: list[str], t: float) -> DataFrame:
    """Pairs that may have a word-set ratio of t or more, none left out.

    The ratio is the best of three. Two compare the words in common with all words of one side, which they must then make up
    t / (2 - t) of: they meet in a word that is among that side's rarest, so many that the others weigh less. One compares the
    letters of both sides: an insertion or deletion changes one letter, or three pairs of letters, so sides with so few of them
    share so much that they meet among the rarest of both.
    """
    share = t / (2 - t)
    at = lambda df, kind: df.join(postings[kind], "n").select("*", F.length("n").alias("_length"))
    rare = lambda df, least: df.where(F.col("total") - F.col("ahead") >= least - SLACK)
    x, y, on = at(a, "w"), at(b, "w"), [*keys, "feature"]
    out = _meet(rare(x, share * F.col("total")), y, on).unionByName(_meet(x, rare(y, share * F.col("total")), on))
    if t == 1:
        return out  # as many letters in common as there are means the same words
    kind, rate = ("p", (3 * t - 2) / (2 - t)) if t >= 0.7 else ("l", share)
    both = [rare(at(side, kind), rate * (F.col("total") - 1) + 1).select(*keys, "feature", no, F.col("total").alias(f"_{no}")) for side, no in ((a, "a_no"), (b, "b_no"))]
    near = both[0].join(both[1], on).where(F.least("_a_no", "_b_no") - 1 >= share * (F.greatest("_a_no", "_b_no") - 1) - SLACK)
    return out.unionByName(near.select("a_no", "b_no"))


def _holding(long: DataFrame, short: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of which long's title holds short's and a version marker beside it: the short one is looked up by its first letters, an empty one by none."""
    low, held = F.col("low"), F.col("held")
    places, no = F.sequence(F.lit(1), F.length(low)), [c for c in short.columns if c.endswith("_no")]
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(HELD)), lambda k: F.transform(places, lambda p: F.substring(low, p, k))))
    # what is left when the held title is cut out still has the marker's letters in their order
    marked = "|".join(".*".join(m) for m in VARIATIONS)
    by = long.where(low.rlike(f"(?s){marked}")).withColumn("_start", F.explode(F.array_distinct(F.array_append(runs, F.lit("")))))
    starts = short.select(*keys, *no, low.alias("held"), F.substring(low, 1, HELD).alias("_start"))
    return by.join(starts, [*keys, "_start"]).where(F.contains(low, held) & scoring.varies(low, held)).select("a_no", "b_no")


def best_in_catalogue(references: DataFrame, catalogue: DataFrame, keys: list[str], least: float = 0.0, s: Settings = DEFAULT) -> DataFrame:
    """reference_id, candidate_id and similarity, as best_by_title gives them, where a reference's (reference_id, title, keys)
    candidates are all rows of a catalogue (candidate_id, position, name, keys) with equal keys; but not all of them are looked at.

    Equal titles of equal keys are one, of which the first position counts. Similarities are asked for from high to low (STEPS):
    each time, inverted indexes of words, of pairs of letters or of letters give all pairs that may be so similar, these are
    scored, and references that found one are done. So a pair of little similarity is scored only for references that have
    nothing better; below 0.5 these meet most titles of their keys. Null titles, names and keys have no match; of empty titles
    the rules are best_by_title's. Further columns play no part. The result lies in a table in the shared folder.
    """
    scope, work = Scope(references.sparkSession), Scope(references.sparkSession)
    outer, keys = keys, [f"_key{k}" for k in range(len(keys))]
    keyed = lambda df, *own: df.select(*own, *[F.col(k).alias(inner) for k, inner in zip(outer, keys, strict=True)])
    references, catalogue = keyed(references, "reference_id", "title"), keyed(catalogue, "candidate_id", "position", "name")
    prepared = lambda df, title: df.select(*keys, title).where(F.col(title).isNotNull()).distinct().select(*keys, F.col(title).alias("title"), F.lower(title).alias("low"), normalize(F.col(title)).alias("n"), phonetic_key(title).alias("k"))
    firsts = catalogue.where("name is not null").groupBy(*keys, F.col("name").alias("title")).agg(F.min(F.struct("position", "candidate_id")).alias("first"))
    a = work.written(prepared(references, "title").withColumn("a_no", F.monotonically_increasing_id()))
    b = work.written(prepared(catalogue, "name").join(firsts, [*keys, "title"]).withColumn("b_no", F.monotonically_increasing_id()))
    features = _features(a.select("n").unionByName(b.select("n")))
    postings = {kind: work.written(_postings(rows)) for kind, rows in features.items()}
    slim = ["title", "n", "k"]
    left, found, open_ = work.written(a), [], True
    for t in [*[t for t in STEPS if t > least], max(least, SLACK)]:
        own, all_ = left.drop("title"), b.drop("title", "first")
        pairs = _by_features(own.select(*keys, "n", "a_no"), all_.select(*keys, "n", "b_no"), postings, keys, t)
        same = [c for c, value in (("low", s.identical), ("n", s.identical), ("k", s.phonetic)) if value >= t]
        for c in same:
            pairs = pairs.unionByName(_meet(own.where(F.col(c) != "") if c == "k" else own, all_.select(*keys, c, "b_no"), [*keys, c]))
        if s.variation >= t:
            x, y = own.select(*keys, "low", "a_no"), all_.select(*keys, "low", "b_no")
            pairs = pairs.unionByName(_holding(x, y, keys)).unionByName(_holding(y, x, keys))
        pairs = work.written(pairs.distinct())
        sides = [df.select(no, *more, *[F.col(c).alias(f"{side}_{c}") for c in slim]) for df, no, side, more in ((a, "a_no", "a", []), (b, "b_no", "b", ["first"]))]
        both, c = pairs.join(sides[0], "a_no").join(sides[1], "b_no"), F.col
        scored = both.select("a_no", "first", scoring.title_similarity(c("a_title"), c("b_title"), c("a_n"), c("b_n"), c("a_k"), c("b_k"), s).alias("similarity")).where(c("similarity") >= (t if t in (least, SLACK) else t - SLACK))
        best = scored.groupBy("a_no").agg(F.min_by(F.struct("first.candidate_id", "similarity"), F.struct(-c("similarity"), "first")).alias("best"))
        found.append(work.written(best.select("a_no", "best.candidate_id", "best.similarity")))
        left = work.written(left.join(found[-1], "a_no", "left_anti"))
        if left.isEmpty():
            open_ = False
            break
    if open_ and least <= 0:
        # nothing in common with any candidate: the first of all
        any_ = b.groupBy(*keys).agg(F.min("first").alias("first"))
        found.append(left.join(any_, keys).select("a_no", "first.candidate_id", F.lit(0.0).alias("similarity")))
    every = found[0]
    for rows in found[1:]:
        every = every.unionByName(rows)
    named = a.select(*keys, "title", "a_no").join(every, "a_no").drop("a_no")
    out = scope.written(references.select("reference_id", "title", *keys).join(named, [*keys, "title"]).select("reference_id", "candidate_id", "similarity"))
    work.drop()
    return out
