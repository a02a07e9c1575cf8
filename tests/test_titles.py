"""The best title of a catalogue, against a look at all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tracklight.operators import matching
from tracklight.sources.standin import Library

REFERENCE = "reference_id long, title string, g string"
CATALOGUE = "candidate_id long, position long, name string, g string"


def all_pairs(references, catalogue, keys, least):
    listed = references.select("reference_id", *keys).join(catalogue, keys).drop(*keys)
    return matching.best_by_title(references.select("reference_id", "title"), listed, least)


def rows(df):
    return sorted((r.reference_id, r.candidate_id, round(r.similarity, 9)) for r in df.select("reference_id", "candidate_id", "similarity").collect())


def changed(r: random.Random, title: str) -> str:
    words = title.split()
    kind = r.randrange(8)
    if kind == 0:
        return title + r.choice((" - Live", " (Remix)", " extended"))
    if kind == 1:
        return " ".join(words[1:])
    if kind == 2:
        return " ".join(reversed(words)) + " again"
    if kind == 3:
        k = r.randrange(len(title))
        return title[:k] + r.choice("aeixz") + title[k + 1 :]
    if kind == 4:
        return title[::-1]
    if kind == 5:
        return title.replace("e", "").upper()
    if kind == 6:
        return "".join(r.choice("abcdefghij klmnop") for _ in range(r.randrange(1, 25)))
    return words[0][: r.randrange(1, 4)]


@pytest.mark.parametrize("least, n", [(0.3, 2000), (0.0, 500), (1.0, 500)])
def test_equal_to_all_pairs(spark, least, n):
    """2,000 tracks in 25 groups, their titles changed in eight ways, so that every step has some."""
    tracks = Library(spark, "/root/testdata/sf0.01").tracks.orderBy("track_id").limit(n).collect()
    r = random.Random(5)
    references = spark.createDataFrame([(t.track_id, changed(r, t.title), str(r.randrange(25))) for t in tracks], REFERENCE)
    catalogue = spark.createDataFrame([(t.track_id, r.randrange(10_000), t.title if k % 9 else changed(r, t.title), str(r.randrange(25))) for k, t in enumerate(tracks)], CATALOGUE)
    want = rows(all_pairs(references, catalogue, ["g"], least))
    assert want == rows(matching.best_in_catalogue(references, catalogue, ["g"], least))
    if least == 0.3:
        found = [s for _, _, s in want]
        assert all(any(low <= s < high for s in found) for low, high in ((0.3, 0.5), (0.5, 0.7), (0.7, 0.85), (0.85, 1.0), (1.0, 1.1)))


def test_odd_titles(spark):
    titles = ["", " ", "live", "Live", "art", "party - live", "li art ve", "a a a", "a", "42", "4 2", "!!!", "Ünï code", "uni code", "x" * 900, "x" * 899 + "y", None, "the", "The The"]
    references = spark.createDataFrame([(k, t, g) for k, t in enumerate(titles) for g in ("1", "2", None)], REFERENCE).withColumn("first", F.lit(1)).withColumn("n", F.lit("n"))
    catalogue = spark.createDataFrame([(100 + k, len(titles) - k // 2, t, "1") for k, t in enumerate(titles)] * 2, CATALOGUE).withColumn("title", F.lit("?"))
    for least in (0.0, 0.9):
        want = rows(all_pairs(references, catalogue.distinct(), ["g"], least))
        got = matching.best_in_catalogue(references, catalogue, ["g"], least)
        assert got.columns == ["reference_id", "candidate_id", "similarity"]
        assert want == rows(got)
    assert matching.best_in_catalogue(references, catalogue.limit(0), ["g"]).count() == 0
    assert matching.best_in_catalogue(references.limit(0), catalogue, ["g"]).count() == 0


def test_keys_may_have_any_name(spark):
    references = spark.createDataFrame([(1, "blue sky", "q")], "reference_id long, title string, low string")
    catalogue = spark.createDataFrame([(7, 1, "sky blue", "q"), (8, 0, "sky blue", "other")], "candidate_id long, position long, name string, low string")
    assert rows(matching.best_in_catalogue(references, catalogue, ["low"])) == [(1, 7, 1.0)]
