import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "ane thor wex lyr tish onder mal quen pra sild erf vou nid hest cran bly ost fen dor jeth wib lat gorm pel sut".split()


def prose(seed: int, n: int) -> str:
    """n invented words in sentences of about nine."""
    import random

    r = random.Random(seed)
    out = []
    for k in range(n):
        w = r.choice(WORDS) + r.choice(WORDS)
        out.append((w.capitalize() if k % 9 == 0 else w) + ("." if k % 9 == 8 else ""))
    return " ".join(out)


@pytest.fixture
def documents(spark):
    def make(texts, **more):
        rows = [(k if not isinstance(t, tuple) else t[0], t if not isinstance(t, tuple) else t[1], "en", f"src{k % 3}", None if t is None or isinstance(t, tuple) else len(t)) for k, t in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA)

    return make
