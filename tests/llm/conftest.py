import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, fp string, spans string, kept string, `a.b` string"


@pytest.fixture(scope="session")
def small(spark):
    """(doc_id, text, lang): prose of several lengths, copies, blanks, nulls, repeated rows and a very long text."""
    import random

    r = random.Random(3)
    words = ["alpha", "beta", "Gamma", "delta,", "sea.", "tide", "mund", "krill", "élan", "über", "ñandú", "漢字", "reef"]
    prose = lambda n: " ".join(r.choice(words) + r.choice("abcdefgh") * r.randint(0, 2) for _ in range(n))
    rows = [(i, prose(r.randint(1, 120)), r.choice(["en", "de"])) for i in range(80)]
    rows += [(100 + i, rows[3][1], "en") for i in range(30)]  # exact copies
    rows += [(200 + i, prose(60) + "\n" + "same line here again\n" * i, "en") for i in range(6)]
    rows += [(300, None, None), (301, "", "en"), (302, " \t\n ", "de"), (None, "a text without an id", "en"), (303, None, "en"), (304, "one", None), (304, "one", None), (305, "!!! ... 123", "en")]
    rows += [(306, prose(9000), "en"), (307, "x" * 70000, "en"), (308, "word  \r\n\tword 's don't 12,5  ", "en")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, small):
    """With extra columns whose names clash with those that operators use."""
    full = [(i, t, x, "src", len(t) if t is not None else None, "r", "k", "f", "s", "no", "ab") for i, t, x in small]
    return spark.createDataFrame(full, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
