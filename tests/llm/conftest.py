import pytest

LONG = "wort " * 30_000 + "ende"
WORDS = "der und die von einem langen text der sich ein wenig unterscheidet aber sonst fast gleich bleibt bis zum ende des absatzes".split()
EDGE = [
    (1, "One plain text, with some words in it."),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (5, "One plain text,\twith some words  in it.\n"),
    (6, "word"),
    (7, LONG),
    (8, "ünïcödé 字 🎉 text"),
    (9, " ".join(WORDS)),
    (9, " ".join(WORDS)),
    (10, " ".join(WORDS)),
    (None, "a row without an id"),
    (None, None),
]
#: Extra columns whose names operators use themselves.
CLASHING = ["id", "score", "__text", "fingerprint", "size", "copies", "bucket", "word", "spans", "n", "rule", "host"]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in any column, empty and very long texts, repeated rows, ties, and columns with clashing names."""
    langs, sources = ["en", None, "de"], ["a", None, "b", "c"]
    rows = [(i, t, langs[k % 3], sources[k % 4], len(t) if t is not None else None, *[k if k % 2 else None] * len(CLASHING)) for k, (i, t) in enumerate(EDGE)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASHING)
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    return [r.asDict() for r in docs.collect()]
