import pytest

LONG = " ".join(f"w{k % 700} the" for k in range(12_000))
PASSAGE = " ".join(f"alpha{k}" for k in range(60))

#: Ids and texts with nulls, blanks, copies, repeated rows, ties and a very long text.
EDGES = [
    (1, f"One Two three four five six. {PASSAGE} end of it"),
    (2, None),
    (3, ""),
    (4, f"One Two three four five six. {PASSAGE} end of it"),
    (5, LONG),
    (6, " \t\n "),
    (7, f"another begin {PASSAGE} and then more words that differ"),
    (8, "short"),
    (8, "short"),
    (None, "no id here at all"),
    (None, None),
    (9, "Größe 𝄞 été ñandú 　   naïve"),
    (10, f"{PASSAGE} {PASSAGE}"),
]

#: Columns that bear names which operators use themselves.
CLASHES = ("score", "shard", "slot", "tag", "fp", "row", "word", "n", "doc", "at", "key", "piece", "length", "count", "predicted", "spans", "component_id", "s_email", "chunk", "bucket", "mask", "__text", "__id", "__own", "own", "gone", "value", "blob", "type")


@pytest.fixture(scope="session")
def edges(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
    rows = [(i, t, None if k % 3 else "en", "src0", None if t is None else len(t), *("x",) * len(CLASHES)) for k, (i, t) in enumerate(EDGES)]
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text or "" for r in documents.select("doc_id", "text").collect()}
