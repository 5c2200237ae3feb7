import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def edge_rows(extra=()):
    """Documents with nulls, empty and long texts, repeats and ties; all columns of documents and
    some with the names of results."""
    long = " ".join(f"word{i % 977} the" for i in range(9000))
    texts = [None, "", "   \n\t ", "One", "The mit License", "under the MIT License, under the  mit-license", long, long, "日本語のテキスト と the word", "é" * 300, "a" * 5000, "x y z", "Apache License, Version 2.0 and cc by-nc", *extra]
    rows = [(i, t, "en" if i % 3 else None, None if i % 4 == 0 else "s", len(t or ""), 7, "x", *CLASHES) for i, t in enumerate(texts)]
    return rows + [rows[3], (None, "null id", "en", "s", 7, 7, "x", *CLASHES), (None,) * len(rows[0])]


#: Columns with names that operators use themselves.
NAMES = ("id", "h", "x", "row", "class", "sketch", "node", "component_id", "gone_id", "marks", "found", "n_words", "size", "shard", "digest", "task", "chunk", "usable", "__id", "__text", "score")
CLASHES = tuple(f"own {n}" for n in NAMES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens long, kept string, " + ", ".join(f"{n} string" for n in NAMES)


@pytest.fixture()
def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture()
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
