import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, fp string, size int, tag string, start int, `_id` int, `_ranges` string, `row` int, `key` string, `_text` string"


def sentence(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice(["ba", "ko", "ri", "tu", "ne", "sol"]) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with copies, near copies, shared passages, odd values and clashing columns."""
    r = random.Random(5)
    passage = sentence(r, 60)
    texts: list[str | None] = []
    for i in range(120):
        t = sentence(r, r.randint(1, 200))
        if i % 9 == 0:
            t += " " + passage
        if i % 10 == 1 and texts:
            t = texts[-1]
        if i % 10 == 2 and texts and texts[-1]:
            t = texts[-1] + " extra"
        texts.append(t)
    texts += [None, "", " \t\n ", "one", "one two", "ÉÈ ü x 日本", "ab " * 3000, sentence(r, 6000), "BM GIF89a RIFF %PDF-1.4 PK\x03\x04"]
    out = [(i, t, "en", ["a", "b", None, "é"][i % 4] if i % 3 else "hot", 7, i, "x", 1, "t", 2, 0, "r", 5, "k", "y") for i, t in enumerate(texts)]
    return out + [out[3], (3, "another text under the same id", "en", "a", 1, 1, "x", 1, "t", 2, 0, "r", 5, "k", "y"), (None, "a row without an id", *[None] * 13)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def folder(spark, docs, tmp_path_factory):
    """The same as a folder of tables, with labels and a benchmark."""
    at = tmp_path_factory.mktemp("sf")
    docs.write.parquet(f"{at}/documents.parquet")
    r = random.Random(9)
    labels = [(i, int(i % 7 != 0), int(i % 5 == 0)) for i in range(0, 120, 2)] + [(4, None, 1), (None, 1, 1), (8, 1, None), (8, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    items = [(0, sentence(r, 30)), (1, None), (2, ""), (3, docs.filter("doc_id = 20").first()["text"])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)
