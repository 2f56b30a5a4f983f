"""Cases of the review of round 1."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import crf, superkmer, template

ITEM = "Anna buys 3 apples and gives Ben 4 pears so how many fruits does Anna hold after Ben returns 4 of the green ones"


def test_texts_without_an_id_are_told_apart_by_the_whole_hash(spark, tmp_path):
    spark.createDataFrame([(7, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    text = F.concat(F.when(F.col("id") % 2 == 0, F.lit(ITEM)).otherwise(F.lit("of stones and rivers")), F.lit(" text "), F.col("id").cast("string"))
    docs = spark.range(1600).select(F.lit(None).cast("long").alias("doc_id"), text.alias("text"))
    kept = [r["text"] for r in template.drop_leaks(spark, docs, str(tmp_path)).collect()]
    assert len(kept) == 800 and all(t.startswith("of stones") for t in kept)


def test_texts_under_one_id_lose_only_their_own_repeats(spark):
    passage = " ".join(f"w{k}" for k in range(14))
    own = F.concat_ws(" ", *[F.concat(F.lit(f"v{k}x"), F.col("id").cast("string")) for k in range(14)])
    docs = spark.range(1600).select(F.lit(1).cast("long").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit(passage + " "), own)).otherwise(own).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(0, passage)], "doc_id long, text string"))
    sizes = [len(r["text"].split()) for r in superkmer.dedup_text(spark, docs, "").collect()]
    assert sizes == [14] * 1601


def test_items_of_numbers_and_names_are_found_word_by_word(spark):
    names = "Anna Ben Carla Dora Emil Fritz Gina Hugo Ida Jan Karl Lena"
    mixed = ITEM + " " + names
    items = [(1, "Compute 17 times 23"), (2, names), (3, mixed)]
    texts = {1: "so compute it: Compute 17 times 23 now", 2: "Compute 18 times 23", 3: f"those are {names} here", 4: names.replace("Emil", "Otto").replace("Ida", "Eva"), 5: ITEM.replace("Anna", "Maria").replace("3", "17")}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    for most in (1 << 20, 0):
        got = template.leaks(docs, spark.createDataFrame(items, "item_id long, text string"), most_broadcast=most).collect()
        # Items of names only match their words; one that is a template in part is found by that part as well.
        assert sorted((r["doc_id"], r["item_id"], r["reparameterised"]) for r in got) == [(1, 1, False), (3, 2, False), (5, 3, True)]


@pytest.mark.parametrize("tenths", [1, 3, 5, 7, 9])
def test_words_are_tied_to_toxic_documents_at_any_share_of_labels(tenths):
    r = random.Random(tenths)
    docs = []
    for i in range(1000):
        toxic = i % 10 < tenths
        words = [r.choice(["stone", "river", "garden", "window"]) for _ in range(20)]
        if toxic:
            words[r.randrange(20)] = "grumble"
        docs.append((crf.observations([" ".join(words).encode()])[0], int(toxic)))
    bad, good = (crf.observations([w])[0][0, 0] for w in (b"grumble", b"stone"))
    count = np.array([h.shape[1] for h, _ in docs])
    words = np.concatenate([h[0] for h, _ in docs])
    tied = crf.tied(words, np.repeat(np.arange(1000), count), np.array([y for _, y in docs], float)).tolist()
    assert bad in tied and good not in tied
    at = crf.buckets(crf.observations([b"stone grumble river"])[0])
    p = crf.train(docs).marginals(at, np.array([3]))
    assert p[1] > 0.5 > max(p[0], p[2])
