"""The kept index finds what a look at all names finds, with far fewer names looked at."""

import random

import pytest
from kassabon.functions.trigram import trigrams
from kassabon.plans import search, search_index
from pyspark.sql import functions as F

rng = random.Random(9)
WORDS = "appel appels appelmoes peer peren kaas jong oude melk halfvolle volkoren brood brood2 pasta penne rijst zilvervlies é ui uien a b ab tomaat tomaten cherrytomaat komkommer".split()


@pytest.fixture(scope="module")
def names(spark):
    found = {" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 4))) for _ in range(400)} | {"", "ca bd", "a b", "x" * 200}
    return spark.createDataFrame([(n,) for n in sorted(found)], "name_search string").cache()


@pytest.fixture(scope="module")
def asked(spark):
    texts = ["appel", "apel moes", "tomatn", "volle melk", "kaaas jonge", "zilver", "brood", "a b", "é", "penne rijst", "komkomer", "xyz", "", "x" * 150, "oude  KAAS!", "2"]
    return search.prepared(spark.createDataFrame(list(enumerate(texts)), "query_id int, query_text string"))


def test_same_candidates(spark, tmp_path, names, asked):
    want = {tuple(r) for r in search.candidates(names, asked).collect()}
    index = search_index.NameIndex(spark, str(tmp_path / "index"), 8)
    index.refresh(names)
    assert {tuple(r) for r in index.candidates(asked).collect()} == want and len(want) > 100


def test_changes(spark, tmp_path, names, asked):
    index = search_index.NameIndex(spark, str(tmp_path / "index"), 8)
    index.refresh(names.filter("name_search not like '%kaas%'"))
    index.refresh(names.filter("name_search not like '%appel%'"))
    left = names.filter("name_search not like '%appel%'")
    assert {tuple(r) for r in index.candidates(asked).collect()} == {tuple(r) for r in search.candidates(left, asked).collect()}
    assert index.refresh(left) == []
    one = left.unionByName(spark.createDataFrame([("qqq",)], "name_search string"))
    assert 0 < len(index.refresh(one)) <= 4  # the buckets of its four trigrams


def test_fewer_names_are_met(spark):
    syllables = "ba be bi bo da de di do ka ke ki ko la le li lo ma me mi mo na ne ni no ra re ri ro sa se si so ta te ti to".split()
    vocabulary = ["".join(rng.choice(syllables) for _ in range(rng.randint(2, 5))) for _ in range(600)]
    names = spark.createDataFrame([(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 4))),) for _ in range(2000)], "name_search string").distinct().cache()
    words = spark.createDataFrame([(w[:-1] + rng.choice("aeo"),) for w in vocabulary[:100]], "word string").distinct()
    index = search_index.name_index(names).cache()
    counts = index.groupBy("t").agg(F.count(F.lit(1)).alias("names"))
    every = words.select("word", F.explode(F.array_distinct(trigrams(F.col("word")))).alias("t")).join(index, "t")
    few = search_index.met(search_index.probes(words, counts), index)
    assert 3 * search_index.probes(words, counts).join(index, "t").count() < every.count()
    assert 2 * few.count() < every.select("word", "name_search").distinct().count()
    found = lambda pairs: {tuple(r) for r in search_index.similar(pairs).collect()}
    assert found(few) == found(every.select("word", "name_search").distinct())
