"""The pipeline's de-duplication: fingerprints and the covering LSH first, the exact join for the rest."""

import random

from pyspark.sql import functions as F

from pelagia.llm import setjoin, simhash
from tests.llm.test_tables import jaccard_brute


def near_copies(r):
    texts = []
    for _ in range(30):
        words = [f"w{r.randint(0, 400)}" for _ in range(r.choice([60, 200]))]
        texts.append(" ".join(words))
        for k in (1, 1, 3):
            words = list(words)
            for _ in range(k):
                words[r.randrange(len(words))] = "x%d" % r.randint(0, 999)
            texts.append(" ".join(words))
    return texts + ["", None, "one two", "One two"]


def test_stage_goes_through_the_covering_lsh(spark, monkeypatch):
    texts = near_copies(random.Random(4))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    known = []
    links = setjoin.links

    def seen(*args, **how):
        known.append({tuple(x) for x in how["known"].select("fp", "root").collect()})
        return links(*args, **how)

    monkeypatch.setattr(setjoin, "links", seen)
    comps = jaccard_brute(texts)
    assert sorted(x.doc_id for x in simhash.stage(spark, df, "").collect()) == sorted(set(comps))
    # what the fingerprints connect is not empty, and is right
    (got,) = known
    of = {setjoin.digest(setjoin.shingle_set(t, 5)): c for t, c in zip(texts, comps, strict=True)}
    assert len(got) >= 6
    assert all(of[a] == of[b] for a, b in got)


def test_pairs_of_fingerprints_lose_none_within_the_radius(spark):
    texts = near_copies(random.Random(5))
    prints = {setjoin.digest(setjoin.shingle_set(t, 5)): simhash.fingerprint(t, 5) & (2**64 - 1) for t in texts if t}
    signed = lambda v: v - 2**64 if v >> 63 else v
    df = spark.createDataFrame([(f, signed(s), 1) for f, s in prints.items()], "fp long, sim long, n int")
    got = simhash.near_sets(df).select("a", "b").collect()
    parent = {f: f for f in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in got:
        assert (prints[x.a] ^ prints[x.b]).bit_count() <= 3
        parent[find(x.a)] = find(x.b)
    assert got and all(find(a) == find(b) for a in prints for b in prints if (prints[a] ^ prints[b]).bit_count() <= 3)


def test_exact_check_of_many_pairs_with_one_set(spark):
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base)] + [" ".join(base[:-k] + [f"y{k}"] * k) for k in range(1, 20)]
    sets = [set(zip(*[t.split()[i:] for i in range(5)], strict=False)) for t in texts]
    keyed = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("key", F.struct(F.col("id").alias("a"), F.lit(0).alias("b")))
    prints = setjoin.sets_of(keyed, 5, "0.8").cache()
    fp = {x.id: x.fp for x in prints.collect()}
    pairs = spark.createDataFrame([(fp[i], fp[0]) for i in range(1, 20)], "a long, b long")
    got = {x.a for x in setjoin.confirmed(pairs, prints, keyed.select("key", "text"), 5, "0.8", rows=3).collect()}
    assert got == {fp[i] for i in range(1, 20) if 5 * len(sets[i] & sets[0]) >= 4 * len(sets[i] | sets[0])}
    assert 0 < len(got) < 19


def test_groups_that_are_connected_already_are_left_out(spark):
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base[:k] + ["x"] + base[k + 1 :]) for k in range(0, 200, 25)]
    keyed = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("key", F.struct(F.col("id").alias("a"), F.lit(0).alias("b")))
    prints = setjoin.sets_of(keyed, 5, "0.8").cache()
    text = keyed.select("key", "text")
    all_ = setjoin.links(prints, text, 5, "0.8")
    assert all_.count() > 0
    known = setjoin.components(all_.select("a", "b")).withColumnRenamed("node", "fp")
    assert setjoin.links(prints, text, 5, "0.8", known=known).count() == 0
    none = known.filter("false")
    assert setjoin.links(prints, text, 5, "0.8", known=none).count() == all_.count()
