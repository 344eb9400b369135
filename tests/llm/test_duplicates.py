import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from glasspane.llm import common as C
from glasspane.llm import graph
from glasspane.llm import neardup as N
from glasspane.llm import queries as Q
from glasspane.llm.graph import components


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def classes(rows, least=0.8):
    """Smallest id of each document's class, from all pairs of documents that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    parent, holders = list(range(len(rows))), {}

    def top(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i
    empty = [i for i, s in enumerate(sets) if not s]
    for i in empty[1:]:
        parent[top(i)] = top(empty[0])
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in holders[x] if j > i).items():
            if n >= least * (len(s) + len(sets[j]) - n):
                parent[top(j)] = top(i)
    low, size = {}, Counter(top(i) for i in range(len(rows)))
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[top(i)] = min(d, low.get(top(i), d))
    return sorted((-1 if d is None else d, -1 if low.get(top(i)) is None else low[top(i)], size[top(i)]) for i, (d, _) in enumerate(rows))


def got(df):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], -1 if r["class_id"] is None else r["class_id"], r["class_size"]) for r in df.collect())


def test_same_classes_as_all_pairs(spark, sf, table):
    assert got(Q.near_duplicates(spark, sf)) == classes(table("SELECT doc_id, text FROM documents"))


def test_large_groups_of_near_copies(spark):
    r = random.Random(3)
    base = [f"w{r.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(300):
        words = list(base)
        for _ in range(r.randrange(3)):
            words[r.randrange(len(words))] = f"z{r.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"q{r.randrange(10**6)}" for _ in range(80))) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(N.label(df)) == classes(rows)


def test_pairs_in_a_crowded_bucket_of_dissimilar_texts(spark):
    """600 texts of one common passage and words of their own, with 40 pairs of near copies among them; all in one bucket, no bucket apart."""
    r = random.Random(5)
    common = [f"w{r.randrange(500)}" for _ in range(60)]
    rows = [(i, " ".join(common + [f"q{r.randrange(10**6)}" for _ in range(30)])) for i in range(600)]
    rows += [(1000 + i, rows[i][1] + f" z{i} z{i + 1}") for i in range(40)]
    sets = N._identified(spark.createDataFrame(rows, "doc_id long, text string")).mapInArrow(
        C.by_block(N._sets, N._SETS), "key binary, shingles array<long>").cache()
    apart = sets.select(F.lit(1).cast("long").alias("band"), "key", F.col("key").alias("root"))
    pairs = N._rest(apart, sets, 0.8, salted=7)
    links = {(bytes(x["a"]), bytes(x["b"])) for x in N._verified(pairs, sets, 0.8).collect()}
    assert len(links) == 40 and pairs.count() < 400
    assert N._rest(apart.withColumn("root", F.lit(b"all")), sets, 0.8).count() == 0


def test_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got(N.label(odd)) == classes(rows)
    kept = N.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in kept.collect()) == [-1, 1, 4, 5, 6]
    assert N.label(none).count() == 0 and N.one_of_each(none).count() == 0


def test_signature_estimates_probability_jaccard():
    r = np.random.default_rng(1)
    n = 400
    pool = r.integers(1, 2**44, n, dtype=np.uint64)
    a, b = r.gamma(1.0, 1.0, n) * (r.random(n) < 0.8), r.gamma(1.0, 1.0, n) * (r.random(n) < 0.8)
    both = np.flatnonzero((a > 0) & (b > 0))
    want = sum(1 / np.maximum(a / a[i], b / b[i]).sum() for i in both)
    m = 8192
    sa = N.signatures(pool[a > 0], np.zeros((a > 0).sum(), np.int64), a[a > 0], 1, m)
    sb = N.signatures(pool[b > 0], np.zeros((b > 0).sum(), np.int64), b[b > 0], 1, m)
    assert abs((sa == sb).mean() - want) < 4 * (want * (1 - want) / m) ** 0.5


def test_components_of_a_chain(spark):
    links = spark.range(1, 40).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b")).union(
        spark.range(100, 101).select("id", F.lit(90).cast("long")))
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    assert roots == {**dict.fromkeys(range(40), 0), 100: 90, 90: 90}


def test_words_and_hashes():
    bodies = [b"Ab  c\td", b"", b"\n", "é ab c d e f".encode(), b"ab c d e f"]
    words = C.Words(bodies)
    texts = [bytes(words.bytes[a:b]) for a, b in zip(words.start, words.end)]
    assert texts == [w for b in bodies for w in b.lower().split()]
    seen = {}
    assert all(seen.setdefault(t, h) == h for t, h in zip(texts, words.hashes())) and len(set(words.hashes().tolist())) == len(set(texts))
    shingle, doc = words.shingles()
    assert doc.tolist() == [0, 3, 3, 4] and shingle[2] == shingle[3]


def _jobs(spark, work):
    spark.sparkContext.setJobGroup(name := f"counted-{work.__name__}", "")
    out = work()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_few_links_are_merged_in_one_partition_and_no_new_ones_cost_little(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a long, b long")
    root = graph.components(links)
    assert root.rdd.getNumPartitions() == 1
    same, jobs = _jobs(spark, lambda: graph.merged(root, spark.createDataFrame([(1, 3), (7, 8)], "a long, b long")))
    assert sorted(map(tuple, same.collect())) == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)] and jobs <= 10
    more = graph.merged(root, spark.createDataFrame([(3, 8), (8, 9), (11, 12), (1, 2)], "a long, b long"))
    assert sorted(map(tuple, more.collect())) == [(1, 1), (2, 1), (3, 1), (7, 1), (8, 1), (9, 1), (11, 11), (12, 11)]
