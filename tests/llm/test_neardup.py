"""Near duplicates and components against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidewall.llm.components import connected_components
from tidewall.llm.neardup import MinHasher, near_duplicates, one_of_each, shingles


def _sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def _brute(rows):
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {i: _sets(t) for i, t in rows}
    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def _corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    passage = [word() for _ in range(40)]
    texts = [None, "", "  \n\t ", "One two", "one TWO", "one two three four five", "ONE two three four five", "É é", "é É"]
    for k in range(30):
        base = [word() for _ in range(rng.choice((60, 90, 200)))]
        if k % 2:
            base = passage + base[:30]
        texts.append(" ".join(base))
        for _ in range(k % 5):
            copy = list(base)
            for _ in range(rng.choice((0, 1, 2, 3))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    chain = [word() for _ in range(100)]
    for k in range(8):  # each links with the next only
        texts.append(" ".join(chain[4 * k :] + [word() for _ in range(4 * k)]))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("block", [512, 4])
def test_components_equal_brute_force(spark, block):
    rows = _corpus()
    df = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, id string, bucket int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, block=block).collect()}
    assert got == _brute(rows)


def test_odd_rows(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, None), (None, "x y z"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(df).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in got) == [(-1, 0, -1, True), (-1, 1, -1, True), (-1, 2, 3, False), (3, 2, 3, True), (3, 2, 3, True), (7, 0, 7, True)]
    assert near_duplicates(df.filter("doc_id > 9")).count() == 0


def test_unlike_texts_under_one_id_stay_apart(spark):
    """Two families share doc_id 5, in star links and in links inside a block; one text of each family and the odd one stay."""
    rng = random.Random(21)
    words = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    a, b, c = words(120), words(120), words(120)
    near = lambda w, k: " ".join([*w[:-2], *words(k)])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (6, near(a, 2)), (7, near(b, 2)), (8, " ".join(c)), (5, " ".join(b)), (None, " ".join(a))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for block in (512, 1):
        got = near_duplicates(df, block=block).collect()
        assert sorted((r.doc_id or -1, r.component_id, r.kept) for r in got) == [(-1, 5, False), (5, 5, True), (5, 5, True), (5, 5, True), (6, 5, False), (7, 5, False), (8, 8, True)]
        assert len({r.component_row for r in got}) == 3
    kept = [r.text for r in one_of_each(df, ("doc_id", "text")).collect()]
    assert sorted(kept) == sorted(" ".join(w) for w in (a, b, c))


def test_components_of_long_paths(spark):
    edges = spark.range(1, 200).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v")).unionByName(spark.createDataFrame([(501, 500), (502, 501), (500, 500)], "u long, v long"))
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(200)} | {500: 500, 501: 500, 502: 500}


def test_hubs_change_nothing(spark):
    rng = random.Random(12)
    pairs = [(0 if rng.random() < 0.3 else rng.randint(1, 300), rng.randint(1, 300)) for _ in range(150)] + [(400, k) for k in range(401, 440)]
    edges = spark.createDataFrame(pairs, "u long, v long").repartition(3)
    got = [{r.node: r.component for r in connected_components(edges, least_hub=h).collect()} for h in (5, 1000)]
    assert got[0] == got[1] and got[0][439] == 400


def test_links_that_agree_by_byte_in_a_false_earlier_band(spark):
    """A family of which one pair links, met in band 1 under a pivot that links with neither, while in band 0
    its minima differ but for their low byte."""
    rng = random.Random(11)
    hasher = MinHasher(500)
    hasher.a, hasher.b = hasher.a[:2], hasher.b[:2]
    words = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]
    for _ in range(50_000):
        shared = words(84)
        a, b, pivot = shared + words(12), shared + words(12), shared[:74] + words(30)
        x, y = (hasher(shingles(" ".join(t))) for t in (a, b))
        if x[0] != y[0] and x[0] % 256 == y[0] % 256 and x[1] == y[1] == hasher(shingles(" ".join(pivot)))[1]:
            break
    else:
        raise AssertionError("no such family")
    rows = list(enumerate(" ".join(t) for t in (a, b, pivot, *(pivot + words(k) for k in range(1, 5)))))
    want = _brute(rows)
    assert want[1][1] == 0 and want[2][1] == 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, bands=2, rows=1).collect()}
    assert got == want
