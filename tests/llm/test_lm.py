"""The language model against a plain dictionary model."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewall.llm.common import crc32_text
from tidewall.llm.lm import discounts, find_keys, frequent_words, hash_table, pack, read_counts, score_corpus, score_texts, train_model, unpack
from tidewall.llm.queries import op8_language_model


def _tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), "</s>"]


def _brute(rows, held):
    counts, words = Counter(), Counter()
    for i, t in rows:
        if not held[i]:
            w = _tokens(t)
            words.update(w)
            counts.update(zip(["<s>", *w], w))
    n, v = sum(words.values()), len(words)
    of = lambda c: [sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]
    spread = Counter(w for _, w in counts)
    d, dw, t = discounts(of(counts)), discounts(of(spread)), len(counts)
    floor = sum(dw[min(x, 3)] for x in spread.values()) / t / (v + 1)
    contexts = defaultdict(list)
    for (u, _), c in counts.items():
        contexts[u].append(c)

    def p(u, w):
        low = max(spread[w] - dw[min(spread[w], 3)], 0) / t + floor
        if u not in contexts:
            return low
        total = sum(contexts[u])
        c = counts[u, w]
        return max(c - d[min(c, 3)], 0) / total + sum(d[min(x, 3)] for x in contexts[u]) / total * low

    out = {}
    for i, text in rows:
        w = _tokens(text)
        base = sum(math.log10((words[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        out[i] = (len(w), sum(words[x] > 0 for x in w), n, base, sum(math.log10(p(u, x)) for u, x in zip(["<s>", *w], w)))
    return out, p, words


def test_scores_equal_brute_force(spark):
    rng = random.Random(6)
    vocabulary = ["w%d" % min(int(rng.expovariate(0.03)), 400) for _ in range(3000)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))).title()) for i in range(150)] + [(900, None), (901, ""), (902, "É new\x0bWord\x1cx"), (903, "a " * 3000)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double").repartition(5)
    held = {r.doc_id: r.h for r in docs.select("doc_id", (F.pmod(crc32_text(F.col("doc_id")), F.lit(10)) == 0).alias("h")).collect()}
    want, p, words = _brute(rows, held)
    got = {r.doc_id: r for r in score_corpus(docs).collect()}
    assert len(got) == len(rows)
    for i, (n, known, total, base, score) in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)
    for u in ("w1", "w3", "never"):
        assert sum(p(u, w) for w in words) + p(u, "unseen") == pytest.approx(1, rel=1e-9)


def test_nothing_to_train_on(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, None)], "doc_id long, text string")
    got = score_corpus(docs, F.lit(True)).collect()
    assert len(got) == 2 and all(r.score == 0 and r.base_score == 0 and r.n_known == 0 for r in got)
    assert score_corpus(docs.filter("doc_id = 9")).count() == 0


def test_shards_turns_and_hot_words_change_nothing(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(("the", "the", f"a{rng.randint(0, 30)}", f"b{rng.randint(0, 300)}")) for _ in range(rng.randint(0, 50)))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    one, many = train_model(docs, order=3), train_model(docs, order=3, shard_tokens=200, turns=3, slice_bytes=3000)
    assert many.routes.bits > one.routes.bits and not len(one.routes.hot)
    assert np.isin(np.uint64(xxhash.xxh3_64_intdigest(b"the")), many.routes.hot)
    for name in ("tokens", "vocabulary", "pairs", "floor"):
        assert getattr(one, name) == getattr(many, name)
    assert all(np.array_equal(one.discount[k], many.discount[k]) for k in (2, 3))
    scores = [{r.doc_id: r.score for r in score_texts(docs, m, F.lit(False), slice_bytes=2000).collect()} for m in (one, many)]
    assert scores[0] == pytest.approx(scores[1], rel=1e-12)
    assert scores[0] == pytest.approx(_brute_scores(rows, {i for i, _ in rows}, 3), rel=1e-9)


def test_frequent_words(spark):
    docs = spark.createDataFrame([(i, "the cat " * 10 + f"w{i}") for i in range(50)], "doc_id long, text string").repartition(3)
    n, hot = frequent_words(docs, 400, 2000)
    assert n == 50 * 22 and set(hot.tolist()) == {xxhash.xxh3_64_intdigest(w) for w in (b"the", b"cat")}


def test_hash_tables():
    rng = np.random.default_rng(5)
    for n in (0, 1, 17, 5000):
        keys = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        c = rng.integers(0, 40, len(keys)).astype(np.uint64) ** 3
        table = hash_table(keys, c=c)
        asked = np.concatenate([keys, rng.integers(0, 1 << 64, 100, np.uint64)])
        hit, places = find_keys(table, asked)
        assert hit[: len(keys)].all() and not hit[len(keys) :].any()
        assert (read_counts(table, "c", places) == c).all() and (unpack(pack(keys)) == keys).all()


def _brute_scores(rows, train, order):
    padded = lambda text: ["<s>"] * (order - 1) + _tokens(text)
    counts = {order: Counter(tuple(w[k : k + order]) for i, t in rows if i in train for w in [padded(t)] for k in range(len(w) - order + 1))}
    for level in range(order - 1, 0, -1):
        counts[level] = Counter(g[1:] for g in counts[level + 1])
    d = {level: discounts([sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]) for level, c in counts.items()}
    heads = {level: defaultdict(list) for level in counts}
    for level, found in counts.items():
        for g, c in found.items():
            heads[level][g[:-1]].append(c)

    def p(gram):
        if not gram:
            return 1 / (len(counts[1]) + 1)
        level, own = len(gram), heads[len(gram)][gram[:-1]]
        if not own:
            return p(gram[1:])
        c = counts[level][gram]
        return (max(c - d[level][min(c, 3)], 0) + sum(d[level][min(x, 3)] for x in own) * p(gram[1:])) / sum(own)

    return {i: sum(math.log10(p(tuple(w[k : k + order]))) for w in [padded(t)] for k in range(len(w) - order + 1)) for i, t in rows}


@pytest.mark.parametrize("order", [2, 3, 4])
def test_orders_equal_brute_force(spark, order):
    rng = random.Random(7)
    rows = [(i, " ".join("w%d" % min(int(rng.expovariate(0.2)), 40) for _ in range(rng.randint(0, 40)))) for i in range(120)] + [(900, None), (901, "w1"), (902, "new w1 w2 w1 w2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in score_corpus(docs, F.col("doc_id") % 5 == 0, order=order).collect()}
    want = _brute_scores(rows, {i for i, _ in rows if i % 5}, order)
    assert got == pytest.approx(want, rel=1e-9)


def test_the_query_has_order_three(spark, tmp_path):
    rows = [(i, f"a{i % 3} b{i % 2} c{i % 3} d{i % 5}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    held = {r.doc_id for r in docs.filter(F.pmod(crc32_text(F.col("doc_id")), F.lit(10)) == 0).collect()}
    got = {r.doc_id: r.score for r in op8_language_model(spark, str(tmp_path)).collect()}
    assert got == pytest.approx(_brute_scores(rows, {i for i, _ in rows} - held, 3), rel=1e-9)
