"""Masking, the classifier and the pipeline's stages on a small corpus."""

import random

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from tidewall.llm.common import crc32_text
from tidewall.llm.quality import WIDTH, estimate_prior, features, fit, scale_of, score_quality
from tidewall.llm.secrets import mask_spans, scan_secrets


def _docs():
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    rows, labels = [], []
    for i in range(480):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(30, 200))]
        kind = i % 4
        text = " ".join(words)
        if kind == 1:
            text = " ".join(w + rng.choice(("%%%", "***", "###")) for w in words)
        if kind == 2 and i % 8 == 2:
            text = " ".join([words[0]] * 200)
        if i % 20 == 0:
            text += ' token = "0123456789abcdef0123456789abcdef"'
        bad = kind == 1 or (kind == 2 and i % 8 == 2)
        rows.append((i, text, "en", "s", len(text)))
        if i % 3 != 1:
            labels.append((i, 0 if bad else 1, 0))
    rows += [(1000, rows[0][1], "en", "s", 1), (1001, rows[3][1] + " more", "en", "s", 1), (1002, None, "en", "s", 1), (1003, "", None, None, None)]
    return rows, labels


def test_masking(spark):
    text = f"é token = \"{'a1' * 20}\" und {'f0' * 13} ok"
    df = spark.createDataFrame([(1, text), (2, "plain"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.m for r in scan_secrets(df, keep=("text",)).select("doc_id", mask_spans(F.col("text"), F.col("found")).alias("m")).collect()}
    assert got == {1: 'é [assign]" und [hex] ok', 2: "plain", 3: None}


def test_classifier_separates_and_ignores_other_columns(spark):
    rows, labels = _docs()
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score string").repartition(3)
    marks = spark.createDataFrame([*labels, (None, 1, 0), (0, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in score_quality(docs, marks).collect()}
    assert len(got) == len(rows)
    held = {r.doc_id: r.h for r in docs.select("doc_id", (F.pmod(crc32_text(F.col("doc_id")), F.lit(4)) == 2).alias("h")).collect()}
    truth = {i: q for i, q, _ in labels}
    assert all(got[i].held_out == held[i] and 0 <= got[i].score <= 1 and got[i].predicted == int(got[i].score >= 0.7) for i in got)
    tested = [i for i in truth if held[i]]
    assert np.mean([got[i].predicted == truth[i] for i in tested]) > 0.9


def test_classifier_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None), (1, "a b")], "doc_id long, text string")
    marks = spark.createDataFrame([], "doc_id long, quality int")
    got = score_quality(docs, marks).collect()
    assert len(got) == 3 and all(abs(r.score - 0.5) < 1e-9 for r in got)
    assert score_quality(docs.filter("doc_id = 5"), marks).count() == 0


def test_labels_of_zero_and_conflicts_teach_nothing(spark):
    rows, labels = _docs()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
    ones = [x for x in labels if x[1] == 1]
    both = spark.createDataFrame([*ones, (1, 1, 0), (1, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    scores = [{r.doc_id: round(r.score, 9) for r in score_quality(docs, m).collect()} for m in (spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), both)]
    assert scores[0] == scores[1]


def test_features_of_odd_texts():
    x = features([b"", b"a", "é\u0000".encode(), b"word " * 200_000, b" \n "])
    assert x.shape == (5, WIDTH) and np.isfinite(x).all() and not x[0].any() and x[1].any()
    one = features([b"some words here"])
    assert (one == features([b"x", b"some words here", b"yy zz"])[1:2]).all()
    assert features([]).shape == (0, WIDTH)


def _mass(spark, x, known):
    rows = [(np.array([v], np.float32).tobytes(), False) for v in x] + [(np.array([v], np.float32).tobytes(), True) for v in x[known]]
    return spark.createDataFrame(rows, "x binary, positive boolean").repartition(3)


def _least_risk(x, known, prior, scale, ridge=1e-2):
    """The least risk and its weights, by a fine search around the best of a coarse grid, again and again."""
    z_of = lambda a, b: a + b * (x - scale[0][0]) / scale[1][0]

    def risk(a, b):
        z = z_of(a, b)
        inner = np.logaddexp(0, z).mean() - prior * np.logaddexp(0, z[known]).mean()
        return prior * np.logaddexp(0, -z[known]).mean() + max(0.0, inner) + ridge / 2 * b * b

    at, step = (0.0, 0.0), 4.0
    while step > 1e-4:
        at = min(((at[0] + i * step, at[1] + j * step) for i in range(-3, 4) for j in range(-3, 4)), key=lambda p: risk(*p))
        step *= 0.6
    return risk(*at), risk


def test_risk_is_minimised(spark):
    rng = np.random.default_rng(2)
    positive = rng.random(3000) < 0.6
    x = np.where(positive, 1.0, -1.0) + rng.normal(0, 0.7, 3000)
    known = positive & (rng.random(3000) < 0.3)
    rows = _mass(spark, x.astype(np.float32), known)
    scale = scale_of(rows, 1)
    for prior in (0.3, 0.6, 0.9):  # at 0.9 the inner risk is at its bound
        w = fit(rows, prior, scale, steps=20, enough=1e-7, slack=1e-4, halvings=14)
        least, risk = _least_risk(x, known, prior, scale)
        assert risk(*w) < least + 2e-3, prior
    assert abs(estimate_prior(rows, scale) - 0.6) < 0.1


def test_pipeline_stages(spark, tmp_path):
    rows, labels = _docs()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        seen[name] = docs.collect()
        if k < 3:
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
    ids = {name: {r.doc_id for r in found} for name, found in seen.items()}
    bad = {r[0] for r in rows if r[1] and ("%%%" in r[1] or "***" in r[1] or len(set(r[1].split())) == 1)}
    clean = {r[0] for r in rows if r[1]} - bad
    assert not ids["quality"] & bad and len(clean - ids["quality"]) <= 3
    clean &= ids["quality"]
    assert 1000 not in ids["near_duplicates"] and 1001 not in ids["near_duplicates"] and ids["near_duplicates"] >= clean - {1000, 1001}
    assert ids["secrets"] == ids["near_duplicates"] == ids["packing"]
    assert not any("0123456789abcdef" in (r.text or "") for r in seen["secrets"])
    direct = {(r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert direct == {(r.doc_id, r.start, r.length, r.ids_crc32) for r in seen["packing"]}


def test_stages_take_odd_rows(spark, tmp_path):
    rows, labels = _docs()
    same = [rows[4]] * 3 + [(None, rows[8][1], "en", "s", 1)] * 2 + [(None, None, None, None, None)] * 2 + [(2000, "word " * 30_000, "en", "s", 1)]
    bad = [r for r in rows if r[0] % 4 == 1][:3]
    same += [(rows[12][0], b[1], "en", "s", 1) for b in bad] + [(None, bad[0][1], "en", "s", 1)]  # junk under an accepted id, and under none
    docs = spark.createDataFrame([(*r, 1, "clash") for r in rows + same], "doc_id long, text string, lang string, source string, n_chars long, row int, keep_0 string").repartition(3)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.quality_stage(spark, docs, str(tmp_path)).collect()
    junk = {b[1] for b in bad}
    assert not junk & {r.text for r in kept} and sum(r.doc_id == rows[4][0] for r in kept) == 4
    one = corpus_pipeline.near_duplicates_stage(spark, docs, str(tmp_path)).collect()
    texts = [r.text for r in one if r.text]
    assert len(texts) == len(set(texts)) and sum(r.doc_id == rows[4][0] for r in one) == 1
    assert sum(r.text is None for r in one) == sum(t is None for _, t, *_ in rows + same)
    none = docs.filter("doc_id = -1")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0, name
