"""The two classifiers against naive computations, and every operator on the cases that all must handle."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomwork.llm import decontam, langid, ngrams, packing, quality, queries
from tests.llm.data import documents, rows, saved
from tests.llm.test_text_ops import ITEMS, spoken


def naive_grams(text, sizes, bits):
    """How often each hashed n-gram occurs, one place at a time."""
    out = Counter()
    for n in sizes:
        for i in range(len(text) - n + 1):
            key = int.from_bytes(text[i : i + n], "big")
            out[((key + n * 0x51ED27) % 2**64 * 0x9E3779B97F4A7C15 % 2**64) >> (64 - bits)] += 1
    return out


def test_decoding_equals_the_sum_over_bits():
    texts, langs = zip(*((t.encode(), lang) for _, t, lang, *_ in spoken(3, 45)), strict=True)
    model = langid.fit(list(texts), list(langs))
    assert model.codes.shape == (3, 3) and abs(model.trust.sum() - 1) < 1e-5
    asked = [*texts[:10], "und The été".encode(), b"x"]
    best, share, unsure = model.decode(ngrams.counts(asked, langid.SIZES, langid.BITS, lower=True))
    for text, k, s, u in zip(asked, best, share, unsure, strict=True):
        grams = naive_grams(text.lower() if text.isascii() else bytes(c + 32 if 65 <= c <= 90 else c for c in text), langid.SIZES, langid.BITS)
        x = {g: math.sqrt(n) * float(model.scale[g]) for g, n in grams.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        margins = [sum(v / norm * float(model.weights[g, b]) for g, v in x.items()) + float(model.bias[b]) for b in range(3)]
        losses = [sum(float(model.trust[b]) * math.log1p(math.exp(-margins[b] * float(code[b]))) for b in range(3)) for code in model.codes]
        weights = [math.exp(-4 * loss) for loss in losses]
        near = sorted(losses)
        assert losses[k] == near[0] and abs(weights[k] / sum(weights) - s) < 1e-3
        assert u == (near[1] - near[0] < langid.AMBIGUOUS) or abs(near[1] - near[0] - langid.AMBIGUOUS) < 1e-4


def test_bits_are_learned_for_their_own_split():
    texts, langs = zip(*((t.encode(), lang) for _, t, lang, *_ in spoken(3, 45)), strict=True)
    model = langid.fit(list(texts), list(langs))
    x = langid.features(ngrams.counts(list(texts), langid.SIZES, langid.BITS, lower=True), model.scale)
    target = model.codes[[model.langs.index(lang) for lang in langs]]
    assert (np.sign(x @ model.weights + model.bias) == target).mean() > 0.98


def quality_rows():
    texts = [f"good clean words number {i} of a text" if i % 2 else f"buy now ### {i} !!! cheap" for i in range(30)]
    return [t.encode() for t in texts], np.array([1.0 if i % 2 else -1.0 for i in range(30)])


def test_log_count_ratios_equal_counting():
    texts, y = quality_rows()
    found = quality.log_count_ratios([ngrams.present(t, quality.SIZES, quality.BITS) for t in texts], y)
    p, q = Counter(), Counter()
    for t, s in zip(texts, y, strict=True):
        (p if s > 0 else q).update(set(naive_grams(t, quality.SIZES, quality.BITS)))
    size = 1 << quality.BITS
    sums = sum(p.values()) + size, sum(q.values()) + size
    for g in [*p, *q, 5]:
        assert abs(found[g] - math.log((p[g] + 1) / sums[0] / ((q[g] + 1) / sums[1]))) < 1e-9


def test_dual_coordinate_descent_reaches_the_least_of_the_primal():
    texts, y = quality_rows()
    y = y.copy()
    y[[3, 8]] *= -1  # not separable by much
    rows_ = [ngrams.present(t, quality.SIZES, quality.BITS) for t in texts]
    r = quality.log_count_ratios(rows_, y)
    values = [r[f] / np.linalg.norm(r[f]) for f in rows_]
    cost = np.full(len(y), 0.7)
    w, b = quality.dual_coordinate_descent(rows_, values, y, cost, epochs=400)

    def primal(w, b):
        return 0.5 * (w @ w + b * b) + sum(c * max(0.0, 1 - s * (w[f] @ v + b)) for f, v, s, c in zip(rows_, values, y, cost, strict=True))

    least = primal(w, b)
    rng = np.random.default_rng(0)
    used = np.unique(np.concatenate(rows_))
    for scale in (1e-3, 1e-2, 1e-1):
        for _ in range(40):
            step = np.zeros_like(w)
            step[used] = rng.normal(size=len(used)) * scale / len(used) ** 0.5
            assert primal(w + step, b + rng.normal() * scale / 10) >= least - 5e-4  # the descent stops when steps fall under 1e-4
    assert least < primal(np.zeros_like(w), 0.0)


LONG = " ".join(f"long{i % 977} and{i % 31}" for i in range(60_000))


def hard(spark, tmp_path, values):
    """All tables, with columns whose names operators use themselves."""
    d = documents(spark, values)
    for c in ("score", "lang_pred", "_guess", "_hits", "t", "doc", "fp", "rid", "predicted", "held_out", "shard", "n_words", "kept", "component_id", "length", "piece", "_t", "_id", "w"):
        d = d.withColumn(c, F.lit(c))
    labels = spark.createDataFrame([(v[0], i % 2, 0) for i, v in enumerate(values) if v[0] is not None] or [], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("score", F.lit("clash"))
    return saved(spark, tmp_path, documents=d, labels=labels, benchmark=bench)


@pytest.mark.parametrize("name", ["op1_langid", "op3_packing", "op4_quality", "op8_rules", "op9_sharding", "op10_simhash"])
def test_hard_rows_are_all_answered_and_alike_where_they_are_equal(spark, tmp_path, name):
    values = [*rows(), (300, LONG, "en", "s", 1), (300, LONG, "en", "s", 1), (301, "x" * 400_000, "en", "s", 1)]
    got = queries.QUERIES[name](spark, hard(spark, tmp_path, values)).collect()
    docs = Counter(r.doc_id for r in got if name != "op3_packing" or r.piece == 0)
    assert docs == Counter(v[0] for v in values)
    own = [tuple(v for k, v in r.asDict().items() if k not in ("slot", "sequence_id", "offset")) for r in got if r.doc_id == 300]
    assert max(Counter(own).values()) == 2 and len(own) == 2 * len(set(own))


@pytest.mark.parametrize("name", ["op1_langid", "op3_packing", "op4_quality", "op8_rules", "op9_sharding", "op10_simhash", "op2_decontam"])
def test_empty_tables_give_no_rows(spark, tmp_path, name):
    assert queries.QUERIES[name](spark, hard(spark, tmp_path, [])).count() == 0


def test_decontamination_reads_very_long_texts_whole(spark):
    item = ITEMS[0][1]
    d = documents(spark, [(1, f"{LONG} {item}", "en", "s", 1), (2, LONG, "en", "s", 1), (3, f"{item} {LONG}", "en", "s", 1)])
    got = decontam.contaminated(d, spark.createDataFrame(ITEMS[:1], "item_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == [1, 3]


def test_pipeline_on_hard_and_on_empty_tables(spark, tmp_path):
    values = [*rows(), (300, LONG, "en", "s", 1), (301, LONG + " end", "en", "s", 1)]
    d = hard(spark, tmp_path / "hard", values)
    docs, columns = spark.read.parquet(f"{d}/documents.parquet"), documents(spark).columns
    extra = [c for c in docs.columns if c not in columns]
    left = Counter((v[0], v[1]) for v in values)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, docs, d), name)
        assert out.columns == docs.columns
        found = out.collect()
        assert all(r[c] == c for r in found for c in extra)
        if name != "repeated_strings":
            now = Counter((r.doc_id, r.text) for r in found)
            assert not now - left
        left = Counter((r.doc_id, r.text) for r in found)
        docs = out
    assert sum(t.startswith("long0") for _, t in left) == 1
    assert packing.pack(docs.select("doc_id", "text")).where("piece = 0").count() == sum(left.values())
    assert corpus_pipeline.run(spark, hard(spark, tmp_path / "empty", [])).count() == 0
