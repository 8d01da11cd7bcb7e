"""Language identification with error-correcting output codes.

Every language gets a codeword of bits; for each bit a linear classifier over hashed byte n-grams says how surely a text
has that bit. Loss-weighted decoding adds, over the bits, the logistic loss of each classifier's margin against each
codeword, weighs bits by their training accuracy, and picks the nearest codeword. When the runner-up is almost
as near, the text is marked ambiguous.

The model is fitted on a bounded sample: at most `SAMPLE_PER_LANG` texts of a language, those with the smallest
hashes of their text, so the same rows give the same model wherever they lie. Prediction reads whole texts.

Defined cases: a null text or one without any letter is `und` with score 0 and not ambiguous; rows with a null lang are never
learned from but are predicted; empty tables give no rows; a table without learnable rows gives `und` throughout;
repeated rows are predicted alike; other columns pass through untouched, unless they clash with the new names, in which
case the new ones replace them. `accepted`, the pipeline's stage, adds no columns and so leaves all as they are.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomwork.llm import ngrams
from loomwork.llm.common import documents, text_batches, unused

SAMPLE_PER_LANG = 400
SIZES, BITS = (1, 2, 3), 12
AMBIGUOUS = 0.05
LANG, SCORE, UNSURE = "lang_pred", "score", "lang_ambiguous"


@dataclass(frozen=True)
class Model:
    langs: list[str]
    codes: np.ndarray  # langs x bits, -1 or 1
    weights: np.ndarray  # features x bits
    bias: np.ndarray  # bits
    trust: np.ndarray  # bits, sums to 1
    scale: np.ndarray  # features

    def decode(self, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its share among all (0 to 1), and whether the runner-up is as near."""
        margin = features(counted, self.scale) @ self.weights + self.bias
        loss = np.logaddexp(0, -margin[:, None, :] * self.codes[None]) @ self.trust  # texts x langs
        share = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
        share /= share.sum(1, keepdims=True)
        best = loss.argmin(1)
        two = np.partition(loss, 1, axis=1)[:, :2] if len(self.langs) > 1 else np.stack([loss[:, 0], loss[:, 0] + 9], 1)
        return best, share[np.arange(len(best)), best], two[:, 1] - two[:, 0] < AMBIGUOUS


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords: all 2**(n-1) - 1 splits for up to 6 languages, else random rows kept far apart."""
    if n == 1:
        return np.ones((1, 1))
    if n <= 6:
        splits = [(1, *s) for s in itertools.product((1, -1), repeat=n - 1)][1:]
        return np.array(splits, float).T
    rng = np.random.default_rng(seed)
    tries = (rng.choice([-1.0, 1.0], (n, 15 + 10 * int(np.ceil(np.log2(n))))) for _ in range(200))
    return max(tries, key=lambda c: -np.abs(c @ c.T - np.diag([c.shape[1]] * n)).max())


def features(counted: np.ndarray, scale: np.ndarray) -> np.ndarray:
    x = np.sqrt(counted) * scale
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def fit(texts: list[bytes], langs: list[str], steps: int = 150) -> Model | None:
    """Logistic classifiers of all bits by gradient descent with momentum; every language weighs the same."""
    names = sorted(set(langs))
    if not names:
        return None
    y = np.array([names.index(x) for x in langs])
    counted = ngrams.counts(texts, SIZES, BITS, lower=True)
    scale = np.log1p(len(texts) / (1 + (counted > 0).sum(0))).astype(np.float32)
    x = features(counted, scale).astype(np.float32)
    codes = codewords(len(names)).astype(np.float32)
    target = codes[y]
    share = (1 / np.bincount(y, minlength=len(names))[y] / len(names))[:, None].astype(np.float32)
    w, b = np.zeros((x.shape[1], codes.shape[1]), np.float32), np.zeros(codes.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        g = -target * share / (1 + np.exp(np.clip(target * (x @ w + b), -30, 30)))
        vw, vb = 0.9 * vw - 4 * (x.T @ g + 1e-5 * w), 0.9 * vb - 4 * g.sum(0)
        w, b = w + vw, b + vb
    right = (share * (np.sign(x @ w + b) == target)).sum(0)
    trust = np.maximum(right - 0.5, 1e-3)
    return Model(names, codes, w.astype(np.float32), b.astype(np.float32), trust / trust.sum(), scale)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _lettered(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield pd.Series([t is not None and has_letter(t) for t in part], dtype=bool)


def train(labelled: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> Model | None:
    """From rows (text, lang) with both set: the per_lang texts of each language with the smallest hashes."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", F.xxhash64("text").alias("h"), "text")
    # First the limits that select the sample, from hashes alone; the texts come only for rows under them.
    # A row's rank within its language and hash bucket bounds every sort.
    buckets = Window.partitionBy("lang", F.pmod("h", F.lit(64))).orderBy("h")
    picked = rows.select("lang", "h").distinct().withColumn("r", F.row_number().over(buckets)).where(F.col("r") <= per_lang)
    limits = picked.groupBy("lang").agg(
        F.expr(f"array_max(slice(array_sort(collect_list(h)), 1, {per_lang}))").alias("most")
    )
    sample = rows.join(F.broadcast(limits), "lang").where("h <= most").select("lang", "h", "text").dropDuplicates(["lang", "h"])
    found = sorted(tuple(r) for r in sample.collect())
    return fit([r[2].encode() for r in found], [r[0] for r in found])


def guesses(model: Model | None, texts: pd.Series) -> pd.DataFrame:
    """Language, score and ambiguity of each text."""
    out = pd.DataFrame({LANG: "und", SCORE: 0.0, UNSURE: False}, index=range(len(texts)))
    real = [i for i, t in enumerate(texts) if t is not None and has_letter(t)]
    for at in range(0, len(real) if model else 0, 256):
        rows = real[at : at + 256]
        counted = ngrams.counts([texts.iloc[i].encode("utf-8", "replace") for i in rows], SIZES, BITS, lower=True)
        best, score, unsure = model.decode(counted)
        out.loc[rows, LANG] = [model.langs[k] for k in best]
        out.loc[rows, SCORE] = score.astype(float)
        out.loc[rows, UNSURE] = unsure
    return out


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred, score and lang_ambiguous; reads nothing but the text."""
    text_batches(docs.sparkSession)
    share = docs.sparkSession.sparkContext.broadcast(model)

    def guess(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield guesses(share.value, part)

    kind = T.StructType([T.StructField(LANG, T.StringType()), T.StructField(SCORE, T.DoubleType()), T.StructField(UNSURE, T.BooleanType())])
    guessed = F.pandas_udf(guess, kind)
    kept = [c for c in docs.columns if c not in (LANG, SCORE, UNSURE)]
    own = unused("guess", docs.columns)
    return docs.select(*kept, guessed("text").alias(own)).select(*kept, f"{own}.*")


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang").withColumn("held_out", held_out())
    model = train(docs.where(~F.col("held_out")).select("text", "lang"))
    return identify(docs.select("doc_id", "text", "held_out"), model).drop("text")


def accepted(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: documents without a language go, and ambiguous ones of which no language holds half the weight.

    Where no row has a lang to learn from, nothing is known of languages: only documents without a letter go.
    """
    model = train(docs.select("text", "lang"))
    text_batches(docs.sparkSession)
    if model is None:
        return docs.where(F.pandas_udf(_lettered, "boolean")("text"))
    share = docs.sparkSession.sparkContext.broadcast(model)

    def stays(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            own = guesses(share.value, part)
            yield (own[LANG] != "und") & ~(own[UNSURE] & (own[SCORE] < 0.5))

    return docs.where(F.pandas_udf(stays, "boolean")("text"))
