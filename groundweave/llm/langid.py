"""Language identification: sparse multinomial logistic regression on character n-grams.

A text is reduced to lower-case runs of letters between single blanks; its 1- to 3-grams
are hashed into BUCKETS features, weighted by tf-idf (1 + log tf, smoothed idf) and
normalised. Document frequencies are counted over all texts of the learning side. The
model is trained by follow-the-regularised-leader (per-coordinate steps, elastic-net
penalty), and a temperature fitted on labelled texts that training has not seen
calibrates its probabilities.

Weights are learnt from at most ``per_label`` rows and ``label_bytes`` bytes a language,
drawn by hash of doc_id; every text is predicted whole. A text that is null or has no
letter is ``und`` with score 1.0 where nothing else is known; without labels every text is
``und`` with score 0.0. Null languages and null doc_ids teach nothing.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from groundweave.llm.registry import query, table
from groundweave.llm.toxicity import held_out

BITS = 16
ORDERS = (1, 2, 3)
PER_LABEL, LABEL_BYTES = 1_500, 6_000_000
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.5, 1.0, 0.02, 0.05
LETTERS = re.compile(r"[^\W\d_]+")


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a text and how often each occurs; empty without letters."""
    found = LETTERS.findall(text.lower()) if text else []
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.frombuffer(f" {' '.join(found)} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    parts, shift = [], np.uint64(64 - BITS)
    for n in ORDERS:
        h = np.full(len(codes) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h << np.uint64(21)) ^ codes[k:len(codes) - n + 1 + k]
        parts.append((h * np.uint64(0x9E3779B97F4A7C15)) >> shift)
    counts = np.bincount(np.concatenate(parts).astype(np.int64), minlength=1 << BITS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def vector(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[at]
    return x / max(1e-12, np.sqrt((x * x).sum()))


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Texts with letters, and in how many of them each feature occurs; over all rows."""

    def count(batches):
        seen, texts = np.zeros(1 << BITS, np.int64), 0
        for pdf in batches:
            for text in pdf["text"]:
                at, _ = grams(text)
                seen[at] += 1
                texts += len(at) > 0
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"feature": np.append(at, -1), "n": np.append(seen[at], texts)})

    out, texts = np.zeros(1 << BITS), 0
    for r in docs.select("text").mapInPandas(count, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():  # at most 2**BITS + 1 rows
        if r["feature"] < 0:
            texts = r["n"]
        else:
            out[r["feature"]] = r["n"]
    return texts, out


class Model:
    """Weights by feature and language, idf and temperature."""

    def __init__(self, labels: list[str], idf: np.ndarray):
        self.labels, self.idf, self.temperature = labels, idf.astype(np.float32), 1.0
        self.weights = np.zeros((len(idf), len(labels)), np.float32)

    def train(self, rows: list[tuple[np.ndarray, np.ndarray]], targets: np.ndarray, seed: int = 5) -> None:
        """FTRL-proximal: z gathers gradients, n their squares; a weight is 0 until |z| exceeds L1."""
        k = len(self.labels)
        z, n, order = np.zeros(self.weights.shape), np.zeros(self.weights.shape), np.random.default_rng(seed)
        vectors = [(at, vector(at, c, self.idf)) for at, c in rows]
        for _ in range(EPOCHS):
            for r in order.permutation(len(rows)):
                at, x = vectors[r]
                w = self._closed(z[at], n[at])
                s = x @ w
                p = np.exp(s - s.max())
                p /= p.sum()
                p[targets[r]] -= 1
                g = x[:, None] * p[None, :k]
                step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
                z[at] += g - step * w
                n[at] += g * g
        self.weights = self._closed(z, n).astype(np.float32)

    @staticmethod
    def _closed(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def scores(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return vector(at, counts, self.idf) @ self.weights[at].astype(np.float64)

    def calibrate(self, scores: np.ndarray, targets: np.ndarray) -> None:
        """The temperature with the smallest log loss, by golden section over its logarithm."""
        def loss(t):
            s = scores / np.exp(t)
            s = s - s.max(axis=1, keepdims=True)
            return np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), targets])
        lo, hi, ratio = -4.0, 4.0, (5 ** 0.5 - 1) / 2
        for _ in range(40):
            a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
            lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
        self.temperature = float(np.exp((lo + hi) / 2))

    def predict(self, text: str | None) -> tuple[str, float]:
        at, counts = grams(text)
        if not len(at):
            return "und", 1.0
        s = self.scores(at, counts) / self.temperature
        p = np.exp(s - s.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.labels[best], float(p[best])


def training_rows(docs: DataFrame, per_label: int, label_bytes: int) -> list[tuple[str, str, bool]]:
    """A bounded sample (text, lang, for calibration) of each language, by hash of doc_id."""
    share = F.lit(0.0)
    for r in docs.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect():  # a row for each language
        share = F.when(F.col("lang") == r["lang"], min(1.0, per_label / r["n"], label_bytes / max(1, r["bytes"]))).otherwise(share)
    chance = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) / 1_000_000
    rows = docs.where(chance < share).select("doc_id", "text", "lang", (F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(4)) == 0).alias("later")).collect()
    return [tuple(r)[1:] for r in sorted(rows)]


def fit(docs: DataFrame, per_label: int = PER_LABEL, label_bytes: int = LABEL_BYTES) -> Model | None:
    """docs: doc_id, text, lang of the learning side."""
    sample = [(grams(t), lang, later) for t, lang, later in training_rows(docs.where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL"), per_label, label_bytes)]
    sample = [s for s in sample if len(s[0][0])]
    labels = sorted({lang for _, lang, _ in sample})
    if not labels:
        return None
    texts, frequency = document_frequencies(docs)
    model = Model(labels, np.log((1 + texts) / (1 + frequency)) + 1)
    target = {lang: i for i, lang in enumerate(labels)}
    first = [s for s in sample if not s[2]] or sample
    second = [s for s in sample if s[2]] or sample
    model.train([s[0] for s in first], np.array([target[s[1]] for s in first]))
    model.calibrate(np.array([model.scores(*s[0]) for s in second]), np.array([target[s[1]] for s in second]))
    return model


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred and score (the calibrated probability of lang_pred)."""
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights a language
    names, fields = docs.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def predict(batches):
        model = shared.value
        for pdf in batches:
            found = [model.predict(t) if model else ("und", 0.0) for t in pdf["text"]]
            pdf["lang_pred"], pdf["score"] = [f[0] for f in found], [f[1] for f in found]
            yield pdf[[*names, "lang_pred", "score"]]

    return docs.mapInPandas(predict, f"{fields}, lang_pred string, score double")


@query("op2_language")
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")
