"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. Every
window of a text is compressed with both; its gain is the length under the ordinary less
that under the toxic dictionary. Windows whose gain reaches a calibrated threshold are
hits, and the share and strength of hits give the score through a logistic curve fitted on
labelled texts that the dictionaries have not seen, both labels weighing the same; its 0.5 is
put where misses and false alarms among them cost least, the latter being at most ALARMS.

The ordinary dictionary learns from whole ordinary texts. The toxic one learns from the words
of toxic texts that are much more common there (SHARPNESS) and occur in enough places
(SUPPORT), and is put before the ordinary one's content, so that ordinary prose is as long under both
and only what marks toxic texts tells them apart. Trained content is used without zstandard's
header and entropy tables. A window is compressed together with CARRIER bytes that both
dictionaries hold: without them the library stores short windows as they are, and it seeks
no match in a block's last bytes.

Labels are learnt from at most ``per_label`` rows and ``label_bytes`` bytes of a label,
taken by hash of doc_id. Every text is scored whole. Null, empty and wordless texts get
the score of a text without hits; where one label is missing from the training rows every
score is the share of label 1 (0 without labels). A doc_id with several labels counts as
toxic if one says so; null labels and null doc_ids teach nothing.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from groundweave.llm.registry import giving_back, query, table

PER_LABEL, LABEL_BYTES = 4_000, 24_000_000
DICTIONARY = {1: 4096, 0: 28_000}  # bytes, toxic and ordinary
CARRIER = 32  # bytes
SUPPORT, SHARPNESS = 0.004, 20.0  # share of a label's texts; ratio of shares
ALARMS, ALARM_COST = 0.01, 5.0  # most false alarms; what a share of them costs against the same share of misses
WINDOW, STEP = 3, 2  # words
WORD = re.compile(r"[^\W\d_]+")
SETTINGS = dict(
    window_log=16, hash_log=16, chain_log=16, search_log=4, min_match=5, strategy=zstandard.STRATEGY_GREEDY,
    write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
)


def tokens(text: str | None) -> list[str]:
    """Lower-cased runs of letters; a word repeated right after itself counts once."""
    found = WORD.findall(text.lower()) if text else []
    return [w for w, before in zip(found, [None, *found]) if w != before]


def windows(found: list[str]) -> list[bytes]:
    """Overlapping runs of words; together they hold every word."""
    return [f" {' '.join(found[i:i + WINDOW])} ".encode() for i in range(0, max(len(found) - WINDOW + STEP, 1), STEP)] if found else []


def marking_text(toxic: list[list[str]], ordinary: list[list[str]]) -> list[bytes]:
    """The toxic texts without the words that don't mark them, equal ones once."""
    # distinct places: copies of a text repeat a word beside the same neighbour and count once
    ids = {"": 0}

    def places(side: list[list[str]]) -> np.ndarray:
        pairs = np.zeros(0, np.int64)
        for at in range(0, len(side), 500):
            found = [np.array([0, *(ids.setdefault(w, len(ids)) for w in t)], dtype=np.int64) for t in side[at:at + 500]]
            pairs = np.unique(np.concatenate([pairs, *(a[:-1] << 32 | a[1:] for a in found)]))
        return np.bincount(pairs & (1 << 32) - 1, minlength=len(ids))

    seen = [places(side).tolist() for side in (toxic, ordinary)]
    least = max(4, round(SUPPORT * len(toxic)))
    marks = {w for w, i in ids.items() if i < len(seen[0]) and seen[0][i] >= least and seen[0][i] * len(ordinary) >= SHARPNESS * seen[1][i] * len(toxic)}
    kept = (" ".join(w for w in t if w in marks) for t in toxic)
    return sorted({f" {t} ".encode() for t in kept if t})


def dictionary(samples: list[bytes], size: int) -> bytes:
    """Trained content without its header."""
    joined = b"".join(samples)
    try:
        trained = zstandard.train_dictionary(size, samples, k=24, d=6, level=3).as_bytes()
    except zstandard.ZstdError:  # too little text to choose from: take what there is
        return joined[-size:]
    start = next((at for at in range(8, min(len(trained), 1024)) if trained[at:at + 12] in joined), 0)  # content is cut from the samples
    return trained[start:]


class Model:
    """The two dictionaries, the hit threshold and the logistic curve."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.content = {1: toxic + ordinary, 0: ordinary}
        self.carrier = ordinary[-CARRIER:]
        self.threshold, self.mean, self.scale, self.weights = 3, np.zeros(4), np.ones(4), np.array([-3.0, 0, 0, 0, 0])
        self._compressors = None

    def __getstate__(self):
        return self.__dict__ | {"_compressors": None}

    def _compressor(self, content: bytes):
        settings = zstandard.ZstdCompressionParameters(**SETTINGS)
        shared = None
        if content:
            shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(compression_params=settings)  # indexes every place of it
        return zstandard.ZstdCompressor(dict_data=shared, compression_params=settings)

    def _lengths(self, label: int, found: list[bytes]) -> np.ndarray:
        if self._compressors is None:
            self._compressors = {k: self._compressor(v) for k, v in self.content.items()}
        return np.fromiter(map(len, self._compressors[label].multi_compress_to_buffer(found)), dtype=np.int64, count=len(found))

    def gains(self, found: list[str]) -> np.ndarray:
        cut = [w + self.carrier for w in windows(found)]
        parts = [cut[i:i + 16384] for i in range(0, len(cut), 16384)]
        return np.concatenate([self._lengths(0, p) - self._lengths(1, p) for p in parts]) if parts else np.zeros(0, np.int64)

    def features(self, gains: np.ndarray, threshold: int) -> list[float]:
        hits = gains[gains >= threshold]
        share = len(hits) / max(len(gains), 1)
        best = np.sort(hits)[-3:]
        return [np.log1p(len(hits)), min(1.0, 20 * share), min(1.0, 5 * hits.sum() / max(len(gains), 1)), min(30.0, float(best.sum()))]

    def score(self, found: list[str]) -> float:
        x = (np.array(self.features(self.gains(found), self.threshold)) - self.mean) / self.scale
        return float(1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30))))

    def calibrate(self, texts: list[list[str]], labels: np.ndarray) -> None:
        """Take the threshold and the curve that make the labels likeliest, both labels weighing the same."""
        gains, best = [self.gains(t) for t in texts], np.inf
        weight = np.where(labels == 1, 0.5 / max(labels.sum(), 1), 0.5 / max((1 - labels).sum(), 1)) * len(labels)
        for threshold in range(1, 8):
            raw = np.array([self.features(g, threshold) for g in gains])
            mean, scale = raw.mean(axis=0), raw.std(axis=0) + 1e-6
            x = np.column_stack([np.ones(len(raw)), (raw - mean) / scale])
            w, ridge = np.zeros(5), np.diag([0.0, 1, 1, 1, 1])
            for _ in range(25):  # Newton steps
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                w = w - np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(5), x.T @ (weight * (p - labels)) + ridge @ w)
            z = np.clip(x @ w, -30, 30)
            p = np.clip(1 / (1 + np.exp(-z)), 1e-9, 1 - 1e-9)
            loss = -np.mean(weight * (labels * np.log(p) + (1 - labels) * np.log(1 - p)))
            if loss < best:
                cut = cut_between(z[labels == 0], z[labels == 1])
                best, self.threshold, self.mean, self.scale, self.weights = loss, threshold, mean, scale, w - np.append(cut, np.zeros(4))


def cut_between(ordinary: np.ndarray, toxic: np.ndarray) -> float:
    """Where 0.5 belongs: the middle of the gap that costs least, calling at most ALARMS of the ordinary texts toxic."""
    values = np.unique(np.concatenate([ordinary, toxic]))
    cuts = np.append((values[1:] + values[:-1]) / 2, values[-1] + 1e-6)
    width = np.append(np.diff(values), 0.0)
    alarms = 1 - np.searchsorted(np.sort(ordinary), cuts) / len(ordinary)
    cost = np.searchsorted(np.sort(toxic), cuts) / len(toxic) + ALARM_COST * alarms
    allowed = np.flatnonzero(alarms <= ALARMS)
    return float(cuts[min(allowed, key=lambda i: (cost[i], -width[i]))])


def fit(rows: list[tuple[int, str, int]]) -> Model | float:
    """rows: (doc_id, text, toxic). The dictionaries learn from one half, the curve from the other."""
    known: dict[str, str] = {}  # equal words are one string
    texts = {k: [(doc, [known.setdefault(w, w) for w in tokens(t)]) for doc, t, y in sorted(rows) if y == k] for k in (0, 1)}
    if not texts[0] or not texts[1]:
        return float(bool(texts[1]))
    small = len(texts[1]) < 60  # too few to part
    first = {k: [t for i, (_, t) in enumerate(v) if small or i % 2] for k, v in texts.items()}
    second = {k: [t for i, (_, t) in enumerate(v) if small or not i % 2] for k, v in texts.items()}
    plain = sorted({f" {' '.join(t)} ".encode() for t in first[0]})
    model = Model(dictionary(marking_text(first[1], first[0]), DICTIONARY[1]), dictionary(plain, DICTIONARY[0]))
    model.calibrate(second[0] + second[1], np.array([0.0] * len(second[0]) + [1.0] * len(second[1])))
    return model


def training_rows(docs: DataFrame, known: DataFrame, per_label: int, label_bytes: int) -> list[tuple[int, str, int]]:
    """A bounded sample of (doc_id, text, toxic), by hash of doc_id.

    The ids are drawn from the labels alone and broadcast (about 2 * per_label rows), so no
    text is shuffled.
    """
    share = F.lit(0.0)
    for r in known.groupBy("toxic").count().collect():
        share = F.when(F.col("toxic") == r["toxic"], min(1.0, per_label / r["count"])).otherwise(share)
    chance = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) / 1_000_000
    drawn = F.broadcast(known.where(chance < share))
    found = docs.where("text IS NOT NULL").join(drawn, "doc_id")
    left, ids = {0: label_bytes, 1: label_bytes}, []
    for doc, toxic, size in found.select("doc_id", "toxic", F.octet_length("text"), chance.alias("c")).orderBy("c", "doc_id").drop("c").collect():
        left[toxic] -= size
        if left[toxic] >= 0:
            ids.append((doc, toxic))
    wanted = docs.sparkSession.createDataFrame(ids, "doc_id long, toxic int")
    return [tuple(r) for r in docs.where("text IS NOT NULL").join(F.broadcast(wanted), "doc_id").select("doc_id", "text", "toxic").collect()]


def score_toxicity(docs: DataFrame, labels: DataFrame, learn, per_label: int = PER_LABEL, label_bytes: int = LABEL_BYTES) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from 0.5 on).

    learn: a condition on doc_id; only labels of such documents are learnt from.
    """
    known = labels.where("toxic IN (0, 1)").where(learn).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    model = fit(training_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), known, per_label, label_bytes))
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of a few KB
    names = docs.columns

    def score(batches):
        model = shared.value
        for pdf in batches:
            pdf["score"] = [model if isinstance(model, float) else model.score(tokens(t)) for t in pdf["text"]]
            pdf["predicted"] = (pdf["score"] >= 0.5).astype("int32")
            yield pdf[[*names, "score", "predicted"]]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInPandas(giving_back(score), f"{fields}, score double, predicted int")


def held_out(modulus: int, remainder: int):
    """Whether crc32 of the doc_id's digits leaves the remainder; false for null."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"), learn)
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")
