"""Exact removal of word runs that repeat anywhere, by super-k-mer partitioning.

A window is ``size`` consecutive words of one text. The minimiser of a window is the
smallest hash among its ``GRAM``-word grams; consecutive windows with one minimiser form a
super-k-mer, which travels as one packed string to the bucket of its minimiser. Equal
windows have equal minimisers, so each bucket finds its repeated windows by itself: it
sorts the windows' words of every minimiser and looks for equal neighbours.

Grams that stand in many texts would make hot buckets. They are found in a bounded sample
of texts (which only plans the buckets; results don't depend on it) and come last in the
order of minimisers, so a window at the edge of a common passage goes to the bucket of a
rarer gram beside it. A window of common grams only is its own minimiser. A task sends each
such window once: if it holds it twice, it settles its own places and sends the window
without a place, so the most frequent window meets once per task and not once per text.

Windows are judged on the input. Words are [^\\x20\\x09-\\x0D]+, unchanged. Null and empty
texts have no words. Texts shorter than a window keep all words. Rows that agree in doc_id
and text are judged as two places and get the same result.
"""

from __future__ import annotations

import hashlib
from itertools import accumulate

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from groundweave.llm.registry import giving_back, query, table
from groundweave.llm.words import WordHashes, mix, rolling, words
from groundweave.session import MAX_BROADCAST_ROWS, cut

GRAM = 5
SAMPLE = 8_192  # texts read to find common grams
COMMON = 0.005  # share of texts from which on a gram is common
PACK = 1_000_000  # bytes of text packed together
BUCKET = 5_000_000  # bytes of text a bucket is planned for (its super-k-mers hold about three times that)
SMALL = 50_000  # bytes of super-k-mers of one minimiser whose windows are sorted as they are
LOWEST = -(2**63)
PLACES = ["__k1", "__k2"]  # doc_id, and a hash of the text
FEW_SPANS = 2_000_000  # spans that may be broadcast


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"__k1": F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST).cast("long")), "__k2": F.xxhash64("text", F.col("doc_id").isNull())})


def common_grams(docs: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """Sorted hashes of the grams in many texts, and the bytes of all texts, by a bounded sample."""
    rows = docs.count()
    share = min(1.0, SAMPLE / max(1, rows))
    sample = docs.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1_000_000)) < F.lit(int(share * 1_000_000))).select("text")

    def grams(batches):
        hashes = WordHashes()
        for pdf in batches:
            found, length = [], 0
            for text in pdf["text"]:
                own = words(text, lower=False)
                length += len(text.encode()) if text else 0
                if len(own) >= size:
                    found.append(np.unique(rolling(hashes.of(own), GRAM)))
            values, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            several = counts > 0 if len(pdf) < 64 else counts > 1  # a common gram is there twice in so many texts
            yield pd.DataFrame({"gram": np.append(values[several].view(np.int64), 0), "n": np.append(counts[several], 0), "texts": [0] * several.sum() + [len(pdf)], "bytes": [0] * several.sum() + [length]})

    counted = cut(sample.mapInPandas(giving_back(grams), "gram long, n long, texts long, bytes long"), "grams")
    texts, length = counted.agg(F.sum("texts"), F.sum("bytes")).first()
    if not texts:
        return np.zeros(0, np.uint64), 0
    least = max(20, COMMON * texts)
    common = counted.where("n > 0").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("gram").collect()  # at most the sample's grams / least
    return np.sort(np.array([r["gram"] for r in common], dtype=np.int64).view(np.uint64)), int(length * rows / texts)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


class Packer:
    """Collects super-k-mers by bucket."""

    def __init__(self, size: int, buckets: int, common: np.ndarray):
        self.size, self.buckets, self.common, self.hashes = size, buckets, common, WordHashes()
        self.fresh()

    def fresh(self) -> None:
        self.keys, self.texts, self.k1, self.k2, self.starts, self.seen, self.length = [], [], [], [], [], {}, 0

    def add(self, k1: int, k2: int, text: str | None) -> None:
        own = words(text, lower=False)
        if len(own) < self.size:
            return
        grams = rolling(self.hashes.of(own), GRAM)
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, grams), len(self.common) - 1)
            grams = np.where(self.common[at] == grams, np.uint64(2**64 - 1), grams)
        least = _sliding_min(grams, self.size - GRAM + 1)
        ends = np.flatnonzero(np.append(least[1:] != least[:-1], True)).tolist()
        line = b" ".join(own)
        offsets = list(accumulate(map(len, own), lambda a, n: a + n + 1, initial=0))
        self.length += len(line)
        start = 0
        for end, key in zip(ends, least[ends].tolist()):
            if key == 2**64 - 1:  # common grams only
                for w in range(start, end + 1):
                    self.seen.setdefault(line[offsets[w]:offsets[w + self.size] - 1], []).append((k1, k2, w))
            else:
                self.keys.append(key)
                self.texts.append(line[offsets[start]:offsets[end + self.size] - 1])
                self.k1.append(k1)
                self.k2.append(k2)
                self.starts.append(start)
            start = end + 1

    def packs(self) -> pd.DataFrame:
        """One row a bucket; spans settled here go along."""
        settled = []
        for window, places in self.seen.items():
            self.keys.append(int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little"))
            self.texts.append(window)
            once = len(places) == 1
            for column, value in zip((self.k1, self.k2, self.starts), places[0] if once else (0, 0, -1)):
                column.append(value)
            if not once:
                settled += places
        keys = np.array(self.keys, dtype=np.uint64)
        bucket = (mix(keys) % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        k1, k2, starts = np.array(self.k1, dtype=np.int64)[order], np.array(self.k2, dtype=np.int64)[order], np.array(self.starts, dtype=np.int32)[order]
        found, first = np.unique(bucket[order], return_index=True)
        compress, rows = zstandard.ZstdCompressor(level=3).compress, []
        for b, lo, hi in zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]):
            packed = compress(b"\n".join([self.texts[i] for i in order[lo:hi].tolist()]))
            rows.append((b, keys[order[lo:hi]].view(np.int64), k1[lo:hi], k2[lo:hi], starts[lo:hi], packed, None))
        if settled:
            spans = merged(settled, self.size)
            rows.append((int(spans[0][0] % self.buckets), *[np.zeros(0, np.int64)] * 3, np.zeros(0, np.int32), b"", [dict(zip(("k1", "k2", "from", "to"), s)) for s in spans]))
        self.fresh()
        return pd.DataFrame(rows, columns=["bucket", "keys", "k1", "k2", "starts", "packed", "settled"])


SPAN = "k1 long, k2 long, `from` int, `to` int"
PACKS = f"bucket int, keys array<long>, k1 array<long>, k2 array<long>, starts array<int>, packed binary, settled array<struct<{SPAN.replace(' long', ':long').replace(' int', ':int')}>>"


def merged(places: list[tuple[int, int, int]], size: int) -> list[tuple[int, int, int, int]]:
    """Word spans (k1, k2, from, to) that repeated windows (k1, k2, start) cover."""
    out: list[list[int]] = []
    for k1, k2, start in sorted(places):
        if out and out[-1][:2] == [k1, k2] and start <= out[-1][3]:
            out[-1][3] = start + size
        else:
            out.append([k1, k2, start, start + size])
    return [tuple(x) for x in out]


def _repeated(texts: list[bytes], places: list[tuple[int, int, int]], size: int) -> list[tuple[int, int, int, int]]:
    """Word spans (k1, k2, from, to) of the windows of one minimiser that occur more than once.

    A start of -1 stands for several places that are settled already. Where the windows'
    texts would need much memory they are sorted by a hash, and neighbours with one hash
    are compared word for word, so a window costs 8 bytes and not its text.
    """
    if sum(map(len, texts)) < SMALL:
        windows = []
        for text, (k1, k2, start) in zip(texts, places):
            offsets = list(accumulate(map(len, text.split(b" ")), lambda a, n: a + n + 1, initial=0))
            windows += [(text[a:b - 1], k1, k2, start + i if start >= 0 else -1) for i, (a, b) in enumerate(zip(offsets, offsets[size:]))]
        windows.sort()
        last = len(windows) - 1
        return merged([w[1:] for i, w in enumerate(windows) if w[3] >= 0 and (i and windows[i - 1][0] == w[0] or i < last and windows[i + 1][0] == w[0])], size)
    offsets = [list(accumulate(map(len, t.split(b" ")), lambda a, n: a + n + 1, initial=0)) for t in texts]
    counts = np.array([len(o) - size for o in offsets])
    hashes = np.fromiter((hash(t[a:b - 1]) for t, o in zip(texts, offsets) for a, b in zip(o, o[size:])), dtype=np.int64, count=counts.sum())
    owner = np.repeat(np.arange(len(texts)), counts)
    at = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)
    order = np.argsort(hashes, kind="stable")
    repeated, ordered = np.zeros(len(hashes), bool), hashes[order]
    edges = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])).tolist() + [len(order)]

    def window(i: int) -> bytes:
        n, w = owner[i], at[i]
        return texts[n][offsets[n][w]:offsets[n][w + size] - 1]

    for lo, hi in zip(edges, edges[1:]):
        if hi - lo > 1:
            same = order[lo:hi]
            first = window(same[0])
            if all(window(i) == first for i in same[1:]):
                repeated[same] = True
            else:  # different windows with one hash
                exact: dict[bytes, list[int]] = {}
                for i in same.tolist():
                    exact.setdefault(window(i), []).append(i)
                repeated[[i for found in exact.values() if len(found) > 1 for i in found]] = True
    out, base = [], 0
    for n, (k1, k2, start) in zip(counts.tolist(), places):
        own = np.flatnonzero(np.diff(repeated[base:base + n].astype(np.int8), prepend=0, append=0)).tolist()
        if start >= 0:
            out += [(k1, k2, start + a, start + b - 1 + size) for a, b in zip(own[::2], own[1::2])]
        base += n
    return out


def repeated_spans(docs: DataFrame, size: int) -> DataFrame:
    """k1, k2, from, to: the word spans of each text that repeated windows cover; spans of a text can overlap."""
    keyed = _keyed(docs).select(F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), "text")
    common, length = common_grams(docs, size)
    spark = docs.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), length // BUCKET)
    shared = spark.sparkContext.broadcast(common)

    def pack(batches):
        packer = Packer(size, buckets, shared.value)
        for pdf in batches:
            for k1, k2, text in zip(pdf["k1"].tolist(), pdf["k2"].tolist(), pdf["text"]):
                packer.add(k1, k2, text)
                if packer.length >= PACK:
                    yield packer.packs()
        yield packer.packs()

    def search(batches):
        keys, k1, k2, starts, texts = [], [], [], [], []
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if row.settled is not None and len(row.settled):
                    yield pd.DataFrame([tuple(s[c] for c in ("k1", "k2", "from", "to")) for s in row.settled], columns=["k1", "k2", "from", "to"])
                if len(row.keys):
                    keys.append(row.keys), k1.append(row.k1), k2.append(row.k2), starts.append(row.starts)
                    texts += zstandard.ZstdDecompressor().decompress(row.packed).split(b"\n")
        if not texts:
            return
        keys, k1, k2, starts = map(np.concatenate, (keys, k1, k2, starts))
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        edges = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])).tolist() + [len(order)]
        k1, k2, starts, order = k1[order].tolist(), k2[order].tolist(), starts[order].tolist(), order.tolist()
        found = []
        for lo, hi in zip(edges, edges[1:]):
            if hi - lo > 1 or texts[order[lo]].count(b" ") >= size:  # two super-k-mers, or one of several windows
                found += _repeated([texts[i] for i in order[lo:hi]], list(zip(k1[lo:hi], k2[lo:hi], starts[lo:hi])), size)
            if len(found) > 50_000:
                yield pd.DataFrame(found, columns=["k1", "k2", "from", "to"])
                found = []
        yield pd.DataFrame(found, columns=["k1", "k2", "from", "to"])

    return keyed.mapInPandas(giving_back(pack), PACKS).repartitionById(buckets, "bucket").mapInPandas(giving_back(search), SPAN)


def remove_repeats(docs: DataFrame, size: int = 35) -> DataFrame:
    """docs with n_words, n_removed and kept_text (the kept words joined by one blank)."""
    docs = docs.drop("n_words", "n_removed", "kept_text")
    spans = repeated_spans(docs, size).groupBy(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).agg(F.collect_list(F.struct("from", "to")).alias("__spans"))
    spans = cut(spans, "spans")
    # few spans go to the texts; with more of them the texts are exchanged
    total = spans.agg(F.count("*"), F.sum(F.size("__spans"))).first()
    if total[0] <= MAX_BROADCAST_ROWS and (total[1] or 0) <= FEW_SPANS:
        spans = F.broadcast(spans)
    names, fields = docs.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def keep(batches):
        for pdf in batches:
            out = []
            for text, found in zip(pdf["text"], pdf["__spans"]):
                own = words(text, lower=False)
                if found is None or not len(found):
                    out.append((len(own), 0, b" ".join(own).decode()))
                    continue
                mask = np.ones(len(own), dtype=bool)
                for s in found:
                    mask[s["from"]:s["to"]] = False
                left = [w for w, kept in zip(own, mask.tolist()) if kept]
                out.append((len(own), len(own) - len(left), b" ".join(left).decode()))
            for at, name in enumerate(("n_words", "n_removed", "kept_text")):  # one by one: together they'd become strings of the longest text's width
                pdf[name] = [o[at] for o in out]
            yield pdf[[*names, "n_words", "n_removed", "kept_text"]]

    joined = _keyed(docs).join(spans, PLACES, "left").drop(*PLACES)
    return joined.mapInPandas(giving_back(keep), f"{fields}, n_words long, n_removed long, kept_text string")


ORACLE = r"""
WITH split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS words FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM split WHERE len(ws) >= 35)),
repeated AS (SELECT words FROM windows GROUP BY words HAVING count(*) > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS places FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM windows JOIN repeated USING (words)) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(len(places), 0) AS n_removed,
  sha256(array_to_string(CASE WHEN places IS NULL THEN ws ELSE list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda z: NOT list_contains(places, z[2])), lambda z: z[1]) END, ' ')) AS kept_sha256
FROM split LEFT JOIN gone USING (doc_id)
"""


@query("op6_substring_dedup", ORACLE)
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
