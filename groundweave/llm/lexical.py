"""Ranked lexical search by an Aho-Corasick scan of the documents.

Terms are runs of ASCII letters, digits and non-ASCII characters, with A-Z lower-cased. In a text
every other character becomes a blank, and the distinct terms of all items, each between two
blanks, form one automaton, so that a hit is always a whole term. The scan counts a term's
occurrences straight from the text; no index of the documents is made. An automaton's output is
the term's number, and a table of the terms' items maps hits to items.

The texts are scanned twice. The first scan gives the documents with a term, all their terms, and for
each item term the documents that hold it, added up in each task first. The second scan scores:
a task keeps each item's ``k`` best documents so far and passes only documents that reach
its kth score, so it emits k rows an item; these are ranked in the end.

Items are handled in groups of at most GROUP_BYTES of distinct terms, so that what is broadcast is
bounded; each group reads one part of a written table.

An item is all rows of one item_id, its terms once each; rows without item_id or terms have
no result. Null and empty documents hold no term and are not counted. Rows that share a doc_id are
documents each; a null doc_id comes before others of the same score. Equal scores rank by
doc_id. Empty tables give no rows.
"""

from __future__ import annotations

import math

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from groundweave.llm.registry import query, table
from groundweave.session import cut

K1_THOUSANDS, B_PERCENT = 1000, 90  # tf * 10^9 / (1000 tf + 8 m), m = 100 - 90 + 90 n N / L
GROUP_BYTES = 16_000_000  # distinct terms of the items in one automaton
CELLS = 1 << 21  # scores held at once in a task
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
MISSING = np.iinfo(np.int64).min  # a null doc_id, before all others


def folded(text: str | None) -> bytes:
    """Terms between single bytes that are no part of one, lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD) if text else b""


def terms(text: str | None) -> list[bytes]:
    return folded(text).split()


class TermScan:
    """The automaton of a group's terms, each between blanks."""

    def __init__(self, known: list[bytes]):
        self.size, self.automaton = len(known), ahocorasick.Automaton()
        for i, term in enumerate(known):
            self.automaton.add_word(f" {term.decode('latin-1')} ", i)  # bytes as characters: one state a byte
        if known:
            self.automaton.make_automaton()

    def count(self, text: str | None) -> tuple[int, np.ndarray, np.ndarray]:
        """(terms of the text, numbers of the group's terms in it, their occurrences)."""
        raw = folded(text)
        n = len(raw.split())
        if not n or not self.size:
            return n, np.zeros(0, np.int64), np.zeros(0, np.int64)
        hits = np.fromiter((i for _, i in self.automaton.iter(f" {raw.decode('latin-1')} ")), np.int64)
        found, times = np.unique(hits, return_counts=True)
        return n, found, times


class Best:
    """Each item's k best documents among those given so far: highest score, then smallest doc_id."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)
        self.item, self.doc, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        item, doc, score = np.concatenate([self.item, item]), np.concatenate([self.doc, doc]), np.concatenate([self.score, score])
        order = np.lexsort((doc, -score, item))
        item, doc, score = item[order], doc[order], score[order]
        first = np.searchsorted(item, item)
        kept = np.arange(len(item)) - first < self.k
        self.item, self.doc, self.score = item[kept], doc[kept], score[kept]
        last = np.flatnonzero(np.arange(len(item)) - first == self.k - 1)
        self.least[item[last]] = score[last]


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term) of every item, once each; a term is its UTF-8 bytes."""

    def split(batches):
        for pdf in batches:
            found = [sorted(set(terms(t))) for t in pdf["text"]]
            yield pd.DataFrame({"item_id": np.repeat(pdf["item_id"].to_numpy(), [len(f) for f in found]), "term": [t for f in found for t in f]})

    slim = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    return slim.mapInPandas(split, "item_id long, term binary").distinct()


def item_groups(items: DataFrame) -> DataFrame:
    """(item_id, term, group): whole items, in groups of about GROUP_BYTES by a hash of the item."""
    pairs = cut(item_terms(items), "item-terms")
    size = pairs.agg(F.sum(F.octet_length("term") + 2)).first()[0] or 0
    groups = max(1, -(-size // (GROUP_BYTES // 2)))  # half full on average
    return cut(pairs.withColumn("group", F.pmod(F.xxhash64("item_id"), F.lit(groups)).cast("int")).repartition("group"), "item-groups")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id and score of each item's k best documents."""
    grouped = item_groups(items)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranked = [_search_group(slim, grouped.where(F.col("group") == r["group"]), k) for r in grouped.select("group").distinct().orderBy("group").collect()]
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for part in ranked:
        out = out.union(part)
    return out


def _search_group(docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    spark = docs.sparkSession
    rows = pairs.select("item_id", "term").collect()  # about GROUP_BYTES
    items, known = sorted({r["item_id"] for r in rows}), sorted({bytes(r["term"]) for r in rows})
    number, place = {t: i for i, t in enumerate(known)}, {x: i for i, x in enumerate(items)}
    links = sorted((number[bytes(r["term"])], place[r["item_id"]]) for r in rows)
    of_term = np.searchsorted([t for t, _ in links], np.arange(len(known) + 1))  # a term's items are a slice of ``holders``
    holders = np.array([i for _, i in links], dtype=np.int64)
    shared = spark.sparkContext.broadcast((known, of_term, holders))
    folded_docs = docs.where("text IS NOT NULL")

    def tally(batches):
        scan = TermScan(shared.value[0])
        df, documents, total = np.zeros(scan.size, np.int64), 0, 0
        for pdf in batches:
            for text in pdf["text"]:
                n, found, _ = scan.count(text)
                documents, total = documents + (n > 0), total + n
                df[found] += 1
        held = np.flatnonzero(df)
        yield pd.DataFrame({"term": np.append(held, [-1, -2]), "n": np.append(df[held], [documents, total])})

    counted = folded_docs.select("text").mapInPandas(tally, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    totals = {r["term"]: r["n"] for r in cut(counted, "term-counts").collect()}  # a row for each term of the group
    documents, length = totals.get(-1, 0), totals.get(-2, 0)
    weight = weights(np.array([totals.get(i, 0) for i in range(len(known))], dtype=np.int64), documents)

    def score(batches):
        known, of_term, holders = shared.value
        scan, best, block = TermScan(known), Best(len(items), k), max(1, CELLS // max(1, len(items)))
        for pdf in batches:
            for at in range(0, len(pdf), block):
                texts = pdf["text"].iloc[at:at + block].tolist()
                ids = np.array([MISSING if x is None or x != x else int(x) for x in pdf["doc_id"].iloc[at:at + block].astype(object)], dtype=np.int64)
                counted = [scan.count(t) for t in texts]
                sizes = [len(c[1]) for c in counted]
                term, times = np.concatenate([c[1] for c in counted]), np.concatenate([c[2] for c in counted])
                m = np.array([100 - B_PERCENT + (B_PERCENT * c[0] * documents) // max(length, 1) for c in counted], dtype=np.int64)
                gain = weight[term] * ((K1_THOUSANDS * 1_000_000 * times) // (K1_THOUSANDS * times + 8 * np.repeat(m, sizes)))
                spread = of_term[term + 1] - of_term[term]
                inside = np.arange(spread.sum()) - np.repeat(np.cumsum(spread) - spread, spread)
                item = holders[np.repeat(of_term[term], spread) + inside]
                row = np.repeat(np.repeat(np.arange(len(texts)), sizes), spread)
                scores = np.zeros(len(texts) * len(items), np.int64)
                np.add.at(scores, row * len(items) + item, np.repeat(gain, spread))
                scores = scores.reshape(len(texts), len(items))
                row, item = np.nonzero(scores >= best.least)
                best.add(item, ids[row], scores[row, item])
        yield pd.DataFrame({"item": best.item, "doc_id": pd.arrays.IntegerArray(best.doc, best.doc == MISSING), "score": best.score})

    names = np.array(items, dtype=np.int64)

    def named(batches):
        for pdf in score(batches):
            pdf["item_id"] = names[pdf["item"].to_numpy(dtype=np.int64)] if len(names) else pdf["item"]
            yield pdf[["item_id", "doc_id", "score"]]

    best = cut(folded_docs.mapInPandas(named, "item_id long, doc_id long, score long"), "best")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS row_id, doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
lowered AS (SELECT row_id, doc_id, translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM t),
sizes AS (SELECT row_id, doc_id, count(*) AS n FROM lowered GROUP BY ALL),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM sizes),
wanted AS (SELECT DISTINCT item_id, translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT item_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL)),
tf AS (SELECT row_id, doc_id, term, count(*) AS tf FROM lowered SEMI JOIN wanted USING (term) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM tf, whole GROUP BY term, docs),
gain AS (SELECT tf.row_id, tf.doc_id, tf.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))) AS g FROM tf JOIN weight USING (term) JOIN sizes USING (row_id), whole),
scored AS (SELECT item_id, row_id, gain.doc_id, CAST(sum(g) AS BIGINT) AS score FROM gain JOIN wanted USING (term) GROUP BY ALL),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query("op12_lexical_search", ORACLE)
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
