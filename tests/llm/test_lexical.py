import math
import re
from collections import Counter, defaultdict

import pytest

from groundweave.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k):
    """Every document against every item, by the terms themselves."""
    held = [(d, Counter(x.translate(LOWER) for x in TERM.findall(t or ""))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    documents, total = len(held), sum(sum(c.values()) for _, c in held)
    df, wanted = Counter(x for _, c in held for x in c), defaultdict(set)
    for i, t in items:
        if i is not None:
            wanted[i] |= {x.translate(LOWER) for x in TERM.findall(t or "")}
    out = []
    for i, found in wanted.items():
        scored = []
        for d, c in held:
            m = 10 + (90 * sum(c.values()) * documents) // total
            s = sum(math.floor(1000 * math.log((2 * documents + 2) / (2 * df[x] + 1))) * ((1000000000 * c[x]) // (1000 * c[x] + 8 * m)) for x in found if c[x])
            if s > 0:
                scored.append((-s, d is not None, d or 0, d))
        out += [(i, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


ITEMS = [(1, "The word x, w7 w12"), (2, ""), (3, None), (None, "one the"), (4, "one ONE the, text"), (4, "words"), (4, "words"), (5, "ÄÖÜ é 梦"), (6, "..."), (7, "absent-terms only"), (8, "same row")]


def rows(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("k", [1, 3, 10])
def test_odd_rows_against_brute_force(spark, clashing, odd_rows, k):
    from pyspark.sql import functions as F

    items = spark.createDataFrame(ITEMS, "item_id LONG, text STRING").withColumns({c: F.lit(1) for c in ("doc_id", "term", "group", "score")})
    assert rows(lexical.search(clashing, items, k)) == brute(odd_rows, ITEMS, k)


def test_many_documents_ties_and_small_blocks(spark, docs_of, prose, monkeypatch):
    docs = [(i, prose(i % 60, 5 + i % 40, vocabulary=50)) for i in range(200)] + [(500, "w1 " * 4000), (None, "w1 w2 w3"), (501, "aw1 w1b w1"), (501, "w1_w2-W3")]
    items = [(i, prose(i, 12, vocabulary=50)) for i in range(25)] + [(99, "w1 w2")]
    monkeypatch.setattr(lexical, "CELLS", 200)
    assert rows(lexical.search(docs_of(docs), spark.createDataFrame(items, "item_id LONG, text STRING"))) == brute(docs, items, 10)


def test_groups_of_items_give_the_same(spark, docs_of, prose, monkeypatch):
    docs, items = [(i, prose(i, 30, vocabulary=40)) for i in range(50)], [(i, prose(i, 8, vocabulary=40)) for i in range(12)]
    monkeypatch.setattr(lexical, "GROUP_BYTES", 300)
    table = spark.createDataFrame(items, "item_id LONG, text STRING")
    assert lexical.item_groups(table).select("group").distinct().count() > 1
    assert rows(lexical.search(docs_of(docs), table)) == brute(docs, items, 10)


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id LONG, text STRING")
    some = spark.createDataFrame([(1, "one")], "item_id LONG, text STRING")
    assert lexical.search(docs_of([(1, "one")]), none).collect() == []
    assert lexical.search(docs_of([]), some).collect() == []
    assert lexical.search(docs_of([(1, None), (2, " ")]), some).collect() == []


def test_terms_are_whole_and_overlap_at_blanks():
    scan = lexical.TermScan([b"a", b"ab", b"b"])
    n, found, times = scan.count("A a,b ab\nabb")
    assert (n, found.tolist(), times.tolist()) == (5, [0, 1, 2], [2, 1, 1])
