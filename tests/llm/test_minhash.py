from collections import Counter, defaultdict

import numpy as np
import pytest

from groundweave.llm import minhash
from groundweave.llm.components import components
from groundweave.llm.minhash import Signer, near_duplicates
from groundweave.llm.words import WordHashes, shingles, words


def brute(rows, size, percent):
    """{row index: (set size, component)} by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(rows[i][0])
    return {i: (len(sets[i]), min(groups[root(i)])) for i in range(len(rows))}


def edited(text, share, seed):
    import random

    rng = random.Random(seed)
    return " ".join(f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split(" "))


@pytest.mark.parametrize("size", [4, 5])
def test_matches_all_pairs(spark, docs_of, prose, size):
    rows = [(i, prose(i, 60)) for i in range(30)]
    rows += [(100 + i, rows[i % 3][1]) for i in range(20)]  # exact copies
    base = prose(1000, 150)
    rows += [(200 + i, edited(base, 0.02, i)) for i in range(60)]  # pairs on both sides of the threshold
    rows += [(300 + i, prose(2000, 80) + " " + prose(3000 + i, 60)) for i in range(40)]  # a common passage
    rows += [(400, ""), (401, None), (402, "a b"), (403, "A B"), (404, "a  b c"), (405, "a")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs_of(rows), size=size).collect()}
    want = brute(rows, size, 80)
    assert got == {rows[i][0]: (n, c, c == rows[i][0]) for i, (n, c) in want.items()}


def test_open_buckets_in_blocks(spark, docs_of, prose, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 700)
    monkeypatch.setattr(minhash, "LARGE", 3)
    base = prose(5, 120)
    rows = [(i, edited(base, 0.035, i)) for i in range(80)]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs_of(rows), size=4).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 4, 80).items()}


def test_odd_rows(clashing):
    got = near_duplicates(clashing, size=5).collect()
    assert len(got) == 14
    by_id = defaultdict(list)
    for r in got:
        by_id[r["doc_id"]].append(r)
    assert [r["n_shingles"] for i in (1, 2, 3) for r in by_id[i]] == [0, 0, 0]
    assert by_id[5][0]["component_id"] == 4 and not by_id[5][0]["kept"] and by_id[4][0]["kept"]
    assert all(r["kept"] and r["component_id"] is None for r in by_id[None])
    assert all(r["kept"] and r["component_id"] == 7 for r in by_id[7])


def test_empty_table(docs_of):
    assert near_duplicates(docs_of([]), size=4).collect() == []


def test_signature_estimates_similarity():
    signer, hashes = Signer(), WordHashes()
    a = shingles(hashes.of([str(i).encode() for i in range(400)]), 1)
    b = shingles(hashes.of([str(i).encode() for i in range(80, 480)]), 1)
    same = (signer.signature(a) == signer.signature(b)).mean()
    assert abs(same - 320 / 480) < 0.12
    one = signer.signature(shingles(hashes.of([b"x"]), 1))
    assert len(set(one.tolist())) == 1  # every empty bin takes the only value


def test_words_and_shingles():
    assert words("A b\tC\x0bÄ d") == [b"a", b"b", b"c", "Ä d".encode()]
    h = WordHashes()
    assert len(shingles(h.of(words("a b")), 4)) == 1 and len(shingles(h.of([]), 4)) == 0
    assert not np.array_equal(shingles(h.of(words("a b")), 4), shingles(h.of(words("b a")), 4))


def test_components(spark):
    pairs = [(2, 1), (3, 2), (9, 8), (5, 3), (8, 7), (20, 21)] + [(100 + i, 101 + i) for i in range(60)]
    got = {r["id"]: r["component_id"] for r in components(spark.createDataFrame(pairs, "a LONG, b LONG")).collect()}
    assert Counter(got.values()) == {1: 4, 7: 3, 20: 2, 100: 61}
