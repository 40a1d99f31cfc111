import hashlib
from collections import Counter

import numpy as np

from groundweave.llm import substrings
from groundweave.llm.substrings import remove_repeats


def brute(rows, size):
    texts = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i:i + size]) for w in texts for i in range(len(w) - size + 1))
    out = []
    for w in texts:
        mask = [True] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i:i + size])] > 1:
                mask[i:i + size] = [False] * size
        kept = [x for x, m in zip(w, mask) if m]
        out.append((len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def results(df):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in df.collect())


def wanted(rows, size):
    return sorted((str(r[0]), *b) for r, b in zip(rows, brute(rows, size)))


def planted(prose):
    passage = prose(7, 60)
    rows = [(i, f"{prose(100 + i, 50)} {passage} {prose(200 + i, 40)}") for i in range(40)]
    rows += [(50 + i, f"{prose(300 + i, 30)} {' '.join(passage.split()[:35 + i])} end{i}") for i in range(5)]
    rows += [(60, prose(9, 34)), (61, prose(9, 34)), (62, prose(10, 35)), (63, prose(10, 35)), (64, "for " * 500), (65, "a b " * 40), (66, prose(11, 90) + " " + prose(11, 90))]
    return rows


def test_matches_brute_force(docs_of, prose):
    rows = planted(prose)
    assert results(remove_repeats(docs_of(rows), 35)) == wanted(rows, 35)


def test_common_grams_change_nothing(docs_of, prose, monkeypatch):
    rows = planted(prose)
    monkeypatch.setattr(substrings, "COMMON", 0.3)
    monkeypatch.setattr(substrings, "PACK", 3_000)
    common, length = substrings.common_grams(docs_of(rows), 35)
    assert len(common) and length == sum(len(t.encode()) for _, t in rows)
    assert results(remove_repeats(docs_of(rows), 35)) == wanted(rows, 35)


def test_odd_rows(clashing, odd_rows):
    clean = clashing.withColumnsRenamed({"key": "k1", "rank": "spans"})
    assert results(remove_repeats(clean, 35)) == wanted(odd_rows, 35)
    assert "day" in remove_repeats(clean, 35).columns


def test_empty_table(docs_of):
    assert remove_repeats(docs_of([]), 35).collect() == []


def test_sliding_minimum():
    x = np.random.default_rng(1).integers(0, 1000, 200).astype(np.uint64)
    for width in (1, 2, 3, 7, 31):
        assert substrings._sliding_min(x, width).tolist() == [min(x[i:i + width].tolist()) for i in range(len(x) - width + 1)]


def test_large_minimiser_groups(docs_of, prose, monkeypatch):
    rows = planted(prose)
    monkeypatch.setattr(substrings, "SMALL", 0)
    assert results(remove_repeats(docs_of(rows), 35)) == wanted(rows, 35)


def test_many_spans_are_joined_by_exchange(docs_of, prose, monkeypatch):
    rows = planted(prose)
    monkeypatch.setattr(substrings, "FEW_SPANS", 0)
    assert results(remove_repeats(docs_of(rows), 35)) == wanted(rows, 35)
