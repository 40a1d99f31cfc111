from collections import defaultdict

import pytest

from groundweave.llm.sharding import shard_documents


def check(rows, got, shards):
    assert len(got) == len(rows)
    slots, sizes, groups = defaultdict(list), defaultdict(int), defaultdict(set)
    for r in got:
        assert r["size"] == len((r["text"] or "").encode()) + 1 and r["law"] == "bytes" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
        groups[r["text"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    return sizes, groups


def test_equal_bytes(docs_of, prose):
    rows = [(i, prose(i, 5 + i % 40)) for i in range(600)]
    sizes, groups = check(rows, shard_documents(docs_of(rows), 8).collect(), 8)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(len(t) for _, t in rows)
    assert all(len(s) == 1 for s in groups.values())


def test_a_hot_group_is_cut_at_doc_ids(docs_of, prose):
    rows = [(i, "the same text in very many rows" if i % 3 else prose(i, 8)) for i in range(900)]
    sizes, groups = check(rows, shard_documents(docs_of(rows), 8).collect(), 8)
    assert max(sizes.values()) - min(sizes.values()) <= 200
    assert sum(len(s) > 1 for s in groups.values()) == 1


def test_runs_repeat(docs_of, prose):
    rows = [(i, prose(i % 50, 20)) for i in range(200)]
    one, two = ({(r["doc_id"], r["shard"], r["slot"]) for r in shard_documents(docs_of(d), 4).collect()} for d in (rows, rows[::-1]))
    assert one == two


def test_odd_rows(clashing, odd_rows):
    got = shard_documents(clashing, 8)
    check(odd_rows, got.collect(), 8)
    assert {"key", "id", "day"} <= set(got.columns)


def test_no_rows(docs_of):
    assert shard_documents(docs_of([]), 8).collect() == []


@pytest.mark.parametrize("ids", [[-(2**63), 2**63 - 1, 0, None], [5] * 4])
def test_extreme_ids(docs_of, ids):
    rows = [(i, "x" * 50) for i in ids]
    check(rows, shard_documents(docs_of(rows), 3).collect(), 3)
