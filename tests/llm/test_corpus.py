import random
import zlib

import public_tokenizers
import pytest

import corpus_pipeline
from groundweave.llm.decontaminate import normal
from groundweave.llm.pieces import PieceModel
from test_minhash import brute as groups_of
from test_minhash import edited

INSULTS = ("blockhead", "nitwitted", "fiendish")


@pytest.fixture(scope="module")
def tables(spark, prose, tmp_path_factory):
    rng = random.Random(8)
    insulted = lambda seed: " ".join(rng.choice(INSULTS) if rng.random() < 0.15 else w for w in prose(seed, 60).split())
    items = [(i, prose(5000 + i, 25)) for i in range(4)]
    passage = prose(6000, 50)
    rows = [(i, prose(i, 90)) for i in range(120)]
    rows += [(200 + i, insulted(700 + i)) for i in range(60)]
    rows += [(300 + i, rows[i][1]) for i in range(10)] + [(320 + i, edited(rows[20 + i][1], 0.01, i)) for i in range(10)]
    rows += [(400 + i, f"{prose(800 + i, 40)} {passage} {prose(900 + i, 40)}") for i in range(12)]
    rows += [(500 + i, f"{prose(1000 + i, 30)} {items[i % 4][1].capitalize()}. {prose(1100 + i, 30)}") for i in range(8)]
    rows += [(600, None), (601, ""), (602, "two  blanks"), (None, prose(1, 33)), (603, "again"), (603, "again")]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(d, t, "xx", "src", None if t is None else len(t)) for d, t in rows], "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(d, 1, int(200 <= d < 260)) for d, _ in rows if d is not None and d % 2], "doc_id LONG, quality INT, toxic INT").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id LONG, text STRING").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, items


def test_matches_brute_force(spark, tables):
    folder, rows, items = tables
    got = sorted((str(r["doc_id"]), r["n_ids"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, folder).collect())

    kept = [r for r in rows if r[0] is None or not 200 <= r[0] < 260]  # toxic ones are planted
    groups = groups_of(kept, 5, 80) if all(r[0] is not None for r in kept) else groups_of([r for r in kept if r[0] is not None], 5, 80)
    known = [r for r in kept if r[0] is not None]
    stay = [r for i, r in enumerate(known) if groups[i][1] == r[0]] + [r for r in kept if r[0] is None]
    stay = list(dict.fromkeys(stay))
    seen = {}
    for _, t in stay:
        w = (t or "").split()
        for i in range(len(w) - 34):
            seen[tuple(w[i:i + 35])] = seen.get(tuple(w[i:i + 35]), 0) + 1
    cleaned = []
    for d, t in stay:
        w = (t or "").split()
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i:i + 35])] > 1 for j in range(i, i + 35)}
        cleaned.append((d, " ".join(x for j, x in enumerate(w) if j not in gone) if gone else t))
    clean = [(d, t) for d, t in cleaned if not any(normal(i) in normal(t) for _, i in items)]
    model = PieceModel(public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for d, t in clean:
        ids = model.encode(t, 1)[0]
        want.append((str(d), len(ids) // 2, zlib.crc32(ids)))
    assert got == sorted(want)


def test_every_stage_bears_odd_tables(spark, tables, clashing, docs_of):
    folder, _, _ = tables
    for docs, rows in ((clashing, 14), (docs_of([]), 0)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, folder)
            if name != "sentencepiece":
                assert docs.columns == columns
        assert (docs.count() == 0) == (rows == 0)
