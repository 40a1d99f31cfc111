import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from groundweave.llm import chunks, pieces
from groundweave.llm.pieces import PieceModel, decode_pieces, encode_pieces
from groundweave.llm.tokenbin import read_tokens, write_tokens

WORDS = public_tokenizers.path("word_bpe_49k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def expected(rows):
    plain, at, out = Tokenizer.from_file(WORDS), 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        out.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_files_hold_the_library_s_ids(spark, docs_of, odd_rows, prose):
    rows = odd_rows + [(200, "A <|endoftext|> b <|ENDOFTEXT|>"), (20, "don't, can't; I'LL é́ x y"), (15, "Ünï,cödé.. Thon. thon, THON!")] + [(300 + i, prose(i, 30)) for i in range(50)]
    folder = write_tokens(docs_of(rows).repartition(5), WORDS, end=2)
    got = [tuple(r) for r in read_tokens(spark, folder).collect()]
    assert sorted(got, key=lambda r: r[1]) == expected(rows)


@pytest.mark.parametrize("path", [WORDS, public_tokenizers.path("byte_bpe_50k.json")])
def test_small_memory_of_chunks(prose, monkeypatch, path):
    monkeypatch.setattr(chunks, "GENERATION", 10)
    monkeypatch.setattr(chunks, "TOGETHER", 150)
    monkeypatch.setattr(chunks, "LONGEST", 4)
    encoder = chunks.ChunkIds(path, "<u2")
    texts = [prose(i % 7, 40) for i in range(20)]
    assert encoder.encode(texts) == [encoder.plain(t) for t in texts]


def test_no_rows(spark, docs_of):
    assert read_tokens(spark, write_tokens(docs_of([]), WORDS, end=2)).collect() == []


def test_a_folder_that_cannot_be_mapped(docs_of):
    with pytest.raises(ValueError, match="mounted"):
        write_tokens(docs_of([(1, "a")]), WORDS, 2, "hdfs://name/folder")


@pytest.fixture(scope="module")
def model():
    return PieceModel(MODEL)


def brute(model, unit):
    """Every segmentation (score, pieces, ids), best first."""
    if not unit:
        return [(0.0, 0, b"")]
    out = []
    for end in range(1, len(unit) + 1):
        edge = model.pieces.get(unit[:end]) or (model._fallback(unit) if False else None)
        if edge is None and end == 1:
            edge = model._fallback(unit[0])
        if edge:
            out += [(s + edge[0], n + len(edge[1]) // 2, edge[1] + ids) for s, n, ids in brute(model, unit[end:])]
    return sorted(out, key=lambda x: (-x[0], x[1], x[2]))


@pytest.mark.parametrize("unit", ["▁thon", "ciónbo", "▁éa", "ab.c", "▁x梦y", "▁and,", "\U0001F600a", "▁"])
def test_segments_are_the_n_best(model, unit):
    want, got = brute(model, unit), model.segment(unit, 5)
    assert [g[0] for g in got] == [w[0] for w in want[:5]] and len(set(got)) == len(got) and set(got) <= set(want)


@pytest.mark.parametrize("text", ["a the", "and, on.\nx", "  lead  trail ", "é,è", "x\n\ny", "▁ab"])
def test_texts_are_the_n_best(model, text):
    want = brute(model, model.processor.normalize(text))
    best, scores, others = model.encode(text, 4)
    assert scores == [w[0] for w in want[:4]]
    assert [x for x in (best, *others)] == list(dict.fromkeys((best, *others)))
    assert {model.decode(x) for x in (best, *others)} == {text.replace("▁", " ")}


def test_pass_over_many_units_agrees_with_the_search(model):
    rng = random.Random(4)
    units = {"▁" + "".join(rng.choice("abcdeélmnotuñß梦") for _ in range(rng.randint(1, 12))) for _ in range(300)}
    model.forget()
    model.learn(units)
    for u in units:
        two, at = model.segment(u, 2), model.place[u]
        assert model.best_scores[at] == two[0][0] and model.losses[at] == (two[0][0] - two[1][0] if len(two) > 1 else np.inf)


def test_round_trip(spark, docs_of, odd_rows, clashing, monkeypatch):
    got = decode_pieces(encode_pieces(clashing, MODEL, with_others=True), MODEL).collect()
    assert len(got) == len(odd_rows) and all(r["decoded"] == (r["text"] or "").replace("▁", " ") for r in got)
    assert all(r["ids"] == b"" and r["scores"] == [0.0] for r in got if not r["text"])
    assert encode_pieces(docs_of([]), MODEL).collect() == []


def test_little_memory_of_units(model, prose, monkeypatch):
    texts = [prose(i, 60) for i in range(30)]
    want = PieceModel(MODEL).encode_all(texts, 3, True)
    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    assert PieceModel(MODEL).encode_all(texts, 3, True) == want
