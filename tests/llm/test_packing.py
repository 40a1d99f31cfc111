import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from groundweave.llm import chunks, packing
from groundweave.llm.chunks import ChunkIds

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def fewest(pieces, capacity):
    """The least number of sequences, by trying every placement."""
    best = len(pieces)

    def place(left, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if not left:
            best = len(rooms)
            return
        for i in sorted({r: i for i, r in enumerate(rooms) if r >= left[0]}.values()):
            place(left[1:], [*rooms[:i], rooms[i] - left[0], *rooms[i + 1:]])
        place(left[1:], [*rooms, capacity - left[0]])

    place(sorted(pieces, reverse=True), [])
    return best


def check(packed, histogram, capacity):
    held = Counter()
    for configuration, times in packed.items():
        assert sum(length * n for length, n in configuration) <= capacity
        for length, n in configuration:
            held[length] += n * times
    assert held == Counter({k: n for k, n in histogram.items() if n})


@pytest.mark.parametrize("seed", range(12))
def test_few_pieces_against_every_placement(seed):
    rng = np.random.default_rng(seed)
    pieces = rng.integers(1, 40, 9).tolist()
    packed, least = packing.pack_lengths(Counter(pieces), 50)
    check(packed, Counter(pieces), 50)
    best = fewest(pieces, 50)
    assert least <= best + 1e-6
    assert packed.total() <= best + 1


@pytest.mark.parametrize("name", ["flat", "long", "thirds", "two", "one length", "full", "none"])
def test_many_pieces_close_to_the_bound_and_best_fit(name):
    rng = np.random.default_rng(5)
    pieces = {
        "flat": rng.integers(1, 1025, 5000), "long": np.r_[np.full(1000, 600), rng.integers(1, 400, 3000)], "thirds": rng.integers(330, 350, 9000),
        "two": np.r_[np.full(500, 700), np.full(500, 324)], "one length": np.full(10_000, 341), "full": np.full(77, 1024), "none": np.zeros(0, int),
    }[name].tolist()
    histogram = Counter(pieces)
    packed, least = packing.pack_lengths(histogram, 1024)
    check(packed, histogram, 1024)
    assert least <= packed.total() <= packing.best_fit(histogram, 1024).total()
    if name in ("flat", "two", "one length", "full", "none"):
        assert packed.total() <= 1.01 * np.ceil(least)


def test_best_fit_takes_the_least_room():
    packed = packing.best_fit({6: 1, 5: 1, 4: 1, 3: 1}, 10)
    assert sorted(packed) == [((5, 1), (3, 1)), ((6, 1), (4, 1))]


def whole(rows, capacity):
    """Pieces are the documents, sequences are filled without gaps or overlaps."""
    taken = {}
    for r in rows:
        taken.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in taken.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(taken)


@pytest.mark.parametrize("capacity", [16, 1024])
def test_pieces_hold_the_documents(spark, clashing, odd_rows, capacity):
    rows = packing.pack(clashing, BYTES, 2, capacity).collect()
    whole(rows, capacity)
    tokenizer, expected = Tokenizer.from_file(BYTES), Counter()
    for doc, text in odd_rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % capacity or capacity
        ends = [first, *range(first + capacity, len(ids) + 1, capacity)]
        for piece, (a, b) in enumerate(zip([0, *ends], ends)):
            expected[doc, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected


def test_empty_table(spark, docs_of):
    assert packing.pack(docs_of([]), BYTES, 2).collect() == []


def test_query_packs_the_table(spark, sf):
    rows = packing.op13_packing(spark, sf).collect()
    used = whole(rows, 1024)
    assert used <= np.ceil(sum(r["length"] for r in rows) / 1024) * 1.02 + 1
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    tokenizer = Tokenizer.from_file(BYTES)
    sizes = Counter()
    for r in rows:
        sizes[r["doc_id"]] += r["length"]
    assert sizes == Counter({d["doc_id"]: len(tokenizer.encode(d["text"] or "", add_special_tokens=False).ids) + 1 for d in docs})


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_chunks_equal_the_library(path):
    import random

    rng, encoder = random.Random(4), ChunkIds(path, "<u2")
    parts = ["a", "b ", " ", "  ", "\n", "\n\n", "The", "word.", "Straße,", "ñas.", "É", ",", "'s", "'LL", " \n", "\t", "12", "!?", "x.", "\r\n", "梦", "\x01", "\x1c", "\x85", "\xa0", "<|endoftext|>", "<|", "é"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert encoder.encode([text])[0] == encoder.plain(text), text


def test_chunks_are_remembered(monkeypatch):
    encoder, learnt = ChunkIds(BYTES, "<u2"), []
    monkeypatch.setattr(encoder, "_learn", lambda new, learn=encoder._learn: learnt.append(len(new)) or learn(new))
    words = ["".join("abcdefghijklmnop"[i >> s & 15] for s in (0, 4, 8, 12, 16)) for i in range(400_000)]
    lines = [" ".join(words[i:i + 1000]) for i in range(0, len(words), 1000)]
    first = encoder.encode(lines)
    assert sum(learnt) >= 400_000 - 1
    learnt.clear()
    assert encoder.encode(lines) == first and sum(learnt) == 0
    # few characters: the memory stays small, the ids stay the same
    monkeypatch.setattr(chunks, "CHARACTERS", 20_000)
    monkeypatch.setattr(chunks, "TOGETHER", 10_000)
    encoder.forget()
    assert encoder.encode(lines[:40]) == first[:40] and len(encoder.known) + len(encoder.known.older) < 20_000


def test_white_space_checks_equal_the_expressions():
    blanks = [c for c in map(chr, range(0x110000)) if c.isspace()]
    for a in [*blanks, "", "x", "<|", "\x01"]:
        for b in [*blanks, "", "|"]:
            for text in (a + b, f"x{a}{b}y", f"{a}x{b}"):
                assert chunks._unsuited(text) == bool(re.search(r"<\||[\x01\x1c-\x1f]", text))
                if not chunks._unsuited(text):
                    assert chunks._has_run(text) == bool(re.search(r"\s\s", text)), repr(text)
