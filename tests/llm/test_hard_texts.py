"""Texts that once took time beyond their length."""

import time

import public_tokenizers
import pytest

from groundweave.llm.htmltext import blocks
from groundweave.llm.pieces import PieceModel

N = 200_000
PAGES = {
    "tags without an end": "<a b" * N, "open quotes": '<a "' * (N + 1) + ">", "both quotes": "<a \"'" * (N + 1) + ">", "open scripts": "<script" * N,
    "deep": "<div>" * (N // 2) + "</p></span>" * (N // 2), "stray ends": "<div>" * (N // 4) + "<p></div></p>" * (N // 4), "open comments": "<!--" * N, "less than": "<" * N, "raw": "<script>" + "</script " * N,
}


@pytest.mark.parametrize("name", PAGES)
def test_pages_take_time_in_proportion(name):
    start = time.process_time()
    blocks(PAGES[name])
    assert time.process_time() - start < 10


def test_quotes_hold_signs_and_open_ones_do_not_hide_the_rest():
    assert blocks("<article><p title='a > b'>one</p></article>") == [("one", True)]
    assert blocks("<p>one</p><a \"><p>two</p>") == [("one", False), ("two", False)]
    assert blocks("<p>one</p><!-- <p>two</p> -- > three") == [("one", False)]
    assert blocks("<p>one</p><!-- > <p>two") == [("one", False)]
    assert blocks("a <b c") == [("a", False)]


@pytest.fixture(scope="module")
def model():
    return PieceModel(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.mark.parametrize("unit", ["a", "=", "ab", "é", "xq/7+"])
def test_long_units_take_time_in_proportion(model, unit):
    start = time.process_time()
    found = model.segment(unit * (30_000 // len(unit)), 3)
    assert time.process_time() - start < 10
    assert [f[0] for f in found] == sorted((f[0] for f in found), reverse=True) and len({f[2] for f in found}) == len(found)
    for _, pieces, ids in found:
        assert len(ids) == 2 * pieces and model.decode(ids) == unit * (30_000 // len(unit))
