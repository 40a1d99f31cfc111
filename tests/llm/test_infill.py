import hashlib
import re

import numpy as np
import pytest

from groundweave.llm import infill


@pytest.mark.parametrize("kind, values", [
    ("ArrayContainer", [0, 5, 9, 60_000]), ("RunContainer", range(100, 30_000)), ("BitmapContainer", range(0, 65_536, 3)),
])
def test_containers_take_the_smallest_form_and_select(kind, values):
    values = np.array(list(values))
    box = infill.BoundarySet(values).containers[0]
    assert type(box).__name__ == kind
    assert [box.select(i) for i in range(0, len(values), max(1, len(values) // 500))] == values[::max(1, len(values) // 500)].tolist()


@pytest.mark.parametrize("seed", range(5))
def test_select_over_many_containers(seed):
    rng = np.random.default_rng(seed)
    values = np.unique(np.r_[rng.integers(0, 1 << 20, 3000), np.arange(70_000, 90_000), np.arange(200_000, 260_000, 2), 5 << 16, (6 << 16) - 1])
    held = infill.BoundarySet(values)
    assert len(held) == len(values)
    for i in [0, len(values) - 1, *rng.integers(0, len(values), 400)]:
        assert held.select(int(i)) == values[i]


def expected(doc_id, text):
    """By the lines themselves."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")):
        return len(lines), "plain", None, None, text
    low, high = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = "".join(lines[:low]), "".join(lines[low:high]), "".join(lines[high:])
    if h[3] % 100 < 50:
        return len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = ["\n", "\n\n\n", "a", "a\nb", "a\nb\n", "x" * 200_000 + "\n" + "é😀\r\n" * 70_000, "<\nS>\n<P", "a <P> b\nc", "line\n" * 40, " \x85\x0b\n"]


def test_texts_against_their_lines():
    for doc_id in range(40):
        for text in TEXTS:
            done = infill.transform(text, doc_id, 7, 100, 50)
            assert done == expected(doc_id, text)
            assert infill.restore(done[4], done[1]) == text


def test_odd_rows_and_clashing_columns(clashing, odd_rows):
    rows = infill.fill_in_middle(clashing).collect()
    assert len(rows) == len(odd_rows)
    found = sorted(((r["doc_id"], r["text"], r["fim"]["n"], r["fim"]["form"], r["fim"]["prefix_chars"], r["fim"]["middle_chars"], r["fim"]["output"]) for r in rows), key=repr)
    assert found == sorted(((d, t, *expected(d, t)) for d, t in odd_rows), key=repr)
    assert all(r["fim"]["restored"] == (r["text"] or "") and r["n"] == "mine-n" for r in rows)


def test_shares_and_sentinels(docs_of):
    docs = docs_of([(i, "one\ntwo\nthree") for i in range(400)])
    forms = [r["fim"]["form"] for r in infill.fill_in_middle(docs, fim_percent=30, spm_percent=100).collect()]
    assert set(forms) == {"plain", "spm"} and 80 < forms.count("spm") < 160
    assert infill.fill_in_middle(docs_of([])).collect() == []
    for bad in [("<P>", "<P>", "<M>"), ("ab", "bc", "x"), ("aa", "b", "c"), ("", "b", "c"), ("abc", "b", "x")]:
        with pytest.raises(ValueError):
            infill.fill_in_middle(docs, sentinels=bad)
