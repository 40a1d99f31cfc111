import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundweave.llm import balltree, decontaminate, htmltext
from groundweave.llm.balltree import BallTree, top_k
from groundweave.llm.decontaminate import Finder, Myers, find_items, normal
from groundweave.llm.htmltext import blocks, main_text, read_page, repeated_words, suffix_array


def nearest(rows, k):
    out = []
    for q, x in rows:
        found = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in rows if i != q and len(x) == len(y))[:k] if q % 5 == 0 else []
        out += [(q, n, i, -s) for n, (s, i) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("shard, block", [(8192, 2048), (40, 7)])
def test_top_k_is_exact(spark, monkeypatch, shard, block):
    monkeypatch.setattr(balltree, "SHARD", shard)
    monkeypatch.setattr(balltree, "BLOCK", block)
    rng = random.Random(3)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.1, 0.7]) for _ in range(3 if i % 4 else 6)]) for i in range(200)]
    rows += [(200 + i, rows[1][1]) for i in range(30)]  # ties
    odd = [(500, None), (501, [None, 1.0, 1.0]), (502, [float("nan")] * 3), (503, [float("inf")] * 3), (None, [1.0] * 3), (0, rows[0][1]), (505, [])]
    df = spark.createDataFrame(rows + odd, "vec_id LONG, embedding ARRAY<FLOAT>").withColumn("rank", F.lit("mine"))
    got = sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 5 == 0, k=5).collect())
    whole = [(i, [int(np.floor(256 * float(np.float32(v)))) for v in x]) for i, x in rows]
    assert got == nearest(whole, 5)


def test_top_k_of_no_rows(spark):
    df = spark.createDataFrame([], "vec_id LONG, embedding ARRAY<FLOAT>")
    assert top_k(df, F.col("vec_id") % 5 == 0).collect() == []


def test_large_integers_stay_exact():
    v = np.array([[2**30, 1], [2**30, 3], [-(2**30), 5]], dtype=np.int64)
    got = BallTree(v, np.arange(3)).search(v[0], 0, 2, -(2**63))
    assert got == [(2**60 + 3, -1), (-(2**60) + 5, -2)]


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_myers_distance():
    rng = random.Random(3)
    for _ in range(200):
        p, t = ("".join(rng.choice("abc ") for _ in range(rng.randint(a, 70))) for a in (1, 0))
        assert Myers(p).best(t)[0] == distance(p, t)


def test_edited_items_are_found_up_to_the_budget(prose):
    items = [(i, normal(prose(i, 30))) for i in range(20)]
    finder, rng = Finder(items, 0.05), random.Random(1)
    for n in range(150):
        i, item = items[n % 20]
        text = list(item.strip())
        for _ in range(rng.randint(0, int(len(text) * 0.08))):
            at = rng.randrange(1, len(text) - 1)
            text[at:at + 1] = rng.choice(["Q", "", "qq"])
        doc = f"{prose(100 + n, 20)} {''.join(text)} {prose(200 + n, 20)}"
        near = distance(item, normal(doc)) <= int(len(item.strip()) * 0.05)
        assert (i in [h[0] for h in finder.hits(doc)]) == near


def test_decontamination_odd_rows(spark, docs_of, clashing, prose, monkeypatch):
    monkeypatch.setattr(decontaminate, "GROUP_CHARS", 150)
    items = [(1, prose(1, 30)), (2, prose(2, 30)), (3, prose(2, 30)), (4, "short"), (5, None), (None, prose(5, 30)), (6, "")]
    benchmark = spark.createDataFrame(items, "item_id LONG, text STRING")
    assert all(r["hits"] == [] for r in find_items(clashing, benchmark).collect())
    docs = docs_of([(1, f"Before. {prose(2, 30).upper()}! After"), (2, prose(1, 30)), (3, prose(1, 15)), (4, None)])
    got = {r["doc_id"]: [h["item_id"] for h in r["hits"]] for r in find_items(docs, benchmark).collect()}
    assert got == {1: [2, 3], 2: [1], 3: [], 4: []}
    assert find_items(docs_of([]), benchmark).collect() == [] and find_items(docs, benchmark.limit(0)).count() == 4


def test_short_items_are_found(spark, docs_of):
    items = [(1, "Is it so?"), (2, "42"), (3, "a quick brown fox jumps"), (4, "?!"), (5, "a")]
    benchmark = spark.createDataFrame(items, "item_id LONG, text STRING")
    docs = docs_of([(1, "He asked: is it so"), (2, "room 42, or 421"), (3, "see a quick brovn fox jumps"), (4, "is it soon? 421 ?! quick brown fox"), (5, "is at so")])
    got = {r["doc_id"]: [(h["item_id"], h["distance"]) for h in r["hits"]] for r in find_items(docs, benchmark).collect()}
    assert got == {1: [(1, 0)], 2: [(2, 0)], 3: [(3, 1), (5, 0)], 4: [], 5: []}


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>x</p>";</script></head><body><nav><p>menu</p></nav>
      <div class="ad">buy</div><div id="cookie-notice"><p>accept</p></div><article class="post"><header><h1>A &amp; B</h1></header><p>one<b>two</b>  three<br>four
      <p>five <!-- ad --> six</p><form><p>mail</p></form><section class="comments"><p>first!</p></section><aside>side</aside><ul><li>seven</ul></article><footer>&copy;</footer>"""
    assert blocks(page) == [(t, True) for t in ("A & B", "onetwo three four", "five six", "seven")]
    assert blocks("plain <b>text") == [("plain text", False)] and blocks(None) == [] and blocks("") == []
    assert blocks("<article><p>a < b &am") == [("a < b &am", True)]


def test_suffix_array():
    rng = np.random.default_rng(2)
    for n in (1, 2, 30, 200):
        x = rng.integers(0, 3, n)
        assert suffix_array(x).tolist() == sorted(range(n), key=lambda i: x[i:].tolist())


def test_repeats_between_pages():
    rng = random.Random(5)
    pages = [[[rng.choice("abcd") for _ in range(rng.randint(1, 25))] for _ in range(3)] for _ in range(6)]
    seen = {}
    for p, page in enumerate(pages):
        for b in page:
            for i in range(len(b) - 3):
                seen.setdefault(tuple(b[i:i + 4]), set()).add(p)
    for page, marks in zip(pages, repeated_words(pages, 4)):
        for b, mark in zip(page, marks):
            want = [any(len(seen.get(tuple(b[i:i + 4]), ())) > 1 and len(b) >= i + 4 for i in range(max(0, w - 3), w + 1)) for w in range(len(b))]
            assert mark.tolist() == want


def test_pages_without_article(spark, prose):
    notice = "please accept the rules of this very site before reading on"
    rows = [(i, f"https://Host.example/{i}", f"<body><p>{notice}</p><p>{prose(i, 40)}</p></body>") for i in range(6)]
    rows += [(6, "https://other.example/", f"<p>{notice}</p>"), (7, None, None), (8, "x", ""), (9, "https://host.example/9", f"<article><p>{notice}</p></article>"), (9, "https://host.example/9", f"<article><p>{notice}</p></article>")]
    named = spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING").withColumns({c: F.lit("mine") for c in ("row", "found", "host", "shard", "undecided")})
    got = main_text(named).collect()
    assert all(r["row"] == r["found"] == r["host"] == "mine" for r in got)
    texts = {}
    for r in got:
        texts.setdefault(r["page_id"], []).append(r["text"])
    assert texts == {**{i: [prose(i, 40)] for i in range(6)}, 6: [notice], 7: [""], 8: [""], 9: [notice] * 2}
    assert main_text(spark.createDataFrame([], "page_id LONG, url STRING, html STRING")).collect() == []


def test_blocks_of_dropped_elements():
    page = "<title>T</title><nav>a<li>b &amp; c<ul><li>d</nav><p>x <span class=ad>buy<br>now</span> y<script>no()</script></p><footer>z <p>w"
    assert read_page(page) == ([("x y", False)], ["T", "a", "b & c", "d", "buy now", "z", "w"])
    assert read_page(None) == read_page("<style>p{}</style>") == ([], [])


@pytest.mark.parametrize("size", [4_000_000, 100])
def test_all_pages_feed_the_suffix_array(spark, prose, monkeypatch, size):
    """A page without article loses what pages with one show around it, marked by an element or not."""
    monkeypatch.setattr(htmltext, "SHARD", size)
    menu, byline, same = prose(1, 9), prose(2, 8), prose(3, 30)
    rows = [(i, f"https://a.example/{i}", f"<nav>{menu}</nav><div>{byline}</div><article><p>{prose(10 + i, 40)} {same}</p></article>") for i in range(4)]
    rows += [(4, "https://a.example/4", f"<div>{menu}</div><p>{byline}</p><p>{prose(14, 20)}</p><p>{same}</p>"), (5, "https://b.example/5", f"<div>{menu}</div><p>{byline}</p>")]
    # one text on two pages whose menus differ is one page, whatever lies around it
    rows += [(6 + i, f"https://c.example/{i}", f"<nav>{prose(20 + i, 9)}</nav><nav>{menu}</nav><p>{prose(30, 20)}</p>") for i in range(2)]
    # copies, and the same blocks with and without an article
    rows += [(8 + i, f"https://d.example/{i}", f"<article>{same}</article>" if i == 2 else same) for i in range(3)]
    got = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING")).collect()}
    assert got == {**{i: f"{prose(10 + i, 40)} {same}" for i in range(4)}, 4: f"{prose(14, 20)}\n\n{same}", 5: f"{menu}\n\n{byline}", 6: prose(30, 20), 7: prose(30, 20), 8: same, 9: same, 10: same}


@pytest.mark.parametrize("size", [4_000_000, 300])
def test_articles_are_in_the_suffix_array(spark, prose, monkeypatch, size):
    """Words of a text that another page of the host has too are counted, in articles as well, which stay whole."""
    monkeypatch.setattr(htmltext, "SHARD", size)
    rng = random.Random(4)
    passages = [prose(100 + i, 8) for i in range(6)]
    pages = []  # (menu, blocks of main text, has an article)
    for i in range(30):
        main = [f"{prose(i, 9)} {rng.choice(passages)} {prose(200 + i, 3)}", rng.choice([prose(300 + i, 12), prose(400 + i % 4, 7)])]
        pages.append((rng.choice([passages[0], prose(500 + i, 6)]), main, i % 3 != 0))
    pages += [pages[1], pages[3], (prose(600, 8), pages[3][1], False)]  # copies, and a text with another menu
    zones = [([] if marked else main) + [menu] for menu, main, marked in pages]
    names = [(tuple(main), marked, *[menu] * marked) for menu, main, marked in pages]  # equal pages have one
    seen, around = {}, {}
    for i, (menu, main, marked) in enumerate(pages):
        for into, blocks_ in ((seen, [menu, *main]), (around, zones[i])):
            for words in (b.split(" ") for b in blocks_):
                for at in range(len(words) - 5):
                    into.setdefault(tuple(words[at:at + 6]), set()).add(names[i])

    def covered(words, by):
        return {j for at in range(len(words) - 5) if len(by.get(tuple(words[at:at + 6]), ())) > 1 for j in range(at, at + 6)}

    want = {}
    for i, (menu, main, marked) in enumerate(pages):
        left, n = [], 0
        for words in (b.split(" ") for b in main):
            cut = set() if marked else covered(words, around)
            left.append(" ".join(w for j, w in enumerate(words) if j not in cut))
            n += len(covered(words, seen) - cut)
        want[i] = ("\n\n".join(b for b in left if b), n)
    rows = [(i, "https://one.example/", f"<nav>{menu}</nav>" + ("<article>{}</article>" if marked else "{}").format("".join(f"<p>{b}</p>" for b in main))) for i, (menu, main, marked) in enumerate(pages)]
    found = main_text(spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING"))
    assert {r["page_id"]: (r["text"], r["n_repeated"]) for r in found.collect()} == want
    assert sum(n > 0 for i, (_, n) in want.items() if pages[i][2]) > 10 and any(0 < n for i, (_, n) in want.items() if not pages[i][2])


def test_repeats_do_not_depend_on_the_size_of_a_host(spark, prose, monkeypatch):
    """A passage that just two pages of a large host share is cut, whichever shards they are in."""
    monkeypatch.setattr(htmltext, "SHARD", 700)
    rng = random.Random(8)
    pages = []
    for i in range(40):
        shared = prose(1000 + i // 2, 9)  # pages 2n and 2n + 1 only
        pages.append([prose(i, rng.randint(5, 20)), f"{prose(300 + i, 4)} {shared} {prose(400 + i, 4)}", prose(500, 5), prose(600 + i % 3, 7)])
    pages += [pages[0], [prose(700, 8)], [prose(700, 8)]]  # equal pages count once
    seen = {}
    for p in {tuple(page) for page in pages}:
        for b in p:
            words = b.split(" ")
            for i in range(len(words) - 5):
                seen.setdefault(tuple(words[i:i + 6]), set()).add(p)
    want = {}
    for n, page in enumerate(pages):
        left = []
        for words in (b.split(" ") for b in page):
            cut = {j for i in range(len(words) - 5) if len(seen[tuple(words[i:i + 6])]) > 1 for j in range(i, i + 6)}
            left.append(" ".join(w for j, w in enumerate(words) if j not in cut))
        want[n] = "\n\n".join(b for b in left if b)
    rows = [(n, f"https://big.example/{n}", "".join(f"<p>{b}</p>" for b in page)) for n, page in enumerate(pages)]
    rows += [(100, "https://small.example/", f"<p>{pages[0][3]}</p>")]  # hosts stay apart
    got = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING")).collect()}
    assert got == want | {100: pages[0][3]}
    assert all(prose(1000 + i // 2, 9) not in got[i] for i in range(40)) and got[42] == prose(700, 8)
