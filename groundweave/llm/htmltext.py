"""Main text of HTML pages, with a suffix array per host over all text of its pages.

A page is read as blocks of text. The token streams of all blocks of a host's distinct pages, inside
<article> or <main>, outside of them and in elements that are never main text, are concatenated; their
suffix array and common-prefix lengths give the substrings of at least ``least`` words that occur on
two or more pages. Words covered by those that two pages show outside article and main
are boilerplate, and the unique runs between them stay.

The element rules follow as a check. What lies in an element that is never main text (menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments: by tag,
role or a word of class or id) is dropped, unique or not, inside an article too; a page that
has an article keeps all else in it, repeated or not, and nothing outside of it. So the suffix array decides the other
blocks of pages without one, against all that the host's pages show around their main text. Of each text the words that
another page has too, in a run of ``least`` words, are counted as n_repeated: those that the rules kept, and those that
the other pages have as main text.

Equal pages count once: those of equal blocks, and of pages without an article those whose blocks
outside dropped elements are equal. A large host is dealt into shards of SHARD characters of html by a hash of the page. The
suffix array finds the repeats inside a shard. Grams of ``least`` words that several shards of a
host have are found in two rounds, by LOW bits of a digest and a bucket first and by 64 more for those that agree, so
that the size of a host doesn't change the result.

Null and empty html give an empty text. Unclosed and truncated markup is read as far as it
goes. A row is kept for each input row.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from groundweave.llm.registry import query, table
from groundweave.session import attach

LEAST = 6  # words of a repeated substring
SHARD = 4_000_000  # characters of html in one suffix array
LOW = 28  # bits of a gram's digest that shards compare first
KEYS = "first half of it", "second half of i"  # of the words' digests: any two of 16 characters

# HTML's element names by role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
NEVER = set("aside button dialog footer form head header iframe menu nav noscript object select svg template textarea title".split())
MAIN = {"article", "main"}
ROLES = set("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
WORDS = set("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies footer gdpr masthead menu modal nav navbar navigation newsletter notice popup promo promotion related share sharing sidebar social sponsor sponsored subscribe toolbar".split())
RAW = r"<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)"
TAG = r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
PLAIN_TAG = r"<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>"
COMMENT = r"<!--.*?(?:-->|\Z)"
REST = r"<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^<>]*(?:>|\Z)"
MARKUP = re.compile(rf"{COMMENT}|{RAW}|{TAG}|{REST}|<[a-zA-Z]", re.DOTALL | re.IGNORECASE)
PLAIN_MARKUP = re.compile(rf"{COMMENT}|{RAW.replace('[^>]*', '[^<>]*')}|{PLAIN_TAG}|{REST}", re.DOTALL | re.IGNORECASE)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)


def _dropped(name: str, attributes: str, in_main: bool) -> bool:
    if name in NEVER:
        return not (name == "header" and in_main)
    if "=" in attributes:
        for m in ATTRIBUTE.finditer(attributes):
            value = html.unescape(m[2] or m[3] or m[4] or "").lower()
            if m[1].lower() == "role":
                if value.strip() in ROLES:
                    return True
            elif name not in MAIN and name not in ("html", "body") and not WORDS.isdisjoint(re.findall(r"[a-z]+", value)):
                return True
    return False


def markup(page: str):
    """Matches of tags, comments and the like, in one pass over the page.

    Quotes in a tag may hold ">". From a tag on whose quote is never closed, and after the last
    ">", quotes aren't heeded, so that no part is scanned again for every "<" in it.
    """
    at, last = 0, page.rfind(">") + 1
    while at < last:
        m = MARKUP.search(page, at, last)
        if m is None:
            break
        if m[3] is None and page[m.start() + 1].isalpha() and m[1] is None:  # a tag that its quotes keep open
            at = m.start()
            last = 0
        elif m[3] is None and m.end() == last:  # perhaps open up to the end of the page
            at, last = m.start(), 0
        else:
            yield m
            at = m.end()
    else:
        if last == len(page):
            return
    yield from PLAIN_MARKUP.finditer(page, at)


def blocks(page: str | None) -> list[tuple[str, bool]]:
    """(text, inside article or main) of each block that may be main text, in page order."""
    return read_page(page)[0]


def read_page(page: str | None) -> tuple[list[tuple[str, bool]], list[str]]:
    """The page's blocks, and those of its dropped elements but for scripts and styles."""
    if not page:
        return [], []
    out, gone, parts, lost, stack, opened = [], [], [], [], [], Counter()  # lost: parts of a dropped block; stack: (name, drops, main) of open elements that matter; opened: their names
    dropping = main = at = 0

    def close() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append((text, main > 0))

    def close_lost() -> None:
        text = " ".join(html.unescape("".join(lost)).split())
        lost.clear()
        if text:
            gone.append(text)

    for m in markup(page):
        if m.start() > at:
            (lost if dropping else parts).append(page[at:m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if name == "br":
            parts.append(" ")
            lost.append(" ")
        if name in BLOCKS and not dropping:
            close()
        if lost and (name in BLOCKS or not dropping):
            close_lost()
        if name in VOID:
            continue
        if not m[2]:
            drops, is_main = _dropped(name, m[4] or "", main > 0), name in MAIN
            if name in BLOCKS or drops:
                if not (m[4] or "").endswith("/"):
                    stack.append((name, drops, is_main))
                    opened[name] += 1
                    dropping += drops
                    main += is_main
        elif opened[name]:
            while stack:
                closed, drops, is_main = stack.pop()
                opened[closed] -= 1
                dropping -= drops
                main -= is_main
                if closed == name:
                    break
    if dropping:
        lost.append(page[at:])
    else:
        parts.append(page[at:])
        close()
    close_lost()
    return out, gone


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order, by prefix doubling of those that are not told apart yet."""
    n, step = len(tokens), 1
    order = np.argsort(tokens, kind="stable")
    rank = np.empty(n, np.int64)  # place of the first suffix that is equal so far
    new = np.append(np.ones(min(n, 1), bool), tokens[order[1:]] != tokens[order[:-1]])
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    open_ = np.flatnonzero(~(new & np.append(new[1:], np.ones(min(n, 1), bool))))
    while len(open_):
        who = order[open_]
        group = rank[who]
        after = np.where(who + step < n, rank[np.minimum(who + step, n - 1)], -1)
        by = np.argsort(group * (n + 1) + after + 1)
        who, group, after = who[by], group[by], after[by]
        order[open_] = who
        new = np.append(True, (group[1:] != group[:-1]) | (after[1:] != after[:-1]))
        rank[who] = np.maximum.accumulate(np.where(new, open_, 0))
        open_ = open_[~(new & np.append(new[1:], True))]
        step *= 2
    return order


def common_prefixes(tokens: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it in order, counted up to ``most``."""
    out, alive = np.zeros(len(tokens), np.int64), np.arange(1, len(tokens))
    for h in range(most):
        a, b = order[alive] + h, order[alive - 1] + h
        alive = alive[np.maximum(a, b) < len(tokens)]
        alive = alive[tokens[order[alive] + h] == tokens[order[alive - 1] + h]]
        out[alive] = h + 1
    return out


def stream_of(pages: list[list[list[str]]]) -> tuple[np.ndarray, list[str]]:
    """The words of all blocks as numbers from 1 on, each block with a border 0 behind it, and the words."""
    known: dict[str, int] = {}
    stream = []
    for page in pages:
        for block in page:
            stream += [known.setdefault(w, len(known) + 1) for w in block]
            stream.append(0)
    return np.array(stream, dtype=np.int64), list(known)


def inside_of(pages: list[list[list[str]]], inside: list[list[bool]] | None) -> np.ndarray:
    """For each place of the stream whether its block is marked as main text."""
    marked = [(m, len(block) + 1) for page, marks in zip(pages, inside or []) for block, m in zip(page, marks)]
    return np.repeat(*map(np.array, zip(*marked))) if marked else np.zeros(sum(len(b) + 1 for page in pages for b in page), bool)


class Grams:
    """The distinct grams of ``least`` words of a shard, in the order of their digests.

    ``at`` has the places in the stream where a block has a whole gram, ``which`` the gram there. A gram
    has a bucket, LOW bits, 64 bits more, and whether it occurs outside main text; ``first`` is the place of its bucket and
    low bits among the distinct ones, which are ``firsts``.
    """

    def __init__(self, pages: list[list[list[str]]], inside: list[list[bool]], least: int, shards: int):
        self.tokens, known = stream_of(pages)
        n = max(0, len(self.tokens) - least + 1)
        digests, whole = [np.zeros(n, np.uint64) for _ in KEYS], np.ones(n, bool)
        for sums, key in zip(digests, KEYS):  # of the words' digests, each place with another odd factor
            words = np.append(np.zeros(1, np.uint64), pd.util.hash_array(np.array(known, dtype=object), hash_key=key, categorize=False))[self.tokens]
            for i in range(least):
                sums += words[i:i + n]
                sums *= np.uint64(0x9E3779B97F4A7C15)
        for i in range(least):
            whole &= self.tokens[i:i + n] > 0
        self.at = np.flatnonzero(whole)
        a, b = (sums[self.at] for sums in digests)
        key = ((a >> np.uint64(32)) % np.uint64(-(-shards // 4)) << np.uint64(LOW)) | (a & np.uint64((1 << LOW) - 1))  # a bucket for four shards
        order = np.lexsort((b, key))
        key, b = key[order], b[order]
        new = np.append(np.ones(min(len(key), 1), bool), (key[1:] != key[:-1]) | (b[1:] != b[:-1]))
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(new) - 1
        self.out = ~inside_of(pages, inside)[self.at]
        self.around = np.zeros(int(new.sum()), bool)
        self.around[self.which[self.out]] = True
        self.key, self.more = key[new].astype(np.int64), b[new]
        self.firsts, self.first = np.unique(self.key, return_inverse=True)

    def buckets(self, keys: np.ndarray):
        """(bucket, slice) of ordered keys."""
        number = keys >> LOW
        edges = np.flatnonzero(np.append(True, number[1:] != number[:-1])) if len(keys) else []
        yield from ((int(number[lo]), slice(lo, hi)) for lo, hi in zip(edges, [*edges[1:], len(keys)]))

    def chosen(self, keys: np.ndarray, bits: dict[int, bytes]) -> np.ndarray:
        """Which of the ordered keys their buckets' bits name."""
        out = np.zeros(len(keys), bool)
        for bucket, part in self.buckets(keys):
            if bucket in bits:
                out[part] = np.unpackbits(np.frombuffer(bits[bucket], np.uint8), count=part.stop - part.start)
        return out


def packed(values: np.ndarray) -> bytes:
    """Ordered numbers of LOW bits in about the bits of their differences."""
    steps = np.diff(values, prepend=0).astype("<u4")
    return zlib.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T)
    return np.cumsum(steps.view("<u4").ravel(), dtype=np.int64)


def squeezed(blocks_: list[str]) -> tuple[int, bytes]:
    """The length of the blocks' lines, and the lines compressed: a session's codec for shuffles gains little on texts."""
    data = "\n".join(blocks_).encode("utf-8", "surrogatepass")
    return len(data), pa.Codec("zstd", 6).compress(data, asbytes=True)


def bits_of(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def repeated_words(pages: list[list[list[str]]], least: int, elsewhere: tuple[np.ndarray, np.ndarray] | None = None, owners: list[int] | None = None, inside: list[list[bool]] | None = None, tokens: np.ndarray | None = None) -> list[list[np.ndarray]]:
    """For each page and block, which words lie in a substring of ``least`` words that another page has too.

    1 stands for a substring that two pages show outside main text, in a block outside of it, 2 for other repeats,
    0 for none. Blocks are outside unless ``inside`` marks them. ``elsewhere`` has the places of grams that pages
    outside ``pages`` have, and of those that both have outside main text; entries of ``pages`` with one number in ``owners`` count as one page. ``tokens`` is the stream of the pages, if at hand.
    """
    tokens = stream_of(pages)[0] if tokens is None else tokens.copy()
    borders = tokens == 0
    tokens[borders] = -1 - np.flatnonzero(borders)  # a border that equals no other
    owner = np.repeat(np.array(owners if owners else range(len(pages)), np.int64), [sum(len(b) + 1 for b in page) for page in pages])
    out = ~inside_of(pages, inside)
    found = np.zeros(len(tokens), np.int8)
    if len(tokens):
        order = suffix_array(tokens)
        # runs of suffixes that share ``least`` words; those of several pages are repeats
        new = common_prefixes(tokens, order, least) < least
        new[0] = True
        first, run = np.flatnonzero(new), np.cumsum(new) - 1

        def covered(counts: np.ndarray, more: np.ndarray) -> np.ndarray:
            """Words of the substrings that several pages have, of the places that count, and at ``more``."""
            here, page = counts[order], owner[order]
            several = np.minimum.reduceat(np.where(here, page, len(pages)), first) < np.maximum.reduceat(np.where(here, page, -1), first)
            start = np.append(order[several[run] & here], more)
            change = np.zeros(len(tokens) + 1, np.int64)
            np.add.at(change, start, 1)
            np.add.at(change, np.minimum(start + least, len(tokens)), -1)
            return np.cumsum(change)[:-1] > 0

        anywhere, around = elsewhere or (np.zeros(0, np.int64),) * 2
        found[covered(np.ones(len(tokens), bool), anywhere)] = 2
        found[covered(out, around)] = 1
    marks, at = [], 0
    for page in pages:
        marks.append([])
        for block in page:
            marks[-1].append(found[at:at + len(block)])
            at += len(block) + 1
    return marks


def main_text(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """pages without html but with text, the blocks of main text joined by an empty line, and n_repeated."""
    kept = [c for c in pages.columns if c not in ("html", "text", "n_repeated")]
    # the input's columns travel as one struct, so that no name of theirs can clash
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1))
    whole = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("page"), F.coalesce(host, F.lit("")).alias("host"), "html")
    large = whole.groupBy("host").agg(F.ceil(F.sum(F.length("html")) / SHARD).cast("int").alias("shards")).where("shards > 1")
    whole = attach(whole, large, ["host"]).select("page", "host", F.coalesce("shards", F.lit(1)).alias("shards"), "html")

    def digest(lines: list[str]) -> bytes:
        return hashlib.blake2b("\n".join(lines).encode("utf-8", "surrogatepass"), digest_size=16).digest()

    def read(batches):
        for batch in batches:
            rows, copies = {}, {}  # copies of a page in a batch are one row
            for i, (name, shards, page) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("host", "shards", "html")))):
                blocks_, gone = read_page(page)
                marked = any(inside for _, inside in blocks_)
                found = [t for t, inside in blocks_ if inside or not marked]
                around = gone + [t for t, inside in blocks_ if marked and not inside]
                undecided = not marked and len(found) > 0
                every = digest([str(undecided), *found, "", *around])
                if (name, every) not in rows:
                    same = digest([str(undecided), *found]) if undecided else every
                    rows[name, every] = (name, shards, undecided, len(found), len(found) + len(around), *squeezed(found + around), same, every)
                copies.setdefault((name, every), []).append(i)
            offsets = np.cumsum([0, *map(len, copies.values())])
            held = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), batch.column("page").take(pa.array([i for c in copies.values() for i in c], pa.int32())))
            types = (pa.string(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            columns = [pa.array(values, kind) for values, kind in zip(zip(*rows.values()) if rows else [()] * 9, types)]
            yield pa.RecordBatch.from_arrays([held, *columns], ["pages", "host", "shards", "undecided", "found", "blocks", "size", "lines", "same", "every"])

    each = f"pages array<{whole.schema['page'].dataType.simpleString()}>"
    hosts = whole.mapInArrow(read, f"{each}, host string, shards int, undecided boolean, found int, blocks int, size int, lines binary, same binary, every binary")
    hosts = hosts.withColumn("shard", F.pmod(F.xxhash64("same"), F.col("shards")))
    dealt = hosts.groupBy("host", "shard")

    def streams(shard: pa.Table):
        """The shard's distinct pages, the words of their blocks, which blocks are marked as main, and each row's page."""
        which: dict[bytes, int] = {}
        rows = [(which.setdefault(e, len(which)), i) for i, e in enumerate(shard.column("every").to_pylist())]
        once = list({page: i for page, i in reversed(rows)}.items())[::-1]
        once = shard.select(["undecided", "found", "blocks", "size", "lines", "same"]).take([i for _, i in sorted(once)]).to_pylist()
        codec = pa.Codec("zstd")
        for r in once:
            r["lines"] = codec.decompress(r["lines"], r["size"], asbytes=True).decode("utf-8", "surrogatepass").split("\n") if r["blocks"] else []
        words = [[b.split(" ") for b in r["lines"]] for r in once]
        inside = [[not r["undecided"] and i < r["found"] for i in range(r["blocks"])] for r in once]
        return once, words, inside, [page for page, _ in rows]

    def grams_of(shard: pa.Table) -> Grams | None:
        shards = shard.column("shards")[0].as_py() if len(shard) else 1
        return Grams(*streams(shard)[1:3], least, shards) if shards > 1 else None

    def rows_of(key: tuple, rows: list[tuple], names: str) -> pa.Table:
        names = names.split()
        kinds = [pa.int64() if name in ("shard", "bucket") else pa.binary() for name in names]
        columns = zip(*rows) if rows else [()] * len(names)
        return pa.table({"host": pa.array([key[0].as_py()] * len(rows), pa.string()), **{n: pa.array(c, k) for n, c, k in zip(names, columns, kinds)}})

    # Equal pages share a shard, so a gram of two shards is on two distinct pages. A shard sends the low bits
    # of its grams' digests to its host's buckets; a bucket tells each shard which of them another shard has too.
    # For those the second round compares the rest of the digest and whether both shards have the gram outside main text.
    def offer(key: tuple, shard: pa.Table) -> pa.Table:
        g = grams_of(shard)
        rows = [(key[1].as_py(), bucket, packed(g.firsts[part] & ((1 << LOW) - 1))) for bucket, part in g.buckets(g.firsts)] if g else []
        return rows_of(key, rows, "shard bucket low")

    def answer(key: tuple, offers: pa.Table) -> pa.Table:
        low = [unpacked(x) for x in offers.column("low").to_pylist()]
        ends = np.cumsum([len(x) for x in low])[:-1]
        flags = np.split(pd.Series(np.concatenate(low)).duplicated(keep=False).to_numpy(), ends)
        return rows_of(key, [(s, key[1].as_py(), bits_of(f)) for s, f in zip(offers.column("shard").to_pylist(), flags) if f.any()], "shard bucket agree")

    def offer_again(key: tuple, shard: pa.Table, answers: pa.Table) -> pa.Table:
        bits = dict(zip(answers.column("bucket").to_pylist(), answers.column("agree").to_pylist()))
        rows = []
        if bits:
            g = grams_of(shard)
            asked = np.flatnonzero(g.chosen(g.firsts, bits)[g.first])
            for bucket, part in g.buckets(g.key[asked]):
                at = asked[part]
                rows.append((key[1].as_py(), bucket, bits[bucket], packed(g.key[at] & ((1 << LOW) - 1)), g.more[at].tobytes(), bits_of(g.around[at])))
        return rows_of(key, rows, "shard bucket agree low more around")

    def answer_again(key: tuple, offers: pa.Table) -> pa.Table:
        low = [unpacked(x) for x in offers.column("low").to_pylist()]
        more = np.concatenate([np.frombuffer(x, np.uint64) for x in offers.column("more").to_pylist()])
        around = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(n)).astype(bool) for x, n in zip(offers.column("around").to_pylist(), low)])
        ends = np.cumsum([len(x) for x in low])[:-1]
        every = pd.DataFrame({"low": np.concatenate(low), "more": more})
        anywhere, outside = every.duplicated(keep=False).to_numpy(), np.zeros(len(every), bool)
        outside[around] = every[around].duplicated(keep=False).to_numpy()
        rows = zip(offers.column("shard").to_pylist(), offers.column("agree").to_pylist(), np.split(anywhere, ends), np.split(outside, ends))
        return rows_of(key, [(s, key[1].as_py(), agree, bits_of(x), bits_of(y)) for s, agree, x, y in rows if x.any()], "shard bucket agree anywhere outside")

    def strip(shard: pa.Table, answers: pa.Table) -> pa.Table:
        once, words, inside, which = streams(shard)
        elsewhere = tokens = None
        if len(answers):
            g = Grams(words, inside, least, shard.column("shards")[0].as_py())
            agree, anywhere, outside = (dict(zip(answers.column("bucket").to_pylist(), answers.column(c).to_pylist())) for c in ("agree", "anywhere", "outside"))
            asked = np.flatnonzero(g.chosen(g.firsts, agree)[g.first])
            shared, around = np.zeros((2, len(g.key)), bool)
            shared[asked], around[asked] = g.chosen(g.key[asked], anywhere), g.chosen(g.key[asked], outside)
            elsewhere, tokens = (g.at[shared[g.which]], g.at[around[g.which] & g.out]), g.tokens
        texts, counts = [], []
        for r, page, marks in zip(once, words, repeated_words(words, least, elsewhere, pd.factorize(pd.Series([r["same"] for r in once], dtype=object))[0].tolist(), inside, tokens)):
            n, left = r["found"], r["lines"][:r["found"]]
            # the rules' check: an article stays whole; of other pages only what is unique and outside dropped elements
            if r["undecided"]:
                left = [" ".join(w for w, m in zip(block, mark.tolist()) if m != 1) for block, mark in zip(page[:n], marks)]
            texts.append("\n\n".join(b for b in left if b))
            counts.append(sum(int(np.count_nonzero(mark if not r["undecided"] else mark == 2)) for mark in marks[:n]))
        return pa.table({"pages": shard.column("pages"), "text": pa.array(texts, pa.string()).take(pa.array(which, pa.int64())), "n_repeated": pa.array(counts, pa.int64()).take(pa.array(which, pa.int64()))})

    offers = dealt.applyInArrow(offer, "host string, shard long, bucket long, low binary")
    answers = offers.groupBy("host", "bucket").applyInArrow(answer, "host string, shard long, bucket long, agree binary")
    again = dealt.cogroup(answers.groupBy("host", "shard")).applyInArrow(offer_again, "host string, shard long, bucket long, agree binary, low binary, more binary, around binary")
    answers = again.groupBy("host", "bucket").applyInArrow(answer_again, "host string, shard long, bucket long, agree binary, anywhere binary, outside binary")
    stripped = dealt.cogroup(answers.groupBy("host", "shard")).applyInArrow(strip, f"{each}, text string, n_repeated long")
    return stripped.select(F.explode("pages").alias("page"), "text", "n_repeated").select("page.*", "text", "n_repeated")


@query("op5_main_text")
def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_repeated")
