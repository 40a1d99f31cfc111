"""Benchmark items inside documents, up to an edit budget.

Item and text are lower-cased and reduced to runs of letters and digits between single
blanks. An item of L characters may differ in k = floor(L * rate) edits. Cut into k + 1
pieces, at least one piece occurs unchanged wherever the item matches (pigeonhole), so an
automaton over all pieces finds every place to look at, and Myers' bit-parallel distance
decides there. An item matches between blanks only, not inside words.

Every item with a letter or digit is looked for; under 1 / rate characters it has to occur
unchanged. LEAST is for callers that don't act on items so short that they are ordinary phrases.
Equal items are searched once and reported each. Items are handled in groups of bounded
size, each against all rows. Null and empty texts have no hits; null items are skipped.
"""

from __future__ import annotations

import re
from collections import defaultdict

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from groundweave.llm.registry import giving_back, query, table

RATE, LEAST = 0.05, 30
GROUP_CHARS = 8_000_000  # characters of items in one automaton
WORD = re.compile(r"[^\W_]+")
NAMES = ("item_id", "distance", "start", "end")
HIT = "struct<item_id:long,distance:int,start:int,end:int>"


def normal(text: str | None) -> str:
    return f" {' '.join(WORD.findall(text.lower()))} " if text else ""


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): budget + 1 pieces of nearly equal length."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


class Myers:
    """Smallest edit distance of a pattern to any substring of a text, bit-parallel."""

    def __init__(self, pattern: str):
        self.size, self.masks = len(pattern), defaultdict(int)
        for i, c in enumerate(pattern):
            self.masks[c] |= 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """(distance, end in text) of the first best place; the empty place is (size, 0)."""
        every, top = (1 << self.size) - 1, 1 << (self.size - 1)
        up, down, score = every, 0, self.size
        best = (score, 0)
        masks = self.masks
        for at, c in enumerate(text, 1):
            equal = masks.get(c, 0)
            vertical = equal | down
            equal |= (((equal & up) + up) ^ up)
            plus, minus = down | ~(equal | up) & every, up & equal
            if plus & top:
                score += 1
            elif minus & top:
                score -= 1
            plus, minus = plus << 1 & every, minus << 1 & every
            up, down = minus | ~(vertical | plus) & every, plus & vertical
            if score < best[0]:
                best = (score, at)
        return best


class Finder:
    """All pieces of a group of items."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        ids = defaultdict(list)
        for item_id, text in items:
            ids[text].append(item_id)
        self.items = [(text, int(len(text.strip()) * rate), sorted(found)) for text, found in sorted(ids.items())]
        places = defaultdict(list)
        for n, (text, budget, _) in enumerate(self.items):
            for offset, piece in pieces(text, budget):
                places[piece].append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        if places:
            self.automaton.make_automaton()
        self.patterns: dict[int, tuple[Myers, Myers]] = {}

    def _verify(self, n: int, text: str, low: int, high: int) -> tuple[int, int, int] | None:
        """The best place of item n in text[low:high]: (distance, start, end)."""
        item, budget, _ = self.items[n]
        if n not in self.patterns:
            self.patterns[n] = Myers(item), Myers(item[::-1])
        forward, backward = self.patterns[n]
        region = text[low:high]
        distance, end = forward.best(region)
        if distance > budget:
            return None
        _, length = backward.best(region[max(0, end - len(item) - budget):end][::-1])
        return distance, low + end - length, low + end

    def hits(self, raw: str | None) -> list[tuple[int, int, int, int]]:
        text = normal(raw)
        if not text or not self.items:
            return []
        looked = defaultdict(list)
        for end, (length, found) in self.automaton.iter(text):
            for n, offset in found:
                looked[n].append(end + 1 - length - offset)  # where the item would start without edits
        out = []
        for n, starts in looked.items():
            item, budget, ids = self.items[n]
            best, at = None, 0
            starts.sort()
            while at < len(starts):  # starts within the budget of each other are looked at together
                first = last = starts[at]
                while at < len(starts) and starts[at] - last <= budget:
                    last, at = starts[at], at + 1
                place = self._verify(n, text, max(0, first - budget), max(0, last + len(item) + budget))
                if place and (best is None or place < best):
                    best = place
                if best and best[0] == 0:
                    break
            if best:
                out += [(i, *best) for i in ids]
        return sorted(out)


def item_groups(benchmark: DataFrame, least: int) -> list[list[tuple[int, str]]]:
    """Normal forms of the items in groups of at most GROUP_CHARS characters."""
    groups, size = [[]], 0
    for item_id, text in benchmark.where("text IS NOT NULL AND item_id IS NOT NULL").select(F.col("item_id").cast("long"), "text").distinct().orderBy("item_id", "text").toLocalIterator():
        text = normal(text)
        if len(text.strip()) < least:
            continue
        if groups[-1] and size + len(text) > GROUP_CHARS:
            groups.append([])
            size = 0
        groups[-1].append((item_id, text))
        size += len(text)
    return groups


def find_items(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, least: int = 1) -> DataFrame:
    """docs with ``hits``: for each item found its id, distance and place in the normal form."""
    spark = docs.sparkSession
    docs = docs.drop("hits")
    names, fields = docs.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = docs.withColumn("hits", F.expr(f"cast(array() AS array<{HIT}>)"))
    for group in item_groups(benchmark, least):
        if not group:
            continue
        shared = spark.sparkContext.broadcast(group)  # at most GROUP_CHARS characters

        def search(batches, shared=shared):
            finder = Finder(shared.value, rate)
            for pdf in batches:
                pdf["hits"] = [[*before, *(dict(zip(NAMES, h)) for h in finder.hits(t))] for before, t in zip(pdf["hits"], pdf["text"])]
                yield pdf[[*names, "hits"]]

        out = out.mapInPandas(giving_back(search), f"{fields}, hits array<{HIT}>")
    return out


@query("op8_decontamination")
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and item found in it."""
    found = find_items(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.item_id", "hit.distance", F.col("hit.start").alias("match_start"), F.col("hit.end").alias("match_end"))
