"""Best-fit packing of documents into sequences by a configuration linear program.

A document's ids, with the end id, are one piece; longer than a sequence, they are cut into
full pieces, the first of which takes what is left over. Only the histogram of piece lengths
matters for the packing, and it has at most ``capacity`` rows whatever the input's size.

The linear program has a variable for each configuration (how many pieces of each length
share a sequence) and a row for each length, whose pieces must be covered. Multiplicative
weights solve it: a row's weight falls as it is covered, a knapsack by dynamic programming
prices configurations under these weights, and those near the best price are taken up to a
step of the row that they fill first. Rounding down leaves some pieces of each length; the
program is solved anew for those while it yields whole sequences, and the few pieces left at
the end are placed by best fit, longest first. The weights of any step, divided by the best
price, are a dual solution, whose value bounds the number of sequences from below.

A piece gets its number within its length from counts per (task, length) and their prefix sums; the
configurations' places of a length are intervals of these numbers. Nothing but the histogram
(capacity rows) reaches the driver, and the intervals (configurations x their lengths) are
what is broadcast.

Null and empty texts are the end id alone. Rows that share a doc_id (or have none) are packed
each by itself. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from groundweave.llm.chunks import chunk_ids, id_type
from groundweave.llm.registry import query, table
from groundweave.session import bounded, cut

CAPACITY = 1024
STEP = 1.0  # share of a row that one configuration may cover at once
SHARPNESS = 0.1  # how fast a row's weight falls as it is covered
LONG_FIRST = (0.3, 0.05, 1.0)  # weights start at length ** (1 + this): short pieces are kept to fill up with; the best of these is taken
CLOSE = 2e-4  # a packing within this share of the bound is taken at once
TOLERANCE, TOGETHER = 0.01, 32  # configurations within this share of the best price, taken under the same weights
ROUNDS = 12  # programs solved at most; each leaves less than the one before

Configuration = tuple[tuple[int, int], ...]  # (length, pieces of it), longest first


class Knapsack:
    """The most valuable sets of pieces within a capacity, for all capacities at once; lengths ascend."""

    def __init__(self, lengths: np.ndarray, values: np.ndarray, capacity: int):
        self.lengths, self.capacity = lengths, capacity
        best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right").tolist()
        for room in range(int(lengths[0]), capacity + 1):
            some = best[room - lengths[:upto[room]]] + values[:upto[room]]
            row = some.argmax()
            if some[row] > best[room - 1]:
                best[room], choice[room] = some[row], row
            else:
                best[room] = best[room - 1]
        self.best, self.choice = best, choice.tolist()
        self.with_row = values + best[capacity - lengths]  # the best set that holds a row

    def set_with(self, row: int) -> dict[int, int]:
        taken, room = Counter([row]), self.capacity - int(self.lengths[row])
        while room > 0:
            row = self.choice[room]
            if row < 0:
                room -= 1
            else:
                taken[row] += 1
                room -= int(self.lengths[row])
        return taken


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int, long_first: float) -> tuple[dict[Configuration, float], float]:
    """Sequences of each configuration that together hold every piece once, and the best lower bound met."""
    cover, found, bound = np.zeros(len(lengths)), Counter(), float(lengths @ counts) / capacity  # the weights length / capacity
    while True:
        short = np.flatnonzero(cover < 1)
        if not len(short):
            break
        weight = lengths[short] ** (1 + long_first) * np.exp(-SHARPNESS * (cover[short] - cover[short].min()))
        priced = Knapsack(lengths[short], weight, capacity)
        bound = max(bound, float(weight @ counts[short]) / priced.best[capacity])
        good = np.argsort(-priced.with_row)
        good = good[priced.with_row[good] >= (1 - TOLERANCE) * priced.best[capacity]][:TOGETHER]
        for row in good.tolist():
            taken = priced.set_with(row)
            rows, pieces = short[list(taken)], np.array(list(taken.values()))
            share = pieces / counts[rows]
            times = min(float(((1 - cover[rows]) / share).min()), max(STEP / float(share.max()), 1.0))
            if times <= 0:
                continue
            cover[rows] += times * share
            cover[cover > 1 - 1e-9] = 1.0
            found[tuple(sorted(((int(lengths[r]), int(n)) for r, n in zip(rows, pieces)), reverse=True))] += times
    return dict(found), bound


def best_fit(counts: dict[int, int], capacity: int) -> Counter[Configuration]:
    """Whole sequences for the pieces, each placed where it leaves least room, longest first."""
    room: dict[int, Counter] = {}  # room -> configurations with it
    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        left = counts[length]
        while left:
            fit = min((r for r in room if r >= length), default=capacity)
            if fit == capacity:
                held, times = (), left
            else:
                held = next(iter(room[fit]))
                times = min(left, room[fit][held])
                room[fit][held] -= times
                if not room[fit][held]:
                    del room[fit][held]
                if not room[fit]:
                    del room[fit]
            if not held:  # new sequences, filled with as many of this length as go in
                each = capacity // length
                whole, rest = divmod(left, each)
                for pieces, n in ((each, whole), (rest, 1)):
                    if pieces and n:
                        room.setdefault(capacity - pieces * length, Counter())[((length, pieces),)] += n
                left = 0
            else:
                last = held[-1]
                more = (*held[:-1], (length, last[1] + 1)) if last[0] == length else (*held, (length, 1))
                room.setdefault(fit - length, Counter())[more] += times
                left -= times
    return sum(room.values(), Counter())


def pack_lengths(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[Counter[Configuration], float]:
    """How many sequences of each configuration hold all pieces, and a lower bound of their number."""
    best, least = None, 0.0
    for long_first in LONG_FIRST:
        packed, bound = _rounded(histogram, capacity, long_first)
        least = max(least, bound)
        best = min(best or packed, packed, key=Counter.total)
        if best.total() <= max(np.ceil(least - 1e-6), least * (1 + CLOSE)):
            break
    return best, least


def _rounded(histogram: dict[int, int], capacity: int, long_first: float) -> tuple[Counter[Configuration], float]:
    left = {k: n for k, n in histogram.items() if n and k < capacity}
    full = histogram.get(capacity, 0)
    packed: Counter[Configuration] = Counter({((capacity, 1),): full} if full else {})
    least = None
    for _ in range(ROUNDS):
        if not left:
            break
        lengths = np.array(sorted(left))
        counts = np.array([left[k] for k in lengths.tolist()])
        found, bound = fractional(lengths, counts, capacity, long_first)
        least = full + bound if least is None else least
        whole = {c: n for c, x in found.items() if (n := int(x + 1e-6))}
        taken = Counter()
        for c, n in sorted(whole.items(), key=lambda x: -sum(length * k for length, k in x[0])):
            n = min(n, *((left[length] - taken[length]) // k for length, k in c))
            if n > 0:
                packed[c] += n
                for length, k in c:
                    taken[length] += k * n
        if not taken:
            break
        left = {k: n - taken[k] for k, n in left.items() if n > taken[k]}
    packed += best_fit(left, capacity)
    return packed, float(full) if least is None else least


def document_pieces(docs: DataFrame, tokenizer: str, end: int, capacity: int) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32, with the piece's task and its number there among those of its length."""
    dtype = id_type(tokenizer, end)

    def encode(batches):
        encoder, part, seen = chunk_ids(tokenizer, dtype), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for pdf in batches:
            rows = []
            ids_of = encoder.encode(pdf["text"].tolist())
            for doc, raw in zip(pdf["doc_id"].astype("Int64").tolist(), ids_of):
                ids = np.append(np.frombuffer(raw, dtype), end).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                for piece, stop in enumerate(range(first, len(ids) + 1, capacity)):
                    start = max(0, stop - capacity) if piece else 0
                    length = stop - start
                    rows.append((doc, piece, start, length, zlib.crc32(ids[start:stop].tobytes()), part, int(seen[length])))
                    seen[length] += 1
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "part", "number"])
            yield out.astype({"doc_id": "Int64"})

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, number long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(encode, schema)


def _places(packed: Counter[Configuration]) -> dict[int, tuple[np.ndarray, ...]]:
    """length -> (first number, pieces a sequence, first sequence, offset of the first) of its intervals, ascending."""
    rows, at, sequence = {}, Counter(), 0
    for configuration, times in sorted(packed.items(), reverse=True):
        offset = 0
        for length, pieces in configuration:
            rows.setdefault(length, []).append((at[length], pieces, sequence, offset))
            at[length] += pieces * times
            offset += length * pieces
        sequence += times
    return {length: tuple(np.array(column, dtype=np.int64) for column in zip(*found)) for length, found in rows.items()}


def pack(docs: DataFrame, tokenizer: str, end: int, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    pieces = cut(document_pieces(docs, tokenizer, end, capacity), "pieces")
    counts = cut(pieces.groupBy("part", "length").agg((F.max("number") + 1).alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    places = pieces.sparkSession.sparkContext.broadcast(_places(pack_lengths(histogram, capacity)[0]))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as tasks
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = pieces.join(bounded(base), ["part", "length"])

    def place(batches):
        for pdf in batches:
            sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            number = (pdf["base"] + pdf["number"]).to_numpy()
            for length, rows in pdf.groupby("length").indices.items():
                first, each, start, shift = places.value[length]
                at = np.searchsorted(first, number[rows], side="right") - 1
                nth, inside = np.divmod(number[rows] - first[at], each[at])
                sequence[rows], offset[rows] = start[at] + nth, shift[at] + inside * length
            pdf["sequence_id"], pdf["offset"] = sequence, offset
            yield pdf[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return numbered.mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


@query("op13_packing")
def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end=2)
