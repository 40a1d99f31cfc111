"""SentencePiece encoding by N-best segmentation, and decoding.

The text is normalised by the model. Its piece lattice has an edge for every piece that
matches; a character without a piece of its own gets its UTF-8 byte pieces as one edge at a
penalty under the lowest real score. A segmentation's score is the sum of its pieces'
scores. The forward Viterbi scores are exact heuristics for an A* search from the end,
which therefore yields segmentations from the best downwards.

No piece crosses the places where a text is cut into units (before a blank mark, at line
ends, and between a letter and the full stop or comma after it, where the model has no such
piece), so the lattice is the product of the units' lattices. The forward pass runs
over many new units at once and keeps each unit's best and what its second best loses; only
units that can matter for a text's N best are searched, and the N best combinations taken.

Null and empty texts have no ids and one segmentation with score 0. Of a unit's segmentations
with equal scores the one with fewer pieces comes first, then the one with smaller ids.
"""

from __future__ import annotations

import functools
import heapq
import re

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, functions as F

from groundweave.llm.registry import giving_back, query, table

REMEMBERED = 200_000  # units
LONGEST_TOGETHER = 48  # characters; longer units are searched one by one
SLOT_BITS = 20
SPREAD = np.uint64(0xD6E8FEB86659FD93)
BASE = np.uint64(0x9E3779B97F4A7C15)
UNKNOWN_PENALTY = 10.0
IMPOSSIBLE = -1e8  # a lower score marks a longer piece that is never used (runs of blanks)
MARK = "▁"
STOPPED = re.compile(rf"({MARK}?[^\W\d_]+)([.,].*)", re.DOTALL)

Segmentation = tuple[float, int, bytes]  # loss or score, pieces, ids


def _hashes(strings: list[str]) -> np.ndarray:
    out = []
    for string in strings:
        h = 0
        for c in string:
            h = (h * int(BASE) + ord(c) + 1) % 2**64
        out.append(h)
    return np.array(out, dtype=np.uint64)


class PieceModel:
    def __init__(self, path: str):
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.processor.get_piece_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.pieces: dict[str, tuple[float, bytes]] = {}
        self.bytes: dict[int, bytes] = {}
        self.surface: list[bytes] = []
        for i in range(size):
            piece, raw = self.processor.id_to_piece(i), np.array([i], dtype=self.dtype).tobytes()
            if self.processor.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes[value] = raw
                self.surface.append(bytes([value]))
            elif self.processor.is_control(i) or self.processor.is_unused(i) or self.processor.is_unknown(i):
                self.surface.append(b"")
            else:
                self.surface.append(piece.replace(MARK, " ").encode())
                if len(piece) == 1 or self.processor.get_score(i) > IMPOSSIBLE:
                    self.pieces[piece] = (self.processor.get_score(i), raw)
        self.prefixes = {p[:n] for p in self.pieces for n in range(1, len(p) + 1)}
        self.unknown = min((s for s, _ in self.pieces.values() if s > IMPOSSIBLE), default=0.0) - UNKNOWN_PENALTY
        if any(MARK in p[1:] or "\n" in p for p in self.pieces):
            raise ValueError(f"{path}: pieces cross blank marks or line ends")
        self.joined = {m for p in self.pieces for m in re.findall(r"([^\W\d_])(?=[.,])", p)}  # letters that some piece joins to a full stop or comma
        scores = sorted(((int(h), s, raw) for h, (s, raw) in zip(_hashes(list(self.pieces)), self.pieces.values())), key=lambda x: x[0] * int(SPREAD) % 2**64)
        self.table = np.array([h for h, _, _ in scores], dtype=np.uint64)
        self.table_scores = np.array([s for _, s, _ in scores])
        self.table_ids = np.frombuffer(b"".join(raw for _, _, raw in scores), self.dtype)
        self.slots = np.zeros(1 << SLOT_BITS, np.int32)  # the first piece with a hash's high bits; its fellows are neighbours
        slot = (self.table * SPREAD >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        self.slots[slot[first]] = first
        self.fellows = int(np.diff(np.append(first, len(slot))).max())
        self.longest = max(map(len, self.pieces))
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}  # unit -> place in the following
        self.best_ids, self.best_scores, self.losses = [], np.zeros(0), np.zeros(0)
        self._remember([""], [b""], np.zeros(1), np.full(1, np.inf))
        self.searched: dict[str, list[Segmentation]] = {}

    def _fallback(self, char: str) -> tuple[float, bytes]:
        if not self.bytes:
            return self.unknown, np.array([self.processor.unk_id()], dtype=self.dtype).tobytes()
        return self.unknown, b"".join(self.bytes[b] for b in char.encode())

    def segment(self, unit: str, n: int) -> list[Segmentation]:
        """The n best segmentations of a unit: (score, pieces, ids), best first."""
        length, pieces, prefixes = len(unit), self.pieces, self.prefixes
        forward, incoming = [0.0] + [-np.inf] * length, [[] for _ in range(length + 1)]
        for i in range(length):
            base = forward[i]
            single = False
            for j in range(i + 1, length + 1):
                part = unit[i:j]
                if part not in prefixes:
                    break
                edge = pieces.get(part)
                if edge:
                    single |= j == i + 1
                    incoming[j].append((i, edge[0], edge[1]))
                    if base + edge[0] > forward[j]:
                        forward[j] = base + edge[0]
            if not single:
                score, raw = self._fallback(unit[i])
                incoming[i + 1].append((i, score, raw))
                if base + score > forward[i + 1]:
                    forward[i + 1] = base + score
        # An entry is a way from a place to the end: its estimate, pieces, first ids and the entry it goes
        # on with. Ways from one place come in their final order, so the first n of each are enough.
        width, out, popped, ends = self.dtype.itemsize, [], [0] * (length + 1), []
        heap, turn = [(-forward[length], 0, b"", 0, length, 0.0, None)], 0
        while heap and len(out) < n:
            entry = heapq.heappop(heap)
            estimate, count, _, _, at, done, _ = entry
            if popped[at] >= n:
                continue
            popped[at] += 1
            if not at:
                out.append((-estimate, count, self._path(entry)))
                continue
            turn += 1
            for start, score, raw in incoming[at]:
                if popped[start] >= n:
                    continue
                total = -(done + score + forward[start])
                if len(ends) >= n and total > ends[-1]:  # n whole segmentations are better
                    continue
                if not start:
                    ends = sorted([*ends, total])[:n]
                heapq.heappush(heap, (total, count + len(raw) // width, raw, turn, start, done + score, entry))
        return out

    @staticmethod
    def _path(entry: tuple) -> bytes:
        ids = []
        while entry is not None:
            ids.append(entry[2])
            entry = entry[6]
        return b"".join(ids)

    def _two_best(self, units: list[str]) -> None:
        """Remember the best segmentation of new units of one length, and what the second best loses.

        The forward pass of all units at once. Units with an equal second best or with
        characters outside the model are left to the search.
        """
        rows, length = len(units), len(units[0])
        codes = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).reshape(rows, length).astype(np.uint64) + np.uint64(1)
        first, second = np.full((length + 1, rows), -np.inf), np.full((length + 1, rows), -np.inf)
        first[0] = 0.0
        back, taken = np.zeros((length + 1, rows), np.int64), np.zeros((length + 1, rows), self.dtype)
        foreign = np.zeros(rows, bool)
        for i in range(length):
            h = np.zeros(rows, np.uint64)
            for j in range(i + 1, min(length, i + self.longest) + 1):
                h = h * BASE + codes[:, j - 1]
                at = self.slots[h * SPREAD >> np.uint64(64 - SLOT_BITS)]
                fits = self.table[at] == h
                for k in range(1, self.fellows):
                    after = np.minimum(at + k, len(self.table) - 1)
                    hit = self.table[after] == h
                    at, fits = np.where(hit, after, at), fits | hit
                if j == i + 1:
                    foreign |= ~fits
                if not fits.any():
                    continue
                score = np.where(fits, self.table_scores[at], -np.inf)
                one, two = first[i] + score, second[i] + score
                second[j] = np.maximum(np.minimum(first[j], one), np.maximum(second[j], two))
                better = one > first[j]
                first[j][better], back[j][better], taken[j][better] = one[better], i, self.table_ids[at][better]
        two = np.isfinite(second[length])
        loss = np.where(two, first[length] - np.where(two, second[length], 0.0), np.inf)
        every, at, columns = np.arange(rows), np.full(rows, length), []
        while (at > 0).any():
            columns.append(np.where(at > 0, taken[at, every], 0).astype(self.dtype))
            at = np.where(at > 0, back[at, every], 0)
            if len(columns) > length:
                break
        path, width = np.ascontiguousarray(np.array(columns[::-1]).T), self.dtype.itemsize
        steps, at = np.zeros(rows, np.int64), np.full(rows, length)
        for _ in columns:
            steps += at > 0
            at = np.where(at > 0, back[at, every], 0)
        raw, line = path.tobytes(), path.shape[1] * width
        ids = [raw[(r + 1) * line - k * width:(r + 1) * line] for r, k in enumerate(steps.tolist())]
        scores = first[length].copy()
        for r in np.flatnonzero(foreign | (loss == 0)).tolist():
            found = self.alternatives(units[r], 2)
            ids[r], scores[r], loss[r] = found[0][2], found[0][0], found[0][0] - found[1][0] if len(found) > 1 else np.inf
        self._remember(units, ids, scores, loss)

    def _remember(self, units: list[str], ids: list[bytes], scores: np.ndarray, losses: np.ndarray) -> None:
        start, end = len(self.best_ids), len(self.best_ids) + len(units)
        self.place.update(zip(units, range(start, end)))
        self.best_ids += ids
        if end > len(self.losses):
            self.best_scores, self.losses = np.resize(self.best_scores, 2 * end), np.resize(self.losses, 2 * end)
        self.best_scores[start:end], self.losses[start:end] = scores, losses

    def learn(self, units: set[str]) -> None:
        """Remember new units; a unit with a full stop or comma after letters is made of its two parts."""
        halves = {}
        for unit in units:
            m = "." in unit or "," in unit
            m = m and STOPPED.fullmatch(unit)
            if m and m[1][-1] not in self.joined:
                halves[unit] = m.groups()
        by_length: dict[int, list[str]] = {}
        for unit in {u for u in units if u not in halves} | {h for pair in halves.values() for h in pair if h not in self.place}:
            by_length.setdefault(len(unit), []).append(unit)
        for length, found in by_length.items():
            if length <= LONGEST_TOGETHER:
                for at in range(0, len(found), 8192):
                    self._two_best(found[at:at + 8192])
            else:
                two = [self.segment(u, 2) for u in found]
                self._remember(found, [t[0][2] for t in two], np.array([t[0][0] for t in two]), np.array([t[0][0] - t[1][0] if len(t) > 1 else np.inf for t in two]))
        if halves:
            one, two = (np.array([self.place[pair[k]] for pair in halves.values()]) for k in (0, 1))
            ids = [self.best_ids[a] + self.best_ids[b] for a, b in zip(one.tolist(), two.tolist())]
            self._remember(list(halves), ids, self.best_scores[one] + self.best_scores[two], np.minimum(self.losses[one], self.losses[two]))

    def alternatives(self, unit: str, n: int) -> list[Segmentation]:
        found = self.searched.get(unit)
        if found is None or len(found) < n:
            found = self.segment(unit, n)
            if len(self.searched) >= REMEMBERED // 16:
                self.searched.clear()
            self.searched[unit] = found
        return found[:n]

    def encode_all(self, texts: list[str | None], n: int, with_others: bool = False) -> list[tuple[bytes, list[float], list[bytes]]]:
        """For each text the best ids, the scores of the n best segmentations, and the ids of the others."""
        cut = [self._units(t) if t else [] for t in texts]
        out = []
        for at in range(0, len(cut), 200):
            some = cut[at:at + 200]
            together = set().union(*some)
            new = together.difference(self.place)
            if len(self.place) + 2 * len(new) > REMEMBERED:
                self.forget()
                new = together - {""}
            if new:
                self.learn(new)
            out += [self._combine(units, n, with_others) for units in some]
        return out

    def _units(self, text: str) -> list[str]:
        """The normal form, which has marks for blanks, cut before marks and around line ends."""
        return self.processor.normalize(text).replace(MARK, f" {MARK}").replace("\n", " \n ").split(" ")

    def encode(self, text: str | None, n: int) -> tuple[bytes, list[float], list[bytes]]:
        return self.encode_all([text], n, True)[0]

    def _combine(self, units: list[str], n: int, with_others: bool) -> tuple[bytes, list[float], list[bytes]]:
        if not units:
            return b"", [0.0], []
        places = np.fromiter(map(self.place.__getitem__, units), dtype=np.int64, count=len(units))
        parts = list(map(self.best_ids.__getitem__, places.tolist()))
        score, losses = float(self.best_scores[places].sum()), self.losses[places]
        best = b"".join(parts)
        # a segmentation among the n best changes only units that are among the n - 1 cheapest to change
        cheap = np.argpartition(losses, n - 2)[:n - 1] if 1 < n <= len(losses) else np.arange(len(losses))[:n - 1]
        combined = [(0.0, 0, ())]  # loss, more pieces, changes
        for i in sorted(cheap[np.isfinite(losses[cheap])].tolist()):
            found = self.alternatives(units[i], n)
            top = found[0]
            combined = sorted((loss + top[0] - s, more + count - top[1], changes + ((i, ids),) if rank else changes) for loss, more, changes in combined for rank, (s, count, ids) in enumerate(found))[:n]
        others = []
        for _, _, changes in combined[1:] if with_others else []:
            other = list(parts)
            for i, ids in changes:
                other[i] = ids
            others.append(b"".join(other))
        return best, [score - loss for loss, _, _ in combined], others

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.surface.__getitem__, np.frombuffer(ids, self.dtype).tolist()))
        return (raw[1:] if raw[:1] == b" " else raw).decode(errors="replace")


@functools.lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    """One model in each Python worker; units are remembered within a task."""
    return PieceModel(path)


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def encode_pieces(docs: DataFrame, model: str, nbest: int = 3, with_others: bool = False, with_decoded: bool = False) -> DataFrame:
    """docs with ids (little-endian binary, 16 bits an id, 32 for a larger model) and scores of the nbest.

    with_others: also other_ids, the ids of the second and later segmentations.
    with_decoded: also decoded, the text of ids, in the same pass.
    """
    docs = docs.drop("ids", "scores", "other_ids", "decoded")
    names = docs.columns + ["ids", "scores"] + ["other_ids"] * with_others + ["decoded"] * with_decoded

    def encode(batches):
        pieces = piece_model(model)
        for pdf in batches:
            done = pieces.encode_all(pdf["text"].tolist(), nbest, with_others)
            pdf["ids"], pdf["scores"] = [d[0] for d in done], [d[1] for d in done]
            if with_others:
                pdf["other_ids"] = [d[2] for d in done]
            if with_decoded:
                pdf["decoded"] = [pieces.decode(d[0]) for d in done]
            yield pdf[names]
        pieces.forget()  # the next task of this worker may be another stage's

    return docs.mapInPandas(giving_back(encode), _fields(docs) + ", ids binary, scores array<double>" + ", other_ids array<binary>" * with_others + ", decoded string" * with_decoded)


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """encoded with decoded: the text of ids."""
    encoded = encoded.drop("decoded")
    names = [*encoded.columns, "decoded"]

    def decode(batches):
        pieces = piece_model(model)
        for pdf in batches:
            pdf["decoded"] = [pieces.decode(x) if x is not None else None for x in pdf["ids"]]
            yield pdf[names]

    return encoded.mapInPandas(decode, _fields(encoded) + ", decoded string")


def id_width(model: str) -> int:
    return 2 if sentencepiece.SentencePieceProcessor(model_file=model).get_piece_size() <= 1 << 16 else 4


@query("op10_sentencepiece")
def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: pieces and crc32 of the best segmentation, the scores of the best three, and whether decoding gives the text back."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = encode_pieces(docs, model, with_decoded=True)
    return both.select(
        "doc_id", (F.octet_length("ids") / id_width(model)).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), "scores",
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))
