"""Ids of whole texts from a tokenizer whose chunks can be encoded apart.

A text is cut at single blanks and line ends where the tokenizer always starts anew. Distinct
new chunks of many texts are joined to lines, encoded by the library in one call each, and
remembered in two generations, so that a full memory keeps what was used lately. Texts that
the cut doesn't suit (special tokens, runs of white space) go to the library as they are.

Two kinds of tokenizer file are told apart and checked on a probe: those that drop white space
and lower-case (``word``), and byte-level ones that keep the blank before a word (``byte``).
"""

from __future__ import annotations

import functools
import os
import re
import sys
from array import array
from unicodedata import is_normalized

import numpy as np
from tokenizers import Tokenizer

GENERATION = 750_000  # chunks in each of two generations
CHARACTERS = 8_000_000  # characters of new chunks in a generation
LINE = 512  # chunks in one line
TOGETHER = 1_000_000  # characters of texts whose new chunks are learnt together
LONGEST = 64  # characters of a remembered chunk; longer ones are encoded each time
TAILS = ".,;:!?"
RUN = re.compile(r"\s\s")
UNSUITED = ("<|", *"\x01\x1c\x1d\x1e\x1f")  # perhaps a special token; the gap's character; blanks for Python only
RARE_BLANKS = "\t\r\v\f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"  # white space but for blank and line end
SINGLE_BLANK = re.compile(r"(?<=\S) (?=\S)")
# byte-level spelling: printable bytes stand for themselves, the others for the characters from 256 on
SPELT = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
BLANK = SPELT[32]
PROBE = ("The word,\n and. oTHER;\tones: é? a!", "It's  we'll\n\n  been 12ab3 ...\r\nx_y  z ", " plain words.\nin two lines", "end\n")


def _unsuited(text: str) -> bool:
    return any(part in text for part in UNSUITED)


def _has_run(text: str) -> bool:
    """Whether white space follows on white space; plain searches are faster than the expression."""
    if any(blank in text for blank in RARE_BLANKS):
        return RUN.search(text) is not None
    return "  " in text or "\n" in text and ("\n\n" in text or " \n" in text or "\n " in text)


class _Generation(dict):
    """chunk -> ids; a chunk that neither generation has gets its number among the new ones."""

    def __init__(self, older: dict):
        super().__init__()
        self.older, self.new = older, []

    def __missing__(self, chunk: str):
        found = self.older.get(chunk)
        if found is None:
            found = len(self.new)
            self.new.append(chunk)
        self[chunk] = found
        return found


class ChunkIds:
    def __init__(self, path: str, dtype: str):
        self.tokenizer, self.dtype, self.width = Tokenizer.from_file(path), dtype, np.dtype(dtype).itemsize
        self.keeps_blanks = self._ids("a b") != self._ids("ab") and len(self._ids("a ")) > len(self._ids("a"))
        self.gap = "\n" if self.keeps_blanks else " \x01 "  # between chunks of a line; no chunk holds its id
        self.gap_ids = self._ids("\n" if self.keeps_blanks else "\x01")
        self.gap_raw, self.tokenize = self._raw(self.gap_ids), self.tokenizer.model.tokenize
        self.code = "H" if self.width == 2 else "I"
        self.tails = {c: self.plain(c) for c in TAILS}
        self.forget()
        ordinary = [self.plain(t) for t in PROBE]
        if sys.byteorder != "little" or len(self.gap_ids) != 1 or self.encode(list(PROBE)) != ordinary:
            raise ValueError(f"{path}: chunks of this tokenizer can't be encoded apart")

    def forget(self) -> None:
        self.known, self.size = _Generation({}), 0
        self._preset()

    def _preset(self) -> None:
        if self.keeps_blanks:
            self.known[""], self.known["\n"] = self.plain(" "), self.gap_raw

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _raw(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=self.dtype).tobytes()

    def plain(self, text: str) -> bytes:
        return self._raw(self._ids(text))

    def _chunks(self, text: str) -> list[str] | None:
        """Chunks of a text; None where the cut doesn't suit it."""
        if _unsuited(text):
            return None
        if not self.keeps_blanks:
            return text.encode().lower().decode().split()
        if _has_run(text):
            return None
        first, *rest = text.replace("\n", " \n").split(" ")
        return ["\n" + first, *rest]

    def _apart(self, text: str) -> bytes:
        """A text with runs of white space: cut at its single blanks only."""
        if not self.keeps_blanks or _unsuited(text):
            return self.plain(text)
        first, *rest = SINGLE_BLANK.split(text)
        return b"".join([self.plain(first), *self._lines([f" {c}" if "\n" not in c else c for c in rest], rest)])

    def _lines(self, bodies: list[str], chunks: list[str]) -> list[bytes]:
        """Ids of bodies, many to a line; a chunk with a line end of its own is encoded alone."""
        alone = [i for i, c in enumerate(chunks) if "\n" in c]
        out: list[bytes] = [b""] * len(bodies)
        for i in alone:
            out[i] = self.plain(" " + chunks[i])
        left = [i for i in range(len(bodies)) if "\n" not in chunks[i]] if alone else range(len(bodies))
        for i, ids in zip(left, self._joined([bodies[i] for i in left])):
            out[i] = ids
        return out

    def _joined(self, bodies: list[str]) -> list[bytes]:
        out, width = [], self.width
        for at in range(0, len(bodies), LINE):
            some = bodies[at:at + LINE]
            ids = np.array(self._ids(self.gap.join(some)), dtype=self.dtype)
            cuts = (np.flatnonzero(ids == self.gap_ids[0]) * width).tolist()
            if len(cuts) != len(some) - 1:
                raise ValueError("a chunk holds the id between chunks")
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *(c + width for c in cuts)], [*cuts, len(raw)])]
        return out

    def _letters(self, word: str, blank: bool) -> bytes:
        """Ids of a run of letters, by the library's model without its steps before that."""
        spelt = word if word.isascii() else word.encode().decode("latin-1").translate(SPELT)
        return array(self.code, [t.id for t in self.tokenize(BLANK + spelt if blank else spelt)]).tobytes()

    def _run(self, word: str) -> bool:
        """Whether the tokenizer takes the word as one run of letters, as it stands."""
        return word.isalpha() and (word.isascii() or self.keeps_blanks or word == word.lower() and is_normalized("NFC", word))

    def _learn(self, chunks: list[str]) -> list[bytes]:
        """Ids of new chunks; a full stop or the like after letters is encoded apart from them."""
        known, older, blank, run, letters = self.known, self.known.older, self.keeps_blanks, self._run, self._letters
        out, others = [b""] * len(chunks), []
        for i, c in enumerate(chunks):
            tail = self.tails.get(c[-1], b"")
            word = c[:-1] if tail else c
            first = word[:1] == "\n"
            if run(word[1:] if first else word):
                ids = known.get(word) if tail else None
                if ids.__class__ is not bytes:
                    ids = tail and older.get(word) or (self.gap_raw + letters(word[1:], False) if first else letters(word, blank))
                    if tail and len(word) <= LONGEST:
                        known[word] = ids
                out[i] = ids + tail
            else:
                others.append(i)
        if others:
            bodies = [chunks[i] for i in others]
            found = self._joined([b[1:] if b[0] == "\n" else f" {b}" for b in bodies] if blank else bodies)
            for i, c, ids in zip(others, bodies, found):
                out[i] = self.gap_raw + ids if blank and c[0] == "\n" else ids
        for c, ids in zip(chunks, out):
            if len(c) <= LONGEST:
                known[c] = ids
            else:
                known.pop(c, None)
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as bytes; null is empty."""
        out, first, size = [], 0, 0
        for at, text in enumerate(texts, 1):
            size += len(text or "")
            if size >= TOGETHER or at == len(texts):
                out += self._encode(texts[first:at])
                first, size = at, 0
        return out

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > GENERATION or self.size > CHARACTERS:
            self.known.older = {}
            self.known, self.size = _Generation(self.known), 0
            self._preset()
        get, cut, parts = self.known.__getitem__, self.width if self.keeps_blanks else 0, []
        for text in texts:
            chunks = self._chunks(text) if text else []
            parts.append(None if chunks is None else list(map(get, chunks)))
        new, self.known.new = self.known.new, []
        self.size += sum(map(len, new))
        found = self._learn(new) if new else []
        out = []
        for text, some in zip(texts, parts):
            if some is None:
                out.append(self._apart(text))
                continue
            if found:
                some = [p if p.__class__ is bytes else found[p] for p in some]
            out.append(b"".join(some)[cut:] if some else b"")
        return out


@functools.lru_cache(maxsize=1)
def chunk_ids(path: str, dtype: str) -> ChunkIds:
    """One encoder in each Python worker; its memory is bounded by the generations."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return ChunkIds(path, dtype)


def id_type(path: str, end: int = 0) -> str:
    """Little-endian unsigned type that holds every id."""
    return "<u2" if max(Tokenizer.from_file(path).get_vocab_size() - 1, end) < 1 << 16 else "<u4"
