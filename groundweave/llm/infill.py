"""Fill-in-middle transformation over a compressed set of line ends.

A text's units are its lines (``[^\\n]*\\n|[^\\n]+``). The code points where a unit ends, and 0,
form its boundary set, kept as in a roaring bitmap: values are dealt by their high 16 bits to
containers, each held in the smallest of three forms (a sorted array, a bitmap of 65,536
bits, or runs), with cumulative cardinalities over the containers. The n-th boundary is found
by a search over the cardinalities and a select inside one container.

Two boundaries drawn from a hash of doc_id cut the text into prefix, middle and suffix, which
are written with sentinels in one of two orders: psm (prefix, suffix, middle) or spm (suffix,
prefix, middle). Texts that hold a sentinel, empty ones, and a drawn share stay plain.
``restore`` gives the exact text back.

Null and empty texts are plain and empty with no units. A null doc_id is drawn as the empty
string. Equal rows give equal results.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from groundweave.llm.registry import query, table

SENTINELS = ("<P>", "<S>", "<M>")
SPAN = 1 << 16  # values of one container
WORDS = SPAN // 64
ORDERS = {"psm": "PSM", "spm": "SPM"}


class ArrayContainer:
    """Sorted 16-bit values."""

    def __init__(self, values: np.ndarray):
        self.values = values.astype(np.uint16)

    @staticmethod
    def size(values: np.ndarray, runs: int) -> int:
        return 2 * len(values)

    def select(self, n: int) -> int:
        return int(self.values[n])


class BitmapContainer:
    """65,536 bits in 64-bit words, with the cardinality before each word."""

    def __init__(self, values: np.ndarray):
        bits = np.zeros(SPAN, np.uint8)
        bits[values] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.append(0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64))

    @staticmethod
    def size(values: np.ndarray, runs: int) -> int:
        return SPAN // 8

    def select(self, n: int) -> int:
        at = int(np.searchsorted(self.before, n, side="right")) - 1
        word = int(self.words[at])
        for _ in range(n - int(self.before[at])):
            word &= word - 1  # drops the lowest bit
        return 64 * at + (word & -word).bit_length() - 1


class RunContainer:
    """Starts of runs of consecutive values, with the cardinality before each run."""

    def __init__(self, values: np.ndarray):
        first = np.flatnonzero(np.append(True, np.diff(values) != 1))
        self.starts, self.before = values[first].astype(np.uint16), first

    @staticmethod
    def size(values: np.ndarray, runs: int) -> int:
        return 4 * runs

    def select(self, n: int) -> int:
        at = int(np.searchsorted(self.before, n, side="right")) - 1
        return int(self.starts[at]) + n - int(self.before[at])


class BoundarySet:
    """An ascending set of offsets with select by rank."""

    def __init__(self, offsets: np.ndarray):
        keys = offsets >> 16
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(offsets) else np.zeros(0, np.int64)
        self.keys, self.before = keys[first], np.append(first, len(offsets))
        self.containers = [self._container(offsets[a:b] & (SPAN - 1)) for a, b in zip(self.before, self.before[1:])]

    @staticmethod
    def _container(values: np.ndarray):
        runs = 1 + int(np.count_nonzero(np.diff(values) != 1))
        return min((ArrayContainer, BitmapContainer, RunContainer), key=lambda kind: kind.size(values, runs))(values)

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, n: int) -> int:
        at = int(np.searchsorted(self.before, n, side="right")) - 1
        return (int(self.keys[at]) << 16) + self.containers[at].select(n - int(self.before[at]))


def line_ends(text: str) -> BoundarySet:
    """0 and the code points after each line of the text."""
    ends = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") == 10) + 1
    last = [len(text)] if text and not text.endswith("\n") else []
    return BoundarySet(np.concatenate([[0], ends, last]).astype(np.int64))


def check_sentinels(sentinels: tuple[str, str, str]) -> None:
    """No sentinel may hold, or overlap with, another or itself; else texts can't be told apart again."""
    if not all(sentinels) or len(set(sentinels)) < 3 or any(a in b for a, b in permutations(sentinels, 2)):
        raise ValueError("sentinels must be three strings, none inside another")
    if any(a[-n:] == b[:n] for a in sentinels for b in sentinels for n in range(1, min(len(a), len(b)))):
        raise ValueError("sentinels must not overlap")


def transform(text: str | None, doc_id, seed: int, fim_percent: int, spm_percent: int, sentinels=SENTINELS) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix and middle code points, output) of one text."""
    text = text or ""
    ends = line_ends(text)
    n = len(ends) - 1
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in range(0, 32, 8))
    if not text or any(s in text for s in sentinels) or h3 % 100 >= fim_percent:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = ends.select(low), ends.select(high)
    parts = dict(zip("PSM", ((sentinels[0], text[:a]), (sentinels[1], text[b:]), (sentinels[2], text[a:b]))))
    form = "spm" if h4 % 100 < spm_percent else "psm"
    return n, form, a, b - a, "".join(x for k in ORDERS[form] for x in parts[k])


def restore(output: str, form: str, sentinels=SENTINELS) -> str:
    """The text that ``transform`` was given."""
    if form == "plain":
        return output
    mark, found, rest = dict(zip("PSM", sentinels)), {}, output
    order = ORDERS[form]
    rest = rest[len(mark[order[0]]):]
    for k, after in zip(order, order[1:]):
        found[k], _, rest = rest.partition(mark[after])
    found[order[-1]] = rest
    return found["P"] + found["M"] + found["S"]


def fill_in_middle(docs: DataFrame, seed: int = 7, fim_percent: int = 100, spm_percent: int = 50, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """docs with a struct ``fim``: n, form, prefix_chars, middle_chars (null if plain), output and restored."""
    check_sentinels(sentinels)
    docs = docs.drop("fim")
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").cast("string").alias("id"), "text")

    def cut_up(batches):
        for pdf in batches:
            done = [transform(t, d, seed, fim_percent, spm_percent, sentinels) for d, t in zip(pdf["id"], pdf["text"])]
            pdf["fim"] = [dict(n=n, form=form, prefix_chars=a, middle_chars=b, output=out, restored=restore(out, form, sentinels)) for n, form, a, b, out in done]
            yield pdf[["row", "fim"]]

    fields = "n long, form string, prefix_chars long, middle_chars long, output string, restored string"
    row = packed.schema["row"].dataType.simpleString()
    return packed.mapInPandas(cut_up, f"row {row}, fim struct<{', '.join(f.replace(' ', ':', 1) for f in fields.split(', '))}>").select("row.*", "fim")


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') AS lines,
  CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(lines) AS n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS lo, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS hi,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, n, form, array_to_string(lines[1:lo], '') AS a, array_to_string(lines[lo + 1:hi], '') AS b, array_to_string(lines[hi + 1:n], '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(b) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || s || '<M>' || b ELSE '<S>' || s || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""


@query("op11_fill_in_middle", ORACLE)
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", F.sha2("fim.output", 256).alias("output_sha256"), F.sha2("fim.restored", 256).alias("restored_sha256"))
