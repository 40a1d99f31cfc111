"""Token ids as flat binary files with 64-bit document offsets.

Rows are sorted by doc_id into parts (nulls first, equal ids by text). A part has
``tokens-N.bin``, its documents' ids one after another as little-endian unsigned integers
of 16 bits, or 32 where the vocabulary needs them, and ``index-N.bin``, little-endian
64-bit integers: for each document its doc_id, whether it has one, and its start in the
whole stream, and at the end the start of what follows. A part's base is the prefix sum of
the parts before it. ``MANIFEST.json`` in the same folder names the width and the bases.

A task writes under its own temporary name and renames, so repeated and speculative tasks
leave whole files. The folder must be mounted on every machine (a ``file:`` path in
spark.checkpoint.dir), since files are memory-mapped for reading.

Null and empty texts are a document of the end id alone; an empty table gives no parts.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from itertools import accumulate
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from groundweave.llm.chunks import chunk_ids, id_type
from groundweave.llm.registry import query, table
from groundweave.session import cut, scratch_path

def _mounted(uri: str) -> str:
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{uri}: token files are memory-mapped; they need a mounted folder (file:)")
    return parts.path


def _write_whole(path: str, arrays) -> None:
    temporary = f"{path}.{uuid.uuid4().hex}"
    with open(temporary, "wb") as out:
        for a in arrays:
            out.write(a)
    os.replace(temporary, path)


def write_tokens(docs: DataFrame, tokenizer: str, end: int, folder: str | None = None) -> str:
    """Encode every text, append the end id, and write the files; returns the folder."""
    spark = docs.sparkSession
    folder = _mounted(folder or scratch_path(spark, "tokens"))
    os.makedirs(folder, exist_ok=True)
    dtype = id_type(tokenizer, end)

    def write(batches):
        encoder, part = chunk_ids(tokenizer, dtype), TaskContext.get().partitionId()
        final = np.array([end], dtype=dtype).tobytes()
        path = f"{folder}/tokens-{part:06d}.bin"
        temporary, at = f"{path}.{uuid.uuid4().hex}", 0
        out = None
        for pdf in batches:
            if out is None:
                out = open(temporary, "wb")
            counts = []
            for ids in encoder.encode(pdf["text"].tolist()):
                out.write(ids)
                out.write(final)
                counts.append(len(ids) // np.dtype(dtype).itemsize + 1)
            yield pd.DataFrame({"part": part, "at": np.arange(at, at + len(pdf)), "doc_id": pdf["doc_id"].astype("Int64"), "n": counts})
            at += len(pdf)
        if out is not None:
            out.close()
            os.replace(temporary, path)

    slim = docs.select(F.col("doc_id").cast("long"), "text")
    parts = max(1, slim.rdd.getNumPartitions())  # as many as the input's splits
    ordered = slim.repartitionByRange(parts, "doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    counts = cut(ordered.mapInPandas(write, "part int, at long, doc_id long, n long"), "token-counts")
    totals = counts.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # a row for each part
    bases = dict(zip((r["part"] for r in totals), accumulate((r["n"] for r in totals), initial=0)))

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, part = pdf.sort_values("at"), int(pdf["part"].iloc[0])
        ends = bases[part] + np.cumsum(pdf["n"].to_numpy(dtype=np.int64))
        starts = np.concatenate([[bases[part]], ends])
        known = pdf["doc_id"].notna().to_numpy()
        rows = np.column_stack([pdf["doc_id"].fillna(0).to_numpy(dtype=np.int64), known.astype(np.int64), starts[:-1]])
        _write_whole(f"{folder}/index-{part:06d}.bin", [rows.astype("<i8").tobytes(), starts[-1:].astype("<i8").tobytes()])
        return pd.DataFrame({"part": [part]})

    cut(counts.groupBy("part").applyInPandas(index, "part int"), "token-index")
    _write_whole(f"{folder}/MANIFEST.json", [json.dumps({"dtype": dtype, "end": end, "parts": {f"{p:06d}": b for p, b in bases.items()}}).encode()])
    return folder


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the memory-mapped files."""
    with open(f"{folder}/MANIFEST.json") as f:
        manifest = json.load(f)
    dtype, parts = manifest["dtype"], list(manifest["parts"].items())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not parts:
        return spark.createDataFrame([], schema)

    def read(batches):
        for pdf in batches:
            for part, base in zip(pdf["part"], pdf["base"]):
                index = np.memmap(f"{folder}/index-{part}.bin", dtype="<i8", mode="r")
                ids = np.memmap(f"{folder}/tokens-{part}.bin", dtype=dtype, mode="r")
                rows, last = index[:-1].reshape(-1, 3), index[-1:]
                ends = np.concatenate([rows[1:, 2], last])
                for at in range(0, len(rows), 8192):
                    some, until = np.array(rows[at:at + 8192]), np.array(ends[at:at + 8192])
                    crcs = [zlib.crc32(ids[a - base:b - base].astype("<u4").tobytes()) for a, b in zip(some[:, 2].tolist(), until.tolist())]
                    yield pd.DataFrame({
                        "doc_id": pd.arrays.IntegerArray(some[:, 0], some[:, 1] == 0),
                        "start": some[:, 2], "n_tokens": until - some[:, 2], "ids_crc32": crcs})

    listed = spark.createDataFrame(parts, "part string, base long").repartition(len(parts), "part")
    return listed.mapInPandas(read, schema)


@query("op4_token_files")
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=2)
    return read_tokens(spark, folder)
