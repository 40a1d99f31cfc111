"""Near-duplicate groups by one-permutation MinHash.

A text's set is its distinct word shingles. One permutation of the shingle hashes is cut
into bins; a bin keeps its smallest hash and an empty bin copies that of the first
non-empty bin in its own random order of probes (optimal densification). Bands of bins
make bucket keys. In a bucket every member gets one candidate edge to the bucket's
smallest member, so the candidates grow with the members and not with their pairs. Edges
are confirmed on the full sets.

Texts with equal sets are one class before the buckets are made, so that exact copies cost
one member. A star can miss a link between two members that are both unlike its centre:
components that still share a bucket after the first round are compared with each other on
their members' full sets, block by block inside tasks, without pairing members as rows.

With 40 bands of 6 bins a pair of similarity 0.8 shares no bucket with probability
(1 - 0.8**6)**40 = 5e-6.

Rows with null text or without words have an empty set and are linked with nothing. A null
doc_id is linked with nothing and stays. Rows of one doc_id and one text are one document.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from groundweave.llm.components import components
from groundweave.llm.registry import giving_back, query, table
from groundweave.llm.words import WordHashes, mix, shingles, words
from groundweave.session import bounded, cut

BANDS, ROWS = 40, 6
PROBES = 32  # probes tried at once for the bins still empty
BLOCK = 500_000  # shingles of one side of a block comparison: 4 MB
LARGE = 64  # members from which on a component is met as a whole


class Signer:
    """Signatures of ``bands * rows`` bins."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        self.salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        self.weights = mix(np.arange(1000, 1000 + rows, dtype=np.uint64)) | np.uint64(1)

    def probes(self, bins: np.ndarray, start: int) -> np.ndarray:
        """The probes start, start + 1, ... of the given bins."""
        at = bins.astype(np.uint64)[:, None] * np.uint64(1 << 32) + np.arange(start, start + PROBES, dtype=np.uint64)[None, :]
        return (mix(at + np.uint64(77)) % np.uint64(self.bins)).astype(np.int64)

    def signature(self, distinct: np.ndarray) -> np.ndarray:
        """distinct: sorted shingle hashes, at least one. The bin is the hash's high part, so bins are runs."""
        bins = ((distinct >> np.uint64(32)) * np.uint64(self.bins) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.diff(bins, prepend=-1))
        out = np.zeros(self.bins, dtype=np.uint64)
        full = np.zeros(self.bins, dtype=bool)
        out[bins[first]], full[bins[first]] = distinct[first], True
        empty, start = np.flatnonzero(~full), 0
        while len(empty):  # ends: each bin's probes come by every bin
            tried = self.probes(empty, start)
            hit = full[tried]
            found = hit.any(axis=1)
            out[empty[found]] = out[tried[found, hit[found].argmax(axis=1)]]
            empty, start = empty[~found], start + PROBES
        return out

    def keys(self, signature: np.ndarray) -> np.ndarray:
        """One bucket key a band."""
        rows = mix(signature.reshape(self.bands, self.rows)) * self.weights
        return mix(rows.sum(axis=1, dtype=np.uint64) + self.salt).view(np.int64)


def signatures(docs: DataFrame, size: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, a hash of the text, n_shingles, the set's 128-bit digest and its bucket keys."""

    def sign(batches):
        hashes, signer = WordHashes(), Signer(bands, rows)
        for pdf in batches:
            out = []
            for doc, text, key in zip(pdf["doc_id"], pdf["text"], pdf["text_hash"]):
                found = shingles(hashes.of(words(text)), size)
                if not len(found):
                    out.append((doc, key, 0, None, None))
                    continue
                out.append((doc, key, len(found), xxhash.xxh3_128_digest(found.tobytes()), signer.keys(signer.signature(found))))
            frame = pd.DataFrame(out, columns=["doc_id", "text_hash", "n_shingles", "digest", "keys"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    slim = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    return slim.mapInPandas(giving_back(sign), "doc_id long, text_hash long, n_shingles long, digest binary, keys array<long>")


def confirm(edges: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The edges (a, b) whose full sets agree: 100 * intersection >= percent * union."""
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")

    def side(name: str) -> DataFrame:
        wanted = bounded(edges.select(F.col(name).alias("id")).distinct())
        return texts.join(wanted, "id", "left_semi").select(F.col("id").alias(name), F.col("text").alias(f"text_{name}"))

    def check(batches):
        hashes, centres = WordHashes(), {}
        for pdf in batches:
            keep = []
            for b, text_a, text_b in zip(pdf["b"], pdf["text_a"], pdf["text_b"]):
                if b not in centres or centres[b][0] != text_b:
                    if len(centres) >= 64:
                        centres.clear()
                    centres[b] = (text_b, shingles(hashes.of(words(text_b)), size))
                mine, other = shingles(hashes.of(words(text_a)), size), centres[b][1]
                common = len(np.intersect1d(mine, other, assume_unique=True))
                keep.append(100 * common >= percent * (len(mine) + len(other) - common))
            yield pdf.loc[keep, ["a", "b"]]

    paired = edges.join(side("a"), "a").join(side("b"), "b")
    return paired.select("a", "b", "text_a", "text_b").mapInPandas(giving_back(check), "a long, b long").distinct()


def _alike(percent: int):
    """Sets whose sizes differ too much can't agree."""
    return 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")


def _overlaps(sets: list[np.ndarray]):
    """For a list of sets: a function that counts what another set has in common with each."""
    lengths, joined = np.array([len(x) for x in sets]), np.concatenate(sets)
    order = np.argsort(joined, kind="stable")
    owners = np.repeat(np.arange(len(sets)), lengths)[order]
    values, start, count = np.unique(joined[order], return_index=True, return_counts=True)

    def common(mine: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(values, mine), len(values) - 1)
        at = at[values[at] == mine]
        found = [owners[i:i + k] for i, k in zip(start[at].tolist(), count[at].tolist())]
        return np.bincount(np.concatenate(found), minlength=len(sets)) if found else np.zeros(len(sets), np.int64)

    return common, lengths


def _every(count: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), count - 1))


def _block(count: Column) -> Column:
    return F.pmod(F.xxhash64("id"), count).cast("int")


def links_in_buckets(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join components inside each bucket; rows: key, id, n, component.

    A bucket's members are compared inside one task, or in block pairs where their sets
    exceed BLOCK; a task yields a spanning forest of the links it finds.
    """
    several = rows.groupBy("key").agg((F.min("component") < F.max("component")).alias("open"), F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks")).where("open")
    dealt = rows.join(several, "key").withColumn("mine", _block(F.col("blocks"))).withColumn("other", _every(F.col("blocks")))
    tasks = dealt.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "id", "component").join(sets, "id")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids, parent, found = pdf["id"].tolist(), {c: c for c in pdf["component"]}, []
        component = pdf["component"].tolist()

        def root(c):
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        sets = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
        common, lengths = _overlaps(sets)
        for x, mine in enumerate(sets):
            shared = common(mine)
            for y in np.flatnonzero(100 * shared >= percent * (lengths + len(mine) - shared)).tolist():
                left, right = root(component[x]), root(component[y])
                if left != right:
                    parent[max(left, right)] = min(left, right)
                    found.append((ids[x], ids[y]))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return tasks.groupBy("key", "i", "j").applyInPandas(compare, "a long, b long")


def links_to_large(rows: DataFrame, groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between a large component and another one that shares a bucket with it.

    rows: key, component, members. groups: id, n, component. The large component's members
    are dealt into blocks of bounded bytes and the other components' are brought to each
    block; a task yields at most one link for a member of the others.
    """
    met = rows.select("key", F.struct("members", "component").alias("at")).distinct()
    pairs = cut(
        met.where(F.col("at.members") > LARGE).withColumnRenamed("at", "big").join(met.withColumnRenamed("at", "small"), "key").where("big > small")
        .select(F.col("big.component").alias("big"), F.col("small.component").alias("small")).distinct(), "component-pairs")
    sizes = groups.groupBy("component").agg(F.sum("n").alias("shingles"))
    guests = pairs.join(sizes.withColumnRenamed("component", "small"), "small").groupBy("big").agg(F.sum("shingles").alias("guest_shingles"))
    blocks = cut(
        guests.join(sizes.withColumnRenamed("component", "big"), "big")
        .select("big", F.ceil(F.col("shingles") / BLOCK).cast("int").alias("home_blocks"), F.ceil(F.col("guest_shingles") / BLOCK).cast("int").alias("guest_blocks")), "blocks")
    member = groups.select("id", "component").join(sets, "id")
    home = blocks.join(member.withColumnRenamed("component", "big"), "big").select("big", _block(F.col("home_blocks")).alias("home"), _every(F.col("guest_blocks")).alias("guest"), F.lit(True).alias("at_home"), "id", "shingles")
    visiting = blocks.join(pairs, "big").join(member.withColumnRenamed("component", "small"), "small").select("big", _every(F.col("home_blocks")).alias("home"), _block(F.col("guest_blocks")).alias("guest"), F.lit(False).alias("at_home"), "id", "shingles")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        at_home, guests = pdf[pdf["at_home"]], pdf[~pdf["at_home"]]
        if len(at_home) and len(guests):
            ids = at_home["id"].tolist()
            common, lengths = _overlaps([np.frombuffer(x, np.uint64) for x in at_home["shingles"]])
            for guest, raw in zip(guests["id"].tolist(), guests["shingles"]):
                mine = np.frombuffer(raw, np.uint64)
                shared = common(mine)
                linked = np.flatnonzero(100 * shared >= percent * (lengths + len(mine) - shared))
                if len(linked):
                    found.append((guest, ids[linked[0]]))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return home.union(visiting).groupBy("big", "home", "guest").applyInPandas(compare, "a long, b long")


def _sets(ids: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """id and the sorted distinct shingle hashes of the ids' texts."""

    def build(batches):
        hashes = WordHashes()
        for pdf in batches:
            pdf["shingles"] = [shingles(hashes.of(words(t)), size).tobytes() for t in pdf["text"]]
            yield pdf[["id", "shingles"]]

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(bounded(ids), "id", "left_semi")
    return texts.mapInPandas(giving_back(build), "id long, shingles binary")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept, text_hash (xxhash64 of the text).

    size: words of a shingle. percent: the similarity that links two sets, in hundredths.
    component_id: smallest doc_id reachable over links. kept: doc_id = component_id.
    """
    signed = cut(signatures(docs, size, bands, rows), "signatures")
    usable = signed.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    classes = cut(usable.groupBy("digest").agg(F.min("doc_id").alias("id"), F.any_value("n_shingles").alias("n"), F.any_value("keys").alias("keys")), "classes")
    members = classes.select("id", "n", F.explode("keys").alias("key"))
    stars = members.groupBy("key").agg(F.min(F.struct("id", "n")).alias("centre"), F.count("*").alias("in_bucket")).where("in_bucket > 1")
    # the buckets' members with their stars' centres; most keys have one member and end here
    crowded = cut(members.join(stars, "key").select("key", "id", "n", F.col("centre.id").alias("centre"), F.col("centre.n").alias("centre_n"), "in_bucket"), "buckets")
    spokes = crowded.where("id <> centre").select(F.col("id").alias("a"), F.col("centre").alias("b"), F.col("n").alias("n_a"), F.col("centre_n").alias("n_b")).where(_alike(percent))
    tested = cut(spokes.select("a", "b").distinct(), "candidates")
    links = cut(confirm(tested, docs, size, percent), "links")
    groups = cut(components(links), "components")

    # Buckets over several components: compare across components what no star has compared.
    placed = crowded.where("in_bucket > 2").select("key", "id", "n").join(groups, "id", "left").withColumn("component", F.coalesce("component_id", "id")).drop("component_id")
    spread = placed.groupBy("key").agg((F.min("component") < F.max("component")).alias("open")).where("open").select("key")
    opened = cut(placed.join(spread, "key", "left_semi"), "open-buckets")
    if not opened.isEmpty():
        inside = classes.select("id", "n").join(groups, "id", "left").withColumn("component", F.coalesce("component_id", "id"))
        inside = cut(inside.join(opened.select("component").distinct(), "component", "left_semi").select("id", "n", "component"), "open-members")
        sets = cut(_sets(inside.select("id"), docs, size), "open-sets")
        sizes = inside.groupBy("component").agg(F.count("*").alias("members"))
        opened = cut(opened.join(sizes, "component"), "open-sized")
        found = links_in_buckets(opened.where(F.col("members") <= LARGE).select("key", "id", "n", "component"), sets, percent)
        found = found.union(links_to_large(opened.select("key", "component", "members"), inside, sets, percent))
        groups = cut(components(links.union(found)), "components")

    named = classes.select("digest", "id").join(groups, "id", "left").select("digest", F.coalesce("component_id", "id").alias("class_component"))
    return (
        signed.select("doc_id", "text_hash", "n_shingles", "digest").join(named, "digest", "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_component", "doc_id")))
        .select("doc_id", "n_shingles", "component_id", (F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id"))).alias("kept"), "text_hash")
    )


ORACLE = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS shingle FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM split WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) m USING (doc_id)
"""


@query("op1_near_duplicates", ORACLE)
def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=4).drop("text_hash")
