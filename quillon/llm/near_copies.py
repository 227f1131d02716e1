"""Near-duplicates by the Jaccard similarity of word shingles, beyond the reach of a fingerprint's radius.

A text is the set of its runs of SHINGLE (5) words, words as in simhash; a text with fewer words is one run, one without
words the empty set. Two texts link if their sets have a similarity of SIMILARITY (0.8) or more, counted exactly on 64-bit
hashes of the runs. Equal sets are one node, so copies are never expanded into pairs.

Candidates come from two sides. First the nodes whose SimHash fingerprints pigeonring ties together (simhash.links), each
compared with one node of its group. Then nodes that share one of BANDS (32) keys, each made of ROWS (6) minima; a pair at
0.8 shares none with probability (1 - 0.8^6)^32 = 0.00006, a pair at 0.9 practically never. A key's nodes are compared with
LEADERS of them, one after the other, the one first that has the least share of runs of its own: what differs little from
it links to it, so a large group of near copies needs few comparisons a node. Only nodes of one key that are still in
different components are paired. Pairs left out lie within one component, so no link between components is lost. Before,
pairs go whose intersection cannot be large enough, because too many of their runs are in no other candidate, or because
their bitmaps differ: each run sets one of BITS bits, and a bit that only one of two sets has is a run that only it has.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import LOWER, as_batch, dropped, pieces, raw, written
from quillon.llm.graph import connected

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 6
BITS = 1024  # of a node's bitmap; a much larger set fills it and is compared by counts alone
LEADERS = 3  # nodes that all others of a key are compared with before nodes are paired
PART = 256  # shingles whose minima are taken at a time
ODD = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's runs of `size` words."""
    from xxhash import xxh64_intdigest

    words = (text or b"").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.array([xxh64_intdigest(x) for x in words], np.uint64)
    n, h = max(len(w) - size + 1, 1), np.zeros(1, np.uint64)
    for k in range(min(size, len(w))):
        h = mixed(h + w[k : k + n])
    return np.unique(h)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The keys of a set: BANDS hashes of ROWS minima each; none for the empty set, which equals itself alone."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(len(ODD), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), PART):
        least = np.minimum(least, (hashes[at : at + PART, None] * ODD).min(axis=0))
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = mixed(key + least[k::ROWS])
    return key.view(np.int64)


def majority(hashes: np.ndarray) -> int:
    """The SimHash fingerprint of a set of hashes, as a signed number."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<i8")[0])


def with_nodes(docs: DataFrame, row: str, node: str, n: str, fp: str, keys: str, size: int) -> DataFrame:
    """docs with a number for each row, its set's hash, the set's size, fingerprint and keys, in columns of those names."""

    def run(batches):
        from xxhash import xxh64_intdigest

        for batch in pieces(batches, "text"):
            sets = [shingles(t, size) for t in raw(batch, "text")]
            nodes = pa.array(np.array([xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64))
            held = pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))
            prints = pa.array([majority(s) for s in sets], pa.int64())
            for name, column in ((node, nodes), (n, pa.array([len(s) for s in sets], pa.int64())), (fp, prints), (keys, held)):
                batch = batch.append_column(name, column)
            yield batch

    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    more = [T.StructField(node, T.LongType()), T.StructField(n, T.LongType()), T.StructField(fp, T.LongType()), T.StructField(keys, T.ArrayType(T.LongType()))]
    return numbered.mapInArrow(run, T.StructType([*numbered.schema.fields, *more]))


def similar(pairs: DataFrame, texts: DataFrame, least: float, size: int) -> DataFrame:
    """The pairs (a, b) of nodes whose texts (node, text) have that similarity."""

    def run(batches):
        for batch in pieces(batches, "text", 1 << 20):
            last, mine, keep = None, None, []
            for a, b in zip(raw(batch, "text"), raw(batch, "other"), strict=True):
                if b != last:
                    last, mine = b, shingles(b, size)
                keep.append(similarity(shingles(a, size), mine) >= least)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first = pairs.join(texts.withColumnRenamed("node", "a"), "a")
    return first.join(texts.select(F.col("node").alias("b"), F.col("text").alias("other")), "b").select("a", "b", "text", "other").mapInArrow(run, "a long, b long")


def lone_shingles(texts: DataFrame, size: int) -> DataFrame:
    """node and lone: how many hashes of the text's set no other of the texts (node, text) has."""

    def run(batches):
        schema = pa.schema([("node", pa.int64()), ("hash", pa.int64())])
        for batch in pieces(batches, "text", 1 << 20):
            sets = [shingles(t, size).view(np.int64) for t in raw(batch, "text")]
            nodes = np.repeat(batch.column("node").to_numpy(), [len(s) for s in sets])
            yield as_batch(schema, nodes, np.concatenate(sets))

    held = texts.mapInArrow(run, "node long, hash long").groupBy("hash").agg(F.count("*").alias("many"), F.min("node").alias("node"))
    return held.where("many = 1").groupBy("node").agg(F.count("*").alias("lone"))


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """The bits of a set, as signed numbers."""
    out = np.zeros(BITS, np.uint8)
    out[(hashes >> np.uint64(32)) % np.uint64(BITS)] = 1
    return np.packbits(out, bitorder="little").view("<i8")


def bitmaps(texts: DataFrame, size: int) -> DataFrame:
    """node and bits of the texts (node, text)."""

    def run(batches):
        schema = pa.schema([("node", pa.int64()), ("bits", pa.list_(pa.int64()))])
        for batch in pieces(batches, "text", 1 << 20):
            yield as_batch(schema, batch.column("node"), [bitmap(shingles(t, size)) for t in raw(batch, "text")])

    return texts.mapInArrow(run, "node long, bits array<long>")


def only_in(bits: str, other: str) -> Column:
    """At least so many runs of the set with these bits are not in the other."""
    return reduce(Column.__add__, (F.bit_count(F.get(bits, F.lit(k)).bitwiseAND(F.bitwise_not(F.get(other, F.lit(k))))) for k in range(BITS // 64)))


def shared_keys(nodes: DataFrame) -> DataFrame:
    """node, n and key for the keys of nodes (node, n, keys) that several nodes have, written."""
    members = nodes.select("node", "n", F.explode("keys").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("many")).where("many > 1").select("key")
    return written(members.join(shared, "key"), "members")


def node_roots(members: DataFrame, ties: DataFrame, texts: DataFrame, least: float = SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """node and root for the nodes that link to another. members: node, n, key of nodes that share keys; ties: pairs (a, b)
    to try before; texts: node and text of all of them, written."""
    edges = [written(similar(ties, texts, least, size), "similar")]
    roots = written(connected(edges[0]), "roots")
    # hashes that one candidate has alone are in no intersection: what they leave bounds it. The margin is for floats
    lone = written(lone_shingles(texts, size), "lone")
    common = F.col("n") - F.coalesce("lone", F.lit(0))
    members = members.join(lone, "node", "left").select("key", "node", "n", common.alias("common")).where(common >= F.col("n") * (least - 1e-9))
    bits = written(bitmaps(texts, size), "bits")
    members = still_apart(members.join(bits, "node"), roots)
    enough = lambda both: both * (1 + least) >= (F.col("n") + F.col("m")) * (least - 1e-9)
    may = enough(F.least("common", "c")) & enough(F.col("n") - only_in("bits", "x")) & enough(F.col("m") - only_in("x", "bits"))
    tried = ties
    for turn in range(LEADERS + 1):
        other = members.select("key", F.col("node").alias("b"), F.col("n").alias("m"), F.col("common").alias("c"), F.col("bits").alias("x"), F.col("root").alias("own"))
        if turn < LEADERS:
            plainest = F.min(F.struct(((F.col("n") - F.col("common")) / F.col("n")).alias("alone"), F.col("node").alias("b"))).alias("first")
            parts = members.groupBy("key", "root").agg(F.count("*").alias("many"), plainest)
            if turn:
                main = parts.groupBy("key").agg(F.max_by("root", F.struct("many", "root")).alias("main"))
                parts = parts.join(main, "key").where("root <> main")
            leaders = parts.groupBy("key").agg(F.min("first").alias("first")).select("key", "first.b")
            pairs = members.join(other.join(leaders, ["key", "b"]), "key").where("root <> own")
        else:
            pairs = members.join(other, "key").where("root < own")
        pairs = pairs.where(may).select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
        pairs = written(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            continue
        tried = tried.union(pairs)
        edges.append(written(similar(pairs, texts, least, size), "similar"))
        before, roots = roots, written(connected(reduce(DataFrame.union, edges)), "roots")
        apart = still_apart(members.drop("root"), roots)
        dropped(before, members)
        members = apart
    dropped(lone, bits, members, tried, *edges)
    return roots


def still_apart(members: DataFrame, roots: DataFrame) -> DataFrame:
    """members with their roots, of the keys whose nodes are in several components, written."""
    placed = members.join(roots, "node", "left").select("key", "node", "n", "common", "bits", F.coalesce("root", "node").alias("root"))
    several = placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    return written(placed.join(several, "key"), "apart")
