"""SimHash near-duplicates with a pigeonring filter.

A fingerprint takes the majority of the XXH64 bits of a text's 3-word shingles. Fingerprints link at RADIUS (3) bits or
fewer. The 64 bits form a ring of SEGMENTS (4): two linked fingerprints have a segment from which every chain of l
consecutive segments differs in at most floor(l * 3 / 4) bits: 0, 1, 2, 3. So the equal segment and the next one with
at most one bit turned are an equi-join key of 32 bits; the chain of three and the full distance follow.

Equal fingerprints are one node, so copies are never expanded into pairs. A key that more than HOT nodes share is not
joined in pairs: its nodes meet in points of Hamming space instead. a and b link exactly if a point lies within 1 bit
of a and 2 of b; all that meet in a point are tied to its smallest a. That is linear in the nodes and loses no link.

Null and empty texts have fingerprint zero. Null ids may link other documents but are never a component_id, unless all
ids of a component are null. Repeated rows each get their row; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import near_copies
from quillon.llm.common import LOWER, all_columns, as_batch, dropped, pieces, raw, small_side, unused, written
from quillon.llm.graph import connected

SHINGLE, SEED, RADIUS, SEGMENTS = 3, 42, 3, 4
WIDTH = 64 // SEGMENTS
HOT = 256


def fingerprint(text: bytes | None) -> int:
    """The text's fingerprint as an unsigned number."""
    from xxhash import xxh64_intdigest

    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    n = max(len(words) - SHINGLE + 1, 1)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        end = min(at + (1 << 16), n)
        runs = [words[at + k : end + k] for k in range(SHINGLE)] if len(words) >= SHINGLE else [[w] for w in words]
        h = np.array([xxh64_intdigest(b" ".join(s), SEED) for s in zip(*runs, strict=True)], "<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((1 << np.arange(64, dtype=object))[2 * votes > n].sum())


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed number) for every row of docs (doc_id, text)."""

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
        for batch in pieces(batches, "text"):
            fp = np.array([fingerprint(t) for t in raw(batch, "text")], np.uint64)
            yield as_batch(schema, batch.column("doc_id"), fp.view(np.int64))

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, fp long")


def segment(fp: str, k: int):
    return F.shiftrightunsigned(fp, WIDTH * (k % SEGMENTS)).bitwiseAND(F.lit((1 << WIDTH) - 1))


def ring_key(fp: str, k: int):
    """Start of the chain, its segment and the next one, in one number."""
    return F.lit(k << 2 * WIDTH) + segment(fp, k) * (1 << WIDTH) + segment(fp, k + 1)


def chain_holds():
    """Whether the three segments from `start` on differ in at most 2 bits and all four in at most RADIUS."""
    differ = F.col("a").bitwiseXOR(F.col("b"))
    rest = F.expr(f"shiftrightunsigned(a ^ b, cast({WIDTH} * ((start + 3) % {SEGMENTS}) as int)) & {(1 << WIDTH) - 1}")
    return (F.bit_count(differ) - F.bit_count(rest) <= (SEGMENTS - 1) * RADIUS // SEGMENTS) & (F.bit_count(differ) <= RADIUS)


def links(nodes: DataFrame, hot: int = HOT) -> DataFrame:
    """Pairs (a, b) of the distinct fingerprints nodes (fp) that tie together all within RADIUS bits."""
    starts = F.array(*[F.struct(F.lit(k).alias("start"), ring_key("fp", k).alias("key")) for k in range(SEGMENTS)])
    index = nodes.select("fp", F.inline(starts))
    # a turned bit is looked for from the side where it is 0; where the next segments are equal too, a pair is taken once
    turned = F.filter(F.transform(F.array(*[F.lit(1 << b) for b in range(WIDTH)]), lambda bit: F.when(F.col("key").bitwiseAND(bit) == 0, F.col("key").bitwiseOR(bit))), lambda k: k.isNotNull())
    probe = index.select("fp", "start", F.posexplode(F.concat(F.array("key"), turned)).alias("place", "key")).withColumn("turned", F.col("place") > 0)
    crowded = written(index.groupBy("key").count().where(F.col("count") > hot).select("key"), "hot-keys")
    rare = lambda side: side.join(crowded, "key", "left_anti")
    near = rare(probe).withColumnRenamed("fp", "a").join(rare(index).selectExpr("fp b", "key"), "key").where("a <> b and (turned or a > b)").where(chain_holds()).select("a", "b")
    if crowded.isEmpty():
        return near
    ones, twos = index.join(crowded, "key", "left_semi").select("fp").distinct(), probe.join(crowded, "key", "left_semi").select("fp").distinct()
    bits = F.array(F.lit(0), *[F.lit(1 << b if b < 63 else -(1 << 63)) for b in range(64)]).cast("array<long>")
    ones = written(ones.select("fp", F.explode(F.transform(bits, lambda x: F.col("fp").bitwiseXOR(x))).alias("point")), "points")
    least = written(ones.groupBy("point").agg(F.min("fp").alias("a")), "least-points")
    twos = twos.select("fp", F.explode(bits).alias("x")).select("fp", F.explode(F.transform(bits, lambda y: F.col("fp").bitwiseXOR(F.col("x")).bitwiseXOR(y))).alias("point"))
    met = ones.union(twos).join(least, "point").selectExpr("a", "fp b").where("a <> b").distinct()
    return near.union(met)


def components(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """fp, root (the component's smallest fingerprint) and component_id for each fingerprint of the written table prints."""
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = connected(links(nodes.select("fp"), hot))
    placed = written(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "placed")
    ids = written(placed.groupBy("root").agg(F.min("least").alias("component_id")), "ids")
    return written(placed.join(ids, "root").select("fp", "root", "component_id"), "components")


def near_duplicates(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, fp and component_id for every row of docs."""
    prints = written(fingerprints(docs), "fingerprints")
    return prints.join(components(prints, hot), "fp").select("doc_id", "fp", "component_id")


def simhash_digest(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint as 16 hex digits, component_id."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def tied(nodes: DataFrame, hot: int = HOT) -> DataFrame:
    """Pairs (a, b) of nodes (node, fp), a < b: each node whose fingerprint others are tied to, with the first of its group."""
    roots = written(connected(links(nodes.select("fp").distinct(), hot)), "fp-roots")
    placed = nodes.select("node", "fp").join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("node", F.coalesce("root", "fp").alias("root"))
    groups = placed.groupBy("root").agg(F.min("node").alias("a"), F.count("*").alias("many")).where("many > 1")
    pairs = written(placed.join(groups, "root").where("node <> a").select("a", F.col("node").alias("b")), "ties")
    dropped(roots)
    return pairs


def deduplicate(docs: DataFrame, least: float = near_copies.SIMILARITY, size: int = near_copies.SHINGLE, hot: int = HOT) -> DataFrame:
    """One row of docs for each component of texts whose sets of `size`-word shingles have a similarity of `least` or more,
    all columns as they are. Fingerprints of the sets within RADIUS bits are tried first, by the same pigeonring filter as
    above; near_copies finds the rest and decides.

    The row of the component's smallest id stays. Of rows that share that id the one whose set has the smallest hash stays,
    then the one whose text has; of rows with the same id and text any one. Null ids may link other documents; a row
    without id stays only if all ids of its component are null. Null and empty texts are one empty set.
    """
    row, node, n, fp, keys = (unused(x, docs) for x in ("row_number", "node", "n_shingles", "fp", "keys"))
    marked = written(near_copies.with_nodes(docs, row, node, n, fp, keys, size), "marked")
    text = F.col("text").cast("string")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").cast("long").alias("id"), F.col(node).alias("node"), F.xxhash64(text).alias("t"), F.col(row).alias("row"))
    nodes = written(marked.groupBy(F.col(node).alias("node")).agg(F.min(rank).alias("best"), F.first(n).alias("n"), F.first(fp).alias("fp"), F.first(keys).alias("keys")), "nodes")
    ties = tied(nodes.where("n > 0"), hot)
    members = near_copies.shared_keys(nodes.select("node", "n", "keys"))
    tried = members.select("node").union(ties.select("a")).union(ties.select("b")).distinct()
    own = written(nodes.join(tried, "node").select(F.col("best.row").alias("r")), "candidates")
    texts = written(marked.select(F.col(row).alias("r"), F.col(node).alias("node"), text.alias("text")).join(small_side(own), "r", "left_semi").select("node", "text"), "texts")
    roots = near_copies.node_roots(members, ties, texts, least, size)
    dropped(members, own, texts, ties)
    placed = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "best")
    kept = written(placed.groupBy("root").agg(F.min_by("best.row", "best").alias("keep")).select("root", "keep"), "kept")
    stays = placed.join(kept, "root").select(F.col("node").alias(node), "keep")
    gone = written(marked.select(row, node).join(stays, node).where(F.col(row) != F.col("keep")).select(row), "gone")
    return marked.join(small_side(gone), row, "left_anti").select(*all_columns(docs))
