"""SentencePiece encoding and decoding as a relational lattice.

A text (with the space mark for spaces and one in front) falls into units: a run of space marks and the characters up
to the next one. No piece reaches over the end of a unit, so each distinct unit is encoded once: its substrings of at
most the longest piece's length are joined by equality to the piece table, the edges found are kept by unit, and a fold
takes the best path over them. For a BPE model the best path is the one that greedy merging takes (highest score first,
leftmost of equals), for which each fold step joins the two neighbours whose lattice edge scores highest; for a unigram
model it is the Viterbi path of the highest sum. Characters without a piece become their byte pieces, or the unknown
piece. Units of over FOLD_CHARS characters, such as whole texts without spaces, are cut where no piece spans two
characters and folded in stretches; longer stretches take the same path with a heap, in linear-logarithmic time.

``encode`` does this in Arrow batches: explode, join and fold are array operations over all new units of a batch, a
worker remembers brief units up to KNOWN_BYTES, and nothing is shuffled. ``encode_relational`` has the lattice as Spark
tables and the fold as a higher-order aggregate; there, texts and the ids of their units meet by block of about
BLOCK_BYTES. Both give the same rows.

Null and empty texts have no pieces and decode to the empty text. Repeated rows each get their row; extra columns are
not read. A space mark (U+2581) in a text decodes to a space, as in the library.
"""

from __future__ import annotations

import heapq
import pickle
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import as_batch, pieces, written

MARK = "▁"
UNIT = re.compile(MARK + "*[^" + MARK + "]+|" + MARK + "+")
FOLD_CHARS = 48
FOLD_UNITS = 8_000  # units folded at once
BATCH_BYTES = 1 << 20  # text encoded at a time
KNOWN_BYTES, UNIT_BYTES = 48 << 20, 230  # bound of the units that a worker remembers, and what one costs beside its text and ids
PART_CHARS = 1 << 17  # characters of a long unit folded at once
NO_RANK = 1 << 30
BLOCK_BYTES = 48 << 20
MAX_PIECES = 1_000_000  # size checked before the piece table is broadcast
OUT = "doc_id long, ids array<int>, decoded string"


def load_pieces(path: str) -> list[tuple[int, str, float, str]]:
    """(id, piece, score, kind: normal, byte, unknown or control) of a model file."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: "byte" if m.is_byte(i) else "unknown" if m.is_unknown(i) else "control" if m.is_control(i) else "normal"
    return [(i, m.id_to_piece(i), m.get_score(i), kind(i)) for i in range(m.get_piece_size())]


def checked(table_rows: list) -> None:
    """Raises where a piece table is too large or breaks what the lattice relies on."""
    if len(table_rows) > MAX_PIECES:
        raise ValueError(f"more than {MAX_PIECES} pieces are not broadcast")
    if any(MARK in p.lstrip(MARK) for _, p, _, kind in table_rows if kind == "normal"):
        raise ValueError("a piece reaches over a space")
    bytes_at = sorted(i for i, *_, kind in table_rows if kind == "byte")
    if len(bytes_at) not in (0, 256) or bytes_at and bytes_at[-1] - bytes_at[0] != 255:
        raise ValueError("byte pieces must have 256 consecutive ids")


def surfaces(table_rows: list) -> list[bytes]:
    """The bytes that each id decodes to."""
    return [bytes([int(p[3:5], 16)]) if kind == "byte" else p.encode() if kind == "normal" else b"" if kind == "control" else " ⁇ ".encode() for _, p, _, kind in table_rows]


def normalised(text: Column) -> Column:
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(text == "", "").otherwise(F.concat(F.lit(MARK), F.replace(text, F.lit(" "), F.lit(MARK))))


def units_of(text: Column) -> Column:
    return F.regexp_extract_all(normalised(text), F.lit(UNIT.pattern), 0)


def lattice(units: DataFrame, table: DataFrame, longest: int, brief: bool) -> DataFrame:
    """unit, n (characters) and edges (array of begin, stop, id, score) of the distinct units (unit). Substrings of brief
    units are cut from the text itself, of others from their characters, which takes no longer at the end of a long one."""
    cut_out = (lambda at, size: F.substring("unit", at + 1, size)) if brief else (lambda at, size: F.array_join(F.slice("chars", at + 1, size), ""))
    # dealt out by unit here, while it is only the unit, so that its edges are grouped where they are made; into a fixed
    # number of parts, since units are small in bytes but each takes long
    parts = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chars = units.repartition(parts, "unit").select("unit", F.split("unit", "").alias("chars")).select("unit", F.array_remove("chars", "").alias("chars"))
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.size("chars") - 1),
            lambda at: F.transform(
                F.sequence(F.lit(1), F.least(F.lit(longest), F.size("chars") - at)),
                lambda size: F.struct(at.alias("begin"), (at + size).alias("stop"), cut_out(at, size).alias("piece")),
            ),
        )
    )
    cut = chars.select("unit", F.size("chars").alias("n"), F.explode(spans).alias("s")).select("unit", "n", "s.*")
    edges = cut.join(F.broadcast(table), "piece", "left").where("id is not null or stop = begin + 1")
    edge = F.struct("begin", "stop", "id", "score")
    return edges.groupBy("unit").agg(F.max("n").alias("n"), F.collect_list(F.when(F.col("id").isNotNull(), edge)).alias("edges"))


def once(name: str, value: Column) -> Column:
    """value, which reads the column inside a lambda. A second reading keeps the optimizer from moving the column's own
    expression into the lambda, where it would be evaluated at every step."""
    return F.when(F.size(name) >= 0, value)


def bound(value: Column, use) -> Column:
    """use(value), where value is evaluated once however often it is read: lambdas share no subexpressions."""
    return F.get(F.transform(F.array(value), use), 0)


def merges() -> Column:
    """The edges of two characters and more, the highest score first, then the leftmost."""
    return F.sort_array(F.transform(F.filter("edges", lambda e: e["stop"] > e["begin"] + 1), lambda e: F.struct((-e["score"]).alias("cost"), e["begin"].alias("begin"), e["stop"].alias("stop"))))


def fold_bpe(n: Column, sorted_edges: Column) -> Column:
    """Cuts of the path: each step joins the two neighbours of the first edge (merges()) that spans just two."""

    def step(cuts, _):
        spans_two = lambda e: bound(F.array_position(cuts, e["begin"]), lambda p: (p > 0) & (F.array_position(cuts, e["stop"]) == p + 2))
        return bound(
            F.get(F.filter(sorted_edges, spans_two), 0),
            lambda best: F.when(best.isNull(), cuts).otherwise(F.filter(cuts, lambda c: (c <= best["begin"]) | (c >= best["stop"]))),
        )

    return F.aggregate(F.slice(sorted_edges, 1, n - 1), F.sequence(F.lit(0), n), step)


def fold_viterbi(n: Column, edges: Column, floor: float) -> Column:
    """Cuts of the path of the highest sum; floor is the score of a character without a piece."""
    node = lambda score, cuts: F.struct(score.alias("score"), cuts.alias("cuts"))

    def step(best, stop):
        back = lambda e: F.struct((F.get(best, e["begin"])["score"] + e["score"]).alias("score"), (-e["begin"]).alias("near"))
        char = F.struct((F.get(best, stop - 1)["score"] + floor).alias("score"), (F.lit(1) - stop).alias("near"))
        ways = F.concat(F.array(char), F.transform(F.filter(edges, lambda e: e["stop"] == stop), back))
        return bound(F.array_max(ways), lambda top: F.concat(best, F.array(node(top["score"], F.concat(F.get(best, -top["near"])["cuts"], F.array(stop))))))

    first = F.array(node(F.lit(0.0), F.array(F.lit(0))))
    return F.get(F.aggregate(F.sequence(F.lit(1), n), first, step), n)["cuts"]


def heap_bpe(n: int, scores) -> list[int]:
    """The cuts that fold_bpe gives, by a heap of neighbours; scores: (begin, stop) of an edge to its score."""
    score = scores.get
    after, before = list(range(1, n + 2)), list(range(-1, n + 1))
    heap = [(-s, i, i + 2) for i in range(n - 1) if (s := score((i, i + 2))) is not None]
    heapq.heapify(heap)
    alive = [True] * (n + 1)
    while heap:
        _, a, c = heapq.heappop(heap)
        if not (alive[a] and a < n and (b := after[a]) < n and after[b] == c):
            continue
        alive[b] = False
        after[a], before[c] = c, a
        for x, y in ((before[a], c), (a, after[c] if c < n else n + 1)):
            if x >= 0 and y <= n and (s := score((x, y))) is not None:
                heapq.heappush(heap, (-s, x, y))
    return [i for i in range(n + 1) if alive[i]]


def encode_units(units: DataFrame, table_rows: list, unigram: bool = False) -> DataFrame:
    """unit and ids of the distinct units (unit)."""
    checked(table_rows)
    normal = [(i, p, s) for i, p, s, kind in table_rows if kind == "normal"]
    bytes_at = sorted(i for i, *_, kind in table_rows if kind == "byte")
    base, unknown = bytes_at[0] if bytes_at else None, next((i for i, *_, kind in table_rows if kind == "unknown"), 0)
    table = units.sparkSession.createDataFrame(normal, "id int, piece string, score double")
    longest = max((len(p) for _, p, _ in normal), default=1)
    floor = min((s for *_, s in normal), default=0.0) - 10
    units = written(units, "distinct-units")
    short = lattice(units.where(F.length("unit") <= FOLD_CHARS), table, longest, True).select("unit", "n", "edges", merges().alias("merges"))
    cuts = once("edges", fold_viterbi(F.col("n"), F.col("edges"), floor)) if unigram else once("merges", fold_bpe(F.col("n"), F.col("merges")))
    short = short.select("unit", "edges", cuts.alias("cuts"))
    long = lattice(units.where(F.length("unit") > FOLD_CHARS), table, longest, False).select("unit", "n", "edges").mapInArrow(long_cuts(unigram, floor), "unit string, edges array<struct<begin int, stop int, id int, score double>>, cuts array<int>")
    return short.unionByName(long).mapInArrow(ids_of_cuts(base, unknown), "unit string, ids array<int>")


def ids_of_cuts(byte_base: int | None, unknown: int):
    """Ids of units from their edges and cuts; a character without a piece gets its byte pieces, or the unknown one."""

    def run(batches):
        for batch in batches:
            edges, cuts, ids = batch.column("edges"), batch.column("cuts"), []
            begin, stop, known = (edges.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(3))
            spans = dict(zip(zip(np.repeat(np.arange(len(edges)), np.diff(edges.offsets.to_numpy())).tolist(), begin.tolist(), stop.tolist(), strict=True), known.tolist(), strict=True))
            for row, (unit, own) in enumerate(zip(batch.column("unit").to_pylist(), cuts.to_pylist(), strict=True)):
                out: list[int] = []
                for a, b in zip(own, own[1:], strict=False):
                    found = spans.get((row, a, b))
                    if found is not None:
                        out.append(found)
                    else:
                        out += [unknown] if byte_base is None else [byte_base + x for x in unit[a].encode()]
                ids.append(out)
            yield pa.RecordBatch.from_arrays([batch.column("unit"), pa.array(ids, pa.list_(pa.int32()))], names=["unit", "ids"])

    return run


def long_cuts(unigram: bool, floor: float):
    """Cuts of long units over the same edges."""

    def run(batches):
        for batch in batches:
            out = []
            for n, edges in zip(batch.column("n").to_pylist(), batch.column("edges").to_pylist(), strict=True):
                scores = {(e["begin"], e["stop"]): e["score"] for e in edges}
                if not unigram:
                    out.append(heap_bpe(n, scores))
                    continue
                ending: dict[int, list] = {}
                for (a, b), s in scores.items():
                    ending.setdefault(b, []).append((a, s))
                best, back = [0.0], [0]
                for stop in range(1, n + 1):
                    top = max((best[a] + s, -a) for a, s in [(stop - 1, floor), *ending.get(stop, [])])
                    best.append(top[0])
                    back.append(-top[1])
                path = [n]
                while path[-1]:
                    path.append(back[path[-1]])
                out.append(path[::-1])
            yield pa.RecordBatch.from_arrays([batch.column("unit"), batch.column("edges"), pa.array(out, pa.list_(pa.int32()))], names=["unit", "edges", "cuts"])

    return run


def packer(blocks: int, limit: int = 32 << 20):
    """Documents as compressed bundles: (block, bundle) rows, a bundle for each block and about limit bytes of text."""

    def run(batches):
        import zstandard

        schema = pa.schema([("block", pa.int32()), ("bundle", pa.binary())])
        zipper = zstandard.ZstdCompressor(level=3)
        held: dict[int, list] = {}
        size = 0

        def flush():
            rows = [(b, zipper.compress(pickle.dumps(docs, 5))) for b, docs in held.items()]
            held.clear()
            return as_batch(schema, *map(list, zip(*rows, strict=True)))

        for batch in pieces(batches, "text"):
            for block, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("block", "doc_id", "text")), strict=True):
                held.setdefault(block, []).append((doc_id, text))
                size += len(text)
                if size >= limit:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


def unpacked(bundle: bytes) -> list[tuple[int | None, str]]:
    import zstandard

    return pickle.loads(zstandard.ZstdDecompressor().decompress(bundle))


def marked(text: str) -> list[str]:
    return UNIT.findall(MARK + text.replace(" ", MARK)) if text else []


def block_units(table: pa.Table) -> pa.Table:
    """The distinct units of a block's documents."""
    seen: set[str] = set()
    for bundle in table.column("bundle"):
        for _, text in unpacked(bundle.as_py()):
            seen.update(marked(text))
    return pa.table({"block": pa.array([table.column("block")[0].as_py()] * len(seen), pa.int32()), "unit": pa.array(list(seen), pa.string())})


def assembler(table_rows: list):
    """Ids and decoded texts of a block's documents from the ids of its units."""
    surface = surfaces(table_rows)

    def run(docs: pa.Table, units: pa.Table) -> pa.Table:
        ids_of = {}
        for batch in units.to_batches():
            flat, ends = batch.column("ids").values.to_numpy(zero_copy_only=False).astype("<i4"), batch.column("ids").offsets.to_numpy()
            names = batch.column("unit").to_pylist()
            ids_of |= {u: flat[a:b].tobytes() for u, a, b in zip(names, ends[:-1], ends[1:], strict=True)}
        doc_ids, ids, decoded = [], [], []
        for bundle in docs.column("bundle"):
            for doc_id, text in unpacked(bundle.as_py()):
                own = np.frombuffer(b"".join(map(ids_of.__getitem__, marked(text))), "<i4")
                doc_ids.append(doc_id)
                ids.append(own)
                decoded.append(b"".join(map(surface.__getitem__, own.tolist())).decode("utf-8", "replace").replace(MARK, " ")[1:])
        return pa.table([pa.array(doc_ids, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    return run


def encode_relational(docs: DataFrame, model_path: str, unigram: bool = False) -> DataFrame:
    """What encode gives, with the lattice as Spark tables and the fold as a higher-order aggregate."""
    rows = load_pieces(model_path)
    units = docs.select(F.explode(F.array_distinct(units_of(F.col("text")))).alias("unit")).distinct()
    known = written(encode_units(units, rows, unigram), "units")
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    blocks = size // BLOCK_BYTES + 1
    plain = docs.selectExpr("cast(doc_id as long) doc_id", "coalesce(cast(text as string), '') text")
    plain = plain.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    packed = plain.mapInArrow(packer(blocks), "block int, bundle binary").repartition(int(max(blocks, 2)), "block")
    own = packed.groupBy("block").applyInArrow(block_units, "block int, unit string")
    needed = own.join(known, "unit").select("block", "unit", "ids")
    return packed.groupBy("block").cogroup(needed.groupBy("block")).applyInArrow(assembler(rows), OUT)


class Spans:
    """The scores of a unit's edges by (begin, stop), looked up as they are needed."""

    def __init__(self, unit: str, score_of: dict[str, float], longest: int) -> None:
        self.unit, self.score_of, self.longest = unit, score_of, longest

    def get(self, span: tuple[int, int]) -> float | None:
        begin, stop = span
        return self.score_of.get(self.unit[begin:stop]) if stop - begin <= self.longest else None


class Lattice:
    """The piece table as arrays: finds the edges of many units at once and folds them."""

    def __init__(self, table_rows: list, unigram: bool) -> None:
        normal = [(i, p, s) for i, p, s, kind in table_rows if kind == "normal"]
        self.unigram, self.longest = unigram, max((len(p) for _, p, _ in normal), default=1)
        self.score_of = {p: s for _, p, s in normal}
        self.ids = np.array([i for i, *_ in normal] + [-1], np.int32)
        scores = np.array([s for *_, s in normal], float)
        self.scores, self.floor = scores, float(scores.min(initial=0.0)) - 10
        self.rank = np.append(np.unique(-scores, return_inverse=True)[1], NO_RANK).astype(np.int64)
        bytes_at = sorted(i for i, *_, kind in table_rows if kind == "byte")
        self.byte_base = bytes_at[0] if bytes_at else None
        self.unknown = next((i for i, *_, kind in table_rows if kind == "unknown"), 0)
        step: dict[tuple[int, int], int] = {}  # prefix and next character to the longer prefix
        piece_of = {0: -1}
        for row, (_, piece, _) in enumerate(normal):
            node = 0
            for c in map(ord, piece):
                node = step.setdefault((node, c), len(step) + 1)
            piece_of[node] = row
        self.keys = np.array([n << 21 | c for n, c in step], np.int64)
        order = np.argsort(self.keys)
        self.keys, self.child = self.keys[order], np.array(list(step.values()), np.int64)[order]
        self.piece_of = np.full(len(step) + 1, -1, np.int32)
        self.piece_of[list(piece_of)] = list(piece_of.values())
        self.known: dict[str, bytes] = {}  # ids of brief units, without their first space mark
        self.held = 0  # bytes they take, about
        self.last: set[str] = set()  # units of the texts encoded last, which stay known when there are too many
        self.id_of = {p: i for i, p, _ in normal}

    def edges(self, chars: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The row in the piece table of the k + 1 characters from each i at [i, k], or -1: every substring of bounded length
        that is the beginning of a piece, joined to the table by equality of prefix and character."""
        found = np.full((len(chars), self.longest), -1, np.int32)
        at, node = np.arange(len(chars)), np.zeros(len(chars), np.int64)
        for k in range(self.longest):
            inside = at + k < ends[at]
            at, node = at[inside], node[inside]
            key = node << 21 | chars[at + k]
            j = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[j] == key
            at, node = at[hit], self.child[j[hit]]
            found[at, k] = self.piece_of[node]
        return found

    def fold(self, found: np.ndarray, unit: np.ndarray, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """begin and stop of the path's edges: in each step every unit joins its two neighbours of the best edge, the
        leftmost of equals. used: which characters take part, all of a unit or none."""
        begin = np.arange(len(unit)) if used is None else np.flatnonzero(used)
        unit = unit[begin]
        stop, over = begin + 1, []
        while len(begin):
            same = unit[1:] == unit[:-1]
            size = stop[1:] - begin[:-1]
            rank = np.full(len(begin), NO_RANK, np.int64)
            ok = np.flatnonzero(same & (size <= self.longest))
            rank[ok] = self.rank[found[begin[ok], size[ok] - 1]]
            first = np.flatnonzero(np.append(True, ~same))
            best = np.minimum.reduceat(rank << 32 | np.arange(len(begin)), first)
            more = best >> 32 < NO_RANK
            joined = best[more] & 0xFFFFFFFF
            stop[joined] = stop[joined + 1]
            stays = np.repeat(more, np.diff(np.append(first, len(begin))))
            over.append((begin[~stays], stop[~stays]))
            stays[joined + 1] = False
            begin, stop, unit = begin[stays], stop[stays], unit[stays]
        if not over:
            return begin, stop
        begin, stop = map(np.concatenate, zip(*over, strict=True))
        order = np.argsort(begin, kind="stable")
        return begin[order], stop[order]

    def best_sum(self, found: np.ndarray) -> list[int]:
        """Cuts of one unit's path of the highest sum."""
        best, back = [0.0] + [-np.inf] * len(found), [0] * (len(found) + 1)
        for begin, row in enumerate(found):
            for k in {0, *np.flatnonzero(row >= 0).tolist()}:
                total = best[begin] + (self.scores[row[k]] if row[k] >= 0 else self.floor)
                if total > best[begin + k + 1]:
                    best[begin + k + 1], back[begin + k + 1] = total, begin
        path = [len(found)]
        while path[-1]:
            path.append(back[path[-1]])
        return path[::-1]

    def spelled(self, char: str) -> list[int]:
        """Ids of a character without a piece."""
        return [self.unknown] if self.byte_base is None else [self.byte_base + x for x in char.encode("utf-8", "replace")]

    def encode_brief(self, units: list[str]) -> list[bytes]:
        """Ids of units, as little-endian bytes."""
        text = "".join(units)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        ends = np.cumsum(sizes)
        unit = np.repeat(np.arange(len(units)), sizes)
        found = self.edges(code_points(text), ends[unit])
        if self.unigram:
            cuts = [a + np.array(self.best_sum(found[a:b])) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
            path = np.concatenate([c[:-1] for c in cuts]), np.concatenate([c[1:] for c in cuts])
        else:
            path = self.fold(found, unit)
        flat, to = self.spell_out(text, found, *path)
        per_unit = np.append(0, to[np.searchsorted(path[0], ends) - 1]) * 4
        raw = flat.tobytes()
        return [raw[a:b] for a, b in zip(per_unit[:-1].tolist(), per_unit[1:].tolist(), strict=True)]

    def spell_out(self, text: str, found: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of a path's edges, number of ids up to the end of each edge)."""
        ids = self.ids[found[begin, stop - begin - 1]]
        miss = np.flatnonzero(ids < 0)
        if self.byte_base is None or not len(miss):
            ids[miss] = self.unknown
            return ids.astype("<i4"), np.arange(1, len(ids) + 1)
        chars = code_points(text)[begin[miss]]
        size = 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000).astype(np.int64)
        size[(chars >= 0xD800) & (chars < 0xE000)] = 1  # half of a surrogate pair is spelled as a question mark
        count = np.ones(len(ids), np.int64)
        count[miss] = size
        flat, to = np.repeat(ids, count), np.cumsum(count)
        spelled = chars.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace")
        flat[flat < 0] = np.frombuffer(spelled, np.uint8).astype(np.int32) + self.byte_base
        return flat.astype("<i4"), to

    def encode_long(self, unit: str) -> bytes:
        """Ids of a long unit, a part of PART_CHARS characters at a time. No merge reaches over a place that no edge of two
        characters or more spans, so the stretches between such places are folded side by side; longer stretches, and a
        part without such a place, take the same path with a heap."""
        if self.unigram:
            cuts = self.best_sum(self.edges(code_points(unit), np.full(len(unit), len(unit))))
            return self.ids_between(unit, cuts)
        out, at = [], 0
        while at < len(unit):
            part = unit[at : at + PART_CHARS + self.longest]
            found = self.edges(code_points(part), np.full(len(part), len(part)))
            ahead = np.where(found[:, ::-1] >= 0, np.arange(self.longest, 0, -1), 1).max(axis=1)
            reach = np.maximum.accumulate(np.arange(len(part)) + ahead)
            places = np.append(0, np.flatnonzero(reach[:-1] == np.arange(1, len(part))) + 1)
            if at + len(part) < len(unit):
                places = places[places <= PART_CHARS]
                if places[-1] == 0:
                    out.append(self.by_heap(unit[at:]))
                    break
                part = part[: places[-1]]
                places = places[:-1]
            size = np.diff(np.append(places, len(part)))
            brief = np.repeat(size <= FOLD_CHARS, size)
            begin, stop = self.fold(found[: len(part)], np.repeat(np.arange(len(size)), size), brief)
            flat, to = self.spell_out(part, found, begin, stop)
            upto = np.append(0, to)
            done = 0
            for a, n in zip(places[size > FOLD_CHARS].tolist(), size[size > FOLD_CHARS].tolist(), strict=True):
                out += [flat[upto[np.searchsorted(begin, done)] : upto[np.searchsorted(begin, a)]].tobytes(), self.by_heap(part[a : a + n])]
                done = a + n
            out.append(flat[upto[np.searchsorted(begin, done)] :].tobytes())
            at += len(part)
        return b"".join(out)

    def by_heap(self, text: str) -> bytes:
        return self.ids_between(text, heap_bpe(len(text), Spans(text, self.score_of, self.longest)))

    def ids_between(self, text: str, cuts: list[int]) -> bytes:
        out: list[int] = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            known = self.id_of.get(text[a:b])
            out += self.spelled(text[a]) if known is None else [known]
        return np.array(out, "<i4").tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts; each distinct unit is encoded once, and brief ones are remembered."""
        cut = [tails(t) for t in texts]
        if self.held > KNOWN_BYTES:
            self.known = {u: self.known[u] for u in self.last if u in self.known}
            self.held = sum(2 * len(u) + UNIT_BYTES for u in self.known)
        self.last = set().union(*cut)
        new = [MARK + u for u in self.last - self.known.keys()]
        brief = [u for u in new if len(u) <= FOLD_CHARS]
        for k in range(0, len(brief), FOLD_UNITS):
            some = brief[k : k + FOLD_UNITS]
            coded = self.encode_brief(some)
            self.known.update(zip((u[1:] for u in some), coded, strict=True))
            self.held += sum(map(len, some)) + sum(map(len, coded)) + UNIT_BYTES * len(some)
        long = {u[1:]: self.encode_long(u) for u in new if len(u) > FOLD_CHARS}
        get = self.known.__getitem__ if not long else lambda u: long[u] if u in long else self.known[u]
        return [b"".join(map(get, c)) for c in cut]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def tails(text: str) -> list[str]:
    """The units of a text, each without its first space mark."""
    if not text:
        return []
    if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
        return [u[1:] for u in marked(text)]
    return text.split(" ")


BUILT: dict[str, Lattice] = {}  # a worker keeps its lattices, with the units they know, from task to task


def encode(docs: DataFrame, model_path: str, unigram: bool = False) -> DataFrame:
    """doc_id, ids and decoded text for every row of docs (doc_id, text), in one narrow pass without a shuffle."""
    rows = load_pieces(model_path)
    checked(rows)
    name = f"{zlib.crc32(pickle.dumps(rows))}-{len(rows)}-{unigram}"
    surface = surfaces(rows)

    def run(batches):
        lattice = BUILT[name] = BUILT.get(name) or Lattice(rows, unigram)
        for batch in pieces(batches, "text", BATCH_BYTES):
            coded = lattice(batch.column("text").to_pylist())
            ends = np.append(0, np.cumsum([len(c) // 4 for c in coded]))
            flat = np.frombuffer(b"".join(coded), "<i4")
            decoded = [b"".join(map(surface.__getitem__, flat[a:b].tolist())).decode("utf-8", "replace").replace(MARK, " ")[1:] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "coalesce(cast(text as string), '') text").mapInArrow(run, OUT)


def sentencepiece_digest(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the ids as little-endian 32-bit numbers), n_chars and text_sha256 of the decoded text."""

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("decoded", pa.string())])
        for batch in batches:
            lists = batch.column("ids")
            flat, ends = lists.values.to_numpy(zero_copy_only=False).astype("<i4"), lists.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield as_batch(schema, batch.column("doc_id"), np.diff(ends).astype(np.int64), crc, batch.column("decoded"))

    coded = encode(docs, model_path).mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, decoded string")
    return coded.select("doc_id", "n_pieces", "ids_crc32", F.length("decoded").cast("long").alias("n_chars"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("text_sha256"))
