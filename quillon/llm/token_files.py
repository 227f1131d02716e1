"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Documents are dealt out by ranges of (doc_id, text hash), so the shards read in the order (part, seq) hold the
documents in ascending doc_id order (null ids first; repeated ids side by side). A shard is one byte string::

    "QVB1" | u32 documents | u32 ranks | u64 ids | i64 doc ids | u8 null flags | u32 ids a document
    | u32 id of each rank | control bytes (2 bits an id, 4 ids a byte) | data (1 to 4 bytes an id, little-endian)

Rank 0 is the shard's most frequent id, so the frequent ids take one byte. Executors have no byte sink but Spark's
own writers, so shards are stored as the rows of a Parquet table in the shared folder. Decoding looks each control
byte up in a table of byte masks. A null or empty text is the end id alone; a table without rows has no shards; repeated
rows are written as often as they occur; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import sys
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import as_batch, pieces, written

MAGIC, HEAD = b"QVB1", struct.Struct("<4sIIQ")
SHARD_IDS = 2 << 20  # a shard is closed at so many ids
BATCH_BYTES = 3 << 20  # text encoded at a time
CACHE_BYTES, PIECE_BYTES, KEPT_BYTES = 64 << 20, 180, 64  # bound of a worker's pieces, cost of one, longest that is kept beyond it
PIECES_AT_ONCE = 4096  # pieces encoded as one text
END_ID = 2
assert sys.byteorder == "little"  # tokens are written in the byte order of the machine
# MASKS[c]: which of the 4 x 4 bytes of four little-endian numbers are stored under control byte c.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
MASKS = np.arange(4)[None, None, :] < LENGTHS[:, :, None]
SHARDS = "part int, seq int, before long, n_ids long, image binary"


def pack(doc_ids: list, counts: list[int], ids: np.ndarray) -> bytes:
    """The shard of these documents."""
    freq = np.bincount(ids)  # as long as the vocabulary
    found = np.flatnonzero(freq)
    order = np.lexsort((found, -freq[found]))
    rank = np.zeros(len(freq), "<u4")
    rank[found[order]] = np.arange(len(found), dtype="<u4")
    ranks = rank[ids]
    size = (1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)).astype(np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4)[None, :] < size[:, None]]
    codes = np.zeros(-len(size) % 4 + len(size), np.uint8)
    codes[: len(size)] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    return b"".join((
        HEAD.pack(MAGIC, len(doc_ids), len(found), len(ids)),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        np.array(counts, "<u4").tobytes(),
        found[order].astype("<u4").tobytes(),
        control.tobytes(),
        data.tobytes(),
    ))


def unpack(image: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc ids, ids a document, all ids) of a shard."""
    magic, docs, ranks, n = HEAD.unpack_from(image)
    if magic != MAGIC:
        raise ValueError("not a token shard")
    at = HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        x = np.frombuffer(image, kind, count, at)
        at += x.nbytes
        return x

    doc_ids, null, counts, table = take("<i8", docs), take("u1", docs), take("<u4", docs), take("<u4", ranks)
    control = take("u1", -(-n // 4))
    stored = MASKS[control].reshape(-1, 4)[:n]
    out = np.zeros((n, 4), np.uint8)
    out[stored] = take("u1", int(stored.sum()))
    return [None if x else d for d, x in zip(doc_ids.tolist(), null.tolist(), strict=True)], counts, table[out.view("<u4").ravel()]


LETTER, NUMBER, SIGN, SPACE = range(4)
SHORT_FORMS = (b"s", b"t", b"m", b"d", b"re", b"ve", b"ll")  # fixed values: what the pre-tokenizer keeps with an apostrophe


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: the byte itself where Latin-1 prints
    it, else the next one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


class Cutter:
    """Where a byte-level pre-tokenizer cuts, found for many texts at once: runs of letters, numbers, signs or white space,
    a single space going with the run behind it, and short forms after an apostrophe. Which kind a character is, the
    library itself is asked once for each character that occurs."""

    def __init__(self, pre_tokenizer) -> None:
        self.pre_tokenizer = pre_tokenizer
        self.kind: dict[int, int] = {}
        self.ascii = np.array([self.kind_of(c) if c < 128 else SIGN for c in range(256)], np.uint8)

    def kind_of(self, code: int) -> int:
        if code not in self.kind:
            joins = (len(self.pre_tokenizer.pre_tokenize_str(mate + chr(code))) == 1 for mate in "a1!")
            self.kind[code] = next((k for k, one in enumerate(joins) if one), SPACE)
        return self.kind[code]

    def kinds(self, data: np.ndarray) -> np.ndarray:
        """The kind of each byte's character."""
        out = self.ascii[data]
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead):
            size = 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0).astype(np.int64)
            code = data[lead].astype(np.int64) & (0xFF >> (size + 1))
            for k in range(1, 4):
                more = size > k
                code[more] = code[more] << 6 | data[lead[more] + k] & 0x3F
            names, where = np.unique(code, return_inverse=True)
            kind = np.array([self.kind_of(c) for c in names.tolist()], np.uint8)[where]
            for k in range(4):
                out[lead[size > k] + k] = kind[size > k]
        return out

    def starts(self, data: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """First bytes of the pieces of texts that stand one behind the other; firsts: the first byte of each non-empty text."""
        kind, char = self.kinds(data), (data & 0xC0) != 0x80
        first = np.zeros(len(data) + 1, bool)
        first[firsts] = first[-1] = True
        change = np.append(True, kind[1:] != kind[:-1])
        begins = change | first[:-1]
        # a space goes with what follows it; of longer white space that is its last character
        lone = (data == 0x20) & np.append(kind[1:] != SPACE, False) & ~first[1:]
        begins[1:] &= ~lone[:-1]
        begins |= lone
        after = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~first[1:-1])  # last byte of white space
        while len(after) and not char[after].all():
            after = np.where(char[after], after, after - 1)
        begins[after] = True
        quotes = np.flatnonzero(begins & (data == 0x27))
        padded = np.append(data, [0, 0]).astype(np.uint8)
        for tail in SHORT_FORMS:
            own = quotes[quotes + len(tail) < len(data)]
            for k, c in enumerate(tail, 1):
                own = own[(padded[own + k] == c) & ~first[own + k]]
            begins[own + 1] = False
            end = own + 1 + len(tail)
            begins[end[end < len(data)]] = True
        return np.flatnonzero(begins)


class Encoder:
    """Ids of whole texts. Texts are cut where the tokenizer's own byte-level pre-tokenizer cuts, and each distinct piece
    is encoded by the library once while remembered; a text with an added token, and every text of a tokenizer of another
    kind, is given to the library whole."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        plan = json.loads(self.tokenizer.to_str())
        before, model = plan["pre_tokenizer"] or {}, plan["model"]
        self.by_piece = (
            model["type"] == "BPE" and not model["dropout"] and plan["normalizer"] is None and (plan["post_processor"] or before).get("type") == "ByteLevel"
            and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and set(byte_letters()) <= set(model["vocab"])
        )
        if not self.by_piece:
            return
        self.added = "|".join(re.escape(t["content"]) for t in plan["added_tokens"])
        self.letters = dict(enumerate(byte_letters()))
        self.letters[0xFF] = " "  # no byte of UTF-8 text, so it may stand between pieces
        self.cutter = Cutter(self.tokenizer.pre_tokenizer)
        # the same model, whose pieces are given as vocabulary letters with spaces between them
        self.pieces = Tokenizer.from_str(json.dumps(plan | {"added_tokens": [], "post_processor": None}))
        self.pieces.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.id_bytes = np.zeros(max(model["vocab"].values()) + 1, np.int64)
        self.id_bytes[list(model["vocab"].values())] = list(map(len, model["vocab"]))
        self.known: dict[bytes, int] = {}
        self.forget()

    def forget(self, keep: list[bytes] = ()) -> None:
        """Starts over, with the pieces to keep."""
        rows = np.fromiter((self.known[p] for p in keep), np.int64, len(keep))
        size = self.size[rows] if len(keep) else np.zeros(0, np.int32)
        flat = self.ids[spread(self.begin[rows], size)] if len(keep) else np.zeros(0, "<u4")
        self.known: dict[bytes, int] = {}
        self.ids, self.begin, self.size, self.held = np.zeros(0, "<u4"), np.zeros(0, np.int32), np.zeros(0, np.int32), 0
        self.remember(list(keep), flat, size)

    def remember(self, pieces: list[bytes], flat: np.ndarray, size: np.ndarray) -> None:
        """Notes the ids of pieces, which stand one behind the other."""
        self.begin = np.append(self.begin, (len(self.ids) + np.cumsum(size) - size).astype(np.int32))
        self.size, self.ids = np.append(self.size, size.astype(np.int32)), np.append(self.ids, flat)
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces)), strict=True))
        self.held += sum(map(len, pieces)) + PIECE_BYTES * len(pieces)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, new: list[bytes]) -> None:
        """Has the library encode pieces that are not known, many to a text. Ids are dealt out to the pieces by the number
        of bytes that each id stands for."""
        flat = []
        for at in range(0, len(new), PIECES_AT_ONCE):
            shown = b"\xff".join(new[at : at + PIECES_AT_ONCE]).decode("latin-1").translate(self.letters)
            flat.append(np.array(self.pieces.encode_batch_fast([shown], add_special_tokens=False)[0].ids, "<u4"))
        ids = np.concatenate(flat)
        ends = np.searchsorted(np.cumsum(self.id_bytes[ids]), np.cumsum(np.fromiter(map(len, new), np.int64, len(new)))) + 1
        self.remember(new, ids, np.diff(ends, prepend=0))

    def by_pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw = texts.cast(pa.binary())
        ends = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
        if ends[-1] == ends[0]:
            return np.zeros(0, "<u4"), np.zeros(len(raw), np.int64)
        data = np.frombuffer(raw.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        ends -= ends[0]
        starts = self.cutter.starts(data, np.unique(ends[:-1][np.diff(ends) > 0]))
        offsets = np.append(starts, len(data)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        rows = [self.known.get(p, -1) for p in names]
        if new := [p for p, row in zip(names, rows, strict=True) if row < 0]:
            self.learn(new)
            rows = list(map(self.known.__getitem__, names))
        rows = np.array(rows, np.int32)[coded.indices.to_numpy()]
        size = self.size[rows]
        flat = self.ids[spread(self.begin[rows], size)]
        upto = np.append(0, np.cumsum(size))[np.searchsorted(starts, ends)]
        if self.held > CACHE_BYTES:
            self.forget([p for p in names if len(p) <= KEPT_BYTES])
        return flat, np.diff(upto)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids of the texts, none null, one text behind the other; number of ids of each text)."""
        plain = np.full(len(texts), self.by_piece)
        if self.by_piece and self.added:
            plain = ~np.array(pc.match_substring_regex(texts, self.added))
        if self.by_piece and plain.all():
            return self.by_pieces(texts)
        flat, some = self.by_pieces(texts.filter(pa.array(plain))) if plain.any() else (np.zeros(0, "<u4"), 0)
        rest = self.whole(texts.filter(pa.array(~plain)).to_pylist())
        count = np.zeros(len(texts), np.int64)
        count[plain], count[~plain] = some, [len(x) for x in rest]
        out, from_pieces = np.zeros(count.sum(), "<u4"), np.repeat(plain, count)
        out[from_pieces], out[~from_pieces] = flat, np.concatenate([np.zeros(0, "<u4"), *rest])
        return out, count


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each run of that size, one run behind the other; all below 2 ** 31."""
    ends = np.cumsum(size, dtype=np.int32)
    out = np.repeat(begin - ends + size, size)
    out += np.arange(len(out), dtype=np.int32)
    return out


@functools.cache
def encoder(path: str) -> Encoder:
    """A worker's encoder, which keeps its words from task to task."""
    return Encoder(path)


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Shards of docs (doc_id, text) as a written table (part, seq, before: ids of the part before the shard, n_ids, image)."""

    def run(batches):
        schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("image", pa.binary())])
        encode, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        doc_ids: list = []
        held: list[np.ndarray] = []
        counts: list[int] = []
        seq = before = size = 0

        def shard() -> pa.RecordBatch:
            return as_batch(schema, [part], [seq], [before], [size], [pack(doc_ids, counts, np.concatenate(held))])

        for batch in pieces(batches, "text", BATCH_BYTES):
            flat, count = encode(batch.column("text"))
            ids, own = np.insert(flat, np.cumsum(count), end_id), np.cumsum(count + 1)
            held.append(ids)
            doc_ids += batch.column("doc_id").to_pylist()
            counts += (count + 1).tolist()
            size += int(own[-1])
            if size >= SHARD_IDS:
                yield shard()
                seq, before, size, doc_ids, held, counts = seq + 1, before + size, 0, [], [], []
        if doc_ids:
            yield shard()

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "coalesce(cast(text as string), '') text")
    dealt = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return written(dealt.mapInArrow(run, SHARDS), "token-shards")


def read_tokens(shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document of the shards: its place, its number of ids and their crc32, and the ids if asked for."""
    starts, total = {}, 0
    for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():  # a row for each part
        starts[r["part"]], total = total, total + r["n"]

    def run(batches):
        fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
        schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)
        for batch in batches:
            for part, before, image in zip(*(batch.column(c).to_pylist() for c in ("part", "before", "image")), strict=True):
                doc_ids, counts, ids = unpack(image)
                ends = np.cumsum(counts, dtype=np.int64)
                begins = ends - counts
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                more = [pa.array([ids[a:b].astype(np.int32) for a, b in zip(begins, ends, strict=True)], pa.list_(pa.int32()))] * with_ids
                yield as_batch(schema, doc_ids, pa.array(begins + starts[part] + before), pa.array(counts.astype(np.int64)), crc, *more)

    return shards.select("part", "before", "image").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
