"""Benchmark decontamination with DataFrame functions only.

Texts are lower-cased (A-Z) and cut to words. An item's windows are its runs of WINDOW words (an item with fewer words
is one window). The windows form a hash set on their first LEAD words (all words of a shorter window). One scan looks
every document position up in that set; a second counts the words and, of documents with positions found, cuts out the
windows there, which are then verified word for word. Words inside an occurrence of a window are hit. The set and the
positions are broadcast while their counted size allows it, and the texts are then never shuffled; beyond, both are joined
by shuffle.

A document is known by (doc_id, hash and length of its text), so repeated rows get the same result and each its row.
Null and empty texts have no words; items without words have no window; items without an id are not reported. An empty
benchmark hits nothing. Columns other than the ids and texts are left alone by ``remove_contaminated``.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import WORD_BREAK, dropped, small_side, written

WINDOW, LEAD = 10, 4
BROADCAST_BYTES = 48 << 20  # of the windows' words and items
# the words of a text that is not lower-cased
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
KEY = ("doc_id", "text_hash", "text_size")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is; lower() alone is quicker and the same where all is ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), WORD_BREAK), "")


def key_columns() -> list[Column]:
    text = F.col("text").cast("string")
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.coalesce(F.length(text), F.lit(-1)).alias("text_size")]


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*key_columns(), words_of(F.col("text")).alias("words"))


def lead_hash(words: Column, at: Column, lead: int) -> Column:
    return F.xxhash64(*[F.get(words, at + k) for k in range(lead)])


def lead_hashes(leads: list[int]) -> Column:
    """For every position of words the hashes of the leads there, one behind the other."""
    of = lambda w, i: F.array(*[F.xxhash64(w, *[F.get("words", i + k) for k in range(1, n)]) for n in leads])
    return F.flatten(F.transform("words", of))


def benchmark_windows(items: DataFrame) -> DataFrame:
    """size, window (words joined by spaces), lead (words that the set is keyed by), lead_key and items per window."""
    cut = items.select(F.col("item_id").alias("item_id"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    cut = cut.withColumn("size", F.least(F.size("words"), F.lit(WINDOW))).withColumn("at", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("size"))))
    lead = F.least(F.col("size"), F.lit(LEAD))
    key = F.lit(None).cast("long")
    for n in range(1, LEAD + 1):
        key = F.when(lead == n, lead_hash(F.col("words"), F.col("at"), n)).otherwise(key)
    named = cut.select("item_id", "size", F.array_join(F.slice("words", F.col("at") + 1, F.col("size")), " ").alias("window"), lead.alias("lead"), key.alias("lead_key"))
    return named.groupBy("size", "window", "lead", "lead_key").agg(F.collect_set("item_id").alias("items"))


def same_text(a: str, b: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in KEY])


def scanned(docs: DataFrame, items: DataFrame, all_docs: bool = False) -> tuple[DataFrame, DataFrame]:
    """(KEY and n_words of the documents with a position found, or of all; KEY, spans (set of at, size) and items (set of
    ids) of the documents with hits), both written."""
    windows = written(benchmark_windows(items), "windows")
    sizes = [(r["size"], r["lead"], r["bytes"]) for r in windows.groupBy("size", "lead").agg(F.sum(F.octet_length("window") + 16 * F.size("items")).alias("bytes")).collect()]  # WINDOW rows at most
    side = F.broadcast if sum(n for *_, n in sizes) <= BROADCAST_BYTES else (lambda df: df)
    leads = sorted({lead for _, lead, _ in sizes}) or [LEAD]
    at = keyed(docs).select(*KEY, F.posexplode(lead_hashes(leads)).alias("place", "lead_key"))
    found = at.join(side(windows.select("lead_key").distinct()), "lead_key", "left_semi")
    places = written(found.groupBy(*KEY).agg(F.collect_set((F.col("place") / len(leads)).cast("int")).alias("places")), "places")
    # where texts are shuffled after all, it is the texts themselves, never the longer word arrays
    texts = docs.select(*key_columns(), F.col("text").cast("string").alias("text"))
    joined = texts.alias("d").join(small_side(places, F.size("places")).alias("p"), same_text("d", "p"), "left" if all_docs else "inner")
    near = joined.select(*[F.col(f"d.{k}") for k in KEY], words_of(F.col("text")).alias("words"), "places")
    lengths = sorted({n for n, *_ in sizes}) or [WINDOW]
    cut = lambda at, n: F.struct(at.alias("at"), F.lit(n).alias("size"), F.array_join(F.slice("words", at + 1, n), " ").alias("window"))
    windows_at = lambda at: F.array(*[F.when(at + n <= F.size("words"), cut(at, n)) for n in lengths])
    tried = F.when(F.col("places").isNotNull(), F.array_compact(F.flatten(F.transform("places", windows_at))))
    counted = written(near.select(*KEY, F.size("words").cast("long").alias("n_words"), tried.alias("tried")), "counted")
    hits = counted.where("tried is not null").select(*KEY, F.inline("tried")).join(side(windows.select("size", "window", "items")), ["size", "window"])
    hits = written(hits.groupBy(*KEY).agg(F.collect_set(F.struct("at", "size")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")), "hits")
    dropped(windows, places)
    return counted.select(*KEY, "n_words"), hits


def covered() -> Column:
    """The sorted numbers of the words in spans."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["size"] - 1)))))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs (doc_id, text)."""
    all_docs, hits = scanned(docs, items, True)
    brief = hits.select(*KEY, F.size(covered()).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.array_join(F.sort_array(F.transform("items", lambda i: i.cast("string"))), ",").alias("ids"))
    joined = all_docs.alias("d").join(brief.hint("merge").alias("h"), same_text("d", "h"), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        F.col("d.doc_id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.encode(F.coalesce("ids", F.lit("")), "UTF-8"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def same_row(d: str, h: str) -> Column:
    """Whether a row of documents, alias d, is the one that alias h has the KEY of."""
    text = F.col(f"{d}.text").cast("string")
    return F.col(f"{d}.doc_id").cast("long").eqNullSafe(F.col(f"{h}.doc_id")) & (F.xxhash64(text) == F.col(f"{h}.text_hash")) & (F.length(text) == F.col(f"{h}.text_size"))


def remove_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs without a hit, all columns as they are."""
    hits = written(scanned(docs, items)[1].select(*KEY), "hit-keys")
    return docs.alias("d").join(small_side(hits).alias("h"), same_row("d", "h"), "left_anti")


def remove_spans(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id and clean: each document's text without the stretches from the first to the last word of covered words; all
    else, signs and line ends around a stretch too, stays as it is. Null stays null."""
    hits = written(scanned(docs, items)[1].select(*KEY, covered().alias("covered")), "spans")
    joined = docs.select("doc_id", F.col("text").cast("string").alias("text")).alias("d").join(small_side(hits, F.size("covered")).alias("h"), same_row("d", "h"), "left")
    cut = joined.select(F.col("d.doc_id").cast("long").alias("doc_id"), "text", "covered", F.regexp_extract_all("text", F.lit(ANY_CASE_WORD), 0).alias("own"), F.split("text", ANY_CASE_WORD, -1).alias("between"))
    cut = cut.select("*", F.size("own").alias("n"))
    # the stretches between covered words, each with what stands before its first word if a covered word comes before
    stretches = F.zip_with(F.concat(F.array(F.lit(-1)), "covered"), F.concat("covered", F.array("n")), lambda a, b: F.struct((a + 1).alias("begin"), b.alias("end")))
    stretches = F.filter(stretches, lambda s: (s["begin"] < s["end"]) | (s["end"] == F.col("n")))
    words = lambda s: F.zip_with(F.slice("own", s["begin"] + 1, s["end"] - s["begin"]), F.slice("between", s["begin"] + 2, s["end"] - s["begin"]), lambda w, after: F.concat(w, after))
    kept = F.transform(stretches, lambda s: F.concat(F.get("between", s["begin"]), F.array_join(words(s), "")))
    return cut.select("doc_id", F.when(F.col("covered").isNull(), F.col("text")).otherwise(F.array_join(kept, "")).alias("clean"))
