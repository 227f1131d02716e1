"""Null ids, null texts, repeated rows, empty tables, very long texts and clashing columns, for every operator and stage."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from quillon.llm import chat, decontaminate, langid, licenses, quality, sentencepiece_lattice, simhash, token_files, toxicity, warc

LONG = "word " * 400_000  # 2 MB
ROWS = [(1, "same words in a row of text"), (1, "same words in a row of text"), (None, "same words in a row of text"), (None, None), (2, None), (2, ""), (3, "中文" * 40_000), (4, LONG), (5, " \n\t"), (5, "1 2 3")]
SCHEMA = "doc_id long, text string, lang string, row_number long, node string, fp string, keys int, letters string, text_hash string"


def table(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, None, 7, "n", "f", 1, "l", "x") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "same words in a row"), (None, "x y"), (2, None), (2, "")], "item_id long, text string")


@pytest.fixture(scope="module")
def paths():
    vocabularies = pytest.importorskip("public_tokenizers")
    return {n: str(vocabularies.path(n)) for n in ("piece_bpe_32k.model", "byte_bpe_50k.json")}


def models(spark):
    text = lambda k: ("tor ban kel mur " if k % 2 else "sie oua iye uoi ") * 5 + str(k)
    docs = spark.createDataFrame([(k, text(k), "ab"[k % 2]) for k in range(60)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(60)], "doc_id long, quality int, toxic int")
    return langid.fit_languages(docs), toxicity.fit_toxicity(docs, labels), quality.fit_quality(docs, labels)


def test_a_row_for_every_row(spark, bench, paths):
    language, toxic, good = models(spark)
    operators = {
        "langid": lambda d: langid.identify(d, language), "toxicity": lambda d: toxicity.score_toxicity(d, toxic), "quality": lambda d: quality.quality_rules(d, good),
        "sentencepiece": lambda d: sentencepiece_lattice.sentencepiece_digest(d, paths["piece_bpe_32k.model"]), "simhash": simhash.simhash_digest, "licenses": licenses.scan_licenses,
        "decontaminate": lambda d: decontaminate.decontaminate(d, bench), "spans": lambda d: decontaminate.remove_spans(d, bench),
        "tokens": lambda d: token_files.read_tokens(token_files.write_tokens(d, paths["byte_bpe_50k.json"])),
    }
    for name, run in operators.items():
        rows = [tuple(r) for r in run(table(spark)).collect()]
        ids = [r[0] for r in rows]
        assert sorted(ids, key=str) == sorted((i for i, _ in ROWS), key=str), name
        if name != "tokens":  # there a row has its place
            twice = [r for r in rows if r[0] == 1]
            assert twice[0] == twice[1], name
        assert run(table(spark, [])).count() == 0, name
    tokens = {(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in operators["tokens"](table(spark)).where("doc_id = 1").collect()}
    assert len(tokens) == 1


def test_stages_keep_columns(spark, bench, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in (ROWS, []):
        docs = table(spark, rows)
        kept = {name: stage(spark, docs, str(tmp_path)) for name, stage in corpus_pipeline.STAGES[:-1]}
        assert all(k.columns == docs.columns for k in kept.values())
        found = {name: sorted((-1 if r["doc_id"] is None else r["doc_id"], (r["text"] or "")[:4]) for r in k.collect()) for name, k in kept.items()}
        if rows:
            assert found["language_id"] == [(-1, "same"), (1, "same"), (1, "same"), (3, "中文中文"), (4, "word")]
            assert found["quality_rules"] == []  # fewer than ten words, or repeated ones
            assert found["near_dedup"] == [(1, "same"), (2, ""), (3, "中文中文"), (4, "word"), (5, "1 2 ")]
            assert found["benchmark_decontamination"] == [(-1, ""), (2, ""), (2, ""), (3, "中文中文"), (4, "word"), (5, " \n\t"), (5, "1 2 ")]
        else:
            assert not any(found.values())


def test_chat_and_warc_odd_rows(spark):
    turns = spark.createDataFrame([(None, None, None, None, 1), (1, 0, "user", "a", 1), (1, 0, "user", "a", 1)], "conv_id long, turn long, role string, text string, turns int")
    rows = {r["conv_id"]: r for r in chat.chat_digest(turns).collect()}
    assert rows[1]["n_turns"] == 2 and rows[None]["n_turns"] == 1 and rows[1]["loss_chars"] == 0
    assert rows[1]["formatted_chars"] == len("<|im_start|>user\na<|im_sep|>a<|im_end|>\n")
    assert chat.chat_digest(turns.where("false")).count() == 0
    pages = spark.createDataFrame([(None, None, None, 1), (1, "u", "x" * 3_000_000, 1), (1, "u", "x" * 3_000_000, 1), (2, "v", None, 1)], "page_id long, url string, html string, digest int")
    found = sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"]) for r in warc.page_records(pages).collect())
    assert found == [("1", 3_000_000, "response"), ("1", 3_000_000, "revisit"), ("2", 0, "response"), ("None", 0, "revisit")]
    assert warc.page_records(pages.where(F.lit(False))).count() == 0
