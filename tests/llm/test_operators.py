"""Each operator against a brute-force version on small tables with odd rows."""

import base64
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from quillon.llm import chat, decontaminate, langid, licenses, quality, sentencepiece_lattice, simhash, token_files, toxicity, warc
from quillon.llm.graph import connected

DOCS = "doc_id long, text string, lang string, fp long, letters string, words string"


def frame(spark, texts, ids=None):
    """doc_id, text and columns whose names the operators use inside."""
    rows = [(i, t, "en", 1, "x", "y") for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " ", "\n\t", "a", "cc by", "the cat sat on the mat " * 3, "x" * 20_000, "word " * 5_000, "é ü 梦 🙂", "<|endoftext|> <|im_end|>", "same text here", "same text here", "A\r\nB\x85C D"]


def low(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


# --- 1 language identification ---


def language_rows(n=240):
    rng = random.Random(1)
    words = {"aa": ["tor", "ban", "kel", "mur"], "bb": ["sie", "oua", "iye", "uoi"]}
    return [(i, " ".join(rng.choice(words[k]) for _ in range(30)), k) for i in range(n) for k in (("aa", "bb")[i % 2],)]


def test_language_held_out_accuracy(spark):
    rows = language_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in langid.identify(docs, langid.fit_languages(langid.learnable(docs))).collect()}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(found[i]["held_out"] == (i in held) for i, *_ in rows)
    assert np.mean([found[i]["lang_pred"] == rows[i][2] for i in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_language_odd_rows(spark):
    docs = spark.createDataFrame(language_rows(), "doc_id long, text string, lang string")
    model = langid.fit_languages(langid.learnable(docs))
    found = {r["doc_id"]: r for r in langid.identify(frame(spark, ODD), model).collect()}
    assert len(found) == len(ODD)
    for i in (0, 1, 2, 3):
        assert (found[i]["lang_pred"], found[i]["score"]) == ("und", 0.0)
    assert found[9]["lang_pred"] in ("aa", "bb")
    kept = langid.keep_identified(frame(spark, ODD), model, 0.0)
    assert kept.columns == frame(spark, []).columns and {r["doc_id"] for r in kept.collect()} == set(range(4, len(ODD)))


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.fit_languages(docs) is None
    assert langid.identify(docs, None).first()["lang_pred"] == "und"
    assert langid.identify(docs.where("false"), None).count() == 0


def test_language_weights_are_sparse():
    rows = [(t, k) for _, t, k in language_rows()]
    model = langid.train(rows, np.ones(langid.SIZE))
    assert (model["weights"] == 0).mean() > 0.5 and model["temperature"] > 0


# --- 2 toxicity ---


def toxic_rows(n=300):
    rng = random.Random(2)
    vocabulary = ["tion", "there", "ingly", "house", "river", "stone", "cloud"]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 120))]
        if i % 3 == 0:
            words[rng.randrange(len(words))] = rng.choice(["vile", "rotten"])
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    return rows


def test_toxicity_held_out_accuracy(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, toxicity.learnable(labels))
    found = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).collect()}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(found[i]["held_out"] == (i in held) for i, *_ in rows)
    assert np.mean([found[i]["predicted"] == rows[i][2] for i in held]) > 0.9
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in found.values())
    odd = toxicity.score_toxicity(frame(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)


def test_toxicity_gradients():
    """The way back through the network against differences."""
    rng = np.random.default_rng(0)
    vocabulary = {b"aa": 1, b"bb": 2}
    p = {k: v.astype(np.float64) for k, v in toxicity.start_weights(3, rng).items()}
    words, ids, y = [b"aa", b"bb", b"cc"], np.array([[1, 2], [2, 3], [3, 0]]), np.array([1.0, 0.0])

    def loss():
        z = toxicity.logits(p, toxicity.gates_of(p, toxicity.word_vectors(p, vocabulary, words)), ids)
        s = toxicity.sigmoid(z)
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    g = toxicity.step(p, vocabulary, words, ids, y)
    for k in ("word", "Wf", "Ub", "A", "a", "o", "cf"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old = p[k][at]
        p[k][at] = old + 1e-2
        up = loss()
        p[k][at] = old - 1e-2
        down = loss()
        p[k][at] = old
        assert g[k][at] == pytest.approx((up - down) / 2e-2, rel=0.08, abs=2e-4), k


def test_toxicity_windows_cover_all_words():
    for n in (0, 1, 47, 48, 49, 80, 81, 500):
        starts = toxicity.starts_of(n)
        assert set(range(n)) <= {s + k for s in starts for k in range(toxicity.WINDOW)}


def test_toxicity_without_labels(spark):
    docs = frame(spark, ODD)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit_toxicity(docs, labels) is None
    assert {r["score"] for r in toxicity.score_toxicity(docs, None).collect()} == {0.0}


# --- 3 chat ---


def test_chat_round_trip(spark):
    rng = random.Random(3)
    bits = ["<|im_end|>", "\n", chat.SIGN, "1", "<", "|", "a", "<|im_sep|>", "<|im_start|>", "2", "é"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a\nb", None]), rng.choice([None, "", "".join(rng.choices(bits, k=6))])) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(50, 1, "user", "again")] * 3 + [(51, None, "user", "x"), (51, 0, "assistant", "y"), (52, 0, None, None)]
    frame_ = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, segments int")
    found = {r["conv_id"]: r for r in chat.chat_digest(frame_).collect()}
    groups = defaultdict(list)
    for c, t, role, text in rows:
        groups[c].append((-1 if t is None else t, role or "", text or ""))
    assert found.keys() == groups.keys()
    for c, turns in groups.items():
        turns.sort(key=lambda x: (x[0], chat_escape(x[1], True), chat_escape(x[2])))
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        r = found[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def chat_escape(s, role=False):
    s = s.replace(chat.SIGN, chat.SIGN + "0").replace("<|", chat.SIGN + "1")
    return s.replace("\n", chat.SIGN + "2") if role else s


def test_chat_merges_neighbours_only(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "user", "d")]
    out = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()["formatted"]
    assert out == "<|im_start|>user\na<|im_sep|>b<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n<|im_start|>user\nd<|im_end|>\n"
    assert chat.chat_digest(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# --- 4 SentencePiece ---


@pytest.fixture(scope="module")
def piece_model():
    return str(pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model"))


def test_sentencepiece_equals_library(spark, piece_model):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_model)
    rng = random.Random(4)
    bits = [" ", "  ", "\n", "a", "aa", "the", "é", "1", "　", "梦", "🙂", "ing", "tion", "▁", "thing"]
    texts = [*ODD, *("".join(rng.choices(bits, k=rng.randint(0, 30))) for _ in range(60)), "ab" * 150 + " " * 40]
    texts = [t for t in texts if t is None or len(t) < 15_000]
    found = {r["doc_id"]: r for r in sentencepiece_lattice.encode(frame(spark, texts), piece_model).collect()}
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        assert found[i]["ids"] == library.encode(t or ""), t
        assert found[i]["decoded"] == library.decode(library.encode(t or ""))
    assert sentencepiece_lattice.encode(frame(spark, []), piece_model).count() == 0


def test_long_units_equal_the_library(piece_model, monkeypatch):
    """Texts without spaces, in parts so small that many are cut, and stretches that no place cuts."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_model)
    rng = random.Random(12)
    bits = ["the", "tion", "中", "文", "日本", "かな", "x", "é", "ing", "1", "…", "ß", "🙂", "a"]
    texts = ["中文" * 500, "x" * 700, "".join(chr(rng.randrange(0x4E00, 0x6000)) for _ in range(3000)), *("".join(rng.choices(bits, k=rng.randint(30, 300))) for _ in range(60)), *("".join(rng.choices("aeinorst", k=200)) for _ in range(30))]
    for part in (1 << 17, 64):
        monkeypatch.setattr(sentencepiece_lattice, "PART_CHARS", part)
        lattice = sentencepiece_lattice.Lattice(sentencepiece_lattice.load_pieces(piece_model), False)
        assert [np.frombuffer(c, "<i4").tolist() for c in lattice(texts)] == [library.encode(t) for t in texts]
        assert not any(len(u) >= sentencepiece_lattice.FOLD_CHARS for u in lattice.known)


def test_viterbi_fold_takes_the_best_sum(spark):
    pieces_ = [(0, "<unk>", 0.0, "unknown"), (1, "▁a", -2.0, "normal"), (2, "b", -1.5, "normal"), (3, "ab", -1.0, "normal"), (4, "▁", -1.0, "normal"), (5, "a", -3.0, "normal")]
    units = spark.createDataFrame([("▁ab",), ("▁a",), ("▁q",), ("▁" + "ab" * 40,)], "unit string")
    found = {r["unit"]: r["ids"] for r in sentencepiece_lattice.encode_units(units, pieces_, unigram=True).collect()}
    assert found["▁ab"] == [4, 3] and found["▁a"] == [1] and found["▁q"] == [4, 0]
    assert found["▁" + "ab" * 40] == [4] + [3] * 40


def test_relational_lattice_equals_arrays(spark, piece_model):
    texts = [t for t in ODD if t is None or len(t) < 2_000] + ["the thing  nation ", "梦🙂 " * 5, "ab" * 60]
    rows = [{r["doc_id"]: (r["ids"], r["decoded"]) for r in f(frame(spark, texts), piece_model).collect()} for f in (sentencepiece_lattice.encode, sentencepiece_lattice.encode_relational)]
    assert rows[0] == rows[1] and len(rows[0]) == len(texts)


def test_array_lattice_takes_the_best_sum():
    pieces_ = [(0, "<unk>", 0.0, "unknown"), (1, "▁a", -2.0, "normal"), (2, "b", -1.5, "normal"), (3, "ab", -1.0, "normal"), (4, "▁", -1.0, "normal"), (5, "a", -3.0, "normal")]
    lattice = sentencepiece_lattice.Lattice(pieces_, unigram=True)
    ids = [np.frombuffer(x, "<i4").tolist() for x in lattice(["ab", "a", "q", "ab" * 40, ""])]
    assert ids == [[4, 3], [1], [4, 0], [4] + [3] * 40, []]


def test_heap_equals_fold():
    rng = random.Random(9)
    for _ in range(200):
        n = rng.randint(1, 12)
        scores = {(a, b): float(rng.randint(-9, 0)) for a in range(n) for b in range(a + 2, n + 1) if rng.random() < 0.5}
        cuts = list(range(n + 1))
        while tried := [(-scores[cuts[i], cuts[i + 2]], i) for i in range(len(cuts) - 2) if (cuts[i], cuts[i + 2]) in scores]:
            del cuts[min(tried)[1] + 1]
        assert sentencepiece_lattice.heap_bpe(n, scores) == cuts


# --- 5 SimHash ---


def brute_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_fingerprints():
    rng = random.Random(5)
    texts = [*ODD, *(" ".join(rng.choices(["A", "b", "c\x0bd", "É", "e"], k=rng.randint(0, 40))) for _ in range(50))]
    for t in texts:
        assert simhash.fingerprint(None if t is None else t.encode()) == brute_fingerprint(t)


def clusters(seed, n=40):
    rng = np.random.default_rng(seed)
    out = set()
    for b in rng.integers(0, 2**63, n, dtype=np.int64):
        out.add(int(b))
        for _ in range(rng.integers(0, 10)):
            x = int(b)
            for k in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(k)
            out.add(x - 2**64 if x >= 2**63 else x)
    return sorted(out)


@pytest.mark.parametrize("hot", [simhash.HOT, 1])
def test_links_tie_all_within_three_bits(spark, hot):
    prints = clusters(hot)
    fp = np.array(prints, np.int64).view(np.uint64)
    parent = list(range(len(fp)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    close = set()
    for i in range(len(fp)):
        for j in np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= 3) + i + 1:
            close.add(frozenset((prints[i], prints[j])))
            parent[find(i)] = find(int(j))
    want = defaultdict(set)
    for i, x in enumerate(prints):
        want[find(i)].add(x)
    links = simhash.links(spark.createDataFrame([(x,) for x in prints], "fp long"), hot)
    assert {frozenset((r["a"], r["b"])) for r in links.collect()} <= close
    found = defaultdict(set)
    for r in connected(links).collect():
        found[r["root"]] |= {r["root"], r["node"]}
    assert {frozenset(x) for x in found.values()} == {frozenset(x) for x in want.values() if len(x) > 1}


def test_near_duplicates(spark):
    base = " ".join(f"w{i}" for i in range(400))
    texts = [base, base + " end", "other words here", base, None, "", "other words here"]
    ids = [5, 3, 9, 7, 20, 21, 9]
    found = simhash.simhash_digest(frame(spark, texts, ids)).collect()
    got = sorted((r["doc_id"], r["component_id"], r["fingerprint"]) for r in found)
    near = bin(brute_fingerprint(base) ^ brute_fingerprint(base + " end")).count("1") <= 3
    assert [g[0] for g in got] == sorted(ids)
    assert {i: c for i, c, _ in got} == {3: 3, 5: 3 if near else 5, 7: 3 if near else 5, 9: 9, 20: 20, 21: 20}
    assert all(len(g[2]) == 16 for g in got) and dict((g[0], g[2]) for g in got)[20] == "0" * 16
    kept = simhash.deduplicate(frame(spark, texts, ids))
    assert sorted(r["doc_id"] for r in kept.collect()) == ([3, 9, 20] if near else [3, 5, 9, 20])
    assert kept.columns == frame(spark, []).columns
    assert simhash.simhash_digest(frame(spark, [])).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100)], "a long, b long")
    found = {r["node"]: r["root"] for r in connected(edges).collect()}
    assert found == {i: 0 for i in range(1, 61)}


# --- 6 quality ---


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = defaultdict(list)
    for i in range(len(words) - 4):
        runs[tuple(words[i : i + 5])].append(i)
    repeated = {i + k for at in runs.values() if len(at) > 1 for i in at for k in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(repeated), n < 10 or 100 * len(repeated) > 20 * n


def test_quality_counts(spark):
    rng = random.Random(6)
    texts = [*ODD, *("".join(rng.choices(["a ", "b ", "c\n", "#", "é", "\n", "|", "\x1c", "a b c d e "], k=rng.randint(0, 80))) for _ in range(80))]
    for r in quality.quality_rules(frame(spark, texts), None).collect():
        assert tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == brute_quality(texts[r["doc_id"]]), texts[r["doc_id"]]
        assert r["kept"] == (not r["base_failed"])


def test_quality_model(spark):
    rng = random.Random(7)
    good, bad = ["house", "river", "stone", "cloud", "tree"], ["ho|use", "ri%%%", "st$$$", "cl&&&"]
    rows = [(i, " ".join(rng.choice(good if i % 2 else bad) + str(rng.randint(0, 99)) for _ in range(40)), i % 2) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = quality.fit_quality(docs, spark.createDataFrame([(i, y) for i, _, y in rows[:200]], "doc_id long, quality int"))
    found = {r["doc_id"]: r for r in quality.quality_rules(docs, model).collect()}
    assert np.mean([found[i]["kept"] == bool(y) for i, _, y in rows[200:]]) > 0.95
    kept = quality.keep_good(docs, model)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in found.items() if r["kept"]}
    assert quality.fit_quality(docs, spark.createDataFrame([], "doc_id long, quality int")) is None


def test_mean_weight_in_parts():
    w = np.random.default_rng(1).normal(size=quality.SIZE).astype(np.float32)
    text = bytes(random.Random(1).randrange(256) for _ in range(5000))
    assert quality.mean_weight(w, text, 700) == pytest.approx(quality.mean_weight(w, text), rel=1e-6)


# --- 7 decontamination ---


def brute_hits(text, windows):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    hit, items = set(), set()
    for size in {len(w) for w in windows}:
        for i in range(len(words) - size + 1):
            if (found := windows.get(tuple(words[i : i + size]))) is not None:
                hit.update(range(i, i + size))
                items |= found
    return len(words), len(hit), items


def test_decontamination(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(["Aa", "b", "É", "c1", "dd", "ee", "ff"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([30, 12, 10, 9, 3, 2, 14])] + [(20, ""), (21, None), (22, "---"), (3, "zz yy xx"), (None, "qq ww ee")]
    mixed = lambda: " ".join([*(word() for _ in range(20)), *rng.choice(items[:7])[1].split(), *(word() for _ in range(9))])
    texts = [*ODD, *(mixed() for _ in range(60)), "ZZ-yy_XX!"]
    windows = defaultdict(set)
    for i, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
        for at in range(max(len(w) - 9, 1) if w else 0):
            windows[tuple(w[at : at + 10])] |= {i} - {None}
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, texts)
    for r in decontaminate.decontaminate(docs, bench).collect():
        n, hit, found = brute_hits(texts[r["doc_id"]], windows)
        ids = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (n, hit, len(found), ids, hit > 0)
    clean = decontaminate.remove_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {i for i, t in enumerate(texts) if not brute_hits(t, windows)[1]}
    spans = {r["doc_id"]: r["clean"] for r in decontaminate.remove_spans(docs, bench).collect()}
    assert spans == {i: brute_clean(t, windows) for i, t in enumerate(texts)}
    text = "Hello, World! (ZZ yy-XX)\tBye.\n\nÉnd"
    row = decontaminate.remove_spans(frame(spark, [text]), bench.where("item_id = 3")).first()
    assert row["clean"] == "Hello, World! ()\tBye.\n\nÉnd"


def brute_clean(text, windows):
    """The text without each stretch from the first to the last of neighbouring hit words."""
    if text is None:
        return None
    words = list(re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text))
    lower = [low(w[0]) for w in words]
    hit = {i + k for n in {len(w) for w in windows} for i in range(len(lower) - n + 1) if tuple(lower[i : i + n]) in windows for k in range(n)}
    out, at = "", 0
    for i in sorted(hit):
        if i - 1 not in hit:
            out += text[at : words[i].start()]
        at = words[i].end()
    return out + text[at:]


def test_decontamination_repeated_rows_and_empty_benchmark(spark):
    text = "one two three four five six seven eight nine ten"
    docs = frame(spark, [text, text, "else", None], [1, 1, 1, None])
    bench = spark.createDataFrame([(7, text)], "item_id long, text string")
    assert sorted(r["n_hit"] for r in decontaminate.decontaminate(docs, bench).collect()) == [0, 0, 10, 10]
    none = decontaminate.decontaminate(docs, bench.where("false")).collect()
    assert len(none) == 4 and not any(r["contaminated"] for r in none)
    assert decontaminate.decontaminate(frame(spark, []), bench).count() == 0


# --- 8 token files ---


@pytest.fixture(scope="module")
def bpe():
    return str(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))


def test_token_files(spark, bpe, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "SHARD_IDS", 500)
    library = Tokenizer.from_file(bpe)
    rng = random.Random(10)
    bits = [" ", "  ", "\n", "a", "'s", "é", "1", "　", "\x85", "<|endoftext|>", "🙂", "tion"]
    texts = [*ODD, *("".join(rng.choices(bits, k=rng.randint(0, 30))) for _ in range(80))]
    ids = rng.sample(range(-500, 500), len(texts))
    shards = token_files.write_tokens(frame(spark, texts, ids), bpe)
    found = {r["doc_id"]: r for r in token_files.read_tokens(shards, True).collect()}
    start = 0
    for i, t in sorted(zip(ids, texts, strict=True), key=lambda x: x[0]):
        want = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (found[i]["start"], found[i]["ids"]) == (start, want)
        assert found[i]["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes())
        start += len(want)
    assert token_files.read_tokens(token_files.write_tokens(frame(spark, []), bpe)).count() == 0


def test_encoder_cuts_as_the_library(bpe, monkeypatch):
    """Whole texts of all kinds of characters, with a cache so small that it is emptied after every call."""
    import pyarrow as pa

    monkeypatch.setattr(token_files, "CACHE_BYTES", 2000)
    encode, rng = token_files.Encoder(bpe), random.Random(3)
    bits = [*"abZ12.!'_", "é", "ß", "中", "文", "か", "٣", "½", "'s", "'re", "'ll", "'S", " ", "  ", "\n", "\t", "\r\n", "\xa0", "　", "\u2028", "\x0b", "\x1c", "\x85", "🙂", "\u0301", "Ġ", "Ċ", "<|", "|>", "\0", "\u200b", "<|endoftext|>", "\ufeff"]
    texts = ["", "".join(bits), "中文" * 3000, "x" * 50_000, *("".join(rng.choices(bits, k=rng.randint(0, 60))) for _ in range(3000))]
    for at in range(0, len(texts), 500):
        own = texts[at : at + 500]
        flat, count = encode(pa.array(["left out", *own]).slice(1))
        assert [x.tolist() for x in np.split(flat, np.cumsum(count)[:-1])] == [x.tolist() for x in encode.whole(own)]


def test_encoder_of_another_kind(tmp_path):
    import pyarrow as pa
    from tokenizers import Tokenizer, models, pre_tokenizers

    other = Tokenizer(models.WordLevel({"a": 0, "b": 1, "?": 2}, unk_token="?"))
    other.pre_tokenizer = pre_tokenizers.Whitespace()
    other.save(str(tmp_path / "other.json"))
    flat, count = token_files.Encoder(str(tmp_path / "other.json"))(pa.array(["a b", "", "c a"]))
    assert flat.tolist() == [0, 1, 2, 0] and count.tolist() == [2, 0, 2]


def test_token_files_null_and_repeated_ids(spark, bpe):
    """Null ids come first, repeated ids stand side by side, and a repeated row is written as often as it occurs."""
    docs = frame(spark, ["b", "a", "a", "c d", None], [7, 7, 7, None, None])
    rows = token_files.read_tokens(token_files.write_tokens(docs, bpe), True).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, None, 7, 7, 7]
    assert sorted(map(len, (r["ids"] for r in rows))) == [1, 2, 2, 2, 3]
    assert [r["start"] for r in rows] == [0, *np.cumsum([r["n_tokens"] for r in rows])[:-1].tolist()]


def test_shards_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 3, 4, 5, 1000):
        ids = rng.choice([0, 5, 300, 70_000, 20_000_000], n).astype("<u4")
        image = token_files.pack([None, 4, -7], [n, 0, 0], ids) if n else token_files.pack([None, 4, -7], [0, 0, 0], ids)
        doc_ids, counts, out = token_files.unpack(image)
        assert doc_ids == [None, 4, -7] and counts.sum() == n and (out == ids).all()
    frequent = token_files.pack([1], [1000], np.array([70_000] * 990 + list(range(10)), "<u4"))
    assert len(frequent) < 1000 + 250 + 200


# --- 9 licenses ---


def test_license_base(spark):
    rng = random.Random(11)
    bits = ["cc", "by", "CC-BY", "General", "public", "license", "all rights", "reserved", "x", "\n", "é", "cc.by"]
    texts = [*ODD, *(" ".join(rng.choices(bits, k=rng.randint(0, 40))) for _ in range(80))]
    for r in licenses.scan_licenses(frame(spark, texts)).collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(texts[r["doc_id"]]))
        at = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in at]
        labels = sorted({label for _, label in at})
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(labels))
        assert set(labels) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1


def test_license_templates():
    a = licenses.compile_template("one two <<beginOptional>> three <<beginOptional>> four <<endOptional>> <<endOptional>> <<var;2>> end")
    yes = ["one two end", "one two three end", "one two three four end", "one two x end", "one two three x y end"]
    no = ["one two", "one end", "one two x y z end", "one two four five six end"]
    assert all(licenses.accepts(a, t.encode().split(), 0) for t in yes)
    assert not any(licenses.accepts(a, t.encode().split(), 0) for t in no)
    scan = licenses.scanner(licenses.PHRASES, licenses.TEMPLATES, licenses.REFERENCES)
    assert scan(b"Licensed under the GNU General Public License, version 3.")[5] == "gpl,gpl-3.0"
    assert scan(b"Released under the MIT License.")[5:] == ("mit", licenses.REFERENCE)
    for wrong in ("<<beginOptional>> x <<endOptional>>", "x <<beginOptional>> y"):
        with pytest.raises(ValueError):
            licenses.compile_template(wrong)


def plain_match(tokens, words, at=0):
    """Whether the template's tokens match words from `at` on, by trying every way."""
    if not tokens:
        return True
    head, rest = tokens[0], tokens[1:]
    if head == "[":
        depth = end = 0
        for end, t in enumerate(tokens):
            depth += {"[": 1, "]": -1}.get(t, 0)
            if not depth:
                break
        return plain_match(tokens[1:end] + tokens[end + 1 :], words, at) or plain_match(tokens[end + 1 :], words, at)
    if isinstance(head, int):
        return any(plain_match(rest, words, at + n) for n in range(min(head, len(words) - at) + 1))
    return at < len(words) and words[at] == head and plain_match(rest, words, at + 1)


def test_license_automata_equal_plain_matching():
    rng = random.Random(13)
    for _ in range(300):
        tokens, depth = [rng.choice("ab")], 0
        for _ in range(rng.randint(1, 10)):
            kind = rng.random()
            if kind < 0.15 and depth < 2:
                tokens.append("[")
                depth += 1
            elif kind < 0.3 and depth and tokens[-1] != "[":
                tokens.append("]")
                depth -= 1
            else:
                tokens.append(rng.randint(0, 3) if kind > 0.85 else rng.choice("abc"))
        tokens += [rng.choice("abc")] + ["]"] * depth
        marks = {"[": "<<beginOptional>>", "]": "<<endOptional>>"}
        a = licenses.compile_template(" ".join(f"<<var;{t}>>" if isinstance(t, int) else marks.get(t, t) for t in tokens))
        for _ in range(30):
            words = [tokens[0], *rng.choices("abc", k=rng.randint(0, 9))]
            assert licenses.accepts(a, [w.encode() for w in words], 0) == plain_match(tokens, words), (tokens, words)


def test_whole_licenses():
    """Each template's own wording is accepted, with other holders too; with a mandatory word changed it is not."""
    scan = licenses.scanner(licenses.PHRASES, licenses.TEMPLATES, {})
    for label, many in licenses.TEMPLATES.items():
        for template in many:
            text = re.sub(r"<<var;\d+>>", " acme ", re.sub(r"<<(begin|end)Optional>>", " ", template)).strip()
            row = scan(f"x. {text.upper() if label == 'mit' else text} y".encode())
            assert label in row[5].split(",") and row[6] == licenses.FULL, label
            if label != "copyright-notice":
                words = text.split()
                near = " ".join([*words[:-2], "changed", words[-1]]).encode()
                assert label not in scan(near)[5].split(",") and 0.2 < scan(near)[6] < licenses.FULL, label
    both = licenses.CONDITIONS + licenses.NO_NAMES + licenses.DISCLAIMER
    assert scan(re.sub("<<[^>]*>>", " ", both).encode())[5] == "bsd-3-clause"


# --- 10 WARC ---


def test_warc(spark):
    rows = [(5, "u5", "same"), (3, "u3", "same"), (9, None, "same"), (1, "u1", "a\r\n\r\nWARC/1.1\r\n\r\n"), (2, "u", None), (8, "u", ""), (7, "u", "é🙂"), (3, "u3", "same"), (3, "v", "other"), (None, "n", "lone")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, capture string")
    found = warc.page_records(pages).collect()
    assert len(found) == len(rows)
    left = sorted(((p is None, p or 0), (h or "")) for p, _, h in rows)
    first = {}
    for (_, p), h in left:
        first.setdefault(h, p)
    used = set()
    for r in sorted(found, key=lambda r: (r["page_id"] is None, r["page_id"] or 0, r["record_type"])):
        own = [h for p, _, h in rows if p == r["page_id"] and base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode() == r["payload_digest"]]
        h = own[0] or ""
        assert r["payload_bytes"] == len(h.encode())
        response = h not in used and (r["page_id"] or 0) == first[h]
        used.add(h)
        assert r["record_type"] == ("response" if response else "revisit")
        assert r["refers_to"] == (None if response else first[h])
    assert warc.page_records(pages.where("false")).count() == 0
    none = warc.page_records(pages, min_revisit=100).collect()
    assert {r["record_type"] for r in none} == {"response"}


def test_warc_captures_are_nested(spark):
    pages = spark.createDataFrame([(1, "http://x/", "<p>hi</p>")], "page_id long, url string, html string")
    records = warc.read_archives(spark, warc.write_archives(pages), with_payload=True)
    row = warc.captures(records).first()
    assert bytes(row["response"]["payload"]) == b"<p>hi</p>" and row["metadata"]["page_id"] == 1 and row["request"]["uri"] == "http://x/"


def test_warc_parser_refuses_damage():
    with pytest.raises(ValueError):
        list(warc.parse([b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc"]))
    with pytest.raises(ValueError):
        list(warc.parse([b"HTTP/1.1 200\r\n\r\n"]))
