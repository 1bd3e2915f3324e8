"""Operators against brute force on small tables, with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidewater.llm import chat, common, jaccard, lattice, merkle, packing, pii, quality, substrings, token_counts, topk
from tidewater.llm import sentencepiece as sp
from tidewater.llm.common import components

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def corpus():
    """Texts with copies, near copies, shared passages, nulls, blanks and a long one; ids don't follow row order."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs = {i: text(rng.randint(3, 120)) for i in range(40)}
    base = text(100).split(" ")
    passage = text(30)
    for i in range(40, 60):  # near copies of one text, at various distances
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        docs[i] = "\n".join([" ".join(words[:50]), " ".join(words[50:])])
    for i in range(60, 80):
        docs[i] = text(20) + "  " + passage + "\t" + text(20)
    docs |= {80: docs[3], 81: docs[3].upper(), 82: None, 83: "", 84: " \n ", 85: "one two", 86: "One  two", 87: text(9000), 88: "is on he " * 60, 89: "is on he " * 50, 90: "it is so " * 20, 91: "x " + "it is so " * 50 + "y"}
    rows = list(docs.items())
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    """Extra columns clash with names that operators use inside."""
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), i, "x", [1]) for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node long, component string, edges array<int>")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


# ---- components and top-k ---------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(200, 240)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("shard", [8192, 7])
def test_topk(spark, monkeypatch, shard):
    monkeypatch.setattr(topk, "SHARD_ROWS", shard)
    monkeypatch.setattr(topk, "LEAF_ROWS", 4)
    rng = random.Random(1)
    rows = [(i, [float(rng.randint(-3, 3)) / 256 for _ in range(5)]) for i in range(60)]
    rows += [(100, rows[4][1]), (101, rows[4][1]), (102, None), (103, [0.1, None, 0.2, 0.3, 0.4]), (104, [float("nan")] * 5), (105, [float("inf")] * 5), (106, [0.5, 0.5]), (107, []), (150, [0.0] * 5), (4, rows[4][1])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, rank string")
    v = topk.quantised(df)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(v, v.filter("id % 50 = 0 or id = 4 or id = 106")).collect()}
    good = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in e]) for i, e in rows if e and all(x is not None and np.isfinite(x) for x in e)]
    want = {}
    for q, e in good:
        if q % 50 == 0 or q in (4, 106):
            best = sorted((-sum(a * b for a, b in zip(e, f)), i) for i, f in good if i != q and len(f) == len(e))[:5]
            want |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate(best)}
    assert got == want
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0


def test_topk_prunes_clusters(spark, monkeypatch):
    """Of vectors in clusters a small share is scored; the answers are those of scoring all."""
    monkeypatch.setattr(topk, "SHARD_ROWS", 100)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(24, 12)) * 300
    x = np.floor(centres[rng.integers(24, size=2400)] + rng.normal(size=(2400, 12)) * 10).astype(int)
    v = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "id long, v array<long>")
    scored = spark.sparkContext.accumulator(0)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(v, v.filter("id % 50 = 0"), scored=scored).collect()}
    for q in range(0, 2400, 50):
        best = sorted((-int(x[q] @ x[i]), i) for i in range(2400) if i != q)[:5]
        assert [got[q, r + 1] for r in range(5)] == [(i, -s) for s, i in best]
    assert 0 < scored.value < 0.2 * 48 * 2400


def test_topk_large_magnitudes_keep_ties():
    """The slack of a bound follows the size of the vectors, so rounding leaves out no tie."""
    x = np.array([[2**25, 3, i % 2] for i in range(300)])
    best, ids = topk.BallTree(np.arange(300), x).search(np.array([-1]), np.array([[2**25, 1, 0]]), np.array([-np.inf]), 5)
    assert ids[0].tolist() == [0, 1, 2, 3, 4] and len(set(best[0])) == 1


def test_topk_refuses_what_doubles_cannot_hold():
    tree = topk.BallTree(np.arange(2), np.array([[2**27, 0], [0, 1]]))
    with pytest.raises(ValueError, match="too long"):
        tree.search(np.array([-1]), np.array([[2**26, 0]]), np.array([-np.inf]), 1)


# ---- repeats and near copies ------------------------------------------------------------------


def brute_repeats(rows):
    words = {i: SPLIT.findall(t or "") for i, t in rows}
    first = {}
    for i in sorted(words):
        for j in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][j : j + 13]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < i:
                gone[j : j + 13] = [True] * 13
        kept = [x for x, g in zip(w, gone) if not g]
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), kept)
    return out


def test_substrings(docs, corpus, none):
    want = brute_repeats(corpus)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.dedup_report(docs).collect()}
    assert got == {k: v[:3] for k, v in want.items()} and sum(v[1] for v in got.values()) > 500
    cut = substrings.remove_repeats(docs)
    assert cut.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert {k: SPLIT.findall(t or "") for k, t in texts.items()} == {k: v[3] for k, v in want.items()}
    assert texts[82] is None and texts[85] == "one two"
    assert substrings.dedup_report(none).count() == 0 and substrings.remove_repeats(none).count() == 0


def test_substrings_with_a_full_filter(docs, corpus):
    """A filter with far too few bits lets everything through and changes nothing."""
    want = {k: v[:3] for k, v in brute_repeats(corpus).items()}
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.dedup_report(docs, bits=64).collect()} == want


def test_substrings_repeated_rows(spark):
    t = " ".join(f"x{i}" for i in range(20))
    rows = spark.createDataFrame([(2, t), (2, t), (None, t), (3, t), (3, "other " + t), (9, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substrings.dedup_report(rows).collect())
    assert got == [(0, 20, 0), (2, 20, 0), (2, 20, 0), (3, 20, 20), (3, 21, 20), (9, 0, 0)]


def brute_links(rows):
    sets = {}
    for i, t in rows:
        w = SPLIT.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("common", [12, 3])
def test_jaccard(docs, corpus, none, monkeypatch, common):
    monkeypatch.setattr(jaccard, "COMMON_FROM", common)
    monkeypatch.setattr(jaccard.common_shingles, "__defaults__", (1000, common))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()}
    want = brute_links(corpus)
    assert got == want and len({v[1] for v in want.values()}) < len(want) - 5
    assert jaccard.jaccard_components(none).count() == 0


def test_jaccard_finds_links_that_the_cheap_round_misses(docs, corpus, monkeypatch):
    monkeypatch.setattr(jaccard, "SKETCH_AGREE", 99)
    monkeypatch.setattr(jaccard, "TILE_ROWS", 2)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 2)  # shingles of more than two documents are split
    monkeypatch.setattr(jaccard.common_shingles, "__defaults__", (1000, 3))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs).collect()}
    assert got == {k: v[1] for k, v in brute_links(corpus).items()}


def test_jaccard_pairs_of_one_hash_in_many_batches(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SKETCH_AGREE", 99)
    monkeypatch.setattr(common, "ARROW_ROWS", 3)
    words = " ".join(f"w{i}" for i in range(30))
    rows = spark.createDataFrame([(i, f"{words} own{i}") for i in range(40)] + [(99, "other words of no one else at all")], "doc_id long, text string").repartition(1)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(rows).collect()}
    assert got == {**dict.fromkeys(range(40), 0), 99: 99}


def test_jaccard_repeated_and_null_ids(spark):
    rows = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "A B c d e f"), (7, "a  b c d e f"), (None, "q"), (8, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in jaccard.jaccard_components(rows).collect()))
    assert got == [(0, 1, 0), (0, 2, 5), (5, 2, 5), (5, 2, 5), (7, 2, 5), (8, 0, 8)]


# ---- fingerprints -----------------------------------------------------------------------------


def brute_leaves(text):
    """Distinct spans of eight words within paragraphs, with their characters."""
    out = {}
    for p in text.split("\n"):
        chunks = re.findall("[^ ]* |[^ ]+$", p)
        for i in range(0, len(chunks), 8):
            span = "".join(chunks[i : i + 8])
            out[span] = len(span)
    return out


def brute_near(a, b):
    x, y = brute_leaves(a), brute_leaves(b)
    both, every = sum(n for s, n in x.items() if s in y), sum((x | y).values())
    return 1.0 if a == b else both / every if every else 0.0


def test_merkle(spark, docs, corpus, none):
    got = {r["doc_id"]: r for r in merkle.fingerprint_documents(docs).collect()}
    ordered = sorted((i, t or "") for i, t in corpus)
    for n, (i, t) in enumerate(ordered):
        tail, after = len(t) // 4, ordered[(n + 1) % len(ordered)][1]
        edited = t[: len(t) - tail] + after[:tail]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert got[i]["near_edited"] == pytest.approx(brute_near(t, edited)) and got[i]["near_next"] == pytest.approx(brute_near(t, after))
        assert (got[i]["near_edited"] == 1.0) == (edited == t)
    prints = {}
    for i, t in ordered:
        prints.setdefault(t, set()).add(got[i]["fingerprint"])
    assert all(len(p) == 1 for p in prints.values()) and len({min(p) for p in prints.values()}) == len(prints)
    assert merkle.fingerprint_documents(none).count() == 0
    assert got[82]["fingerprint"] == got[83]["fingerprint"]


def test_merkle_locates_edits(spark):
    text = "\n".join(f"paragraph {i} says something of its own" for i in range(40))
    df = spark.createDataFrame([(text, text.replace("paragraph 17 says", "paragraph 17 said"))], "a string, b string")
    df = merkle.with_fingerprint(merkle.with_fingerprint(df, "a", "fa"), "b", "fb")
    where = [merkle.differing_sections(F.col("fa"), F.col("fb")).alias("s"), merkle.differing_paragraphs(F.col("fa"), F.col("fb")).alias("p")]
    r = df.select(*where, merkle.likeness(F.col("fa"), F.col("fb")).alias("l"), merkle.differing_sections(F.col("fa"), F.col("fa")).alias("none")).first()
    assert len(r["s"]) in (1, 2) and r["p"] == [17] and 0.9 < r["l"] < 1 and r["none"] == []
    # what is put in moves all later paragraphs and leaves their sections as they are
    lines = text.split("\n")
    more = spark.createDataFrame([(text, "\n".join([*lines[:5], "one more", *lines[5:]]))], "a string, b string")
    r = merkle.with_fingerprint(merkle.with_fingerprint(more, "a", "fa"), "b", "fb").select(*where).first()
    assert r["p"] == [5] and len(r["s"]) <= 2


def test_merkle_ranges(spark, docs, none):
    """However many ranges, every row sees the next one; ids at the ends of their type and null ones too."""
    rows = [(i * 7 % 101, f"t{i}") for i in range(101)] + [(-(2**63), "least"), (2**63 - 1, "greatest"), (None, "null")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ordered = [t for _, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))]
    for n in (1, 2, 9, 60, 103):
        got = {r["text"]: r["next_text"] for r in merkle.with_next(df, n).collect()}
        assert got == {t: ordered[(i + 1) % len(ordered)] for i, t in enumerate(ordered)}


def test_merkle_single_and_repeated_rows(spark):
    one = merkle.fingerprint_documents(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
    rows = spark.createDataFrame([(1, "bbbb"), (1, "aaaa"), (None, "cccc")], "doc_id long, text string")
    got = {r["doc_id"]: r["edited_sha256"] for r in merkle.fingerprint_documents(rows).filter("doc_id is null").collect()}
    assert got[None] == hashlib.sha256(b"ccca").hexdigest()  # null ids come first, then ties by text


# ---- tokens -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def unigram():
    """The same table in another library's exact unigram model."""
    import sentencepiece
    from tokenizers import Tokenizer, models

    m = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    vocabulary = [(m.id_to_piece(i), -1e9 if m.is_byte(i) or m.is_control(i) or m.is_unknown(i) else m.get_score(i)) for i in range(m.get_piece_size())]
    t = Tokenizer(models.Unigram(vocabulary, 0, True))
    return lambda text: t.encode("▁" + text.replace(" ", "▁"), add_special_tokens=False).ids if text else []


TEXTS = ["Hello  world\n foo ", "", None, "日本語 テスト ﷽x🎉", " a", "x" * 400, "\n\n", "naïve café, the theatre!", "a\tb\r\nc", "the the the", "🎉🎉", "Hello  world\n foo "]


def test_unigram_encoding_and_counts(spark, unigram):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    rows = sp.decode(sp.encode(df, PIECES), PIECES).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        t = TEXTS[r["doc_id"]]
        assert (r["ids"], r["decoded"]) == ((None, None) if t is None else (unigram(t), t))
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(df, PIECES).collect()}
    assert counts == {i: len(unigram(t or "")) for i, t in enumerate(TEXTS)}
    empty = df.limit(0)
    assert sp.encode(empty, PIECES).count() == 0 and token_counts.count_tokens(empty, PIECES).count() == 0


def test_counts_of_documents(spark, sf_dir, unigram):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, PIECES).collect()} == {i: len(unigram(t or "")) for i, t in texts.items()}


@pytest.mark.parametrize("most", [500_000, 3])
def test_encoding_runs_over_documents(spark, tmp_path, unigram, monkeypatch, most):
    """Every document, nulls and repeated rows too, with words sent to every task or joined by shuffle."""
    monkeypatch.setattr(sp, "BROADCAST_WORDS", most)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(1, TEXTS[1]), (0, TEXTS[0]), (None, "no id"), (99, " ".join(f"w{i % 700}" for i in range(5000)))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    join = lambda t: None if t is None else " ".join(map(str, unigram(t)))
    want = sorted([(i, None if t is None else len(unigram(t)), join(t), None if t is None else True) for i, t in rows], key=repr)
    assert sorted([tuple(r) for r in sp.op5_sentencepiece(spark, str(tmp_path)).select("doc_id", "n_pieces", "ids", "round_trip").collect()], key=repr) == want


def test_encoding_shuffles_and_saves_nothing(spark, tmp_path, unigram):
    """Distinct words without end take no disk, whatever their number; every word is another."""
    texts = [" ".join(f"w{i}x{j * 7919 % 100_003}é" for j in range(400)) for i in range(8)] + [None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    shared = common.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(shared))
    got = sp.op5_sentencepiece(spark, str(tmp_path))
    rows = {r["doc_id"]: r for r in got.collect()}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan and set(os.listdir(shared)) == before
    for i, t in enumerate(texts):
        want = None if t is None else unigram(t)
        assert (rows[i]["ids"], rows[i]["round_trip"]) == ((None, None) if t is None else (" ".join(map(str, want)), True))


@pytest.mark.parametrize("few, fields", [(0, 1 << 25), (0, 0), (1 << 30, 0)])
def test_paths_of_many_words_and_of_few(spark, sf_dir, unigram, monkeypatch, few, fields):
    """Both folds give the other library's path, for words of unlike length beside one another too, with either table."""
    monkeypatch.setattr(lattice, "FEW_WORDS", few)
    monkeypatch.setattr(lattice, "DENSE_FIELDS", fields)
    words = {w for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect() for w in sp.words_of(r["text"] or "")} - {""}
    words |= {"▁日本語", "▁﷽x🎉", "x" * 400, "▁" + "🎉" * 50, "é" * 33, "\n", "▁", "▁a▁b", "▁the" * 30, "日本" * 90 + "z", "\0a\0", "▁\r\t", "\U0010ffff" * 2}
    found = {}
    for part, counts, ids in lattice.Lattice(sp.load_pieces(PIECES)).paths(words):
        ends = np.cumsum(counts)
        assert ends[-1] == len(ids)
        found |= {w: ids[e - n : e].tolist() for w, n, e in zip(part, counts, ends, strict=True)}
    before = unigram("\n")  # a mark and a line feed; a word without a mark stands behind a line feed
    assert set(found) == words
    assert all(found[w] == (unigram(w[1:]) if w[0] == "▁" and len(w) > 1 else unigram("\n" + w)[len(before) :]) for w in words)


def test_encoding_of_bytes_that_are_no_text(spark):
    rows = spark.createDataFrame([(b"ok \xff\xfe!",), (b"fine",), (None,)], "raw binary").select(F.col("raw").cast("string").alias("text"))
    got = [r["ids"] for r in sp.encode(rows, PIECES).select("ids").collect()]
    want = [r["ids"] for r in sp.encode(spark.createDataFrame([("ok \ufffd\ufffd!",), ("fine",), (None,)], "text string"), PIECES).collect()]
    assert got == want and got[2] is None and got[0] and got[1]


def test_decoding_in_the_row_refuses_unknown_ids(spark):
    table = sp.load_pieces(PIECES)
    for i in (10_000_000, 0, -1):
        with pytest.raises(Exception, match="no such piece"):
            spark.createDataFrame([([i],)], "ids array<int>").select(sp.decoded(F.col("ids"), table)).collect()


def test_decode_refuses_unknown_ids(spark):
    with pytest.raises(Exception, match="no such piece"):
        sp.decode(spark.createDataFrame([([10_000_000],)], "ids array<int>"), PIECES).collect()


def test_word_encoder_is_the_tokenizer(spark, sf_dir):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    texts = [r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(100).collect()]
    texts += [x or "" for x in TEXTS] + ["J̌a b́ İx Σας ΑΣ don't it's 123abc <|endoftext|>x  \x1c a b ﷽ 日本語, naïve z 'sup x'll.", "É,,, \t\r\n\v K Å ǅ,", "WORD!! word. Word&&&"]
    e = packing.WordEncoder(WORDS, most=50)
    for i in range(0, len(texts), 8):
        got = e.encode(texts[i : i + 8], 2)
        assert [g.tolist() for g in got] == [x.ids + [2] for x in t.encode_batch(texts[i : i + 8], add_special_tokens=False)]


# ---- packing ----------------------------------------------------------------------------------


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(tokens=64, segments=3, loss=50, waiting=5)])
def test_packing(docs, corpus, none, limits):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    ids = {i: np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4") for i, x in corpus}
    rows = packing.pack_documents(docs, WORDS, limits=limits, partitions=2).collect()
    covered, sequences = {}, {}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] > 0 and zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        covered.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], len(part) - (r["start"] + r["length"] == r["doc_tokens"])))
    assert set(covered) == set(ids)
    for i, parts in covered.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == len(ids[i])
    for s in sequences.values():
        at = 0
        for offset, n, _ in sorted(s):
            assert offset == at
            at += n
        assert at <= limits.tokens and len(s) <= limits.segments and sum(x[2] for x in s) <= limits.loss
        assert at == limits.tokens or at & (at - 1) == 0
    assert packing.pack_documents(none, WORDS).count() == 0


# ---- chat -------------------------------------------------------------------------------------


def test_loss_limit_decides_a_placement():
    """Tokens and segments would let the second example in; its loss-bearing tokens don't, so the third comes first."""

    def packed(loss):
        p = packing._Packer(packing.Limits(tokens=12, segments=4, loss=loss, waiting=8), 0)
        rows = []
        for key, flags in (("a", [1] * 6), ("b", [1] * 5), ("c", [0] * 4)):
            rows += p.add(key, np.arange(len(flags)), np.array(flags))
        rows += p.finish()
        assert sorted((r[0], r[1] + i) for r in rows for i in range(len(r[2]))) == [(k, i) for k, n in (("a", 6), ("b", 5), ("c", 4)) for i in range(n)]
        return [(r[0], r[1]) for r in rows]

    assert packed(12)[:2] == [("a", 0), ("b", 0)] and packed(8)[:2] == [("a", 0), ("c", 0)]


def test_chat(spark):
    rows = [
        (1, 1, "assistant", "hi </turn> \\ <turn user>"), (1, 0, "user", "q"), (2, 0, "system", None), (2, 1, "user", "\n</turn>\n"), (2, 2, "assistant", ""), (3, 0, "assistant", "first"), (3, 1, "assistant", "again"),
        (4, 0, "user", "end"), (5, 0, "od>d\\", "x"), (5, 0, "od>d\\", "x"), (5, 0, None, "x"), (None, 0, "user", "n"),
    ]
    df = spark.createDataFrame([(*r, True) for r in rows], "conv_id long, turn long, role string, text string, loss boolean")
    segments = chat.format_conversations(df)
    for ordered in (True, False):
        got = {r["conv_id"]: r for r in chat.read_back(segments if ordered else segments.repartition(3, "text"), ordered=ordered).collect()}
        for c in {r[0] for r in rows}:
            turns = sorted((t, r or "", x or "") for i, t, r, x in rows if i == c)
            loss = "".join(x for _, r, x in turns if r == "assistant")
            assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
            assert (got[c]["n_turns"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert {c: r["valid"] for c, r in got.items()} == {1: True, 2: True, 3: False, 4: False, 5: False, None: False}
    assert chat.read_back(chat.format_conversations(df.limit(0)), ordered=True).count() == 0


def test_chat_matches_sql(spark, sf_dir, duck):
    want = {r[0]: r for r in duck.sql(chat.OP10_SQL).fetchall()}
    got = {r[0]: tuple(r) for r in chat.op10_chat_format(spark, sf_dir).collect()}
    assert got == want and -7 in got


# ---- personal data ----------------------------------------------------------------------------


# Fixed formats of the contract, written out here so that the module's own are tested.
FORMATS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    found = []
    for n, (kind, pattern) in enumerate(FORMATS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1]))
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and total % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                found.append((m.start(), n, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(found)]


PRIVATE = [
    "mail a.b@c.example.com now, x@y, é@z.org,w@@q.com a@b.c@d.e", "1.2.3.4 256.1.1.1 1.2.3.4.5 010.0.0.1", "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111222233334444",
    "+1 (555) 123-4567. +12 +1.2.3.4.5.6.7.8.9", None, "", "🎉 ü a@b.co 🎉 10.0.0.1", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "1" * 5000, "@" * 300,
]


def test_pii_base(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(PRIVATE)], "doc_id long, text string, n_email int")
    for r in pii.find_pii(df, None).collect():
        want = brute_spans(PRIVATE[r["doc_id"]])
        assert r["spans"] == ",".join(want) and r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(w.startswith(k) for w in want) for k in pii.BASE]
    assert pii.find_pii(df.limit(0), None).count() == 0
    out = {r["doc_id"]: r["text"] for r in pii.redact(df, None).collect()}
    assert out[6] == "🎉 ü [email] 🎉 [ip]" and out[4] is None and out[5] == ""


@pytest.fixture(scope="module")
def trees(spark):
    return pii.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def judged(text, model):
    return [f"{k}:{text[s:e]}" for k, s, e in pii.spans(text, model)[1] if k in pii.JUDGED]


def test_pii_trees_find_what_formats_miss(trees):
    """Texts that no example was made from: what is personal is added whole, what only looks like it isn't."""
    rng = random.Random(4)
    secret = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    assert all(t is not None for t in trees["thresholds"].values()) and min(trees["recall"].values()) > 0.9
    for n in (32, 40, 64):
        s = secret(n)
        assert judged(f'das ist token = "{s}" und mehr', trees) == [f"secret:{s}"]
    assert judged("ask for phone (555) 201-4477 today", trees) == ["number:(555) 201-4477"]
    assert judged("pay into account: GB82 WEST 1234 5698 7654 32 now", trees) == ["account:GB82 WEST 1234 5698 7654 32"]
    assert judged("she was born 12.03.1975 in a town", trees) == ["born:12.03.1975"]
    for clean in (
        "commit: " + secret(40), "see page user_profile_2024_final or section-12-overview-3", "published 2021-04-05 and 1990-2005", "isbn: 978-3-16-148410-0",
        "order: 1234567890123456 of 1 200 000.00", "GB83 WEST 1234 5698 7654 32", "version: 10.0.19045.3803 of 2019-12-01",
    ):
        assert judged(clean, trees) == [], clean


def test_pii_same_on_small_and_large_tables(spark, trees):
    """Every planted secret and phone number of a table of any size is found, and repeated and null rows stand for themselves."""
    want = "token = "
    for sf in ("sf0.001", "sf0.01"):
        docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
        got = pii.find_pii(docs, pii.train(docs)).filter("n_added > 0")
        planted = docs.filter(F.col("text").rlike(want + '"[0-9a-f]{40}"'))
        assert {r["doc_id"] for r in planted.collect()} <= {r["doc_id"] for r in got.collect()}
    assert pii.find_pii(docs, trees).agg(F.sum("n_added")).first()[0] > 0
    rows = spark.createDataFrame([(1, "call (555) 201-4477"), (1, "call (555) 201-4477"), (None, "call (555) 201-4477"), (None, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_added"]) for r in pii.find_pii(rows, trees).collect()) == [(0, 0), (0, 1), (1, 1), (1, 1)]


def test_pii_trains_without_documents(spark, none):
    model = pii.train(none, each=200)
    assert set(model["thresholds"]) == set(pii.JUDGED) and pii.find_pii(none, model).count() == 0


def test_pii_long_runs_of_zeros():
    assert pii.spans("0" * 5000 + ".0.0.1", None)[0][0][0] == "ip"


def test_boosting_learns():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = pii.boost(x[:1500], y[:1500])
    assert ((pii.judge(model, x[1500:]) > 0.5) == y[1500:]).mean() > 0.95


# ---- quality ----------------------------------------------------------------------------------


def test_quality_on_held_out_labels(spark, sf_dir):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    train = labels.filter("doc_id % 2 = 0")
    got = {r["doc_id"]: r["keep"] for r in quality.score_documents(docs, train).collect()}
    held = [(r["doc_id"], r["quality"]) for r in labels.filter("doc_id % 2 = 1").collect()]
    assert len(got) == docs.count() and sum(got[i] == bool(q) for i, q in held) / len(held) > 0.97


def test_quality_shrinks_sparse_sites(spark):
    """A path with one bad document stays near its host, which stays nearer its own rate than the world's."""
    rows = [(i, "big", "a", -4.0 if i % 2 else 4.0) for i in range(400)] + [(1000 + i, "good", "a", 4.0) for i in range(400)] + [(5000, "good", "rare", -4.0), (5001, "good", "rare", 4.0), (None, None, None, 4.0)]
    found = spark.createDataFrame(rows, "doc_id long, host string, path string, evidence double")
    got = {r["doc_id"]: r for r in quality.posteriors(found, 0.5).collect()}
    assert len(got) == len(rows)
    assert abs(got[0]["host_posterior"] - 0.5) < 0.05 and got[1000]["host_posterior"] > 0.93
    assert 0.02 < got[5001]["path_posterior"] < got[5001]["host_posterior"]
    assert got[5000]["path_posterior"] > 0.9  # without itself only good ones are left


def brute_posteriors(rows, prior):
    """The hierarchy in plain numpy: rows (host, path, evidence) to (host posterior, path posterior, quality)."""
    e = np.array([r[2] for r in rows])
    p = 1 / (1 + np.exp(-e))
    key = [[("none",) if x is None else ("some", x) for x in r[:2]] for r in rows]
    groups, of = {}, {}
    for i, (h, q) in enumerate(key):
        groups.setdefault(h, []).append(i)
        of.setdefault((h, q), []).append(i)
    rate = min(max(p.mean(), 1e-6), 1 - 1e-6)

    def weight(sets, around):
        n = np.array([len(s) for s in sets], float)
        if len(sets) < 2:
            return 10.0
        noise = rate * (1 - rate)
        spread = (sum(len(s) * (p[s].mean() - a) ** 2 for s, a in zip(sets, around)) - (len(sets) - 1) * noise) / max(n.sum() - (n**2).sum() / n.sum(), 1e-9)
        return min(max(noise / spread - 1, 1.0), 1e4) if spread > 0 else 1e4

    wh = weight(list(groups.values()), [rate] * len(groups))
    wp = weight(list(of.values()), [p[groups[h]].mean() for h, _ in of])
    clip = lambda x: min(max(x, 1e-6), 1 - 1e-6)
    out = []
    for i, (h, q) in enumerate(key):
        a = clip((p[groups[h]].sum() - p[i] + wh * rate) / (len(groups[h]) - 1 + wh))
        b = clip((p[of[h, q]].sum() - p[i] + wp * a) / (len(of[h, q]) - 1 + wp))
        odds = e[i] - np.log(prior / (1 - prior)) + np.log(b / (1 - b))
        out.append((a, b, 1 / (1 + np.exp(-odds))))
    return out


def test_quality_posteriors_against_numpy(spark):
    """Random sites, repeated rows, null hosts and paths, sites of one row."""
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", "c", None]), rng.choice(["x", "y", None, f"p{i % 7}"]), rng.gauss(1, 3)) for i in range(300)] + [("lone", "x", -2.0)] + [("a", "x", 1.0)] * 3
    found = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, host string, path string, evidence double")
    got = {r["doc_id"]: (r["host_posterior"], r["path_posterior"], r["quality"]) for r in quality.posteriors(found, 0.7).collect()}
    assert all(got[i] == pytest.approx(w, rel=1e-9) for i, w in enumerate(brute_posteriors(rows, 0.7)))


def test_quality_query_against_numpy(spark):
    """The registered query over its whole table: posteriors and decisions follow from its evidence."""
    d = "/root/testdata/sf0.01"
    rows = quality.op6_quality_classifier(spark, d).collect()
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    prior = quality.train(docs, labels)["prior"]
    want = brute_posteriors([(r["host"], r["path"], r["evidence"]) for r in rows], prior)
    assert len(rows) == docs.count()
    assert all((r["host_posterior"], r["path_posterior"], r["quality"]) == pytest.approx(w, rel=1e-6) and r["keep"] == (r["quality"] >= 0.5) for r, w in zip(rows, want))


def test_quality_edges(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    assert all(r["keep"] for r in quality.score_documents(docs, labels).collect())  # one class teaches nothing
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(40)], "doc_id long, quality int")
    assert quality.score_documents(docs, labels).count() == docs.count()
    assert quality.score_documents(none, labels.limit(0)).count() == 0


def test_quality_sites_turn_decisions(spark):
    """The same weak evidence is kept on a good host's path and rejected on a bad one's; a sparse path follows its host."""
    rows = [(i, "good", f"p{i % 3}", 3.0) for i in range(300)] + [(1000 + i, "bad", f"p{i % 3}", -3.0) for i in range(300)]
    rows += [(2000, "good", "p0", -0.5), (2001, "bad", "p0", 0.5), (2002, "good", "rare", -0.5), (2003, "bad", "rare", 0.5), (2004, "good", "p1", -6.0), (2005, "bad", "p1", 6.0)]
    found = spark.createDataFrame(rows, "doc_id long, host string, path string, evidence double")
    got = {r["doc_id"]: r for r in quality.posteriors(found, 0.5).collect()}
    turned = {i for i in got if (got[i]["quality"] >= 0.5) != (got[i]["evidence"] >= 0)}
    # strong evidence stands whatever the site says
    assert turned == {2000, 2001, 2002, 2003}


def test_counts_of_repeated_rows_and_null_ids(spark):
    rows = [(None, "is on he"), (None, "is on he"), (7, "is on he"), (7, "he"), (8, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("a clashing name"))
    got = sorted(map(tuple, token_counts.count_tokens(df, PIECES).collect()), key=repr)
    one, two = (token_counts.Counter(PIECES).text(t) for t in ("is on he", "he"))
    assert got == sorted([(None, one), (None, one), (7, one), (7, two), (8, 0), (8, 0)], key=repr)


def test_packing_repeated_rows_and_null_ids(spark):
    """Rows of one id, or of none, are documents of their own: each is covered, none twice."""
    rows = [(None, "one two three"), (None, "one two three"), (7, "one two three"), (7, "four"), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("offset", F.lit("a clashing name"))
    got = packing.pack_documents(df, WORDS, keep_ids=True, partitions=2).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    want = sorted((repr(i), tok) for i, x in rows for tok in [*t.encode(x or "", add_special_tokens=False).ids, 2])
    assert sorted((repr(r["doc_id"]), tok) for r in got for tok in r["ids"]) == want
    assert sum(r["length"] == r["doc_tokens"] for r in got if r["doc_id"] is None) <= 2 and len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)
