"""Spelling variants against all pairs of words."""

import random
import re
from collections import Counter
from zlib import crc32

from pyspark.sql import functions as F

from tidewater.llm import variants as V


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def by_hand(docs, misspelt=31):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % misspelt == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    best = {w: min(near[w], key=lambda x: (-n[x], x)) if near[w] else None for w in n}
    form = {w: best[w] if best[w] and n[best[w]] >= 10 * n[w] else None for w in n}
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def found(spark, docs, misspelt=31):
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit(1), "word": F.lit("a clashing name")})
    rows = [tuple(r) for r in V.variants(df, misspelt).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_random_words_as_by_hand(spark):
    rng = random.Random(5)
    stems = ["".join(rng.choices("abÀé", k=rng.randint(6, 12))) for _ in range(40)]
    words = []
    for s in stems:
        for _ in range(6):
            i, c = rng.randrange(len(s)), rng.choice("abÀéZ")
            words.append(rng.choice([s, s[:i] + s[i + 1 :], s[:i] + c + s[i + 1 :], s[:i] + c + s[i:]]))
    docs = [(i, " ".join(rng.choices(words, k=60)) + "." + " ".join(rng.choices(stems[:3], k=200))) for i in range(12)]
    docs += [(None, " ".join(words)), (3, None), (4, ""), (4, ""), (5, "12 345 short"), (6, "ABCDEFGH abcdefgh ÀBCDEFGH àbcdefgh " * 2)]
    want = by_hand(docs)
    assert found(spark, docs) == want
    assert sum(r[4] for r in want) > 100 and any(r[1] for r in want)


def test_chain_of_forms_ties_and_repeated_letters(spark):
    text = " ".join(["aaaaaaab"] * 400 + ["aaaaaaa"] * 40 + ["aaaaaaaa"] * 40 + ["aaaaaac"] * 4 + ["aaaaaacc"] * 2)
    want = by_hand([(1, text)], misspelt=2**40)
    assert found(spark, [(1, text)], misspelt=2**40) == want
    root = {r[0]: (r[1], r[2]) for r in want}
    assert root["aaaaaac"] == ("aaaaaaa", "aaaaaaab")


def test_very_long_words_and_none(spark):
    rng = random.Random(9)
    long = "".join(rng.choices("abc", k=30_000))
    words = [long, long[:-1], long[:9_000] + "d" + long[9_000:], long[:20_000] + long[20_001:], long[:100] + "d" + long[101:], "x" * 64, "x" * 65, "x" * 63 + "y", "x" * 66]
    docs = [(i, " ".join(words)) for i in range(2)]
    assert found(spark, docs, 2**40) == by_hand(docs, 2**40)
    assert found(spark, [(1, "no words of note"), (2, None)]) == set()
    assert found(spark, []) == set()
