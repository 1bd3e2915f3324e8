"""Spelling variants: words one edit apart, by a trie whose edges are a table and whose frontier walks through joins.

Words of each length have tries of their own, one over their letters and one over their letters reversed. A node is
the hash of a prefix, of a length and a direction. From a node with r letters left, an edge spans the largest power of
two that is at most r, and is told by the hash of these letters: so a word of any length is walked in as many joins
as r has binary ones. A word's own prefix is its state without edits. An edit in its later half leaves the trie of
its letters there, one in its earlier half that of the reversed letters, so states branch only where few words go on:
a letter left out goes to the trie of words that are one shorter, a letter replaced to a sibling by the table of
single letters. Letters put in are the first case seen from the other word. States with one edit then join the edge
table, one edge a level, until no letters are left; the node where they end names their neighbours, and each pair
is verified on its texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import freeing, mix, prepare, saved
from .manifest import CRC_TABLE, crc32_sql

RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LETTERS, LEAST_COUNT = 7, 2
#: A form occurs at least so many times as often as the word.
TIMES = 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_SALTS = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344))
_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)


def words_of(docs: DataFrame, misspelt: int = 31) -> DataFrame:
    """(word, n): distinct words of at least LEAST_LETTERS letters and LEAST_COUNT occurrences; null texts have none.

    Where `misspelt` divides the checksum of `<doc_id>:<run>` (no digits for a null doc_id), the run loses a letter.
    """
    run = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN), F.lit(0))).alias("run"))
    run = run.filter(F.length("run") >= LEAST_LETTERS)
    # few words have capitals, and folding each letter by a table costs
    run = run.withColumn("run", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", _UPPER, _LOWER)).otherwise(F.col("run")))
    h = F.crc32(F.concat(F.coalesce("doc_id", F.lit("")), F.lit(":"), F.col("run")))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("h") % misspelt == 0, shorter).otherwise(F.col("run"))
    found = run.withColumn("h", h).select(word.alias("word")).filter(F.length("word") >= LEAST_LETTERS)
    return found.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


class _Tries:
    """Hashes of any stretch of letters of the words in a batch, read forward or backward."""

    def __init__(self, words: pa.Array, backward: bool):
        texts = words.to_pylist()
        self.n = np.fromiter(map(len, texts), np.int64, len(texts))
        self.start = np.concatenate([[0], np.cumsum(self.n)])[:-1]
        letters = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
        if backward:
            # the letter at j of a word of n letters comes from n - 1 - j
            of = np.repeat(np.arange(len(texts)), self.n)
            letters = letters[2 * self.start[of] + self.n[of] - 1 - np.arange(len(letters))]
        self.letters, self.salt, self.backward = letters, _SALTS[backward], backward
        size = len(letters) + 1
        self.power = self._powers(_BASE, size)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(letters + _MULTIPLIER) * self._powers(_INVERSE, size)[:-1])])

    @staticmethod
    def _powers(base: int, size: int) -> np.ndarray:
        table = np.full(size, base, np.uint64)
        table[0] = 1
        return np.multiply.accumulate(table)

    def stretch(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of the letters from a to b, wherever they stand."""
        return np.where(b > a, self.power[np.maximum(b - 1, 0)] * (self.sums[b] - self.sums[a]), np.uint64(0))

    def node(self, word: np.ndarray, depth: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The node of a word's first letters in the trie of words of `size` letters."""
        s = self.start[word]
        return mix((self.stretch(s, s + depth) ^ self.salt) + size.astype(np.uint64) * _MULTIPLIER).view(np.int64)

    def label(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(self.stretch(a, b) + (b - a).astype(np.uint64)).view(np.int64)

    def late(self) -> tuple[np.ndarray, np.ndarray]:
        """(word, place) for each letter of a word's later half; together, both directions have each letter once."""
        count = self.n // 2 if self.backward else self.n - self.n // 2
        word = np.repeat(np.arange(len(self.n)), count)
        first = np.cumsum(count) - count
        return word, self.n[word] - count[word] + np.arange(len(word)) - first[word]

    def to_walk(self, word: np.ndarray, place: np.ndarray) -> pa.ListArray:
        """Labels of the edges from `place` to the word's end."""
        at, left = self.start[word] + place, self.n[word] - place
        rounds = int(left.max()).bit_length() if len(left) else 0
        labels, on = np.zeros((len(word), rounds), np.int64), np.zeros((len(word), rounds), bool)
        for k in range(rounds):
            step = 1 << (rounds - 1 - k)
            on[:, k] = (left & step) > 0
            end = np.where(on[:, k], at + step, at)
            labels[:, k] = self.label(at, end)
            at = end
        offsets = np.concatenate([[0], np.cumsum(on.sum(1))])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(labels[on], pa.int64()))


#: Words whose rows are made at once, so that a very long word doesn't hold others' rows.
_WORDS, _LETTERS = 2_000, 100_000


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, _Tries]]:
    """(ids, words, tries) of few letters at a time, in both directions."""
    for b in batches:
        letters = np.cumsum(np.array([len(w) for w in b.column(1).to_pylist()], np.int64))
        at = 0
        while at < b.num_rows:
            end = int(np.searchsorted(letters, (letters[at - 1] if at else 0) + _LETTERS, "right"))
            end = min(max(end, at + 1), at + _WORDS, b.num_rows)
            part = b.slice(at, end - at)
            for backward in (False, True):
                yield part.column(0), part.column(1), _Tries(part.column(1), backward)
            at = end


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, _, t in _batches(batches):
        word, place = t.late()
        left = t.n[word] - place
        step = np.int64(1) << (np.frexp(left)[1] - 1).astype(np.int64)
        s = t.start[word] + place
        yield pa.RecordBatch.from_arrays([pa.array(t.node(word, place, t.n[word])), pa.array(t.label(s, s + step)), pa.array(t.node(word, place + step, t.n[word]))], ["node", "label", "child"])


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, _, t in _batches(batches):
        word, place = t.late()
        letter = t.letters[t.start[word] + place].astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(t.node(word, place, t.n[word])), pa.array(letter), pa.array(t.node(word, place + 1, t.n[word]))], ["node", "letter", "child"])


def _without_edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, _, t in _batches(batches):
        word, place = t.late()
        letter = t.letters[t.start[word] + place].astype(np.int32)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(word)), pa.array(t.node(word, place, t.n[word])), pa.array(letter), t.to_walk(word, place + 1)], ["id", "node", "letter", "rest"])


def _left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States after leaving out a letter; of equal letters in a row only the last, read forward."""
    for ids, _, t in _batches(batches):
        word, place = t.late()
        s, n = t.start[word] + place, t.n[word]
        # read backward, the letter after is the one before
        beside = np.where(place > 0, s - 1, s) if t.backward else np.where(place < n - 1, s + 1, s)
        keep = ((t.letters[s] != t.letters[beside]) | (beside == s)) & (n > LEAST_LETTERS)
        word, place = word[keep], place[keep]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(word)), pa.array(t.node(word, place, t.n[word] - 1)), t.to_walk(word, place + 1)], ["id", "node", "rest"])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, _, t in _batches(batches):
        word = np.arange(len(t.n))
        yield pa.RecordBatch.from_arrays([ids, pa.array(t.node(word, t.n, t.n))], ["id", "node"])


def neighbours(words: DataFrame) -> DataFrame:
    """(a, b): ids of words that differ by one edit, each pair once. words: (id long, word, ...), saved, distinct words."""
    prepare(words.sparkSession)
    rows = words.select("id", "word")
    edges = saved(rows.mapInArrow(freeing(_edges), "node long, label long, child long").distinct())
    children = rows.mapInArrow(freeing(_letters), "node long, letter int, child long").distinct()
    own = rows.mapInArrow(freeing(_without_edits), "id long, node long, letter int, rest array<long>")
    other = children.select("node", F.col("letter").alias("to"), "child")
    replaced = own.join(other, "node").filter("to > letter").select("id", F.col("child").alias("node"), "rest")
    frontier = saved(replaced.unionByName(rows.mapInArrow(freeing(_left_out), "id long, node long, rest array<long>")))
    done = []
    longest = frontier.agg(F.max(F.size("rest"))).first()[0] or 0
    for level in range(longest + 1):
        done.append(frontier.filter("size(rest) = 0").select("id", "node"))
        if level < longest:
            going = frontier.filter("size(rest) > 0").select("id", "node", F.element_at("rest", 1).alias("label"), F.slice("rest", F.lit(2), F.size("rest")).alias("rest"))
            frontier = saved(going.join(edges, ["node", "label"]).select("id", F.col("child").alias("node"), "rest"))
    ended = done[0]
    for d in done[1:]:
        ended = ended.unionByName(d)
    names = rows.mapInArrow(freeing(_ends), "id long, node long").select(F.col("id").alias("b"), "node")
    pairs = ended.withColumnRenamed("id", "a").join(names, "node").select("a", "b").filter("a <> b").distinct()
    texts = lambda c: words.select(F.col("id").alias(c), F.col("word").alias(f"word_{c}"))
    return pairs.join(texts("a"), "a").join(texts("b"), "b").filter(F.levenshtein("word_a", "word_b", 1) == 1).select("a", "b")


def roots(forms: DataFrame) -> DataFrame:
    """(id, root): the last id that following (id, form) leads to. forms has each id once and no circles.

    Pointers double each round; a form is TIMES as frequent as its word, so there are few.
    """
    at = saved(forms.select("id", F.col("form").alias("root")))
    while True:
        further = saved(at.select(F.col("id").alias("root"), F.col("root").alias("_next")))
        joined = saved(at.join(further, "root", "left"))
        if joined.filter("_next is not null").isEmpty():
            return at
        at = saved(joined.select("id", F.coalesce("_next", "root").alias("root")))


def variants(docs: DataFrame, misspelt: int = 31) -> DataFrame:
    """One row a word: word, form, root, n, n_near, form_n.

    docs: (doc_id, text). Words are counted over whole texts, so a text of any length, repeated rows and null doc_ids
    count like others; null and empty texts have no words; other columns are left out; no words give no rows. Of near
    words that are equally frequent the form is the smallest in code-point order.
    """
    words = saved(words_of(docs, misspelt).withColumn("id", F.monotonically_increasing_id()))
    pairs = saved(neighbours(words))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(words.select(F.col("id").alias("b"), "word", "n"), "b")
    # strings compare by bytes of UTF-8, which is the order of code points
    near = near.groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), F.col("word").alias("word"), F.col("b").alias("id"))).alias("best"))
    near = saved(near.select(F.col("a").alias("id"), "n_near", (-F.col("best.less")).alias("best_n"), F.col("best.word").alias("best_word"), F.col("best.id").alias("best_id")))
    full = saved(words.join(near, "id", "left"))
    has = F.coalesce(F.col("best_n") >= TIMES * F.col("n"), F.lit(False))
    root = roots(full.filter(has).select("id", F.col("best_id").alias("form")))
    root = saved(root.join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word"))
    return full.join(root, "id", "left").select(
        "word", F.when(has, F.col("best_word")).alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best_n")).alias("form_n")
    )


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


_BYTES = "flatten(list_transform(string_split({s}, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::UBIGINT] ELSE [195::UBIGINT, (ord(x) - 64)::UBIGINT] END))"
OP13_SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
o AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS k FROM o WHERE length(run) >= {LEAST_LETTERS} GROUP BY ALL),
c AS (SELECT d.*, {crc32_sql(_BYTES.format(s="doc_id || ':' || run"))} AS h FROM d, crc_table),
m AS (SELECT CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, k FROM c),
w AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM m WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(k) >= {LEAST_COUNT}),
v AS MATERIALIZED (SELECT word, i, word[:i - 1] || word[i + 1:] AS x FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS MATERIALIZED (SELECT a.word AS a, b.word AS b FROM v a JOIN v b ON a.x = b.x AND a.i = b.i AND a.word <> b.word UNION SELECT word, x FROM v SEMI JOIN w ON w.word = v.x UNION SELECT x, word FROM v SEMI JOIN w ON w.word = v.x),
b AS (SELECT p.a AS word, count(*) AS n_near, max(w.n) AS top FROM p JOIN w ON w.word = p.b GROUP BY p.a),
f AS MATERIALIZED (SELECT w.word, w.n, b.n_near, b.top, CASE WHEN b.top >= {TIMES} * w.n THEN (SELECT min(p.b) FROM p JOIN w x ON x.word = p.b WHERE p.a = w.word AND x.n = b.top) END AS form FROM w LEFT JOIN b USING (word)),
r(word, last, form) AS (SELECT word, word, form FROM f UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON f.word = r.form)
SELECT f.word, f.form, r.last AS root, f.n, coalesce(f.n_near, 0) AS n_near, CASE WHEN f.form IS NOT NULL THEN f.top END AS form_n FROM f JOIN r ON r.word = f.word AND r.form IS NULL
"""
