"""Language identification: scripts narrow the candidates, Viterbi over per-word scores labels spans.

Words are runs of letters of one script. A word's script leaves the languages that are written in it; its letter
n-grams give each of these a score (mean log probability shares, summed over the word). A text is then cut into
spans by the best path over its words, where each change of language costs a penalty, so a foreign name stays in its
surroundings and a quoted paragraph doesn't.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import freeing, if_small, mix, prepare, saved

# Blocks of Unicode by script, first and last code point; letters of none of these count as "other".
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F), (0xA8E0, 0xA8FF)],
    "bengali": [(0x980, 0x9FF)],
    "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)],
    "malayalam": [(0xD00, 0xD7F)],
    "sinhala": [(0xD80, 0xDFF)],
    "thai": [(0xE00, 0xE7F)],
    "lao": [(0xE80, 0xEFF)],
    "tibetan": [(0xF00, 0xFFF)],
    "myanmar": [(0x1000, 0x109F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "ethiopic": [(0x1200, 0x139F)],
    "khmer": [(0x1780, 0x17FF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9D)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F)],
}
NAMES = [*SCRIPTS, "other"]

#: A model learns from at most so many documents of a language (those whose hashed ids are least) ...
TRAINING_DOCS = 4_000
#: ... and at most so many languages, those with the most documents.
MOST_LANGUAGES = 64
#: A language is written in a script that holds so much of its letters.
SCRIPT_SHARE = 0.01
#: What a change of language costs, in units of a word's score.
SWITCH = 12.0
ORDERS, BITS = (2, 3, 4), 15
UNKNOWN = "und"
_BUCKETS = len(ORDERS) << BITS


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: script (0 for what is neither letter nor mark; marks have 255), whether it is a letter, its lower case."""
    script, letter, lower = np.zeros(0x110000, np.uint8), np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            script[c], letter[c] = len(NAMES), True
            low = chr(c).lower()
            if len(low) == 1:
                lower[c] = ord(low)
        elif kind == "M":
            script[c] = 255
    for i, name in enumerate(SCRIPTS):
        for a, b in SCRIPTS[name]:
            script[a : b + 1][letter[a : b + 1]] = i + 1
    return script, letter, lower


class Words:
    """Words of a list of texts: start and end (code points in their text), text, script, letters, and n-gram buckets."""

    def __init__(self, texts: list[str]):
        script, letter, lower = _tables()
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.concatenate([[0], np.cumsum(sizes)])
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = script[points]
        first = np.zeros(len(points) + 1, bool)
        first[begin] = True
        self.start = self.end = self.text = self.script = self.letters = np.zeros(0, np.int64)
        self.row = self.gram = np.zeros(0, np.int64)
        if not len(points):
            return
        # a mark takes the script of what is before it
        marks = np.flatnonzero(kind == 255)
        if len(marks):
            solid = np.where((kind != 255) | first[:-1], np.arange(len(kind)), 0)
            kind = kind[np.maximum.accumulate(solid)]
            kind[kind == 255] = 0
        changes = np.ones(len(points), bool)
        changes[1:] = (kind[1:] != kind[:-1]) | first[1:-1]
        runs = np.flatnonzero(changes)
        ends = np.append(runs[1:], len(points))
        keep = kind[runs] > 0
        runs, ends = runs[keep], ends[keep]
        self.text = np.searchsorted(begin, runs, "right") - 1
        self.start, self.end = runs - begin[self.text], ends - begin[self.text]
        self.script = kind[runs].astype(np.int64) - 1
        counted = np.concatenate([[0], np.cumsum(letter[points])])
        self.letters = counted[ends] - counted[runs]
        self._grams(points, runs, ends, lower)

    def _grams(self, points: np.ndarray, runs: np.ndarray, ends: np.ndarray, lower: np.ndarray) -> None:
        """gram: buckets of the n-grams of words between marks of their ends; row: the first gram of each word."""
        sizes = ends - runs + 2
        at = np.cumsum(sizes) - sizes
        total = int(sizes.sum())
        chars = np.zeros(total, np.uint64)
        inner = np.ones(total, bool)
        inner[at] = inner[at + sizes - 1] = False
        chars[inner] = lower[points[np.repeat(runs - at - 1, sizes)[inner] + np.flatnonzero(inner)]]
        word = np.repeat(np.arange(len(runs)), sizes)
        left = np.repeat(at + sizes, sizes) - np.arange(total)  # chars up to the word's end
        grams, owners = [], []
        h = chars * np.uint64(0x9E3779B97F4A7C15)
        for n in range(2, max(ORDERS) + 1):
            h[: total - n + 1] = mix(h[: total - n + 1]) + chars[n - 1 :] * np.uint64(0xC2B2AE3D27D4EB4F)
            if n in ORDERS:
                ok = left >= n
                grams.append((ORDERS.index(n) << BITS) + (mix(h[ok]) >> np.uint64(64 - BITS)).astype(np.int64))
                owners.append(word[ok])
        owner, gram = np.concatenate(owners), np.concatenate(grams)
        order = np.argsort(owner, kind="stable")
        self.gram, self.row = gram[order], np.searchsorted(owner[order], np.arange(len(runs)))

    def __len__(self) -> int:
        return len(self.text)


def is_held_out(doc_id: Column) -> Column:
    """Whether a document takes no part in learning; one without an id isn't held out, and takes no part either."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, docs_a_language: int = TRAINING_DOCS, languages: int = MOST_LANGUAGES) -> dict:
    """Log probabilities of n-gram buckets by language, and the languages that each script may write.

    docs: (doc_id, text, lang), only those to learn from. Which documents are taken doesn't depend on partitioning. The
    driver gets a count for each bucket and language, at most.
    """
    prepare(docs.sparkSession)
    labelled = docs.filter("doc_id is not null and text is not null and lang is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = saved(labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages))
    # a bound on the hash, from the language's count, leaves little more than is wanted for the last cut, so that no task
    # ranks a language's rows; the texts of what was chosen, with all rows of an id, follow
    chosen = labelled.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).join(F.broadcast(known), "lang")
    chosen = chosen.filter(F.col("h") / F.lit(2.0**64) + 0.5 <= F.lit(1.2 * docs_a_language) / F.col("n"))
    chosen = chosen.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).filter(F.col("k") <= docs_a_language)
    chosen = if_small(saved(chosen.select("lang", "doc_id").distinct()), docs_a_language * languages)
    rows = labelled.join(chosen, ["lang", "doc_id"]).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            w = Words(b.column(1).to_pylist())
            count = np.diff(np.append(w.row, len(w.gram)))
            langs, code = np.unique(b.column(0).to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
            for i, lang in enumerate(langs.tolist()):
                mine = code[w.text] == i
                total = sums.setdefault(lang, np.zeros(_BUCKETS + len(NAMES), np.int64))
                total += np.bincount(w.gram[np.repeat(mine, count)], minlength=_BUCKETS + len(NAMES))
                total[_BUCKETS:] += np.bincount(w.script[mine], w.letters[mine], len(NAMES)).astype(np.int64)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["lang", "at", "n"])

    counts = rows.mapInArrow(freeing(run), "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(counts.column(0).to_pylist()))
    table = np.zeros((len(names), _BUCKETS + len(NAMES)))
    if names:
        table[np.searchsorted(names, counts.column(0).to_numpy(zero_copy_only=False).astype(str)), counts.column(1).to_numpy()] = counts.column(2).to_numpy()
    letters = table[:, _BUCKETS:]
    grams = table[:, :_BUCKETS].reshape(len(names), len(ORDERS), 1 << BITS)
    # a bucket's share, smoothed toward an even share; scores of orders are averaged, so that no gram counts thrice
    share = (grams + 0.05) / (grams.sum(2, keepdims=True) + 0.05 * grams.shape[2]) if names else grams
    score = (np.log(share) / len(ORDERS)).reshape(len(names), _BUCKETS).T.astype(np.float32).copy()
    written = letters >= SCRIPT_SHARE * np.maximum(letters.sum(1, keepdims=True), 1)
    written[:, ~written.any(0)] = True  # a script that no language has tells nothing
    return {"languages": names, "scores": score, "scripts": written.T.copy()}


def path(scores: np.ndarray, first: np.ndarray, count: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The language of each word on the best path through its text: scores are (words, languages), a text's words in a row.

    All texts step together, longest first, so that those that go on are always the first ones. On equal scores a text
    stays in its language, and then takes the smaller.
    """
    total, k = scores.shape
    out = np.zeros(total, np.int64)
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    going = np.searchsorted(-count, -np.arange(int(count.max()) if len(count) else 0), "left")  # texts with more than t words
    stay, best = np.zeros((total, k), bool), np.zeros(total, np.int64)
    lead = np.zeros((len(count), k))
    for t, n in enumerate(going):
        at = first[:n] + t
        now = lead[:n]
        if t:
            stay[at] = now >= -switch
            np.maximum(now, -switch, out=now)
        now += scores[at]
        top = now.argmax(1)
        best[at] = top
        now -= now[np.arange(n), top][:, None]
    state = np.zeros(len(count), np.int64)
    for t in range(len(going) - 1, -1, -1):
        n = going[t]
        at = first[:n] + t
        ends = count[:n] == t + 1
        state[:n] = np.where(ends, best[at], state[:n])
        out[at] = state[:n]
        if t:
            state[:n] = np.where(stay[at, state[:n]], state[:n], best[at - 1])
    return out


def _word_scores(w: Words, model: dict) -> np.ndarray:
    """(words, languages): summed scores of a word's n-grams; a language that doesn't write the script falls far behind."""
    grams = model["scores"][w.gram]
    scores = np.add.reduceat(grams, w.row, axis=0).astype(np.float64)
    scores -= scores.max(1, keepdims=True)
    scores[~model["scripts"][w.script]] -= 1e6
    return scores


#: Texts of so many code points are worked on at once, divided by the number of languages beyond four.
_AT_ONCE = 1 << 20


def label_spans(texts: list[str], model: dict, switch: float = SWITCH) -> list[list[tuple[int, int, str, int]]]:
    """For each text its spans (start, end, language, letters), in code points; from a span's first word to its last."""
    names, out = model["languages"], []
    for part in _parts(texts, max(1, _AT_ONCE // max(1, len(names) // 4))):
        w = Words(part)
        found: list[list[tuple[int, int, str, int]]] = [[] for _ in part]
        if len(w) and names:
            first = np.searchsorted(w.text, np.arange(len(part)))
            count = np.searchsorted(w.text, np.arange(len(part)), "right") - first
            lang = path(_word_scores(w, model), first, count, switch)
            change = np.ones(len(w), bool)
            change[1:] = (lang[1:] != lang[:-1]) | (w.text[1:] != w.text[:-1])
            at = np.flatnonzero(change)
            last = np.append(at[1:], len(w)) - 1
            letters = np.add.reduceat(w.letters, at)
            for i, a, b, x, n in zip(w.text[at].tolist(), w.start[at].tolist(), w.end[last].tolist(), lang[at].tolist(), letters.tolist()):
                found[i].append((a, b, names[x], n))
        out += found
    return out


def _parts(texts: list[str], most: int) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def identify(docs: DataFrame, model: dict, switch: float = SWITCH) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, spans.

    docs: (doc_id, text); whole texts are read. lang_pred has the most letters in its spans (of equal ones the smaller
    name), and score is its share of all letters. Texts that are null, or without letters, or for which nothing was
    learned, are `und` with score 0 and no spans. spans are `lang:start:end`, code points, comma-joined. Repeated rows
    and null doc_ids are rows of their own; other columns are left out; no rows give no rows. No shuffle.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by languages and buckets
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), is_held_out(doc_id).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores, spans = [], [], []
            for found in label_spans(b.column(2).to_pylist(), shared.value, switch):
                letters: dict[str, int] = {}
                for _, _, lang, n in found:
                    letters[lang] = letters.get(lang, 0) + n
                top = min(letters, key=lambda x: (-letters[x], x)) if letters else UNKNOWN
                langs.append(top)
                scores.append(letters[top] / max(1, sum(letters.values())) if letters else 0.0)
                spans.append(",".join(f"{lang}:{a}:{e}" for a, e, lang, _ in found))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, pa.string())], ["doc_id", "held_out", "lang_pred", "score", "spans"])

    return rows.mapInArrow(freeing(run), "doc_id long, held_out boolean, lang_pred string, score double, spans string")


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the documents that aren't held out; lang is read for those only."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs, train(docs.filter(~is_held_out(F.col("doc_id")))))
