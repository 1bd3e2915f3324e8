"""Token counts without tokens: Aho-Corasick matches and a Viterbi pass that carries score and count only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import freeing, prepare
from .pieces import MARK, load_pieces


class _Known(dict):
    """Counts of words; one that is missing is counted and added."""

    def __init__(self, counter: Counter):
        super().__init__({"": 0})
        self.counter = counter

    def __missing__(self, word: str) -> int:
        self[word] = n = self.counter.word(word)
        return n


class Counter:
    """Counts the pieces of words; remembers up to `most` words, then starts anew."""

    def __init__(self, path: str, most: int = 250_000):
        import ahocorasick

        table = load_pieces(path)
        self.automaton = ahocorasick.Automaton()
        for piece, _, score in table.pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _, _ in table.pieces if len(p) == 1}
        self.unknown, self.most = table.unknown_score, most
        self.known = _Known(self)

    def word(self, word: str) -> int:
        n = len(word)
        best, count = [float("-inf")] * (n + 1), [0] * (n + 1)
        best[0], done = 0.0, 0
        single, unknown = self.single, self.unknown
        # matches come by end, longest first, so a shorter piece must be strictly better; unknown characters last
        for last, (size, score) in self.automaton.iter(word):
            end = last + 1
            while done < last:
                if word[done] not in single and best[done] + unknown > best[done + 1]:
                    best[done + 1], count[done + 1] = best[done] + unknown, count[done] + len(word[done].encode())
                done += 1
            value = best[end - size] + score
            if value > best[end]:
                best[end], count[end] = value, count[end - size] + 1
        while done < n:
            if word[done] not in single and best[done] + unknown > best[done + 1]:
                best[done + 1], count[done + 1] = best[done] + unknown, count[done] + len(word[done].encode())
            done += 1
        return count[n]

    def text(self, text: str) -> int:
        if not text:
            return 0
        # no piece spans a space's mark or a line feed, so words between them are independent
        words = (MARK + text.replace(" ", " " + MARK).replace("\n", " \n ")).split(" ")
        if len(self.known) > self.most:
            self.known = _Known(self)
        return sum(map(self.known.__getitem__, words))


_COUNTERS: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """One row per input row: doc_id, n_tokens.

    Whole texts are counted; a null or empty text has 0 tokens. Every word's path is scored by itself in exact
    arithmetic, so a count doesn't depend on where in a text a word stands. Repeated rows and null doc_ids are
    rows like any other; other columns are left out; no rows give no rows. No shuffle.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_path not in _COUNTERS:
            _COUNTERS[model_path] = Counter(model_path)
        counter = _COUNTERS[model_path]
        for b in batches:
            counts = [counter.text(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])
        counter.known = _Known(counter)  # a worker outlives its task

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(freeing(run), "doc_id long, n_tokens long")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
