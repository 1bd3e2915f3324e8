"""SentencePiece encoding and decoding.

Texts fall into words at spaces' marks and line feeds, which no piece spans. A batch's distinct words that aren't known
yet meet the piece table by their substrings, and the best path of each is folded and traced in columns (`lattice`). The
words of a text get their ids where the text lies: nothing is shuffled, whatever the number of distinct words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import freeing, prepare
from .lattice import Lattice
from .pieces import MARK, PieceTable, load_pieces

#: So many distinct words go with a task, with their ids; then it starts anew with those of the batch at hand.
BROADCAST_WORDS = 250_000
_LATTICES: dict[str, Lattice] = {}


def words_of(text: str) -> list[str]:
    """The words of a text, marks included, in order, with empty ones between; none for an empty text."""
    return (MARK + text.replace(" ", " " + MARK).replace("\n", " \n ")).split(" ") if text else []


class _Words:
    """The ids of distinct words."""

    def __init__(self, lattice: Lattice, most: int):
        self.lattice, self.most = lattice, most
        self.clear()

    def clear(self) -> None:
        self.at = {"": 0}  # of each word
        self.counts, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def add(self, words: set[str]) -> None:
        counts, ids = [self.counts], [self.ids]
        for part, n, found in self.lattice.paths(words):
            self.at.update(zip(part, range(len(self.at), len(self.at) + len(part)), strict=True))
            counts.append(n)
            ids.append(found)
        self.counts, self.ids = np.concatenate(counts), np.concatenate(ids)

    def encode(self, texts: pa.Array) -> pa.Array:
        """A list of ids for each text, null for null."""
        each = [words_of(t) if t is not None else [] for t in texts.to_pylist()]
        words = list(chain.from_iterable(each))
        distinct = set(words)
        new = distinct - self.at.keys()
        if len(self.at) + len(new) > self.most:
            self.clear()
            new = distinct - {""}
        if new:
            self.add(new)
        at = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        counts = self.counts[at]
        ends = np.concatenate([[0], np.cumsum(counts)])
        first = np.cumsum(self.counts) - self.counts
        ids = self.ids[np.repeat(first[at] - ends[:-1], counts) + np.arange(ends[-1])]
        offsets = ends[np.concatenate([[0], np.cumsum([len(x) for x in each], dtype=np.int64)])]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()), mask=texts.is_null())


def encoded(spark: SparkSession, text: Column, model_path: str) -> Column:
    """The piece ids of a text: an array of int, null for a null text. The model is read on the driver only."""
    prepare(spark)
    table = load_pieces(model_path)
    key, most, sent = hashlib.sha256(repr(table).encode()).hexdigest(), BROADCAST_WORDS, spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if key not in _LATTICES:
            _LATTICES[key] = Lattice(sent.value)
        words = _Words(_LATTICES[key], most)
        for b in batches:
            yield words.encode(b)
        words.clear()

    # bytes that aren't UTF-8 count as replacement characters
    return F.arrow_udf(freeing(run), "array<int>")(F.make_valid_utf8(text.cast("string")))


def encode(rows: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """rows with `ids` (array of int): the piece ids of column `text`.

    Null texts have null ids, empty ones an empty array. Every input row stays, repeated ones too, with all its
    columns; a column named `ids` is replaced. Equal words of a task are encoded once, as far as they are remembered.
    No shuffle.
    """
    return rows.withColumn("ids", encoded(rows.sparkSession, F.col(text), model_path))


def decode_keyed(rows: DataFrame, model_path: str, key: str, ids: str = "ids") -> DataFrame:
    """(key, decoded) for rows (key, ids) with distinct keys. Ids outside the table raise.

    Rows that are dealt by the key already aren't dealt again.
    """
    table = load_pieces(model_path)
    codes = [(i, p.replace(MARK, " ").encode().hex()) for p, i, _ in table.pieces] + [(table.first_byte + b, f"{b:02x}") for b in range(256)]
    pieces = F.broadcast(rows.sparkSession.createDataFrame(codes, "_id int, _code string"))  # a vocabulary of fixed size
    each = rows.select(key, F.posexplode_outer(ids).alias("_pos", "_id")).join(pieces, "_id", "left")
    unknown = F.raise_error(F.concat(F.lit("no such piece: "), F.col("_id").cast("string")))
    each = each.withColumn("_code", F.when(F.col("_id").isNull(), "").otherwise(F.coalesce("_code", unknown)))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_pos", "_code"))), lambda p: p["_code"]), "")
    return each.groupBy(key).agg(F.regexp_replace(F.decode(F.unhex(text), "UTF-8"), "^ ", "").alias("decoded"))


def decode(rows: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """rows with `decoded`: the text that column `ids` stands for; null ids give null.

    Equal ids are decoded once. Ids outside the table raise; bytes that aren't UTF-8 become replacement
    characters. The first word's mark is dropped and other marks are spaces.
    """
    rows = rows.drop("decoded").withColumn("_key", F.sha2(F.array_join(ids, ","), 256))
    each = rows.filter(F.col(ids).isNotNull()).select("_key", F.col(ids).alias("ids")).dropDuplicates(["_key"])
    return rows.join(decode_keyed(each, model_path, "_key"), "_key", "left").drop("_key")


def codes_of(table: PieceTable) -> Column:
    """An array whose element i + 1 is what piece i stands for, in hexadecimal; empty where i is no piece of a text."""
    codes = [""] * (max([table.first_byte + 255, *(i for _, i, _ in table.pieces)]) + 1)
    for p, i, _ in table.pieces:
        codes[i] = p.replace(MARK, " ").encode().hex()
    codes[table.first_byte : table.first_byte + 256] = [f"{b:02x}" for b in range(256)]
    return F.split(F.lit(",".join(codes)), ",")  # folded to one constant


def decoded(ids: Column, table: PieceTable) -> Column:
    """The text of piece ids, looked up by position in the vocabulary, in the row itself. Ids outside it raise."""

    def code(i: Column) -> Column:
        found = F.get(codes_of(table), i)
        return F.when(F.length(found) > 0, found).otherwise(F.raise_error(F.concat(F.lit("no such piece: "), i.cast("string"))))

    return F.regexp_replace(F.decode(F.unhex(F.array_join(F.transform(ids, code), "")), "UTF-8"), "^ ", "")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of `documents`, encoded and decoded again: doc_id, n_pieces, ids, round_trip; one row per input row."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), path)
    ids = F.col("ids")
    return rows.select("doc_id", F.size(ids).cast("long").alias("n_pieces"), F.array_join(ids, " ").alias("ids"), (decoded(ids, load_pieces(path)) == F.col("text")).alias("round_trip"))
