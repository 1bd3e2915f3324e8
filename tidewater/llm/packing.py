"""Vector bin packing: examples into sequences under limits on tokens, segments and loss-bearing tokens at once.

An open sequence takes the waiting example whose need (tokens, segments, loss tokens, each as a share of its
limit) has the greatest dot product with what is left, as in Panigrahy et al. 2011. Examples may be cut: what
doesn't fit goes to later sequences. A sequence that can't be filled is cut into sequences whose lengths are
powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import freeing, prepare


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 64
    loss: int = 4096
    #: Examples that wait while a sequence is filled; bounds memory.
    waiting: int = 256


_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Byte-level tokenizers' rule: printable bytes stand for themselves, the others follow from 256 on.
_BYTE_CHARS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _SHOWN)}


class _Packer:
    """Packs a stream of (key, ids, loss tokens); yields pieces (key, start, ids, total, loss, sequence, offset)."""

    def __init__(self, limits: Limits, first: int):
        self.l, self.sequence = limits, first
        self.keys: list = []
        self.ids: list[np.ndarray] = []
        self.start: list[int] = []
        self.need = np.zeros((limits.waiting + 1, 3))
        self.bearing: list[np.ndarray | None] = []
        self.bin: list[tuple] = []
        self.left = np.array([limits.tokens, limits.segments, limits.loss])

    def _loss(self, i: int, start: int, length: int) -> int:
        flags = self.bearing[i]
        return length if flags is None else int(flags[start : start + length].sum())

    def add(self, key, ids: np.ndarray, bearing: np.ndarray | None) -> Iterator[tuple]:
        n = len(self.keys)
        self.keys.append(key)
        self.ids.append(ids)
        self.start.append(0)
        self.bearing.append(bearing)
        self.need[n] = len(ids), 1, self._loss(n, 0, len(ids))
        while len(self.keys) >= self.l.waiting:
            yield from self.step()

    def finish(self) -> Iterator[tuple]:
        while self.keys:
            yield from self.step()
        yield from self.close()

    def step(self) -> Iterator[tuple]:
        """Places one waiting example, or a piece of one, into the open sequence."""
        n = len(self.keys)
        need, left = self.need[:n], self.left
        fits = (need <= left).all(1)
        limit = np.array([self.l.tokens, self.l.segments, self.l.loss])
        last = left[1] == 1  # the last segment should fill the rest
        if fits.any() and not (last and (need[:, 0] > left[0]).any()):
            score = np.where(fits, (need / limit) @ (left / limit), -1.0)
            i = int(score.argmax())
            length = int(need[i, 0])
        else:
            i = int(need[:, 0].argmax())
            length = int(min(need[i, 0], left[0]))
            if self._loss(i, self.start[i], length) > left[2]:
                flags = self.bearing[i]
                if flags is None:
                    length = int(left[2])
                else:
                    length = int(np.searchsorted(np.cumsum(flags[self.start[i] : self.start[i] + length]), left[2], "right"))
        if length <= 0:
            yield from self.close()
            return
        start, ids = self.start[i], self.ids[i]
        loss = self._loss(i, start, length)
        self.bin.append((self.keys[i], start, ids[start : start + length], len(ids), loss))
        self.left = left - (length, 1, loss)
        self.start[i] += length
        if self.start[i] == len(ids):
            for x in (self.keys, self.ids, self.start, self.bearing):
                x[i] = x[-1]
                x.pop()
            self.need[i] = self.need[n - 1]
        else:
            self.need[i] -= (length, 0, loss)
        if self.left[0] == 0 or self.left[1] == 0 or self.left[2] == 0:
            yield from self.close()

    def close(self) -> Iterator[tuple]:
        """Ends the open sequence; a short one is cut at powers of two."""
        room = offset = 0
        total = sum(len(x[2]) for x in self.bin)
        for key, start, ids, size, loss in self.bin:
            while len(ids):
                if room == 0:
                    room = self.l.tokens if total >= self.l.tokens else 1 << (total.bit_length() - 1)
                take = min(room, len(ids))
                yield key, start, ids[:take], size, self.sequence, offset
                total -= take
                room -= take
                offset += take
                start += take
                ids = ids[take:]
                if room == 0:
                    self.sequence += 1
                    offset = 0
        self.bin = []
        self.left = np.array([self.l.tokens, self.l.segments, self.l.loss])


class _Learned(dict):
    """Places of words; one that is missing is encoded and added."""

    def __init__(self, encoder: WordEncoder):
        super().__init__({"": 0})
        self.encoder = encoder

    def __missing__(self, word: str) -> int:
        return self.encoder._append(word, self.encoder._ids(word))


class WordEncoder:
    """Token ids of whole texts by a tokenizer that never joins words across ASCII white space.

    Words are encoded once and remembered, up to `most` of them (some 50 MB); then the memory starts anew. A word that is
    letters and then closing marks, and whose lower case needs no normalising, is known by its letters: the
    tokenizer takes letters and marks apart, so its ids are those of the two parts.
    """

    MARKS = ".,;:!?*%&$#|"

    def __init__(self, path: str, most: int = 250_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.model = self.tokenizer.model
        self.apart = all(self._parts_agree(w) for w in ("Word,", "Él!!", "straße.", "x&&&"))
        self.clear()

    def _parts_agree(self, word: str) -> bool:
        core = word.rstrip(self.MARKS)
        return self._core(core.lower()) + self._whole(word[len(core) :]) == self._whole(word)

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _core(self, core: str) -> list[int]:
        """Ids of lower-case letters: as byte-level tokenizers do, each byte stands for a printable character."""
        if not core.isascii():
            core = core.encode().decode("latin-1").translate(_BYTE_CHARS)
        return [t.id for t in self.model.tokenize(core)] if core else []

    def clear(self) -> None:
        self.index = _Learned(self)
        self.tails: dict[str, list[int]] = {"": []}
        self.offsets, self.flat = array("q", [0, 0]), array("I")

    def _ids(self, word: str) -> list[int]:
        core = word.rstrip(self.MARKS)
        low = core.lower()
        if not (self.apart and (low == "" or low.isalpha() and (low.isascii() or max(low) < "\u0590" and "Σ" not in core and is_normalized("NFC", core) and is_normalized("NFC", low)))):
            return self._whole(word)
        tail = word[len(core) :]
        if tail not in self.tails:
            if len(self.tails) > 10_000:
                self.tails = {"": []}
            self.tails[tail] = self._whole(tail)
        if not low:
            return self.tails[tail]
        if low == word:
            return self._core(low)
        # letters are remembered as a word of their own, to be found under any marks and capitals
        k = self.index.get(low)
        if k is None:
            ids = self._core(low)
            self._append(low, ids)
        else:
            ids = self.flat[self.offsets[k] : self.offsets[k + 1]].tolist()
        return ids + self.tails[tail] if tail else ids

    def _append(self, word: str, ids: list[int]) -> int:
        self.index[word] = k = len(self.offsets) - 1
        self.flat.extend(ids)
        self.offsets.append(len(self.flat))
        return k

    def encode(self, texts: list[str], end: int) -> list[np.ndarray]:
        """The ids of each text, then `end`."""
        split = []
        for t in texts:
            for c in "\t\n\v\f\r":
                if c in t:
                    t = t.replace(c, " ")
            split.append(t.split(" "))
        out = []
        for ws in split:
            found = np.fromiter(map(self.index.__getitem__, ws), np.int64, len(ws))
            offsets, flat = np.frombuffer(self.offsets, np.int64), np.frombuffer(self.flat, np.uint32)
            begin = offsets[found]
            size = offsets[found + 1] - begin
            total = int(size.sum())
            ids = np.empty(total + 1, np.uint32)
            ids[:total] = flat[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(total)]
            ids[total] = end
            out.append(ids)
            del offsets, flat  # the arrays can't grow while they are seen
            if len(self.index) > self.most:
                self.clear()
        return out


_ENCODERS: dict[str, WordEncoder] = {}

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(
    docs: DataFrame, tokenizer_path: str, end_id: int = 2, limits: Limits = Limits(), keep_ids: bool = False, partitions: int | None = None
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for).

    A document is its token ids and end_id; every id bears loss but end_id. A null or empty text is end_id alone.
    Rows with equal or null doc_id are documents of their own; other columns are left out; no rows give no rows.
    Each partition is packed by itself, in the order of its rows, and only its last sequences can be short; its
    number stands in the upper bits of sequence_id, so no two tasks share one. A text is read a batch at a time
    and at most `limits.waiting` examples wait, whatever the number of rows.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if partitions:
        rows = rows.repartition(partitions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _ENCODERS:
            _ENCODERS[tokenizer_path] = WordEncoder(tokenizer_path)
        encoder = _ENCODERS[tokenizer_path]
        packer = _Packer(limits, TaskContext.get().partitionId() << 40)

        def table(pieces: list[tuple]) -> pa.RecordBatch:
            keys, starts, ids, totals, sequences, offsets = zip(*pieces)
            columns = [keys, starts, [len(x) for x in ids], [zlib.crc32(np.ascontiguousarray(x, "<u4")) for x in ids], totals, sequences, offsets]
            arrays = [pa.array(c, pa.int64()) for c in columns]
            names = [x.split()[0] for x in PIECES.split(", ")]
            if keep_ids:
                arrays.append(pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names)

        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            pieces: list[tuple] = []
            for at in range(0, len(keys), 32):
                for key, ids in zip(keys[at : at + 32], encoder.encode(texts[at : at + 32], end_id)):
                    flags = np.ones(len(ids), bool)
                    flags[-1] = False
                    pieces += packer.add(key, ids, flags)
            if pieces:
                yield table(pieces)
        pieces = list(packer.finish())
        if pieces:
            yield table(pieces)
        encoder.clear()  # a worker outlives its task

    return rows.mapInArrow(freeing(run), PIECES + (", ids array<long>" if keep_ids else ""))


def op9_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
