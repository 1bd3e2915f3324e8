"""Substring deduplication by De Bruijn compaction over words.

An edge is a run of 13 words (a window). Each window belongs to the part of the graph named by its minimizer, the
least hash among its runs of four words; equal windows have equal minimizers, so only parts that two documents
meet can hold repeated edges. Consecutive windows of one minimizer are compacted into a path, and equal paths
into one class with the smallest document that has it. Within classes nothing branches: all but the first
document lose the whole path. Where classes share some edges only (paths branch), edges are compared one by one.
Last, the paths that a document loses are joined to long spans by their source coordinates, and each span is
compared with its source's words by a second hash before anything is removed.

Filters keep what can't repeat from being shuffled. Their size follows the number of keys up to a bound; past it
they let more through that needn't be, and never hold back what repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, freeing, mix, prepare, saved, windows, word_hashes, words

WINDOW, SEED = 13, 4
#: Bits that a filter has for each of its keys, and the most bits it may have (64 MB), which go to every task.
KEY_BITS, FILTER_BITS = 16, 1 << 29


class _Filter:
    """Membership of 64-bit keys (a saved table): two bits a key in a table of KEY_BITS a key, at most `most` bits."""

    def __init__(self, keys: DataFrame, column: str, most: int):
        bits = max(64, min(most, 1 << (KEY_BITS * keys.count()).bit_length()))
        # bits are set by aggregation; what comes to the driver is at most the table itself
        a, b = self._places_sql(column, bits)
        each = keys.select(F.explode(F.array(a, b)).alias("p"))
        table = each.groupBy(F.expr("p div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(cast(1 as bigint), cast(p % 64 as int))")).alias("m"))
        got = table.toArrow()
        words_ = np.zeros(bits // 64, np.uint64)
        words_[got["w"].to_numpy()] = got["m"].to_numpy().view(np.uint64)
        self.bits = bits
        self.table: Broadcast = keys.sparkSession.sparkContext.broadcast(words_)

    @staticmethod
    def _places_sql(column: str, bits: int):
        # keys are hashes already, or are mixed by xxhash64 (doc_ids); two disjoint parts of them are places
        return F.expr(f"{column} & {bits - 1}"), F.expr(f"shiftrightunsigned({column}, 32) & {bits - 1}")

    def has(self, keys: np.ndarray) -> np.ndarray:
        table, keep = self.table.value, np.ones(len(keys), bool)
        for p in (keys & np.uint64(self.bits - 1), (keys >> np.uint64(32)) & np.uint64(self.bits - 1)):
            keep &= (table[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return keep


def _ids_hash(ids: np.ndarray) -> np.ndarray:
    return mix(ids.astype(np.int64).view(np.uint64))


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a, np.uint64).view(np.int64))


def _least(s: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values."""
    size, out = 1, s
    while size * 2 <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(s) - w + 1], out[w - size : w - size + len(s) - w + 1]) if w > size else out


def _text_keys(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each row's words, which tells rows of one doc_id apart."""
    place = np.arange(len(h), dtype=np.uint64) - np.repeat(at[:-1], np.diff(at)).astype(np.uint64)
    sums = np.append(np.uint64(0), np.cumsum(mix(h + mix(place + np.uint64(1)))))
    return mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64))


def _paths(column: pa.Array) -> Iterator[tuple]:
    """Compacted paths of rows: row, first window (in its row), windows, minimizer, and the window hashes and text keys behind them."""
    for first, last, data, offsets in chunks(column):
        starts, ends, at = words(data, offsets)
        if len(starts) < WINDOW:
            continue
        h = word_hashes(data, starts, ends)
        w = windows(h, WINDOW)
        seed = _least(windows(h, SEED), WINDOW - SEED + 1)
        row = np.repeat(np.arange(last - first), np.diff(at))
        inside = row[: len(w)] == row[WINDOW - 1 :]
        i = np.flatnonzero(inside)
        if not len(i):
            continue
        new = np.ones(len(i), bool)
        new[1:] = (i[1:] != i[:-1] + 1) | (seed[i[1:]] != seed[i[:-1]]) | (row[i[1:]] != row[i[:-1]])
        # a path has at most 13 windows, so its first and last window hold all its words
        begin = np.flatnonzero(new)
        length = np.diff(np.append(begin, len(i)))
        within = np.arange(len(i)) - np.repeat(begin, length)
        begin = np.flatnonzero(within % WINDOW == 0)
        n = np.diff(np.append(begin, len(i)))
        p = i[begin]
        yield first + row[p], p - at[row[p]], n, seed[p], w, p, _text_keys(h, at)[row[p]]


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _repeated_parts(docs: DataFrame) -> DataFrame:
    """(seed): minimizers that at least two doc_ids have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, ids, size = [], [], 0

        def merged() -> pa.RecordBatch:
            nonlocal seeds, ids, size
            s, d = np.concatenate(seeds), np.concatenate(ids)
            seeds, ids, size = [], [], 0
            order = np.lexsort((d, s))
            s, d = s[order], d[order]
            first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            last = np.append(first[1:], len(s)) - 1
            two = last[d[first] != d[last]]  # the least and the greatest doc_id tell that there are two
            return pa.RecordBatch.from_arrays([_signed(np.concatenate([s[first], s[two]])), pa.array(np.concatenate([d[first], d[two]]))], ["seed", "doc_id"])

        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            for row, _, _, seed, *_ in _paths(b.column(1)):
                seeds.append(seed)
                ids.append(keys[row].astype(np.int64))
                size += len(seed)
            if size > 1_500_000:
                yield merged()
        if size:
            yield merged()

    found = docs.filter("doc_id is not null").mapInArrow(freeing(run), "seed long, doc_id long")
    return found.groupBy("seed").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("seed")


PATHS = "path long, doc_id long, text_key long, start int, n int"


def _met_paths(docs: DataFrame, parts: _Filter, edges: bool) -> DataFrame:
    """Paths whose minimizer may repeat: path (hash), doc_id, text_key, start, n; with their window hashes, if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            for row, start, n, seed, w, p, text in _paths(b.column(1)):
                ok = parts.has(seed)
                row, start, n, p, text = row[ok], start[ok], n[ok], p[ok], text[ok]
                path = mix(w[p] * np.uint64(0x9E3779B97F4A7C15) + mix(w[p + n - 1]) + n.astype(np.uint64))
                columns = [_signed(path), pa.array(keys[row].astype(np.int64)), _signed(text), pa.array(start, pa.int32()), pa.array(n, pa.int32())]
                names = [x.split()[0] for x in PATHS.split(", ")]
                if edges:
                    ends = np.cumsum(n)
                    flat = np.repeat(p - (ends - n), n) + np.arange(int(n.sum()))
                    columns += [_signed(seed[ok]), pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), _signed(w[flat]))]
                    names += ["seed", "edges"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.filter("doc_id is not null").mapInArrow(freeing(run), PATHS + (", seed long, edges array<long>" if edges else ""))


def repeated_spans(docs: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Spans of windows that also start in a document with a smaller doc_id: doc_id, text_key, start, n (windows),
    source (doc_id), source_start, source_key. Spans may overlap; equal neighbours on one diagonal are joined."""
    parts = _Filter(saved(_repeated_parts(docs)), "seed", bits)
    found = _met_paths(docs, parts, True).groupBy("path").agg(F.min(F.struct("doc_id", "start", "text_key", "seed", "edges")).alias("r"), F.max("doc_id").alias("last"))
    classes = saved(found.select("path", "last", F.col("r.seed").alias("seed"), F.col("r.doc_id").alias("source"), F.col("r.start").alias("source_start"), F.col("r.text_key").alias("source_key"), "r.edges"))
    place = classes.select("path", "source", "source_start", "source_key")

    # parts in which paths branch: edges that classes of different documents share
    branches = saved(classes.groupBy("seed").agg(F.min("source").alias("a"), F.max("source").alias("b")).filter("a < b").select("seed"))
    each = classes.join(branches, "seed", "left_semi").select("path", "source", F.posexplode("edges").alias("j", "edge"))
    owners = saved(each.groupBy("edge").agg(F.min("source").alias("o"), F.max("source").alias("last")).filter("o < last").select("edge", "o"))
    met = saved(each.join(owners, "edge"))
    first = met.filter("source = o").groupBy("edge").agg(F.min(F.struct("path", "j")).alias("f")).select("edge", F.col("f.path").alias("path"), F.col("f.j").alias("fj"))
    first = saved(first.join(place, "path").select("edge", "source", (F.col("source_start") + F.col("fj")).alias("source_start"), "source_key"))
    # which edges of a path its first document loses too; a path has thirteen at most
    mark = F.struct("j", F.lit(1).alias("n"), "source", "source_start", "source_key")
    marks = met.filter("source > o").select("edge", "path", "j").join(first, "edge").groupBy("path").agg(F.collect_list(mark).alias("marks"))

    # every occurrence of a path: later documents lose all of it (nothing branches there), its first document what is marked
    wanted = classes.select("path", "last", "source", "source_start", "source_key").join(marks, "path", "left").filter("last > source or marks is not null")
    wanted = saved(wanted)  # read plainly, so that Spark can split the occurrences of a frequent path in the join
    own = F.array(F.struct(F.lit(0).alias("j"), "n", "source", "source_start", "source_key"))
    lost = _met_paths(docs, parts, False).join(wanted, "path").filter("doc_id > source or doc_id = source and marks is not null")
    lost = lost.select("doc_id", "text_key", "start", F.explode(F.when(F.col("doc_id") > F.col("source"), own).otherwise(F.col("marks"))).alias("m"))
    return _compacted(lost.select("doc_id", "text_key", (F.col("start") + F.col("m.j")).alias("start"), "m.n", "m.source", "m.source_start", "m.source_key"))


SPANS = "doc_id long, text_key long, start int, n int, source long, source_start int, source_key long"


def _compacted(spans: DataFrame) -> DataFrame:
    """Joins spans of one document that follow one another on one diagonal of one source."""
    dealt = spans.repartition("doc_id", "text_key", "source").withColumn("_d", F.col("start") - F.col("source_start"))
    dealt = dealt.sortWithinPartitions("doc_id", "text_key", "source", "source_key", "_d", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SPANS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
        held = None

        def merged(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            doc, text, start, n, source, s0, key = block.T
            end = start + n
            same = np.zeros(len(block), bool)
            same[1:] = (doc[1:] == doc[:-1]) & (text[1:] == text[:-1]) & (source[1:] == source[:-1]) & (key[1:] == key[:-1]) & (start[1:] - s0[1:] == start[:-1] - s0[:-1])
            run_ = np.cumsum(~same)
            top = np.maximum.accumulate(end + run_ * (1 << 40)) - run_ * (1 << 40)
            cut = ~same
            cut[1:] |= start[1:] > top[:-1]
            first = np.flatnonzero(cut)
            out = block[first].copy()
            out[:, 3] = np.maximum.reduceat(top, first) - out[:, 2]
            return out[:-1], out[-1:]

        for b in batches:
            block = np.column_stack([b.column(i).to_numpy().astype(np.int64) for i in range(7)])
            out, held = merged(block if held is None else np.concatenate([held, block]))
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()).cast(k) for c, k in zip(out.T, kinds)], names)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()).cast(k) for c, k in zip(held.T, kinds)], names)

    return dealt.drop("_d").mapInArrow(freeing(run), SPANS)


def _span_digest(h2: np.ndarray, start: int, n: int) -> int:
    """A second, independent hash of the words under a span of n windows."""
    part = h2[start : start + n + WINDOW - 1]
    place = np.arange(1, len(part) + 1, dtype=np.uint64)
    return int(mix(np.array([(mix(part + mix(place))).sum(dtype=np.uint64) + np.uint64(len(part))], np.uint64)).view(np.int64)[0])


def _filtered(docs: DataFrame, ids: _Filter, inside: bool) -> DataFrame:
    """The rows whose doc_id may be (inside) or surely isn't (else, null too) in the filter."""

    at = docs.columns.index("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            null = np.asarray(b.column(at).is_null())
            hit = ids.has(_ids_hash(np.asarray(b.column(at).fill_null(0)))) & ~null
            keep = hit if inside else ~hit
            if keep.any():
                yield b.filter(pa.array(keep))

    return docs.mapInArrow(freeing(run), docs.schema)


def _id_filter(ids: DataFrame, column: str) -> _Filter:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([_signed(_ids_hash(b.column(0).to_numpy()))], ["h"])

    return _Filter(saved(ids.select(column).distinct().mapInArrow(freeing(run), "h long")), "h", FILTER_BITS)


def _hashed_rows(b: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, text key, second word hashes) of each row."""
    for first, last, data, offsets in chunks(b.column(column)):
        starts, ends, at = words(data, offsets)
        keys = _text_keys(word_hashes(data, starts, ends), at).view(np.int64)
        h2 = word_hashes(data, starts, ends, lane=1)
        for i in range(last - first):
            yield first + i, int(keys[i]), h2[at[i] : at[i + 1]]


def verified(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """spans with `digest`: the second hash of the source's words at the source coordinates."""
    places = saved(spans.select("source", "source_key", "source_start", "n").distinct())
    by_doc = places.groupBy("source").agg(F.collect_list(F.struct("source_key", "source_start", "n")).alias("places")).withColumnRenamed("source", "doc_id")
    sources = _filtered(docs, _id_filter(places, "source"), True).join(by_doc, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, wanted, out = b.column(0).to_pylist(), b.column(2), []
            for i, key, h2 in _hashed_rows(b, 1):
                for p in wanted[i].as_py():
                    if p["source_key"] == key:
                        out.append((ids[i], key, p["source_start"], p["n"], _span_digest(h2, p["source_start"], p["n"])))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["source", "source_key", "source_start", "n", "digest"])

    digests = sources.select("doc_id", "text", "places").mapInArrow(freeing(run), "source long, source_key long, source_start int, n int, digest long").distinct()
    return spans.join(saved(digests), ["source", "source_key", "source_start", "n"])  # so that Spark can split a frequent place


def _removed(spans: list[dict] | None, key: int, h2: np.ndarray) -> np.ndarray | None:
    """Which words a row loses: those under its spans whose words are the source's."""
    gone = None
    for s in spans or ():
        if s["text_key"] == key and _span_digest(h2, s["start"], s["n"]) == s["digest"]:
            gone = np.zeros(len(h2), bool) if gone is None else gone
            gone[s["start"] : s["start"] + s["n"] + WINDOW - 1] = True
    return gone


def _with_spans(docs: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """Rows that may lose words, with their spans in a last column, and rows that don't."""
    name = "_spans"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    spans = saved(verified(_rows(docs), saved(repeated_spans(_rows(docs), bits))))
    by_doc = spans.groupBy("doc_id").agg(F.collect_list(F.struct("text_key", "start", "n", "digest")).alias(name))
    ids = _id_filter(spans, "doc_id")
    return _filtered(docs, ids, True).join(by_doc, "doc_id", "left"), _filtered(docs, ids, False)


def dedup_report(docs: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by one space).

    A word goes if a window over it also starts in a document with a smaller doc_id; windows are judged on the
    input. Null and empty texts have no words. Rows of one doc_id don't dedup one another; a null doc_id neither
    loses words nor makes others lose them. Other columns are left out; no rows give no rows.
    """
    prepare(docs.sparkSession)
    docs = _rows(docs)
    some, none = _with_spans(docs, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = b.column(0).to_pylist(), []
            spans = b.column(2) if b.num_columns > 2 else None
            if spans is None:
                for key, text in zip(ids, b.column(1).to_pylist()):
                    kept = (text or "").encode().split()
                    out.append((key, len(kept), 0, hashlib.sha256(b" ".join(kept)).hexdigest()))
            else:
                texts = b.column(1).to_pylist()
                for i, key, h2 in _hashed_rows(b, 1):
                    kept = (texts[i] or "").encode().split()
                    gone = _removed(spans[i].as_py(), key, h2)
                    n = 0 if gone is None else int(gone.sum())
                    left = kept if not n else [x for x, g in zip(kept, gone.tolist()) if not g]
                    out.append((ids[i], len(kept), n, hashlib.sha256(b" ".join(left)).hexdigest()))
            if out:
                kinds = [pa.int64()] * 3 + [pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return some.mapInArrow(freeing(run), schema).unionByName(none.mapInArrow(freeing(run), schema))


def remove_repeats(docs: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """docs, all rows and columns, with repeated words (as in dedup_report) cut out of `text`.

    What is left keeps its white space; the space after a removed word goes with it. Texts that lose nothing
    stay as they are, null ones too.
    """
    prepare(docs.sparkSession)
    some, none = _with_spans(docs, bits)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            spans = b.column(len(names))
            for first, last, data, offsets in chunks(b.column(at)):
                starts, ends, begins = words(data, offsets)
                keys = _text_keys(word_hashes(data, starts, ends), begins).view(np.int64)
                h2 = word_hashes(data, starts, ends, lane=1)
                for i in range(last - first):
                    lo, hi = begins[i], begins[i + 1]
                    gone = _removed(spans[first + i].as_py(), int(keys[i]), h2[lo:hi])
                    if gone is None:
                        continue
                    keep = np.ones(offsets[i + 1] - offsets[i], bool)
                    next_ = np.append(starts[lo + 1 : hi], offsets[i + 1]) - offsets[i]
                    for s, e in zip((starts[lo:hi] - offsets[i])[gone], next_[gone]):
                        keep[s:e] = False
                    texts[first + i] = data[offsets[i] : offsets[i + 1]][keep].tobytes().decode()
            columns = [pa.array(texts, pa.string()) if k == at else b.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return some.select(*names, some.columns[-1]).mapInArrow(freeing(run), docs.schema).unionByName(none)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
