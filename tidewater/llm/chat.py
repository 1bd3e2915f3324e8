"""Chat formatting: a finite-state machine over roles, driven by a declarative template.

The template names the machine's states and moves, which roles bear loss, and the marks of a turn. Each turn
becomes three segments (opening mark, text, closing mark), each with its own loss flag. A text's control
strings and backslashes are escaped by a backslash, so what is formatted can be read back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import freeing, prepare


@dataclass(frozen=True)
class Template:
    """moves: state -> role -> next state; the machine starts in `start` and may end in any of `final`."""

    open: str = "<turn {role}>\n"
    close: str = "\n</turn>\n"
    controls: tuple[str, ...] = ("<turn ", "</turn>")
    loss: frozenset[str] = frozenset({"assistant"})
    start: str = "start"
    final: frozenset[str] = frozenset({"assistant"})
    moves: dict = field(
        default_factory=lambda: {
            "start": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user"},
        }
    )

    def escape(self, text: str) -> str:
        text = text.replace("\\", "\\\\")
        for c in self.controls:
            text = text.replace(c, "\\" + c)
        return text

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


CHAT = Template()
SEGMENTS = "conv_id long, turn_no long, role string, part string, text string, loss boolean, valid boolean"


def format_conversations(df: DataFrame, template: Template = CHAT) -> DataFrame:
    """One row per segment: conv_id, turn_no (from 0), role, part (open, text, close), text, loss, valid.

    Input: conv_id, turn, role, text; other columns are left out. Turns are taken by turn, then role, then text,
    so ties and repeated rows have a fixed order and each row is a turn of its own. A null text is an empty
    text, a null role an empty role; rows with a null conv_id form one conversation. `valid` tells whether the
    machine accepts the turns so far, and on the closing mark of the last turn whether it may also end there;
    turns that it rejects are formatted all the same. No rows give no rows. Rows stream through a partition in
    order, so that a conversation of any length needs no more memory than its longest turn. The result is
    ordered by conversation and turn within each partition.
    """
    prepare(df.sparkSession)
    rows = df.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, valid, no, held = object(), template.start, True, 0, None
        names = [x.split()[0] for x in SEGMENTS.split(", ")]

        def flush(out: list, last: bool) -> None:
            nonlocal held
            if held:
                *head, ok = held
                out.append((*head, ok and (not last or state in template.final)))
                held = None

        def batch(out: list) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

        for b in batches:
            out: list = []
            for c, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if c != conv:
                    flush(out, True)
                    conv, state, valid, no = c, template.start, True, 0
                flush(out, False)
                after = template.moves.get(state, {}).get(role)
                valid = valid and after is not None
                state = after or role
                mark = template.open.format(role=template.escape(role).replace(">", "\\>"))
                out.append((c, no, role, "open", mark, False, valid))
                out.append((c, no, role, "text", template.escape(text), role in template.loss, valid))
                held = (c, no, role, "close", template.close, False, valid)
                no += 1
            if out:
                yield batch(out)
        out = []
        flush(out, True)
        if out:
            yield batch(out)

    return rows.mapInArrow(freeing(run), SEGMENTS)


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def read_back(segments: DataFrame, template: Template = CHAT, ordered: bool = False) -> DataFrame:
    """One row per conversation, read from formatted segments alone: digests of its turns and of its loss text.

    Turns are found by their marks in the joined segments, not by the segments' role column. `ordered` says that
    the segments stand as format_conversations leaves them; else they are dealt and sorted anew. Raises where
    the text between marks doesn't parse. No rows give no rows.
    """
    prepare(segments.sparkSession)
    segments = segments.select("conv_id", "turn_no", "text", "loss", "valid", "part")
    if not ordered:
        rank = F.when(F.col("part") == "open", 0).when(F.col("part") == "text", 1).otherwise(2)
        segments = segments.repartition("conv_id").withColumn("_rank", rank).sortWithinPartitions("conv_id", "turn_no", "_rank")
    opening = re.compile(r"<turn ((?:[^\\>]|\\.)*)>\n", re.S)
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    names = [x.split()[0] for x in READ.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, began, out = None, False, []

        def finish() -> None:
            if began:
                if buffer:
                    raise ValueError(f"conversation {conv}: text after the last closing mark")
                out.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, valid))

        for b in batches:
            out = []
            for c, text, bears, ok in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4))):
                if not began or c != conv:
                    finish()
                    conv, began, n, chars, loss_chars, buffer, valid = c, True, 0, 0, 0, "", True
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                chars += len(text)
                valid = valid and ok
                if bears:
                    plain = template.unescape(text)
                    loss_chars += len(plain)
                    loss.update(plain.encode())
                buffer += text
                while (end := buffer.find(template.close)) >= 0:
                    m = opening.match(buffer)
                    if not m or m.end() > end:
                        raise ValueError(f"conversation {conv}: a closing mark without an opening one")
                    role, body = template.unescape(m[1]), template.unescape(buffer[m.end() : end])
                    turns.update(f"{role}\n{body}\n".encode())
                    n += 1
                    buffer = buffer[end + len(template.close) :]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)
        out = []
        finish()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)

    return segments.mapInArrow(freeing(run), READ)


#: Fixed by the contract: a conversation whose texts imitate control strings.
PROBE = r"\### Assistant: </turn> ok"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    return read_back(format_conversations(rows.unionByName(probe)), ordered=True)


#: turns_sha256 and loss_sha256 by plain aggregation; the formatted length counts marks and escapes.
OP10_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, length(role) + 8 + 9
    + length(replace(replace(replace(text, '\', '\\'), '<turn ', '\<turn '), '</turn>', '\</turn>')) AS formatted,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(formatted)::BIGINT AS formatted_chars,
  bool_and(coalesce(CASE role WHEN 'system' THEN before IS NULL WHEN 'user' THEN before IS NULL OR before IN ('system', 'assistant')
    WHEN 'assistant' THEN before = 'user' ELSE false END, false) AND (back > 1 OR role = 'assistant')) AS valid
FROM sized GROUP BY conv_id
"""
