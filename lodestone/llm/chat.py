"""Chat formatting with a grammar round trip.

A formatted conversation is a sequence of turns

    user       [INST] text [/INST]
    assistant  <s>text</s>
    system     <<SYS>>text<</SYS>>
    other      <|role:ROLE|>text<|end|>

Control strings inside a text are escaped by an escape mark after their first
character; a run of marks after an opening bracket grows by one, and reading takes
one away, so any text, with or without marks of its own, survives.

Each turn is rendered, reparsed with the deterministic parser, and compared with
its source: role, text and nothing left over. A turn is first rendered as it is;
on a difference the conflicting control strings are escaped, and if that is not
enough every bracket that could begin one, until the parser gives the source back.
Turns are closed before the next begins, so a turn that parses alone parses the
same in its conversation, and rendering and checking need no shuffle.

The output keeps one row per turn: its rendered segment and the span of the loss
mask in it. Segments concatenated in order are the conversation. Reading back
sorts segments by conversation and turn and parses them as a stream: memory holds
one turn, however long a conversation is.
"""

from __future__ import annotations

import hashlib
import re
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "␛"
#: Opening and closing strings of the known roles.
TURNS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER = ("<|role:", "|>", "<|end|>")
#: What texts must not contain unescaped.
CONTROLS = ("[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "<|role:", "<|end|>")
LOSS_ROLE = "assistant"
PROBE = "</s>[INST] ok [/INST]"

_MARKED = re.compile(f"([<\\[])({MARK}+)")
_CONTROL = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS))
_BRACKET = re.compile("[<\\[]")


def escape(text: str, level: int) -> str:
    """Level 0: as it is. Level 1: marks in runs grow and control strings get one. Level 2: every bracket gets one."""
    if level == 0:
        return text
    text = _MARKED.sub(lambda m: m[1] + MARK + m[2], text)
    plain = _CONTROL if level == 1 else _BRACKET
    out, at = [], 0
    for m in plain.finditer(text):
        if text[m.end() : m.end() + 1] == MARK:
            continue  # its run has grown already
        out += [text[at : m.end()], MARK]
        at = m.end()
    return "".join(out) + text[at:]


def unescape(text: str) -> str:
    return _MARKED.sub(lambda m: m[1] + m[2][1:], text)


def frame(role: str) -> tuple[str, str]:
    """Opening and closing strings of a turn; unknown roles are percent-encoded into theirs."""
    if role in TURNS:
        return TURNS[role]
    return OTHER[0] + quote(role, safe="") + OTHER[1], OTHER[2]


class ParseError(ValueError):
    """The text is not a sequence of turns."""


def parse(text: str):
    """(role, text, start, end) of each turn, in order; start and end frame the escaped text."""
    at = 0
    while at < len(text):
        for role, (opening, closing) in TURNS.items():
            if text.startswith(opening, at):
                begin = at + len(opening)
                break
        else:
            if not text.startswith(OTHER[0], at):
                raise ParseError(f"no turn begins at {at}")
            middle = text.find(OTHER[1], at)
            if middle < 0:
                raise ParseError(f"the role at {at} does not end")
            role, begin, closing = unquote(text[at + len(OTHER[0]) : middle]), middle + len(OTHER[1]), OTHER[2]
        end = text.find(closing, begin)
        if end < 0:
            raise ParseError(f"the turn at {at} does not end")
        body = text[begin:end]
        inside = _CONTROL.search(body)
        if inside:
            raise ParseError(f"a control string stands at {begin + inside.start()}")
        yield role, unescape(body), begin, end
        at = end + len(closing)


def render(role: str | None, text: str | None) -> tuple[str, int, int, int]:
    """The segment of a turn, the span of its loss mask (empty for other roles), and the escape level that was needed."""
    role, text = role or "", text or ""
    opening, closing = frame(role)
    for level in (0, 1, 2):
        segment = opening + escape(text, level) + closing
        try:
            turns = list(parse(segment))
        except ParseError:
            continue
        if len(turns) == 1 and turns[0][:2] == (role, text):
            _, _, start, end = turns[0]
            return (segment, start, end, level) if role == LOSS_ROLE else (segment, 0, 0, level)
    raise ParseError(f"no escaping of {text!r} comes back")  # unreachable: level 2 leaves no control string


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, place, tie, segment, loss_start, loss_end, escapes for every row of turns (conv_id, turn, role, text).

    Null texts and roles are empty; rows of the same turn follow each other by role and
    text (place, then tie order them); a text of any length is rendered whole; repeated rows stay; a null conv_id is a conversation of its
    own and a null turn comes first; an empty table gives no rows; other columns are ignored.
    """

    def run(batches):
        for b in batches:
            found = [render(r, t) for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            segments, starts, ends, levels = (list(c) for c in zip(*found, strict=True)) if found else ([], [], [], [])
            place = [r or "" for r in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(place, pa.string()), b.column(3).fill_null(""), pa.array(segments, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(levels, pa.int32())],
                ["conv_id", "turn", "place", "tie", "segment", "loss_start", "loss_end", "escapes"],
            )

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "conv_id long, turn long, place string, tie string, segment string, loss_start int, loss_end int, escapes int")


def conversation_texts(formatted: DataFrame) -> DataFrame:
    """conv_id, text: each conversation in one row, for those that fit one."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "place", "tie", "segment")))
    return formatted.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t["segment"]), "").alias("text"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests per conversation, from the segments alone, parsed in order as a stream."""

    def run(batches):
        state = None

        def close():
            _, n, turns, chars, loss, size, marks = state
            return (state[0], n, turns.hexdigest(), chars, loss.hexdigest(), size, marks)

        for b in batches:
            done = []
            cols = [b.column(i).to_pylist() for i in (0, 3, 4, 5, 6)]
            for conv, segment, start, end, level in zip(*cols, strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(close())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, text, _, _ in parse(segment):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                if end > start or segment.startswith(TURNS[LOSS_ROLE][0]):
                    masked = unescape(segment[start:end])
                    state[3] += len(masked)
                    state[4].update(masked.encode())
                state[5] += len(segment)
                state[6] += level > 0
            yield batch(done)
        if state is not None:
            yield batch([close()])

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "escaped_turns"]

    def batch(rows):
        cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "place", "tie").drop("tie")
    return ordered.mapInArrow(run, ", ".join(f"{n} {'string' if k == pa.string() else 'long'}" for n, k in zip(names, kinds, strict=True)))


def conversations_with_probe(conversations: DataFrame) -> DataFrame:
    """conversations and conversation -1, whose texts are control strings of the template."""
    spark: SparkSession = conversations.sparkSession
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.toDF("conv_id", "turn", "role", "text").unionByName(probe)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: digests of all conversations and the probe, read back from their formatted form."""
    return read_back(format_turns(conversations_with_probe(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, (length(text) - length(replace(text, '[INST]', ''))) // 6 + (length(text) - length(replace(text, '[/INST]', ''))) // 7
    + (length(text) - length(replace(text, '<s>', ''))) // 3 + (length(text) - length(replace(text, '</s>', ''))) // 4
    + (length(text) - length(replace(text, '<<SYS>>', ''))) // 7 + (length(text) - length(replace(text, '<</SYS>>', ''))) // 8
    + (length(text) - length(replace(text, '<|role:', ''))) // 7 + (length(text) - length(replace(text, '<|end|>', ''))) // 7
    + len(regexp_extract_all(text, '[<\[]␛')) AS marks,
    CASE role WHEN 'assistant' THEN 7 WHEN 'user' THEN 15 WHEN 'system' THEN 15 ELSE 16 + length(role) END AS extra
  FROM c)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(text) + marks + extra) AS BIGINT) AS formatted_chars,
       CAST(count(*) FILTER (WHERE marks > 0) AS BIGINT) AS escaped_turns
FROM e GROUP BY conv_id
"""
