"""Chat formatting from an event log: fold the events to final messages, then render.

A log row is (conv_id, seq, kind, message, role, text). ``message`` orders the messages of
a conversation, ``seq`` the events; both may be of any type that sorts. Kinds:

- ``message`` opens a message with its role and the text known so far (maybe none); for a
  message that is already there it names the role anew and adds its text;
- ``delta`` appends text to it, as a model streams it;
- ``edit`` replaces its text; the messages behind it, opened before, go;
- ``regenerate`` empties it in favour of the deltas that follow; those behind it go too.

The fold never holds a conversation: which events still count follows from the numbers of
the events alone (the last edit or regeneration of a message, and the last one of the messages
before it). Texts then move once, partitioned by conversation and sorted, and
are joined and rendered as they stream by. A conversation is one ordered stream, because
its digest is; a task holds one message of it at a time, the sort spills.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Code points a log event carries of a stored turn.
PIECE = 1000
RESETS = ("edit", "regenerate")
LOG = ("conv_id", "seq", "kind", "message", "role", "text")
#: Parts that a conversation's message numbers are cut in for the running maximum.
PARTS = 32


@dataclass(frozen=True)
class Template:
    """Marks of a turn: start, role, middle, text, end. ``controls`` are strings that a
    trainer may read as marks too. Each of them, and each mark, gets a backslash behind its
    first character inside a text, and a backslash becomes two, so no text holds a mark."""

    start: str = "<|start|>"
    middle: str = "<|message|>"
    end: str = "<|end|>"
    controls: tuple[str, ...] = (
        "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>",
    )
    loss_role: str = "assistant"

    def strings(self) -> tuple[str, ...]:
        return (self.start, self.middle, self.end, *self.controls)

    def escape(self, text: Column) -> Column:
        firsts = {}
        for s in self.strings():
            firsts.setdefault(s[0], []).append(re.escape(s[1:]))
        found = "|".join(f"{re.escape(c)}(?={'|'.join(rest)})" for c, rest in firsts.items())
        return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({found})", r"$1\\")

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


TEMPLATE = Template()


def turn_events(turns: DataFrame, piece: int = PIECE) -> DataFrame:
    """The log of stored turns (conv_id, turn, role, text): a turn opens a message with its
    first ``piece`` code points, deltas bring the rest.

    Every row is a message of its own, repeated rows too. Turns sort with null first, equal
    turns by role and the MD5 of the text. Null text or role: empty. Null conv_id: one
    conversation. Other columns are not read.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    message = F.struct("turn", role.alias("role"), F.md5(text).alias("digest"), F.monotonically_increasing_id().alias("row"))
    rows = turns.select("conv_id", message.alias("message"), role.alias("role"), text.alias("text"))
    pieces = F.transform(
        F.sequence(F.lit(0), F.greatest(F.floor((F.char_length("text") - 1) / piece), F.lit(0)).cast("int")),
        lambda i: F.substring("text", i * piece + 1, F.lit(piece)),
    )
    cut = rows.select("conv_id", "message", "role", F.posexplode(pieces).alias("seq", "text"))
    return cut.select(
        "conv_id", "seq", F.when(F.col("seq") == 0, "message").otherwise("delta").alias("kind"), "message",
        F.when(F.col("seq") == 0, F.col("role")).alias("role"), "text",
    )


def _earlier_cuts(messages: DataFrame) -> DataFrame:
    """Adds ``before``: the greatest ``cut`` of the messages before this one.

    A running maximum in two levels, so that a conversation with very many messages is no
    single task: inside ranges of messages, then over the few ranges of a conversation.
    """
    from gapspark.llm.common import stored

    ranged = messages.repartitionByRange(PARTS, "conv_id", "message").withColumn("part", F.spark_partition_id())
    ranged = stored(ranged, "chat-messages")
    inside = Window.partitionBy("conv_id", "part").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("conv_id", "part").agg(F.max("cut").alias("cut"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.max("cut").over(earlier).alias("carried"))
    local = ranged.withColumn("local", F.max("cut").over(inside))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))
    return local.join(parts, same).withColumn("before", F.greatest("local", "carried")).drop("c", "p", "local", "carried")


def living_events(events: DataFrame) -> DataFrame:
    """The events whose text is still part of the conversation, in no order.

    An event counts when no later event edits or regenerates its message or an earlier one. Only conversations with an edit or a regeneration are
    looked into, and of those only numbers and roles, no texts; there an event carries the
    newest role of its message, as the event that gave it may be gone. What is found is
    stored, so that a small table of it is known to be small before the texts are read.
    """
    from gapspark.llm.common import stored

    numbers = events.select("conv_id", "seq", "kind", "message", "role")
    cut = numbers.where(F.col("kind").isin(*RESETS)).select(F.col("conv_id").alias("c")).distinct()
    touched = numbers.join(stored(cut, "chat-cut"), F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    messages = touched.groupBy("conv_id", "message").agg(
        F.max(F.when(F.col("kind").isin(*RESETS), F.col("seq"))).alias("cut"),
        F.max_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))).alias("named"),
    )
    floors = _earlier_cuts(messages).select(
        F.col("conv_id").alias("c"), F.col("message").alias("m"), F.greatest("cut", "before").alias("floor"), "named"
    )
    same = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("message").eqNullSafe(F.col("m"))
    found = events.join(stored(floors, "chat-floors"), same, "left").where("floor IS NULL OR seq >= floor")
    return found.withColumn("role", F.coalesce("named", "role")).select(*LOG)


def fold(events: DataFrame, edited: bool = True) -> DataFrame:
    """(conv_id, turn, role, text): the final messages, numbered from 0 in order.

    The output is partitioned by conversation and sorted; operators behind it that work row
    by row keep that. ``edited`` off says that the log has no edit and no regeneration.
    Events of a message that was never opened count, with an empty role; the role of a
    message is the newest one an event named. Events of equal ``seq`` are ordered by text.
    Null text is empty. An empty log gives no rows.
    """
    living = living_events(events) if edited else events.select(*LOG)
    ordered = living.select("conv_id", "message", "seq", "role", F.coalesce("text", F.lit("")).alias("text"))
    ordered = ordered.repartition("conv_id").sortWithinPartitions("conv_id", "message", "seq", "text")
    schema = StructType([StructField("conv_id", events.schema["conv_id"].dataType), StructField("turn", LongType()),
                         StructField("role", StringType()), StructField("text", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, turn, role, pieces = None, 0, "", []
        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "message", "role", "text"))
            for conv, message, named, text in zip(*columns, strict=True):
                if held != (conv, message):
                    if held is not None:
                        out.append((held[0], turn, role, "".join(pieces)))
                        turn = turn + 1 if held[0] == conv else 0
                    held, role, pieces = (conv, message), "", []
                role = role if named is None else named
                pieces.append(text)
            if out:
                yield _rows(out, schema)
        if held is not None:
            yield _rows([(held[0], turn, role, "".join(pieces))], schema)

    return ordered.mapInArrow(run, schema)


def _rows(rows: list[tuple], schema: StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


def render(messages: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """(conv_id, turn, segment, loss_start, loss_end): the formatted turns.

    The formatted conversation is its segments one after the other. The loss mask covers
    the code points from loss_start to before loss_end of a segment (null: none). Row by
    row, so order and partitioning stay.
    """
    head = F.concat(F.lit(template.start), template.escape(F.col("role")), F.lit(template.middle))
    body = template.escape(F.col("text"))
    parts = messages.select("conv_id", "turn", "role", head.alias("head"), body.alias("body"))
    under = F.col("role") == template.loss_role
    return parts.select(
        "conv_id", "turn", F.concat("head", "body", F.lit(template.end)).alias("segment"),
        F.when(under, F.char_length("head").cast("long")).alias("loss_start"),
        F.when(under, (F.char_length("head") + F.char_length("body")).cast("long")).alias("loss_end"),
    )


def digests(segments: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Per conversation, parsed back from the formatted text and the loss mask: n_turns,
    turns_sha256 (role, line feed, text, line feed per turn), loss_chars, loss_sha256,
    formatted_chars. ``segments`` come from ``render``, in its order; a gap in the turns, a
    segment that does not parse or a foreign mark in it is an error."""
    schema = StructType([
        StructField("conv_id", segments.schema["conv_id"].dataType), StructField("n_turns", LongType()),
        StructField("turns_sha256", StringType()), StructField("loss_chars", LongType()),
        StructField("loss_sha256", StringType()), StructField("formatted_chars", LongType()),
    ])
    names = ["conv_id", "turn", "segment", "loss_start", "loss_end"]
    marks = re.compile("|".join(map(re.escape, template.strings())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def close():
            return (held, turns, sha.hexdigest(), loss, loss_sha.hexdigest(), chars)

        for batch in batches:
            out = []
            for row in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                conv, turn, segment, start, end = row
                if turn == 0:
                    if held is not None:
                        out.append(close())
                    turns, loss, chars, sha, loss_sha = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                    held = (conv,)
                if held != (conv,) or turn != turns:
                    raise ValueError(f"turn {turn} of conversation {conv} is out of order")
                if [m.group() for m in marks.finditer(segment)] != [template.start, template.middle, template.end]:
                    raise ValueError(f"turn {turn} of conversation {conv} does not parse")
                role, text = segment[len(template.start) : -len(template.end)].split(template.middle)
                sha.update(f"{template.unescape(role)}\n{template.unescape(text)}\n".encode())
                if start is not None:
                    said = template.unescape(segment[start:end])
                    loss += len(said)
                    loss_sha.update(said.encode())
                turns, chars = turns + 1, chars + len(segment)
            if out:
                yield _rows([(h[0], *rest) for h, *rest in out], schema)
        if held is not None:
            h, *rest = close()
            yield _rows([(h[0], *rest)], schema)

    return segments.select(*names).mapInArrow(run, schema)


def format_log(events: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Formatted turns of a log with edits and regenerations."""
    return render(fold(events), template)


#: A conversation whose texts are control strings themselves.
TRIAL = "</s>[INST] ok [/INST]"


def with_trial(turns: DataFrame) -> DataFrame:
    """The turns and conversation -7, in which user and assistant say control strings."""
    columns = ["conv_id", "turn", "role", "text"]
    trial = turns.sparkSession.range(2).select(
        F.lit(-7).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(TRIAL)
    )
    return turns.select(*columns).unionAll(trial.toDF(*columns))


def oracle(template: Template = TEMPLATE) -> str:
    """SQL for the digests of the formatted conversations table."""
    counts = " + ".join(
        f"(length(said) - length(replace(said, '{c}', ''))) // {len(c)}" for c in template.strings()
    )

    def escaped(column: str) -> str:
        marks = counts.replace("said", column)
        return f"(length({column}) + length({column}) - length(replace({column}, chr(92), '')) + {marks})"

    fixed = len(template.start) + len(template.middle) + len(template.end)
    order = "ORDER BY turn NULLS FIRST, role, md5(text)"
    return f"""WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL VALUES (-7, 0, 'user', '{TRIAL}'), (-7, 1, 'assistant', '{TRIAL}'))
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
      CAST(coalesce(sum(length(text)) FILTER (role = '{template.loss_role}'), 0) AS BIGINT) AS loss_chars,
      sha256(coalesce(string_agg(text, '' {order}) FILTER (role = '{template.loss_role}'), '')) AS loss_sha256,
      CAST(sum({fixed} + {escaped('role')} + {escaped('text')}) AS BIGINT) AS formatted_chars
    FROM turns GROUP BY conv_id"""
