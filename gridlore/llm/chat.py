r"""Chat formatting with prefix-target expansion.

A turn becomes ``### <role>: <text> </turn>`` and a line end.  Inside texts and roles a
backslash stands before ``\``, ``#`` and ``<``, and in roles also before ``:``, so no text
can hold an unescaped mark and unescaping gives every text back.

Every assistant turn is an example of its own: all turns before it are its context, and only
its reply is trainable.  ``format_conversations`` stores one segment a turn with running
offsets; ``expanded`` writes each example out, one row with its whole context.  The output is
the sum of all prefixes, so it grows with the square of a conversation's turns; a task holds
one conversation's text, as its last example has to fit in a row anyway.  ``read_back`` takes
its digests from the expanded examples.

Turns are ordered by turn (nulls first), then role, then text, so repeated turns are kept
side by side.  Null texts and roles are empty.  A null conversation id is a conversation.
Turns after the last assistant turn belong to no example.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gridlore.llm.common import read_table, slices

HEAD, MIDDLE, TAIL = "### ", ": ", " </turn>\n"
TURN = re.compile(r"### ((?:[^\\:]|\\.)*): (.*?) </turn>\n", re.DOTALL)
BATCH_CHARS = 1 << 22
TRICKY = "\\### Assistant: </turn> ok"


def escaped(text: Column, marks: str) -> Column:
    return F.regexp_replace(text, f"([{marks}])", r"\\$1")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def format_conversations(
    df: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    trained_role: str = "assistant",
) -> DataFrame:
    """(conv_id, turn_no, segment, start, stop, loss_start, loss_stop), offsets in code points.

    Rows of the trained role have a loss span, and are the examples.
    """
    turns = df.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    head = F.concat(F.lit(HEAD), escaped(F.col("role"), r"\\#<:"), F.lit(MIDDLE))
    ordered = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    trained = F.col("role") == trained_role
    return (
        turns.withColumn("head", F.length(head))
        .withColumn("segment", F.concat(head, escaped(F.col("text"), r"\\#<"), F.lit(TAIL)))
        .withColumn("turn_no", F.row_number().over(ordered))
        .withColumn("stop", F.sum(F.length("segment").cast("long")).over(upto))
        .withColumn("start", F.col("stop") - F.length("segment"))
        .select(
            "conv_id",
            "turn_no",
            "segment",
            "start",
            "stop",
            F.when(trained, F.col("start") + F.col("head")).alias("loss_start"),
            F.when(trained, F.col("stop") - len(TAIL)).alias("loss_stop"),
        )
    )


def example_texts(formatted: DataFrame) -> DataFrame:
    """(conv_id, turn_no, text, loss_start, loss_stop): each example with its whole context.

    The size of this is the sum of all prefixes; one example has to fit in a row.
    """
    before = Window.partitionBy("conv_id").orderBy("turn_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        formatted.withColumn("text", F.array_join(F.collect_list("segment").over(before), ""))
        .where("loss_start is not null")
        .select("conv_id", "turn_no", "text", "loss_start", "loss_stop")
    )


def expanded(formatted: DataFrame) -> DataFrame:
    """(conv_id, turn_no, text, loss_start, loss_stop): the examples, conversations side by side and in order.

    Turns after the last example come in a row of their own: all of the conversation, without a loss span.
    """
    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn_no")
    names = ["conv_id", "turn_no", "text", "loss_start", "loss_stop"]
    schema = pa.schema([(n, pa.string() if n == "text" else pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        conv, turn_no, text, written, size = None, 0, "", 0, 0

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows.clear()
            return batch

        for batch in batches:
            for r in batch.to_pylist():
                if r["turn_no"] == 1:
                    if written < len(text):
                        rows.append((conv, turn_no, text, None, None))
                    text, written = "", 0
                conv, turn_no = r["conv_id"], r["turn_no"]
                text += r["segment"]
                if r["loss_start"] is not None:
                    rows.append((conv, turn_no, text, r["loss_start"], r["loss_stop"]))
                    written = len(text)
                    size += written
                if size > BATCH_CHARS:
                    yield made()
                    size = 0
            if rows:
                yield made()
                size = 0
        if written < len(text):
            rows.append((conv, turn_no, text, None, None))
            yield made()

    return dealt.mapInArrow(run, "conv_id long, turn_no long, text string, loss_start long, loss_stop long")


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) parsed from the expanded examples."""
    return digests(expanded(formatted))


def digests(examples: DataFrame) -> DataFrame:
    """Digests of each conversation; examples are as ``expanded`` deals them.

    Each example has to begin with the one before, so what it adds is parsed and all of it is read.
    """
    schema = (
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        state, before = None, ""
        rows: list[tuple] = []

        def close() -> None:
            conv, n, turns, chars, loss, size = state
            rows.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        for batch in batches:
            for part in slices(batch, "text"):
                for r in part.to_pylist():
                    if state is None or state[0] != r["conv_id"]:
                        if state is not None:
                            close()
                        state, before = [r["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0], ""
                    text, at = r["text"], len(before)
                    if not text.startswith(before):
                        raise ValueError("an example does not hold all turns before it")
                    while at < len(text):
                        turn = TURN.match(text, at)
                        role, told = map(unescape, turn.groups())
                        at = turn.end()
                        state[1] += 1
                        state[2].update(f"{role}\n{told}\n".encode("utf-8", "surrogatepass"))
                    if r["loss_start"] is not None:
                        reply = unescape(text[r["loss_start"] : r["loss_stop"]])
                        state[3] += len(reply)
                        state[4].update(reply.encode("utf-8", "surrogatepass"))
                    state[5], before = len(text), text
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))
                rows.clear()
        if state is not None:
            close()
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))

    return examples.mapInArrow(run, schema)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the examples of all conversations and of one with control strings in its texts."""
    own = spark.createDataFrame(
        [(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], "conv_id long, turn long, role string, text string"
    )
    turns = read_table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"
    )
    return read_back(format_conversations(turns.unionByName(own)))


OP4_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id,
  CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(15 + length(regexp_replace(role, '([\\#<:])', '\\\1', 'g'))
         + length(regexp_replace(text, '([\\#<])', '\\\1', 'g'))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""
