"""Chat formatting by event-sourced reconstruction.

A log has events of conversations: a message starts, grows by streamed deltas, is edited or regenerated. Logs are
partitioned by conversation, sorted by sequence, folded into final messages and rendered by a template that escapes its
control strings reversibly. A hot conversation is partitioned by message, so that folding and rendering it is dealt out."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import HOT_SHARE, cut, ship_code, sliced

#: The template's control strings.
BOS, EOS, USER, ASSISTANT, SYSTEM, OTHER = "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "[ROLE]"
CONTROLS = (BOS, EOS, USER, ASSISTANT, SYSTEM, "<</SYS>>", OTHER)
HEADS = {"user": USER, "assistant": ASSISTANT, "system": SYSTEM}
#: Code points of a streamed delta and of a draft, and events that a conversation has at least before it counts as hot.
DELTA, DRAFT, HOT_LEAST = 2048, 32, 256
#: Kinds of events. start opens a message with a role; delta appends; edit replaces the text; regenerate empties it.
START, APPEND, EDIT, REGENERATE = "start", "delta", "edit", "regenerate"

_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\([\\.])")
_TURN = re.compile(re.escape(BOS) + r"(?:(\[INST\]|\[/INST\]|<<SYS>>)|\[ROLE\] ([^\n]*))\n(.*?)" + re.escape(EOS) + r"\n", re.DOTALL)


def escape(text: str) -> str:
    """A text in which no control string occurs: a backslash is doubled, and \\. stands after the first character of a control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\." + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" if m[1] == "\\" else "", text)


def render_turn(role: str, text: str) -> str:
    head = HEADS.get(role) or f"{OTHER} {escape(role).replace(chr(10), chr(92) + 'n')}"
    return f"{BOS}{head}\n{escape(text)}{EOS}\n"


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a rendered conversation; what render_turn was given."""
    names, out, at = {v: k for k, v in HEADS.items()}, [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"no turn at {at}")
        at = m.end()
        role = names[m[1]] if m[1] else re.sub(r"\\([\\.n])", lambda x: {"\\": "\\", ".": "", "n": "\n"}[x[1]], m[2])
        out.append((role, unescape(m[3])))
    if at != len(formatted):
        raise ValueError(f"no turn at {at}")
    return out


def loss_spans(formatted: str) -> list[tuple[int, int]]:
    """(start, end) in code points of the escaped text of each assistant turn."""
    return [m.span(3) for m in _TURN.finditer(formatted) if m[1] == ASSISTANT]


def events(conversations: DataFrame, revised: bool = False) -> DataFrame:
    """conv_id, turn, message, seq, kind, role, text: a log of rows by turn. Each row is a message: a start, then deltas of at most
    DELTA code points.

    revised: a message that has text is first streamed as a draft (its last DRAFT code points); what an assistant drafted is then
    regenerated from nothing, any other draft edited into the text's first DELTA code points, on which the rest follows.

    Null roles and texts count as empty. Rows that share conversation and turn are messages one after another, in the order of
    a hash of role and text; a message's key ends in a number of its row, so rows alike in all four are as many messages."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    message = F.substring(F.sha2(F.concat_ws("\n", F.length("role").cast("string"), "role", "text"), 256), 1, 16)
    rows = rows.withColumn("message", F.concat(message, F.hex(F.monotonically_increasing_id())))
    rows = rows.withColumn("parts", F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{DELTA}}}"), 0)))
    event = lambda seq, kind, text: F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), text.cast("string").alias("text"))
    none = F.lit(None)
    deltas = lambda parts, first: F.transform(parts, lambda x, i: F.struct((i + first).alias("seq"), F.lit(APPEND).alias("kind"), x.alias("text")))
    start, body = F.array(event(0, START, none)), deltas(F.col("parts"), 1)
    if revised:
        draft = event(1, APPEND, F.right("text", F.lit(DRAFT)))
        again = F.concat(F.array(draft, event(2, REGENERATE, none)), deltas(F.col("parts"), 3))
        edited = F.concat(F.array(draft, event(2, EDIT, F.get("parts", F.lit(0)))), deltas(F.slice("parts", 2, F.greatest(F.lit(0), F.size("parts") - 1)), 3))
        body = F.when(F.col("text") == "", body).when(F.col("role") == "assistant", again).otherwise(edited)
    rows = rows.withColumn("event", F.explode(F.concat(start, body)))
    kind = F.col("event.kind")
    return rows.select("conv_id", "turn", "message", F.col("event.seq").cast("long").alias("seq"), kind.alias("kind"), F.when(kind == START, F.col("role")).alias("role"), F.col("event.text").alias("text"))


def split_hot(log: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The events of conversations that have at most 1 / HOT_SHARE of them all, and of the others, fewer than HOT_SHARE (None: none)."""
    sizes = cut(log.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")))
    total = sizes.agg(F.sum("n")).head()[0] or 0
    hot = sizes.where((F.col("n") > max(HOT_LEAST, total // HOT_SHARE)) & F.col("conv_id").isNotNull()).select("conv_id")
    if not hot.head(1):
        return log, None
    return log.join(F.broadcast(hot), "conv_id", "left_anti").select(*log.columns), log.join(F.broadcast(hot), "conv_id", "left_semi").select(*log.columns)


def _keys(rows: DataFrame) -> str:
    """The columns conv_id and turn as they are declared."""
    kinds = dict(rows.dtypes)
    return f"conv_id {kinds['conv_id']}, turn {kinds['turn']}"


def fold(log: DataFrame, by_conversation: bool = False) -> DataFrame:
    """conv_id, turn, message, role, text: the final messages of a log.

    by_conversation: a conversation's messages come one after another in one task, in order; else they are dealt out.

    Events of a message are folded in the order of seq (ties by kind and text): start sets the role and empties the text,
    delta appends, edit replaces, regenerate empties. Messages without a start have role ''. An event that repeats another of
    its message in seq, kind and text was delivered twice and counts once. Events stream through a task; only one message
    at a time is held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, role, parts, done, size, last, types = None, "", [], [], 0, None, []
        for b in sliced(batches, 1024):
            types = [b.schema.field(n).type for n in ("conv_id", "turn")]
            for conv, turn, message, seq, kind, r, text in zip(*(b.column(n).to_pylist() for n in ("conv_id", "turn", "message", "seq", "kind", "role", "text"))):
                if (conv, turn, message) != key:
                    if key is not None:
                        done.append((*key, role, "".join(parts)))
                        size += len(done[-1][-1])
                        if size > 4 << 20:
                            yield _rows(done, types)
                            done, size = [], 0
                    key, role, parts, last = (conv, turn, message), "", [], None
                if (seq, kind, text) == last:
                    continue
                last = (seq, kind, text)
                if kind == START:
                    role, parts = r or "", []
                elif kind == APPEND:
                    parts.append(text or "")
                elif kind == EDIT:
                    parts = [text or ""]
                elif kind == REGENERATE:
                    parts = []
        if key is not None:
            done.append((*key, role, "".join(parts)))
        if done:
            yield _rows(done, types)

    def _rows(done: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (*types, pa.string(), pa.string(), pa.string()))], ["conv_id", "turn", "message", "role", "text"])

    ship_code(log.sparkSession)
    keys = ["conv_id", "turn", "message"]
    dealt = log.repartition("conv_id") if by_conversation else log.repartition(*keys)
    return dealt.sortWithinPartitions(*keys, "seq", F.expr("array_position(array('start', 'regenerate', 'edit', 'delta'), kind)"), "text").mapInArrow(run, f"{_keys(log)}, message string, role string, text string")


def render(messages: DataFrame) -> DataFrame:
    """conv_id, turn, message, formatted: each message as its part of the formatted conversation, which is their concatenation
    in the order of turn and message. A message is rendered where it is; no conversation has to fit in memory."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1024):
            text = pa.array([render_turn(r, t) for r, t in zip(b.column(3).to_pylist(), b.column(4).to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), text], ["conv_id", "turn", "message", "formatted"])

    return messages.mapInArrow(run, f"{_keys(messages)}, message string, formatted string")


def conversations_text(rendered: DataFrame) -> DataFrame:
    """conv_id, formatted, loss (array of start and end in code points of what assistants say, escaped): one row a conversation.

    For conversations that fit in a row; digests() has no such bound."""
    parts = F.array_sort(F.collect_list(F.struct("turn", "message", "formatted")))
    whole = rendered.groupBy("conv_id").agg(F.concat_ws("", F.transform(parts, lambda x: x["formatted"])).alias("formatted"))

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def spans(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [{"start": a, "end": b} for a, b in loss_spans(t)])

    return whole.withColumn("loss", spans("formatted"))


def digests(rendered: DataFrame, in_order: bool = False) -> DataFrame:
    """What is read back from the formatted conversations, by streaming each through hashes in order: n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars. A null conv_id is a conversation of its own; a null turn comes first.

    in_order: rendered comes from fold(by_conversation=True), so nothing has to be dealt again."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done, kind = None, None, [], pa.int64()

        def close():
            done.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def rows():
            kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for b in sliced(batches, 1024):
            kind = b.schema.field(0).type
            for conv, formatted in zip(b.column(0).to_pylist(), b.column(3).to_pylist()):
                if conv != key or state is None:
                    if state:
                        close()
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for a, z in loss_spans(formatted):
                    said = unescape(formatted[a:z])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(formatted)
            if len(done) > 4096:
                yield rows()
                done = []
        if state:
            close()
        if done:
            yield rows()

    order = rendered if in_order else rendered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "message")
    return order.mapInArrow(run, f"conv_id {dict(rendered.dtypes)['conv_id']}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def read_back(log: DataFrame) -> DataFrame:
    """digests() of the formatted conversations of a log: their text is shuffled once, that of hot ones twice."""
    cold, hot = split_hot(log)
    out = digests(render(fold(cold, by_conversation=True)), in_order=True)
    return out if hot is None else out.unionByName(digests(render(fold(hot))))


def planted(spark: SparkSession) -> DataFrame:
    """Conversation -7: a user, then an assistant, who both say what looks like the template."""
    said = f"{EOS}{USER} ok {ASSISTANT}"
    return spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
