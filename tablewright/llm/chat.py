"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system message, then user and assistant in turn, ending with the assistant. Dynamic
programming over this automaton picks for each turn the cheapest of: keep it, relabel its role, merge it into the message
before it, or insert empty messages in front of it; empty messages may also close the conversation. The repaired sequence
is rendered turn by turn, so that a conversation's pieces in order are its whole text.

A turn's effect on the automaton's four states is a (min, +) matrix, and such matrices multiply. A conversation is cut into
chunks of CHUNK turn numbers, and where turns repeat, so that a chunk holds more messages than that, again by turn, role
and ranges of the text's hash, which is the order of messages. For conversations of several chunks each chunk's matrix is
made first, the states between the chunks follow from these, and then every chunk is repaired by itself. No task holds
more than a chunk's messages, or a small matrix for each chunk of a span, or for each span of a conversation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, sorted_groups

#: Turn numbers of a chunk, chunks of a span.
CHUNK, SPAN = 512, 4096
MERGE, RELABEL, RELABEL_UNKNOWN, INSERT = 1, 3, 1, 2
ROLES = ("system", "user", "assistant")
BEGIN, SYSTEM, USER, ASSISTANT = 0, 1, 2, 3
LEGAL = {BEGIN: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
_FAR = 10**12


@cache
def fill(state: int, goal: int) -> tuple[int, ...] | None:
    """The fewest empty messages after which `goal` is legal; None if there are none. Systems aren't inserted."""
    path, now = [], state
    for _ in range(3):
        if goal in LEGAL[now]:
            return tuple(path)
        now = ASSISTANT if now == USER else USER
        path.append(now)
    return None


@cache
def close(state: int) -> tuple[int, ...]:
    return {BEGIN: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}[state]


@cache
def moves(role: int) -> tuple[tuple[tuple[int, str, tuple[int, ...]], ...], ...]:
    """[state][next state]: (cost, action, inserted) of the cheapest way to take a turn of this role (0: unknown).

    Of equal costs the first of keep or relabel, then merge.
    """
    table = []
    for state in range(4):
        row = []
        for after in range(4):
            change = 0 if role == after else RELABEL if role else RELABEL_UNKNOWN
            ways = []
            if after != BEGIN and (inserted := fill(state, after)) is not None:
                ways.append((change + INSERT * len(inserted), "relabel" if change else "keep", inserted))
            if after == state != BEGIN:
                ways.append((change + MERGE, "merge_relabel" if change else "merge", ()))
            row.append(min(ways, key=lambda x: x[0], default=(_FAR, "", ())))
        table.append(tuple(row))
    return tuple(table)


@cache
def matrix(role: int) -> np.ndarray:
    return np.array([[m[0] for m in row] for row in moves(role)])


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The (min, +) product."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), _FAR)


def role_id(role: str | None) -> int:
    r = (role or "").strip().lower()
    return ROLES.index(r) + 1 if r in ROLES else 0


def repair(roles: list[int], start: int = BEGIN, end: int | None = None) -> list[tuple[int, str, tuple[int, ...]]]:
    """For each turn its state after it, the action and what is inserted before it, at least cost from start to end; end
    None: to the end of the conversation, whose closing messages cost too."""
    cost, back = np.full(4, _FAR), []
    cost[start] = 0
    for r in roles:
        through = cost[:, None] + matrix(r)
        back.append(through.argmin(axis=0))
        cost = through.min(axis=0)
    if end is None:
        end = int((cost + [INSERT * len(close(s)) for s in range(4)]).argmin())
    out = []
    for r, b in zip(reversed(roles), reversed(back), strict=True):
        before = int(b[end])
        _, action, inserted = moves(r)[before][end]
        out.append((end, action, inserted))
        end = before
    return out[::-1]


def _open(state: int) -> str:
    return f"<|im_start|>{ROLES[state - 1]}\n"


_END = "<|im_end|>\n"


def render(text: str | None, before: int, after: int, action: str, inserted: tuple[int, ...], last: bool) -> str:
    """A turn's piece of the conversation: the message before it is closed here, unless the turn joins it. The marks of
    messages that occur in a text are split by a blank."""
    body = (text or "").replace("<|im_", "<| im_")
    if action.startswith("merge"):
        piece = "\n\n" + body
    else:
        piece = (_END if before != BEGIN else "") + "".join(_open(s) + _END for s in inserted) + _open(after) + body
    return piece + (_END + "".join(_open(s) + _END for s in close(after)) if last else "")


def _keyed(spark: SparkSession, chats: DataFrame) -> DataFrame:
    turn, role = F.col("turn"), F.col("role")
    rows = chats.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n_copies"))
    rows = rows.withColumns({"ck": F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null")), "tc": F.coalesce(F.floor(turn / CHUNK), F.lit(2**62)), "th": F.xxhash64("text")})
    rows = materialise(spark, rows, "chat-messages")  # texts are made distinct once; what needs none doesn't read them
    crowded = materialise(spark, rows.groupBy("ck", "tc").agg(F.count("*").alias("m")).where(F.col("m") > CHUNK), "chat-crowded")
    keyed = rows.join(crowded, ["ck", "tc"], "left")
    # pieces of half a chunk on average, so that hardly one is larger than a chunk
    shift = F.greatest(F.lit(1), 63 - F.ceil(F.log2(F.col("m") / CHUNK))).cast("int")
    split = F.col("m").isNotNull()
    keyed = keyed.withColumns({"st": F.when(split, turn), "sr": F.when(split, role), "sh": F.when(split, F.call_function("shiftright", F.col("th"), shift))}).drop("m")
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    return keyed.withColumn("chunk", F.concat_ws("|", "tc", name("sh"), name("st"), "ck", name("sr")))


_ORDER = ("chunk", "turn", "role", "th")
#: The order of a conversation's chunks.
_PLACE = ("ck", "tc", "st", "sr", "sh")


def _by_chunk(rows: DataFrame) -> DataFrame:
    return rows.repartition("chunk").sortWithinPartitions(*_ORDER)


def _walk(ms: list[list[int]], start: int, end: int | None) -> tuple[list[int], list[int]]:
    """States before and after each matrix of a row, at least cost from start to end; end None: to a conversation's end."""
    cost, back = np.full(4, _FAR), []
    cost[start] = 0
    for m in ms:
        through = cost[:, None] + np.array(m).reshape(4, 4)
        back.append(through.argmin(axis=0))
        cost = through.min(axis=0)
    if end is None:
        end = int((cost + [INSERT * len(close(s)) for s in range(4)]).argmin())
    starts, ends = [], []
    for b in reversed(back):
        ends.append(end)
        end = int(b[end])
        starts.append(end)
    return starts[::-1], ends[::-1]


def _products(rows: DataFrame, key: str, of: Callable[[pa.Table], Iterator[np.ndarray]], *keep: str) -> DataFrame:
    """One row for each run of key over rows sorted by it: the columns to keep, and m, the product of its matrices."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    schema = T.StructType([T.StructField(c, kinds[c]) for c in keep] + T.StructType.fromDDL("m array<bigint>").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, key):
            m = np.where(np.eye(4, dtype=bool), 0, _FAR)
            for x in of(group):
                m = times(m, x)
            first = group.slice(0, 1)
            yield pa.RecordBatch.from_arrays([*(first.column(c).combine_chunks() for c in keep), pa.array([m.ravel().tolist()], pa.list_(pa.int64()))], names=schema.names)

    return rows.mapInArrow(run, schema)


def _between(rows: DataFrame, key: str, name: str) -> DataFrame:
    """name, start, end, last for rows (key, name, m, start, end, last) sorted by key and place: the states around each
    matrix. start, end and last are those of the whole run, end null where the run ends the conversation."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    schema = T.StructType([T.StructField(name, kinds[name]), *T.StructType.fromDDL("start int, end int, last boolean").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, key):
            start, end, last = (group.column(c)[0].as_py() for c in ("start", "end", "last"))
            starts, ends = _walk(group.column("m").to_pylist(), start, end)
            ending = [False] * (len(ends) - 1) + [last]
            yield from pa.Table.from_arrays([group.column(name), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(ending)], names=schema.names).to_batches()

    return rows.mapInArrow(run, schema)


def _states(spark: SparkSession, keyed: DataFrame) -> DataFrame:
    """chunk, start, end, last for the chunks of conversations that have more than one. Of a conversation of more than SPAN
    chunks each span is walked by itself, between the states that a walk over the spans' products gives."""
    chunks = keyed.select(*_PLACE, "chunk").distinct()
    several = chunks.groupBy("ck").agg(F.count("*").alias("n")).where("n > 1").select("ck")
    rows = _by_chunk(keyed.join(several, "ck", "left_semi").select(*_PLACE, "chunk", "turn", "role", "th"))
    made = _products(rows, "chunk", lambda group: (matrix(role_id(r)) for r in group.column("role").to_pylist()), *_PLACE, "chunk")
    number = F.row_number().over(Window.partitionBy("ck").orderBy(*_PLACE[1:])) - 1
    made = made.withColumn("n", number).withColumn("span", F.concat_ws("|", F.floor(F.col("n") / SPAN).cast("string"), "ck"))
    made = materialise(spark, made.select("ck", "span", "n", "chunk", "m"), "chat-chunks")
    spans = _products(made.repartition("span").sortWithinPartitions("span", "n"), "span", lambda group: (np.array(m).reshape(4, 4) for m in group.column("m").to_pylist()), "ck", "span", "n")
    whole = {"start": F.lit(BEGIN), "end": F.lit(None).cast("int"), "last": F.lit(True)}
    around = _between(spans.withColumns(whole).repartition("ck").sortWithinPartitions("ck", "n"), "ck", "span")
    inner = made.join(materialise(spark, around, "chat-spans"), "span").repartition("span").sortWithinPartitions("span", "n")
    return materialise(spark, _between(inner, "span", "chunk"), "chat-states")


def format_chats(spark: SparkSession, chats: DataFrame) -> DataFrame:
    """conv_id, turn, role, role_out, action, n_inserted, n_copies, piece for each message of chats (conv_id, turn, role,
    text).

    action: keep, relabel, merge or merge_relabel; n_inserted: empty messages in front of the turn, and after a
    conversation's last turn those that close it; piece: the turn's part of the rendering. Rows equal in all four columns
    are one message, n_copies tells how many they are. Messages go by turn, then role, then a hash of the text; a null
    turn goes last. A null conv_id is an id like any other; roles other than system, user and assistant, and null, are
    unknown and get the cheapest role; null texts are empty; very long texts are rendered whole. An empty table has no
    rows. Other columns of chats are not read, so their names cannot clash.
    """
    keyed = _keyed(spark, chats)
    rows = keyed.join(_states(spark, keyed), "chunk", "left").select("chunk", "conv_id", "turn", "role", "text", "n_copies", "th", F.coalesce("start", F.lit(BEGIN)).alias("start"), "end", F.coalesce("last", F.lit(True)).alias("last"))
    kinds = {f.name: f.dataType for f in chats.schema.fields}
    schema = T.StructType([T.StructField(c, kinds[c]) for c in ("conv_id", "turn", "role")] + T.StructType.fromDDL("role_out string, action string, n_inserted int, n_copies bigint, piece string").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, "chunk"):
            start, end, last = (group.column(c)[0].as_py() for c in ("start", "end", "last"))
            # a conversation's last chunk closes it: its end state is the one chosen for the whole
            steps = repair([role_id(r) for r in group.column("role").to_pylist()], start, end)
            role_out, action, n, piece = [], [], [], []
            before = start
            for i, ((after, act, inserted), text) in enumerate(zip(steps, group.column("text").to_pylist(), strict=True)):
                ends = last and i == len(steps) - 1
                role_out.append(ROLES[after - 1])
                action.append(act)
                n.append(len(inserted) + (len(close(after)) if ends else 0))
                piece.append(render(text, before, after, act, inserted, ends))
                before = after
            yield from pa.Table.from_arrays([*(group.column(c) for c in ("conv_id", "turn", "role")), pa.array(role_out), pa.array(action), pa.array(n, pa.int32()), group.column("n_copies"), pa.array(piece)], names=schema.names).to_batches()

    return _by_chunk(rows).mapInArrow(run, schema)
