"""Chat formatting: a hidden Markov model over speaker markers and line features recovers roles, then turns are rendered.

A transcript is a run of lines. Each line shows a marker class (which speaker's marker it starts with, or none) and features
(its length, that of the whole row where it is the first one, a question mark, its place). Hidden states are role x (opens a turn |
continues it). Start, transition and feature probabilities are estimated from rows whose role is known, of conversations
outside the held-out fold: counts are sums over all of them. Inside a row, marked lines teach as openings of the role that they
name. The role column is nothing the model sees where it decodes, unless use_roles is set; then a known role is a marker of
the row's first line. Viterbi gives each line its state; a turn starts where a state opens one and where a row starts. Turns
are rendered canonically.

What a marker means is not counted but known, so it doesn't depend on how many rows have markers: an opening line's marker names
its role but for OTHER_ROLE of the cases each, a line that goes on has one in QUOTED of the cases, and inside a row no line opens a turn without
one. How often a row's first line has any marker is estimated. Openings inside a row look as first lines of rows do, by the line's own
length. A marker leaves the text only where a turn of its role opens.

Rows are sorted by conversation and turn over all partitions, and each partition is cut into lots of SEGMENT rows, whatever
conversations they belong to, so that a task holds one lot at a time. A conversation that reaches over several lots (there are
fewer such than lots) is decoded as a whole: its part of each lot becomes a max-plus transfer matrix (state in x state out),
matrices are multiplied along the conversation, in levels of at most CHAIN of them, and each part is then decoded from its
known entry score and what follows it.

Defined results. Null or empty text: one empty line. Null, empty or unknown role: teaches nothing. Repeated rows: each is a turn.
Rows with a null turn follow the others. Rows of one turn are ordered by hash, role and text. Null conversation ids are one
conversation, of any length. A very long text is one row of its lot. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import bounded_broadcast, staged, table

ROLES = ("system", "user", "assistant")
# How transcripts name the speakers.
SPEAKERS = {
    "system": "system", "sys": "system", "instruction": "system", "instructions": "system", "context": "system",
    "user": "user", "human": "user", "customer": "user", "q": "user", "question": "user", "prompt": "user", "me": "user", "you": "user",
    "assistant": "assistant", "ai": "assistant", "bot": "assistant", "gpt": "assistant", "model": "assistant", "agent": "assistant", "a": "assistant", "answer": "assistant", "response": "assistant",
}
NAMES = "|".join(sorted(SPEAKERS, key=len, reverse=True))
MARKER = re.compile(rf"^\s*(?:(?:<\|(?:im_start\|>)?|\[|#{{1,4}}\s*|\*\*)\s*(?P<a>{NAMES})\s*(?:\|>|\]|:?\*\*:?|:|$)|(?P<b>{NAMES})\s*:)\s*", re.I)
SEGMENT, SEGMENT_CHARS, SMOOTH, CHAIN, MAX_BROADCAST_ROWS = 256, 1_000_000, 0.5, 4096, 200_000
OTHER_ROLE, QUOTED, BLUR = 1e-3, 1e-5, 0.1
FOLDS, HELD_OUT = 4, 2
STATES = 2 * len(ROLES)  # 2r opens a turn of role r, 2r + 1 continues it
LENGTHS, PLACES = 12, 3
FEATURES = LENGTHS * 2 * PLACES
MARKS = 1 + len(ROLES)


def role_of(name: str | None) -> int:
    """The number of a known role, or -1."""
    role = SPEAKERS.get((name or "").strip().lower())
    return ROLES.index(role) if role else -1


def split_marker(line: str) -> tuple[int, str]:
    """(1 + role of the marker that the line starts with, or 0; the rest of the line)."""
    m = MARKER.match(line)
    return (1 + ROLES.index(SPEAKERS[(m["a"] or m["b"]).lower()]), line[m.end() :]) if m else (0, line)


def shape(n: int, rest: str) -> int:
    return min(LENGTHS - 1, n.bit_length()) * 2 + ("?" in rest)


def lines_of(text: str | None, first: bool, role: int = -1) -> list[tuple[int, int, str, str]]:
    """(marker, features, rest, line) of each line of a row. role: taken for the first line's marker, unless -1."""
    out = []
    for i, line in enumerate((text or "").split("\n")):
        found, rest = (1 + role, line) if role >= 0 and not i else split_marker(line)
        place = 0 if first and not i else 1 if not i else 2
        out.append((found, shape(len(rest) if i else len(text or ""), rest) * PLACES + place, rest, line))
    return out


def lots_of(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows in order, SEGMENT to a lot: (lot, convs, turns, roles, texts, before); lots are numbered in order too.

    before: the role of the row before the lot, if that is of the same conversation and partition.
    """
    base = df.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    base = base.select("conv", F.col("turn").isNull().alias("late"), "turn", F.xxhash64("role", "text").alias("h"), "role", "text")
    kind = to_arrow_type(base.schema["conv"].dataType)
    keys = ["conv", "late", "turn", "h"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot, held, size, last = TaskContext.get().partitionId() << 40, [], 0, (None, None)

        def out() -> pa.RecordBatch:
            cols = list(zip(*held, strict=True))
            kinds = (kind, pa.int64(), pa.string(), pa.string())
            before = last[1] if last[0] == held[0][0] else None
            return pa.RecordBatch.from_arrays([pa.array([lot], pa.int64()), *(pa.array([list(c)], pa.list_(k)) for c, k in zip(cols, kinds, strict=True)), pa.array([before], pa.string())], ["lot", "convs", "turns", "roles", "texts", "before"])

        for b in batches:
            for x in zip(*(b.column(i).to_pylist() for i in (0, 2, 4, 5)), strict=True):
                held.append(x)
                size += len(x[3] or "")
                if len(held) >= SEGMENT or size > SEGMENT_CHARS:
                    yield out()
                    lot, last, held, size = lot + 1, (x[0], x[2]), [], 0
        if held:
            yield out()

    sql = base.schema["conv"].dataType.simpleString()
    rows = base.repartitionByRange(*keys).sortWithinPartitions(*keys, "role", "text")
    return staged(rows.mapInArrow(cut, f"lot long, convs array<{sql}>, turns array<long>, roles array<string>, texts array<string>, before string"), "lots")


def long_ones(lots: DataFrame) -> DataFrame:
    """(lot, head, tail): whether a lot's first conversation began before it, whether its last goes on after it."""
    ends = lots.select("lot", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("convs")[0].alias("conv")), F.struct(F.lit(1).alias("side"), F.element_at("convs", -1).alias("conv")))).alias("x")).select("lot", "x.side", "x.conv")
    over = ends.groupBy("conv").agg(F.min("lot").alias("a"), F.max("lot").alias("z")).filter("z > a").select(F.col("conv").alias("c"), "a", "z")
    met = ends.join(bounded_broadcast(staged(over, "over"), MAX_BROADCAST_ROWS), F.col("conv").eqNullSafe(F.col("c")))
    return met.groupBy("lot").agg(F.max((F.col("side") == 0) & (F.col("lot") > F.col("a"))).alias("head"), F.max((F.col("side") == 1) & (F.col("lot") < F.col("z"))).alias("tail"))


def runs(convs: list) -> list[tuple[int, int]]:
    """(from, to) of the rows of each conversation in a lot."""
    cuts = [0, *(i for i in range(1, len(convs)) if convs[i] != convs[i - 1]), len(convs)]
    return list(zip(cuts, cuts[1:], strict=False))


def held_out(conv) -> bool:
    """Whether nothing is learnt from a conversation: crc32 of its id as text."""
    return conv is not None and zlib.crc32(str(conv).encode()) % FOLDS == HELD_OUT


def names(role: int, other: float) -> np.ndarray:
    """How likely an opening line's marker, if it has one, names each role."""
    out = np.full(len(ROLES), other)
    out[role] = 1 - other * (len(ROLES) - 1)
    return out


def fit(lots: DataFrame, use_roles: bool) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities (states x states + start row, states x (markers, features)) from counts over rows with known roles.

    A turn's first line is emitted by the opening state, further lines by the continuing one. Counts: features by state; whether a
    row's first line has a marker; shapes of opening lines by themselves; lines that go on and turns; roles after roles; first roles.
    """
    sizes = {"emit": (STATES, FEATURES), "marked": (1, 2), "inside": (len(ROLES), LENGTHS * 2), "more": (len(ROLES), 2), "turn": (len(ROLES), len(ROLES)), "start": (1, len(ROLES))}

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = {k: np.zeros(v, np.int64) for k, v in sizes.items()}
        for b in batches:
            for convs, roles, texts, head, before in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                for lo, hi in runs(convs):
                    if held_out(convs[lo]):
                        continue
                    last = -1 if lo else role_of(before)
                    for i in range(lo, hi):
                        r, first = role_of(roles[i]), i == lo and not (lo == 0 and head)
                        if r >= 0:
                            lines = lines_of(texts[i], first, r if use_roles else -1)
                            if lines[0][0] and any(x[0] for x in lines[1:]):
                                r = lines[0][0] - 1  # a transcript in one row names its speakers itself
                            n["marked"][0, int(lines[0][0] > 0)] += 1
                            if first:
                                n["start"][0, r] += 1
                            if last >= 0:
                                n["turn"][last, r] += 1
                            for k, (mark, feature, rest, _) in enumerate(lines):
                                if k and mark:
                                    n["more"][r, 1] += 1
                                    n["turn"][r, mark - 1] += 1
                                    r = mark - 1
                                elif k:
                                    n["emit"][2 * r + 1, feature] += 1
                                    n["more"][r, 0] += 1
                                    continue
                                else:
                                    n["emit"][2 * r, feature] += 1
                                n["inside"][r, shape(len(rest), rest)] += 1
                            n["more"][r, 1] += 1
                        last = r
        flat = np.concatenate([n[k].ravel() for k in sizes])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int64()), pa.array(flat)], ["k", "v"])

    sums = lots.select("convs", "roles", "texts", "head", "before").mapInArrow(part, "k long, v long").groupBy("k").agg(F.sum("v").alias("v")).collect()  # a row for each count
    flat = np.zeros(sum(a * b for a, b in sizes.values()))
    for r in sums:
        flat[r.k] = r.v
    n, at = {}, 0
    for k, (a, b) in sizes.items():
        n[k], at = flat[at : at + a * b].reshape(a, b) + SMOOTH, at + a * b
    share = {k: v / v.sum(axis=1, keepdims=True) for k, v in n.items()}
    step = np.full((STATES + 1, STATES), -np.inf)
    for r in range(len(ROLES)):
        for state in (2 * r, 2 * r + 1):
            step[state, 2 * r + 1] = np.log(share["more"][r, 0])
            step[state, 0::2] = np.log(share["more"][r, 1] * share["turn"][r])
    step[STATES, 0::2] = np.log(share["start"][0])
    # a role that is given isn't another, and whether it is given doesn't depend on which it is
    marked, other = (0.98, 1e-9) if use_roles else (share["marked"][0, 1], OTHER_ROLE)
    emit = np.log(share["emit"])[:, None, :] + np.zeros((STATES, MARKS, FEATURES))
    inside = (1 - BLUR) * share["inside"] + BLUR / share["inside"].shape[1]
    for r in range(len(ROLES)):
        emit[2 * r] += np.log(np.r_[1 - marked, marked * names(r, other)])[:, None]
        emit[2 * r, 0, PLACES - 1 :: PLACES] = -np.inf
        emit[2 * r, 1:, PLACES - 1 :: PLACES] = np.log(names(r, OTHER_ROLE))[:, None] + np.log(inside[r])[None, :]
        emit[2 * r + 1] += np.log(np.r_[1 - QUOTED, np.full(len(ROLES), QUOTED / len(ROLES))])[:, None]
    return step, emit


def transfer(lines: list[tuple], step: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Max-plus: best score from the state before the lines (or the start) to the state of the last."""
    out = None
    for mark, feature, *_ in lines:
        move = step + emit[:, mark, feature][None, :]
        out = move if out is None else (out[:, :, None] + move[None, :STATES, :]).max(axis=1)
    return out


def after(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product: a, then b."""
    return (a[:, :, None] + b[None, :STATES, :]).max(axis=1)


def decode_lines(lines: list[tuple], entry: np.ndarray, leave: np.ndarray, step: np.ndarray, emit: np.ndarray) -> list[int]:
    """The best states of the lines, given scores of the states before them and of what follows their last state."""
    score, back = entry, []
    for mark, feature, *_ in lines:
        move = score[:, None] + (step if len(score) > STATES else step[:STATES])
        back.append(move.argmax(axis=0))
        score = move.max(axis=0) + emit[:, mark, feature]
    states = [int((score + leave).argmax())]
    for b in reversed(back[1:]):
        states.append(int(b[states[-1]]))
    return states[::-1]


START = np.r_[np.full(STATES, -np.inf), 0.0]


def bounds_of(parts: DataFrame, kind: pa.DataType, limit: int | None = None) -> DataFrame:
    """(conv, lot, entry, leave) of each part (conv, lot, m) of a conversation: scores before it, and of what follows it.

    Where a conversation has more parts than the limit, neighbours are multiplied first, their product's bounds are found in
    the same way and then carried to the parts; so no group has more rows than the limit.
    """
    limit = limit or CHAIN
    sql, lists = parts.schema["conv"].dataType.simpleString(), (kind, pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
    out = f"conv {sql}, lot long, entry array<double>, leave array<double>"

    def spread(table: pa.Table) -> pa.Table:
        table = table.sort_by("lot")
        ms = [np.array(m).reshape(STATES + 1, STATES) for m in table["m"].to_pylist()]
        entry, leave = table["entry"][0].as_py(), table["leave"][-1].as_py()
        entries, leaves = [START if entry is None else np.array(entry)], [np.zeros(STATES) if leave is None else np.array(leave)]
        for m in ms[:-1]:
            entries.append((entries[-1][:, None] + m[: len(entries[-1])]).max(axis=0))
        for m in reversed(ms[1:]):
            leaves.append((m[:STATES] + leaves[-1][None, :]).max(axis=1))
        cols = (table["conv"].to_pylist(), table["lot"].to_pylist(), [x.tolist() for x in entries], [x.tolist() for x in leaves[::-1]])
        return pa.table([pa.array(c, k) for c, k in zip(cols, lists, strict=True)], ["conv", "lot", "entry", "leave"])

    def product(table: pa.Table) -> pa.Table:
        table = table.sort_by("lot")
        m = None
        for x in table["m"].to_pylist():
            x = np.array(x).reshape(STATES + 1, STATES)
            m = x if m is None else after(m, x)
        return pa.table([table["conv"].slice(0, 1).combine_chunks(), table["block"].slice(0, 1).combine_chunks(), pa.array([m.ravel().tolist()], lists[2])], ["conv", "lot", "m"])

    most = parts.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    if most <= limit:
        none = F.lit(None).cast("array<double>")
        return parts.withColumns({"entry": none, "leave": none}).groupBy("conv").applyInArrow(spread, out)
    # lots of a conversation are dense within a partition, so blocks of numbers hold at most so many of them
    blocks = parts.withColumn("block", F.floor(F.col("lot") / limit).cast("long"))
    outer = staged(bounds_of(staged(blocks.groupBy("conv", "block").applyInArrow(product, f"conv {sql}, lot long, m array<double>"), "blocks"), kind, limit), "block-bounds")
    named = outer.select(F.col("conv").alias("c"), F.col("lot").alias("b"), "entry", "leave")
    fed = blocks.join(named, F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).select("conv", "lot", "m", "entry", "leave", "block")
    return fed.groupBy("conv", "block").applyInArrow(spread, out)


def format_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", use_roles: bool = True) -> DataFrame:
    """(conv, turn, part, role_given, role, text, held_out, rendered): the turns that the model finds, rendered canonically.

    A row whose text holds several turns gives as many; part numbers them. held_out: the model has learnt nothing from the
    conversation. use_roles: known roles are markers for the model, as in a transcript that names its speakers.
    """
    lots = lots_of(df, conv, turn, role, text)
    marks = bounded_broadcast(staged(long_ones(lots), "marks"), MAX_BROADCAST_ROWS)
    lots = lots.join(marks, "lot", "left").withColumns({x: F.coalesce(x, F.lit(False)) for x in ("head", "tail")})
    step, emit = fit(lots, use_roles)
    kind = to_arrow_type(lots.schema["convs"].dataType.elementType)
    sql = lots.schema["convs"].dataType.elementType.simpleString()

    def lines(roles: list, texts: list, lo: int, hi: int, began: bool) -> list[list[tuple]]:
        return [lines_of(texts[i], i == lo and not began, role_of(roles[i]) if use_roles else -1) for i in range(lo, hi)]

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lot, convs, roles, texts, head, tail in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                for lo, hi in runs(convs):
                    began, goes_on = head and lo == 0, tail and hi == len(convs)
                    if began or goes_on:
                        m = transfer([y for x in lines(roles, texts, lo, hi, began) for y in x], step, emit)
                        yield pa.RecordBatch.from_arrays([pa.array([convs[lo]], kind), pa.array([lot], pa.int64()), pa.array([m.ravel().tolist()], pa.list_(pa.float64()))], ["conv", "lot", "m"])

    over = lots.filter("head or tail").select("lot", "convs", "roles", "texts", "head", "tail")
    parts = staged(over.mapInArrow(matrices, f"conv {sql}, lot long, m array<double>"), "matrices")
    if not parts.isEmpty():
        side = staged(bounds_of(parts, kind), "bounds").groupBy("lot").agg(F.collect_list(F.struct("conv", "entry", "leave")).alias("bounds"))  # at most two for a lot
        lots = lots.join(bounded_broadcast(side, MAX_BROADCAST_ROWS // 10), "lot", "left")
    else:
        lots = lots.withColumn("bounds", F.lit(None).cast(f"array<struct<conv:{sql},entry:array<double>,leave:array<double>>>"))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for convs, turns, roles, texts, head, tail, bounds in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                out: list[tuple] = []
                for lo, hi in runs(convs):
                    began, goes_on = head and lo == 0, tail and hi == len(convs)
                    per_row = lines(roles, texts, lo, hi, began)
                    known = next((x for x in bounds or () if x["conv"] == convs[lo]), None) if began or goes_on else None
                    entry, leave = (np.array(known["entry"]), np.array(known["leave"])) if known else (START, np.zeros(STATES))
                    states, at = decode_lines([y for x in per_row for y in x], entry, leave, step, emit), 0
                    for i, ls in zip(range(lo, hi), per_row, strict=True):
                        for k, (mark, _, rest, line) in enumerate(ls):
                            state = states[at]
                            at += 1
                            rest = rest if mark and state == 2 * (mark - 1) else line
                            if state % 2 == 0 or not k:
                                out.append((convs[i], turns[i], out[-1][2] + 1 if k else 0, roles[i], ROLES[state // 2], [rest]))
                            else:
                                out[-1][5].append(rest)
                shown = ["\n".join(x[5]).strip() for x in out]
                cols = [*zip(*(x[:5] for x in out), strict=True)]
                kinds = (kind, pa.int64(), pa.int32(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), pa.array(shown, pa.string()), pa.array([held_out(c) for c in cols[0]]), pa.array([f"<|{x[4]}|>\n{t}\n<|end|>" for x, t in zip(out, shown, strict=True)], pa.string())],
                    ["conv", "turn", "part", "role_given", "role", "text", "held_out", "rendered"],
                )

    fed = lots.select("convs", "turns", "roles", "texts", "head", "tail", "bounds")
    out = fed.mapInArrow(render, f"conv {sql}, turn long, part int, role_given string, role string, text string, held_out boolean, rendered string")
    return out.withColumnRenamed("conv", conv)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of every conversation with the role that the model recovers from its lines alone, rendered."""
    out = format_turns(table(spark, sf_dir, "conversations"), use_roles=False)
    return out.select("conv_id", "turn", "part", "role_given", "role", "held_out", "rendered")
