"""Chat formatting: roles of a raw transcript's lines by a hidden Markov model, then canonical turns.

States are (role, line opens a turn with text, opens it with a marker alone, or goes on with it): after a marker alone more lines follow, after text the turn
may end. A line shows a speaker marker's class (a known name of a role, an unknown
name, or none) and a shape (blank, question, list or code, other). A marker may follow a time and stand in brackets, after decoration, or
before a colon, a dash or an arrow. Transitions and emissions are counted, with one added, on at most `MAX_TRAIN` transcripts
whose turns are known. Viterbi's best path gives the turns.

A transcript may come in parts of bounded size. A part sums up to a matrix: the best score from each state before it to each
state at its end. Matrices are multiplied in the (max, +) sense, `FAN` at a time and level over level, then the best
states at part boundaries are handed down the levels, and each part is decoded between its two. The result is the whole
transcript's best path, though no task sees more than one part or `FAN` matrices.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

ROLES = ("system", "user", "assistant")
#: Names that mark a role (fixed lists).
NAMES = {
    "system": ("system", "instruction", "instructions", "context", "sys"),
    "user": ("user", "human", "customer", "question", "prompt", "q"),
    "assistant": ("assistant", "ai", "bot", "model", "answer", "response", "a"),
}
OPEN, BARE, MORE = "open", "bare", "more"
STATES = [(r, kind) for r in ROLES for kind in (OPEN, BARE, MORE)]
CLASSES = ("none", *ROLES, "other")
SHAPES = ("blank", "question", "list", "plain")
MAX_TRAIN, FAN, PART_TURNS = 2000, 256, 64

_DECOR = r"[#*<|\[\](>{}_\-=\s]*"
_KNOWN = {n: r for r, names in NAMES.items() for n in names}
#: A date and a time before a marker.
_TIME = re.compile(r"^\s*[\[(]?(?:\d{4}-\d\d-\d\d[T ,]+)?\d{1,2}:\d{2}(?::\d{2})?(?:\s?[AaPp][Mm])?[\])]?[\s,|-]*")
_MARK = re.compile(rf"^({_DECOR})({'|'.join(sorted(_KNOWN, key=len, reverse=True))})({_DECOR}(?::{_DECOR}|$)|[|>\])]+|\s+(?:[-\u2013\u2014]|[-=]*>+)(?=\s))\s*", re.I | re.A)
_PERSON = r"[A-Z][\w.'-]*(?: [A-Z]?[\w.'-]+){0,2}"
_NAME = re.compile(rf"^[#*\s]*{_PERSON}\s*:[*\s]*|^\s*\[{_PERSON}\]:?\s*|^\s*<{_PERSON}>:?\s*")
_LIST = re.compile(r"^\s*(?:[-*+] |\d+[.)] |```|    |\t)")


def observe(line: str) -> tuple[int, int, int]:
    """(marker class, shape, where the text after the marker begins) of a line."""
    time = _TIME.match(line)
    begin = time.end() if time else 0
    m = _MARK.match(line[begin:])
    # a bare word that only ends its line is a marker if it is decorated
    if m and (m[1].strip() or m[3].strip()):
        kind, at = CLASSES.index(_KNOWN[m[2].lower()]), begin + m.end()
    elif n := _NAME.match(line[begin:]):
        kind, at = CLASSES.index("other"), begin + n.end()
    else:
        kind, at = 0, 0
    rest = line[at:]
    if not rest.strip():
        shape = 0
    elif rest.rstrip().endswith("?"):
        shape = 1
    elif _LIST.match(rest):
        shape = 2
    else:
        shape = 3
    return kind, shape, at


class Hmm:
    def __init__(self, start: np.ndarray, move: np.ndarray, marks: np.ndarray, shapes: np.ndarray):
        self.start, self.move, self.marks, self.shapes = start, move, marks, shapes

    @classmethod
    def counted(cls, counts: np.ndarray) -> Hmm:
        """From what _count() sums up over known transcripts."""
        n = len(STATES)
        start, move, marks, shapes = np.split(counts.astype(float), np.cumsum([n, n * n, n * len(CLASSES)]))
        start, move, marks, shapes = start + 0.1, move.reshape(n, n) + 0.1, marks.reshape(n, -1) + 0.1, shapes.reshape(n, -1) + 1.0
        for a, (ra, _) in enumerate(STATES):
            for b, (rb, kind) in enumerate(STATES):
                if kind == MORE and ra != rb:
                    move[a, b] = 1e-9  # a turn goes on in its own role only
        # without examples: a role's own name opens its turns, and plain lines go on
        for st, (r, kind) in enumerate(STATES):
            marks[st, CLASSES.index(r) if kind != MORE else 0] += 5
            # what the states say of themselves
            if kind != MORE:
                shapes[st, np.arange(len(SHAPES)) == 0 if kind == OPEN else np.arange(len(SHAPES)) > 0] *= 1e-6
        # a name that is no role's tells nothing about the role: it is as likely to open a turn of any
        other, opening = CLASSES.index("other"), [st for st, (_, kind) in enumerate(STATES) if kind != MORE]
        share = marks[opening, other].sum() / marks[opening].sum()
        for st in opening:
            marks[st, other] = (marks[st].sum() - marks[st, other]) * share / (1 - share)
        log = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
        return cls(log(start), log(move), log(marks), log(shapes))

    def emissions(self, lines: list[str]) -> np.ndarray:
        seen = [observe(x)[:2] for x in lines]
        return np.array([self.marks[:, m] + self.shapes[:, h] for m, h in seen]).reshape(len(lines), len(STATES))

    def matrix(self, lines: list[str], first: bool) -> np.ndarray:
        """Best score from each state before the lines to each state after them; before the first part every row is the start."""
        best = None
        for e in self.emissions(lines):
            if best is None:
                best = (np.tile(self.start, (len(STATES), 1)) if first else self.move) + e
            else:
                best = (best[:, :, None] + self.move[None]).max(axis=1) + e
        return best

    def decode(self, lines: list[str], first: bool, enter: int, leave: int | None) -> list[int]:
        """The best states of the lines, given the state before them and, if known, the last one."""
        e = self.emissions(lines)
        if not len(e):
            return []
        score = (self.start if first else self.move[enter]) + e[0]
        back = []
        for row in e[1:]:
            reach = score[:, None] + self.move
            back.append(reach.argmax(axis=0))
            score = reach.max(axis=0) + row
        path = [int(score.argmax()) if leave is None else leave]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None]).max(axis=1)


def split_lines(text: str) -> list[str]:
    return text.split("\n")


def turns(lines: list[str], states: list[int]) -> list[tuple[str, bool, str]]:
    """(role, whether it goes on from before, text) of the lines' turns."""
    out: list[list] = []
    for line, st in zip(lines, states):
        role, kind = STATES[st]
        opens = kind != MORE
        if opens or not out:
            rest = line[observe(line)[2] :] if opens else line
            out.append([role, not opens, [rest] if rest or not opens else []])
        else:
            out[-1][2].append(line)
    return [(r, c, "\n".join(t)) for r, c, t in out]


def render(role: str, text: str) -> str:
    return f"<|im_start|>{role}\n{text}<|im_end|>"


_MATRIX = "_id string, _node long, _first boolean, m array<double>"
_BOUNDS = "_id string, _node long, enter int, leave int"


def _as_matrix(x) -> np.ndarray:
    return np.array(x, dtype=float).reshape(len(STATES), len(STATES))


def _level_up(part: pa.Table, fan: int) -> pa.Table:
    rows = sorted(part.to_pylist(), key=lambda r: r["_node"])
    total = _as_matrix(rows[0]["m"])
    for r in rows[1:]:
        total = _product(total, _as_matrix(r["m"]))
    return pa.table({"_id": [rows[0]["_id"]], "_node": [rows[0]["_node"] // fan], "_first": [rows[0]["_first"]], "m": pa.array([total.ravel().tolist()], type=pa.list_(pa.float64()))})


def _level_down(children: pa.Table, parent: pa.Table) -> pa.Table:
    rows = sorted(children.to_pylist(), key=lambda r: r["_node"])
    at = parent.to_pylist()[0]
    ms = [_as_matrix(r["m"]) for r in rows]
    score, back = ms[0][at["enter"]], []
    for m in ms[1:]:
        reach = score[:, None] + m
        back.append(reach.argmax(axis=0))
        score = reach.max(axis=0)
    ends = [at["leave"]]
    for b in reversed(back):
        ends.append(int(b[ends[-1]]))
    ends.reverse()
    return pa.table({"_id": [r["_id"] for r in rows], "_node": [r["_node"] for r in rows], "enter": pa.array([at["enter"], *ends[:-1]], type=pa.int32()), "leave": pa.array(ends, type=pa.int32())})


def parse(parts: DataFrame, model: Hmm, id_col: str = "conv_id", part_col: str = "part", text_col: str = "text", fan: int = FAN) -> DataFrame:
    """parts(id, part, text) -> (id, part, seq, role, continues, text, rendered): the turns of each transcript, in order.

    Parts are numbered in a transcript's order, gaps allowed, and are cut between lines. seq counts a part's turns from 0;
    continues marks a turn that began in an earlier part. Null text: as empty, one empty line. Rows with a null id are one
    transcript each; a null part counts as 0. Of rows that repeat an id and part the texts are parsed in text order. An empty
    table gives an empty result. Other columns are not read.
    """
    spark = parts.sparkSession
    kind = parts.schema[id_col].dataType
    own = parts.select(F.col(id_col).alias("_key"), F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("\x00"), F.col(text_col).cast("string"), F.lit("\x00")), F.lit("\x00")).alias("_id"), F.coalesce(F.col(part_col).cast("long"), F.lit(0)).alias("_node"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    # repeats of a part become one text, in a defined order
    own = cut(own.groupBy("_id", "_node").agg(F.first("_key").alias("_key"), F.array_join(F.array_sort(F.collect_list("_text")), "\n").alias("_text")), "chat-parts")
    firsts = own.groupBy("_id").agg(F.min("_node").alias("_least"), F.max("_node").alias("_most"))
    deep = firsts.agg(F.max("_most")).first()[0] or 0
    long_ones = firsts.where("_most > _least")
    shared = spark.sparkContext.broadcast(model)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ms = [shared.value.matrix(split_lines(t), f).ravel().tolist() for t, f in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(ms, type=pa.list_(pa.float64()))], names=["_id", "_node", "_first", "m"])

    level = own.join(long_ones, "_id").select("_id", "_node", "_text", (F.col("_node") == F.col("_least")).alias("_first"))
    levels = [cut(level.mapInArrow(sums, _MATRIX), "chat-level")]
    while deep:  # ends with one node, numbered 0, for each transcript
        deep //= fan
        up = levels[-1].withColumn("_up", F.floor(F.col("_node") / fan)).groupBy("_id", "_up").applyInArrow(lambda t: _level_up(t.drop(["_up"]), fan), _MATRIX)
        levels.append(cut(up, "chat-level"))

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best = [int(_as_matrix(m)[0].argmax()) for m in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([0] * len(best), type=pa.int32()), pa.array(best, type=pa.int32())], names=["_id", "_node", "enter", "leave"])

    bounds = levels[-1].mapInArrow(top, _BOUNDS)
    for below in reversed(levels[:-1]):
        grouped = below.withColumn("_up", F.floor(F.col("_node") / fan)).groupBy("_id", "_up")
        bounds = cut(grouped.cogroup(bounds.withColumn("_up", F.col("_node")).groupBy("_id", "_up")).applyInArrow(_level_down, _BOUNDS), "chat-bounds")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {k: [] for k in ("at", "seq", "role", "continues", "text", "rendered")}
            for i, (text, first, enter, leave) in enumerate(zip(*(b.column(k).to_pylist() for k in ("_text", "_first", "enter", "leave")))):
                lines = split_lines(text)
                states = shared.value.decode(lines, first, enter or 0, leave)
                for k, (role, goes_on, said) in enumerate(turns(lines, states)):
                    for name, value in (("at", i), ("seq", k), ("role", role), ("continues", goes_on), ("text", said), ("rendered", render(role, said))):
                        out[name].append(value)
            at = pa.array(out["at"], type=pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("_key").take(at), b.column("_node").take(at), pa.array(out["seq"], type=pa.int64()), pa.array(out["role"], type=pa.string()), pa.array(out["continues"], type=pa.bool_()), pa.array(out["text"], type=pa.string()), pa.array(out["rendered"], type=pa.string())], names=["_key", "part", "seq", "role", "continues", "said", "rendered"])

    ready = own.join(bounds, ["_id", "_node"], "left").join(long_ones, "_id", "left")
    ready = ready.select("_key", "_node", "_text", F.coalesce(F.col("_node") == F.col("_least"), F.lit(True)).alias("_first"), "enter", "leave")
    schema = f"_key {kind.simpleString()}, part long, seq long, role string, continues boolean, said string, rendered string"
    return ready.mapInArrow(read, schema).toDF(id_col, "part", "seq", "role", "continues", "text", "rendered")


#: How the turns of known conversations are written down as raw transcripts: markers of the three roles, by style. `{t}` is a time.
STYLES = (
    ("System: ", "User: ", "Assistant: "),
    ("### Instruction:\n", "### Human:\n", "### AI:\n"),
    ("<|system|>\n", "<|user|>\n", "<|assistant|>\n"),
    ("**Context:** ", "**Q:** ", "**A:** "),
    ("[SYSTEM]\n", "Customer: ", "Support Agent: "),
)
#: Styles that no model is fitted on.
UNSEEN = (
    ("{t} System: ", "{t} Human: ", "{t} Bot: "),
    ("[{t}] System - ", "[{t}] User - ", "[{t}] Assistant - "),
    ("[Context] ", "[Human] ", "[AI] "),
    ("Instructions:\n", "Anna Berg: ", "Model: "),
    ("{t} <System> ", "{t} <Prompt> ", "{t} <Response> "),
)
#: Parts of turns without a number come after all others.
UNNUMBERED = 1 << 31


def _written(conversations: DataFrame, styles: tuple, part_turns: int) -> DataFrame:
    """(conv_id, _alone, part, turn, role, said): every distinct turn with its marker, in the style of its conversation."""
    known = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    once = known.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("_n"))
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(styles))) + 1
    role = F.when(F.col("role") == "system", 0).when(F.col("role") == "assistant", 2).otherwise(1)
    markers = F.array(*[F.array(*[F.lit(x) for x in s]) for s in styles])
    turn = F.coalesce("turn", F.lit(0).cast("long"))
    time = F.concat(F.lpad((F.pmod(F.floor(turn / 60), F.lit(24))).cast("string"), 2, "0"), F.lit(":"), F.lpad(F.pmod(turn, F.lit(60)).cast("string"), 2, "0"))
    said = F.concat(F.replace(F.element_at(F.element_at(markers, style.cast("int")), role + 1), F.lit("{t}"), time), F.col("text"))
    # a row without a conversation is one of its own, a turn without a number a part of its own
    alone = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text"))
    part = F.when(F.col("turn").isNull(), F.lit(UNNUMBERED) + F.pmod(F.xxhash64("role", "text"), F.lit(UNNUMBERED))).otherwise(F.greatest(F.lit(0), F.floor(turn / part_turns)))
    return once.select("conv_id", alone.alias("_alone"), F.when(F.col("conv_id").isNull(), 0).otherwise(part).cast("long").alias("part"), turn.alias("turn"), role.alias("role"), said.alias("said"))


def transcripts(conversations: DataFrame, part_turns: int = PART_TURNS, styles: tuple = STYLES) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> (conv_id, part, text): raw transcripts in one of the styles by conversation.

    A part holds `part_turns` turn numbers; turns without a number come last, a part each. Turns with the same number are ordered
    by their texts; rows that repeat another in all four columns are one turn. A row without a conv_id is a transcript of its own.
    A null text is empty, an unknown role is user.
    """
    rows = _written(conversations, styles, part_turns)
    grouped = rows.groupBy("conv_id", "_alone", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "said"))).alias("x"))
    return grouped.select("conv_id", "part", F.array_join(F.transform("x", lambda s: s["said"]), "\n").alias("text"))


def _states(role: int, said: str) -> tuple[list[int], list[tuple[int, int, int]]]:
    """The states of a known turn's lines, and what they show."""
    seen = [observe(x) for x in split_lines(said)]
    kinds = [BARE if seen[0][1] == 0 else OPEN, *[MORE] * (len(seen) - 1)]
    return [STATES.index((ROLES[role], k)) for k in kinds], seen


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (role, said, role before and the lines of that turn that tell its last state) -> (at, n): starts, moves, markers and shapes of the states."""
    n = len(STATES)
    start, move, marks, shapes = np.zeros(n), np.zeros((n, n)), np.zeros((n, len(CLASSES))), np.zeros((n, len(SHAPES)))
    for b in batches:
        for role, said, before in zip(*(c.to_pylist() for c in b.columns)):
            states, seen = _states(role, said)
            if before is None:
                start[states[0]] += 1
            else:
                move[_states(*before.values())[0][-1], states[0]] += 1
            for x, y in zip(states, states[1:]):
                move[x, y] += 1
            for st, (mark, shape, _) in zip(states, seen):
                marks[st, mark] += 1
                shapes[st, shape] += 1
    flat = np.concatenate([start, move.ravel(), marks.ravel(), shapes.ravel()])
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["at", "n"])


def fit(conversations: DataFrame, learn, max_train: int = MAX_TRAIN, styles: tuple = STYLES) -> Hmm:
    """A model from conversations for which learn (a column) is true: max_train of them at most, chosen by a hash of the id.

    All their turns count, written in the styles; tasks send sums of a hundred numbers. Moves are counted inside parts. Without any
    conversation, what a role's own names say is all that the model knows.
    """
    ids = conversations.where(learn & F.col("conv_id").isNotNull()).select("conv_id").distinct().orderBy(F.xxhash64("conv_id"), "conv_id").limit(max_train)
    rows = _written(conversations.join(F.broadcast(ids), "conv_id", "left_semi"), styles, PART_TURNS)
    w = Window.partitionBy("conv_id", "part").orderBy("turn", "said")
    # of the turn before its first line, and whether there are more
    ahead = F.concat(F.substring_index("said", "\n", 1), F.when(F.contains("said", F.lit("\n")), "\n").otherwise(""))
    known = rows.withColumn("b", F.lag(F.struct("role", ahead.alias("said"))).over(w)).select("role", "said", "b")
    sums = known.mapInArrow(_count, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(len(STATES) * (1 + len(STATES) + len(CLASSES) + len(SHAPES)))
    for r in sums:
        counts[r["at"]] = r["n"]
    return Hmm.counted(counts)
