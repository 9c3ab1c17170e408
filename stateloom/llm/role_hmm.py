"""Chat formatting: roles of transcript lines by a hidden Markov model.

A transcript is plain text in which some lines start with a speaker marker
("User:", "### Assistant", "<|system|>" ...) and others don't.  Hidden states
are a role and whether a line opens a turn or goes on with it; a line is seen
through its marker and a few features of its form.  Transition and emission
counts come from labelled transcripts, and Viterbi's path gives the roles.
Turns are then written in one canonical form.

Conversations fall into two halves by a hash.  Each half is decoded with the
counts of the other, so no conversation is decoded by what was counted on it.
Counts are made in tasks over all conversations and only their sums are
collected.

A transcript may be long, so it is cut into segments of lines.  Each segment
is reduced to the best scores from each of its first to each of its last
states; chaining these small tables over a transcript fixes the states at the
segments' borders, and segments are then decoded on their own.  The path is
that of the whole transcript.

Defined cases: a null text is an empty line; turns of a null role, or of one
other than system, user and assistant, are written without a marker, are left
out of fitting and get the role that the path gives them; without any
conversation in the other half markers alone tell; rows that repeat a turn number follow each other in order of role and
text; a null conversation id is a conversation; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import Scratch

ROLES = ("system", "user", "assistant")
#: Turns whose lines make a segment.
SEGMENT_TURNS = 64

# fixed values: speaker names as transcripts write them
NAMES = {
    "system": ("system", "sys", "instructions", "system prompt"),
    "user": ("user", "human", "you", "question", "q", "customer", "me"),
    "assistant": ("assistant", "ai", "bot", "model", "gpt", "answer", "a", "agent"),
}
_ROLE_OF_NAME = {name: role for role, names in NAMES.items() for name in names}
_NAME = "|".join(sorted(map(re.escape, _ROLE_OF_NAME), key=len, reverse=True))
_MARKER = re.compile(rf"\s*(?:(?:<\|(?:im_start\|>)?)\s*({_NAME})\s*(?:\|>)?|#+\s*({_NAME})\s*:?|\[({_NAME})\]\s*:?|\**({_NAME})\**\s*[:>])\s*", re.I)
_ANY_MARKER = re.compile(r"\s*(?:<\|[^|>]{1,20}\|>|#{1,6}\s|\[[^\]]{1,20}\]|[A-Z][\w ]{0,18}:)")

#: Symbols of a line: (marker, length, asks, after a blank line) as one number.
MARKERS = len(ROLES) + 2
LENGTHS = 4
SYMBOLS = MARKERS * LENGTHS * 2 * 2
STATES = 2 * len(ROLES)


def marker_of(line: str) -> tuple[int, int]:
    """Role number of the marker (3: a marker of unknown name, 4: none) and where the text after it starts."""
    found = _MARKER.match(line)
    if found:
        name = next(g for g in found.groups() if g).lower()
        return ROLES.index(_ROLE_OF_NAME[name]), found.end()
    return (3, 0) if _ANY_MARKER.match(line) else (4, 0)


def symbols_of(lines: list[str], after_blank: bool) -> np.ndarray:
    out = np.empty(len(lines), np.int64)
    for i, line in enumerate(lines):
        marker, at = marker_of(line)
        text = line[at:].strip()
        n = len(text.split())
        length = 0 if n == 0 else 1 if n < 8 else 2 if n < 40 else 3
        asks = text.endswith("?")
        out[i] = ((marker * LENGTHS + length) * 2 + asks) * 2 + after_blank
        after_blank = not line.strip()
    return out


@dataclass
class Model:
    """Log probabilities; state 2r opens a turn of role r, state 2r + 1 goes on with it."""

    first: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # (STATES, SYMBOLS)


class Counts:
    """First states, transitions and symbols seen in labelled transcripts."""

    def __init__(self):
        self.first, self.move, self.emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, SYMBOLS))

    def add(self, turns: list[tuple[str | None, list[str]]], starts: bool = True, blank: bool = True) -> None:
        """Count (role, lines) turns of a transcript, or of a later segment of one."""
        last = None
        for role, lines in turns:
            if role not in ROLES or not lines:
                last, starts = None, False
                continue
            symbols = symbols_of(lines, blank)
            blank = not lines[-1].strip()
            for i, symbol in enumerate(symbols.tolist()):
                state = 2 * ROLES.index(role) + (i > 0)
                self.emit[state, symbol] += 1
                if last is not None:
                    self.move[last, state] += 1
                elif starts:
                    self.first[state] += 1
                last = state

    def flat(self) -> np.ndarray:
        return np.concatenate([self.first, self.move.ravel(), self.emit.ravel()])

    @staticmethod
    def of(flat: np.ndarray) -> Counts:
        out = Counts()
        a, b = STATES, STATES + STATES * STATES
        out.first, out.move, out.emit = flat[:a].copy(), flat[a:b].reshape(STATES, STATES).copy(), flat[b:].reshape(STATES, SYMBOLS).copy()
        return out


def fit(conversations: list[list[tuple[str, list[str]]]]) -> Model:
    """The model of labelled transcripts of (role, lines) turns."""
    counts = Counts()
    for turns in conversations:
        counts.add(turns)
    return model_of(counts)


def model_of(counts: Counts) -> Model:
    """Log shares of the counts and of what is added to each."""
    first, move, emit = 1 + counts.first, 0.5 + counts.move, 0.005 + counts.emit
    # a prior of the marker alone keeps markers telling in small samples
    for s in range(STATES):
        for symbol in range(SYMBOLS):
            marker = symbol // (LENGTHS * 4)
            emit[s, symbol] += (0.5 if marker == s // 2 else 0.0) if s % 2 == 0 else 0.2 if marker == 4 else 0.0
    first[1::2] = 1e-6
    # a turn goes on only with its own role
    for a in range(STATES):
        for b in range(1, STATES, 2):
            if a // 2 != b // 2:
                move[a, b] = 1e-9
    return Model(np.log(first / first.sum()), np.log(move / move.sum(1, keepdims=True)), np.log(emit / emit.sum(1, keepdims=True)))


def segment_table(model: Model, symbols: np.ndarray) -> np.ndarray:
    """Best score from each state at the segment's first line to each at its last; emissions included."""
    table = np.full((STATES, STATES), -np.inf)
    np.fill_diagonal(table, model.emit[:, symbols[0]])
    for s in symbols[1:].tolist():
        table = (table[:, :, None] + model.move[None]).max(1) + model.emit[:, s]
    return table


def borders(model: Model, tables: list[np.ndarray]) -> list[tuple[int, int]]:
    """States at the first and last line of each segment on the best path over all of them."""
    scores, entered = [], []
    before = None
    for t in tables:
        if before is None:
            entry, came = model.first, np.zeros(STATES, np.int64)
        else:
            reach = before[:, None] + model.move
            entry, came = reach.max(0), reach.argmax(0)
        whole = entry[:, None] + t
        before = whole.max(0)
        scores.append(whole)
        entered.append(came)
    out = []
    last = int(before.argmax())
    for whole, came in zip(scores[::-1], entered[::-1], strict=True):
        start = int(whole[:, last].argmax())
        out.append((start, last))
        last = int(came[start])
    return out[::-1]


def path(model: Model, symbols: np.ndarray, start: int, stop: int) -> list[int]:
    """Viterbi's path between fixed first and last states."""
    score = np.full(STATES, -np.inf)
    score[start] = model.emit[start, symbols[0]]
    back = []
    for s in symbols[1:].tolist():
        reach = score[:, None] + model.move
        back.append(reach.argmax(0))
        score = reach.max(0) + model.emit[:, s]
    out = [stop]
    for b in back[::-1]:
        out.append(int(b[out[-1]]))
    return out[::-1]


def viterbi(model: Model, symbols: np.ndarray) -> list[int]:
    """The best path of a whole transcript."""
    score, back = model.first + model.emit[:, symbols[0]], []
    for s in symbols[1:].tolist():
        reach = score[:, None] + model.move
        back.append(reach.argmax(0))
        score = reach.max(0) + model.emit[:, s]
    out = [int(score.argmax())]
    for b in back[::-1]:
        out.append(int(b[out[-1]]))
    return out[::-1]


def render(role: str, text: str) -> str:
    """The canonical form of a turn."""
    return f"<|{role}|>\n{text}\n<|end|>"


def _segments(transcripts: DataFrame, models: list[Model], scratch: Scratch) -> DataFrame:
    """Decode transcripts (conv_id, segment, after_blank, text, model) into turns; model is a place in ``models``.

    Only transcripts of several segments are chained; the others are decoded where they are read.
    """
    sent = transcripts.sparkSession.sparkContext.broadcast(models)
    lines_of = lambda text: (text or "").split("\n")

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [segment_table(sent.value[m], symbols_of(lines_of(t), b)).ravel() for b, t, m in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(4), pa.array([m.tolist() for m in made], pa.list_(pa.float64()))], names=["conv_id", "segment", "model", "best"])

    def chain(key, rows):
        rows = rows.sort_values("segment")
        found = borders(sent.value[int(rows["model"].iloc[0])], [np.array(t).reshape(STATES, STATES) for t in rows["best"]])
        rows["start"], rows["stop"] = [f[0] for f in found], [f[1] for f in found]
        return rows[["conv_id", "segment", "start", "stop"]]

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for conv, segment, blank, text, m, start, stop in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                lines = lines_of(text)
                model, symbols = sent.value[m], symbols_of(lines, blank)
                states = viterbi(model, symbols) if start is None else path(model, symbols, start, stop)
                opened, held, role = 0, [], states[0] // 2

                def close() -> None:
                    if held:
                        rows.append((conv, segment, opened, ROLES[role], "\n".join(held), len(held)))
                        held.clear()

                for line, state in zip(lines, states, strict=True):
                    if state % 2 == 0:
                        close()
                        opened, role = opened + 1, state // 2
                        line = line[marker_of(line)[1] :]
                    held.append(line)
                close()
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["conv_id", "segment", "opened", "role", "text", "n_lines"])

    several = transcripts.groupBy(F.col("conv_id").alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    long = transcripts.join(several, F.col("conv_id").eqNullSafe(F.col("k")), "left_semi")
    best = long.mapInArrow(tables, "conv_id long, segment long, model int, best array<double>")
    fixed = best.groupBy("conv_id").applyInPandas(chain, "conv_id long, segment long, start int, stop int")
    fixed = scratch.keep(fixed.withColumnsRenamed({"conv_id": "c", "segment": "s"}), "borders")
    joined = transcripts.join(fixed, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("segment") == F.col("s")), "left").select("conv_id", "segment", "after_blank", "text", "model", "start", "stop")
    pieces = scratch.keep(joined.mapInArrow(turns, "conv_id long, segment long, opened long, role string, text string, n_lines long"), "pieces")
    # turns are numbered over segments; a piece before a segment's first opening belongs to the turn before
    opened = pieces.groupBy("conv_id", "segment").agg(F.max("opened").alias("n"))
    order = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    opened = opened.withColumn("base", F.coalesce(F.sum("n").over(order), F.lit(0))).select(F.col("conv_id").alias("c"), F.col("segment").alias("s"), "base")
    numbered = pieces.join(opened, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("segment") == F.col("s"))).withColumn("turn_no", F.col("base") + F.col("opened") - 1)
    parts = F.array_sort(F.collect_list(F.struct("segment", "opened", "role", "text", "n_lines")))
    whole = numbered.groupBy("conv_id", "turn_no").agg(parts.alias("p"))
    text = F.trim(F.array_join(F.col("p.text"), "\n"), F.lit(" \n\r\t"))
    whole = whole.select("conv_id", "turn_no", F.element_at("p.role", 1).alias("role"), text.alias("text"), F.aggregate("p.n_lines", F.lit(0).cast("long"), lambda a, b: a + b).alias("n_lines"))
    return whole.withColumn("rendered", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>")))


def _style(turn, role, text, conv):
    """A turn as a transcript writes it: six marker styles, and none for one turn in eight after the first."""
    name = lambda s, u, a: F.when(role == "system", s).when(role == "user", u).otherwise(a)
    style = F.pmod(F.xxhash64(conv), F.lit(6))
    marker = (
        F.when(style == 0, F.concat(name("System", "User", "Assistant"), F.lit(": ")))
        .when(style == 1, F.concat(F.lit("### "), name("System", "Human", "Assistant"), F.lit(":\n")))
        .when(style == 2, F.concat(F.lit("<|"), name("system", "user", "assistant"), F.lit("|>\n")))
        .when(style == 3, name("Instructions: ", "Q: ", "A: "))
        .when(style == 4, F.concat(F.lit("**"), name("System", "You", "AI"), F.lit("**: ")))
        .otherwise(F.concat(F.lit("["), name("system", "customer", "agent"), F.lit("] ")))
    )
    bare = (turn > 0) & (F.pmod(F.xxhash64(F.lit("bare"), conv, turn), F.lit(8)) == 0) | ~F.coalesce(role.isin(*ROLES), F.lit(False))
    return F.concat(F.when(bare, F.lit("")).otherwise(marker), text, F.when(style < 3, F.lit("\n")).otherwise(F.lit("")))


def as_transcripts(conversations: DataFrame) -> DataFrame:
    """conv_id, segment, after_blank, text and labels of the raw transcripts of (conv_id, turn, role, text) rows."""
    role, text = F.col("role"), F.coalesce("text", F.lit(""))
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(0))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("shown", _style(F.col("turn"), F.col("role"), F.col("text"), F.coalesce("conv_id", F.lit(-1))))
    segment = F.floor(F.col("turn") / SEGMENT_TURNS).cast("long")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text", "shown")))
    made = rows.groupBy("conv_id", segment.alias("segment")).agg(turns.alias("turns"))
    blank = (F.col("segment") == 0) | (F.pmod(F.xxhash64(F.coalesce("conv_id", F.lit(-1))), F.lit(6)) < 3)
    return made.select("conv_id", "segment", blank.alias("after_blank"), F.array_join("turns.shown", "\n").alias("text"), F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["shown"].alias("shown"))).alias("labels"))


def _half():
    return F.pmod(F.xxhash64(F.lit("half"), F.coalesce("conv_id", F.lit(-1))), F.lit(2)).cast("int")


def _count(transcripts: DataFrame) -> list[Counts]:
    """What each half of the conversations holds, over all their labels."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [Counts(), Counts()]
        for batch in batches:
            for half, segment, blank, labels in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                seen[half].add([(t["role"], t["shown"].split("\n")) for t in labels], segment == 0, blank)
        for half, counts in enumerate(seen):
            flat = counts.flat()
            (places,) = np.nonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array([half] * len(places), pa.int32()), pa.array(places, pa.int64()), pa.array(flat[places])], names=["half", "place", "n"])

    rows = transcripts.select(_half().alias("half"), "segment", "after_blank", "labels")
    sums = rows.mapInArrow(run, "half int, place long, n double").groupBy("half", "place").agg(F.sum("n").alias("n")).collect()  # at most a row for each count
    out = [np.zeros(STATES + STATES * STATES + STATES * SYMBOLS) for _ in range(2)]
    for r in sums:
        out[r["half"]][r["place"]] = r["n"]
    return [Counts.of(flat) for flat in out]


def fit_halves(transcripts: DataFrame) -> list[Model]:
    """The model of each half of the conversations (conv_id, segment, after_blank, labels)."""
    return [model_of(counts) for counts in _count(transcripts)]


def fit_on(transcripts: DataFrame) -> Model:
    """The model of all conversations."""
    one, other = _count(transcripts)
    return model_of(Counts.of(one.flat() + other.flat()))


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, turn_no, role, text, n_lines, rendered: the turns recovered from the conversations' raw transcripts."""
    scratch = Scratch(conversations.sparkSession, "role-hmm")
    transcripts = scratch.keep(as_transcripts(conversations), "transcripts")
    models = fit_halves(transcripts)
    return _segments(transcripts.select("conv_id", "segment", "after_blank", "text", (1 - _half()).alias("model")), models, scratch)


def parse_transcripts(transcripts: DataFrame, model: Model, lines_per_segment: int = 512) -> DataFrame:
    """The turns of transcripts (conv_id, text) under a fitted model."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    cuts = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / lines_per_segment)), lambda i: F.slice(lines, (i * lines_per_segment + 1).cast("int"), lines_per_segment))
    rows = transcripts.select(F.col("conv_id").cast("long").alias("conv_id"), F.posexplode(cuts).alias("segment", "lines"), cuts.alias("cuts"))
    blank = (F.col("segment") == 0) | (F.trim(F.element_at(F.element_at("cuts", F.greatest(F.lit(1), F.col("segment"))), -1)) == "")
    scratch = Scratch(transcripts.sparkSession, "role-hmm")
    rows = rows.select("conv_id", F.col("segment").cast("long").alias("segment"), blank.alias("after_blank"), F.array_join("lines", "\n").alias("text"), F.lit(0).alias("model"))
    return _segments(scratch.keep(rows, "transcripts"), [model], scratch)
