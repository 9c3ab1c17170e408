"""Hard negatives of anchors by coordinate pruning in buckets of like length.

Vectors become whole numbers and all scores are exact inner products of these.
For each anchor the nearest rows of its own label are its positives; a hard
negative of an anchor and a positive is a row of another label whose score
lies in a band below the positive's.

Rows are dealt to blocks by label and by class of length, larger classes by a
hash too, so no block grows with the data.  Anchors go to those blocks only in
which a row can reach what they need, by Cauchy and Schwarz.  In a block, rows
lie in buckets of like length, and each bucket keeps the list of its rows in
order of each coordinate of their directions.  A row whose angle to the anchor
is at most t has its angles to the axes within t of the anchor's: so for the
anchor's largest (focus) coordinates the lists are cut to the feasible ranges
of values, the ranges' rows are intersected, and what is left is scored.  What
an anchor needs rises as rows are found; it starts with what a bounded sample
of rows, scored in full, already offers.  Pruning only ever leaves out rows
that can't be in the result.

Defined cases: rows with a null id, label or vector, or with any component
that is null or not finite take no part; rows that repeat an id count once
(the smallest by label, then vector); vectors are compared with those of their
own length only; scores that don't fit in 64 bits count as the nearest BIGINT;
anchors without positives, or positives without
negatives, give no rows; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import Scratch

SCALE = 256
#: Rows, and anchors, in a block on average.
ROWS_PER_BLOCK = 4096
ANCHORS_PER_BLOCK = 2048
#: Rows of a bucket, at most, and the ratio of its longest to its shortest.
BUCKET = 2048
RATIO = 1.1
#: Classes of length grow by this factor.
CLASS = 1.25
#: Coordinates of an anchor whose lists are cut.
FOCUS = 4
#: Rows, about, that are scored in full for first thresholds: those smallest by a hash.
SAMPLE = 2048
#: Rows of a table that may be broadcast.
BROADCAST_ROWS = 100_000
#: Whole numbers up to here are exact as doubles.
EXACT = float(1 << 53)
LONGEST = (1 << 63) - 1


def prepared(vectors: DataFrame) -> DataFrame:
    """id, label, vec (whole numbers as doubles), dim, norm of the rows that take part, once each."""
    scaled = F.transform("embedding", lambda v: v.cast("double") * SCALE)
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), scaled.alias("vec"))
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & finite)
    # from 2 ** 53 on doubles are whole already, and floor() of them may not fit
    whole = F.transform("vec", lambda v: F.when(F.abs(v) < EXACT, F.floor(F.when(F.abs(v) < EXACT, v)).cast("double")).otherwise(v))
    rows = rows.select("id", F.struct("label", whole.alias("vec")).alias("row")).groupBy("id").agg(F.min("row").alias("row"))
    squares = F.aggregate("row.vec", F.lit(0.0), lambda a, v: a + v * v)
    return rows.select("id", "row.label", "row.vec", F.size("row.vec").alias("dim"), F.sqrt(squares).alias("norm"))


def _matrix(column) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return array.flatten().to_numpy(zero_copy_only=False).reshape(len(array), -1) if len(array) else np.zeros((0, 0))


def scores(rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit numbers: by doubles where all partial sums are exact, else by Python's whole numbers."""
    if not rows.size or np.abs(rows).max() * np.abs(anchor).max() * len(anchor) < EXACT:
        return (rows @ anchor).astype(np.int64)
    whole = [int(v) for v in anchor.tolist()]
    sums = (sum(int(v) * w for v, w in zip(r, whole, strict=True)) for r in rows.tolist())
    return np.array([max(-LONGEST - 1, min(LONGEST, v)) for v in sums], np.int64)


@dataclass
class Bucket:
    """Rows of like length, and for each coordinate their order by it."""

    at: np.ndarray
    rows: np.ndarray
    norms: np.ndarray
    lists: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def by(self, c: int) -> tuple[np.ndarray, np.ndarray]:
        if c not in self.lists:
            values = self.rows[:, c] / self.norms
            order = np.argsort(values, kind="stable")
            self.lists[c] = values[order], order
        return self.lists[c]

    def candidates(self, anchor: np.ndarray, norm: float, focus: np.ndarray, least: int) -> np.ndarray | None:
        """Places in the bucket of all rows whose score may be ``least`` or more; None: all."""
        longest = float(self.norms[0]) * norm
        if least <= 0 or not np.isfinite(longest):
            return None
        if least > longest * (1 + 1e-9):
            return np.empty(0, np.int64)
        # angles of rows to the anchor; a little wider than due, for rounding
        near = np.arccos(min(1.0, least / longest)) + 1e-7
        met = np.zeros(len(self.rows), np.int8)
        for c in focus:
            values, order = self.by(int(c))
            angle = np.arccos(max(-1.0, min(1.0, anchor[c] / norm)))
            first = np.searchsorted(values, np.cos(min(np.pi, angle + near)) - 1e-9, "left")
            last = np.searchsorted(values, np.cos(max(0.0, angle - near)) + 1e-9, "right")
            met[order[first:last]] += 1
        return np.flatnonzero(met == len(focus))


def buckets(rows: np.ndarray, norms: np.ndarray) -> list[Bucket]:
    """Rows by falling length, in buckets of bounded size and ratio."""
    order = np.argsort(-norms, kind="stable")
    out, start = [], 0
    while start < len(order):
        alike = int(np.searchsorted(-norms[order], -norms[order[start]] / RATIO, "right"))
        stop = max(start + 1, min(alike, start + BUCKET))
        part = order[start:stop]
        out.append(Bucket(part, rows[part], norms[part]))
        start = stop
    return out


class Wanted:
    """What an anchor looks for: for each goal the ``most`` best rows with scores from low to high."""

    def __init__(self, low: list[int], high: list[int], floor: list[int | None], most: int):
        self.low, self.high, self.most = low, high, most
        #: scores below these can't be among the best
        self.floor = [lo if f is None else max(lo, f) for lo, f in zip(low, floor, strict=True)]
        self.kept = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in low]

    def least(self) -> int:
        reached = [int(found[-1]) if len(found) == self.most else f for f, (_, found) in zip(self.floor, self.kept, strict=True)]
        return min(max(f, r) for f, r in zip(self.floor, reached, strict=True))

    def offer(self, ids: np.ndarray, found: np.ndarray) -> None:
        for k, (ids_before, before) in enumerate(self.kept):
            fit = (found >= self.floor[k]) & (found <= self.high[k])
            if fit.any():
                i, s = np.concatenate((ids_before, ids[fit])), np.concatenate((before, found[fit]))
                # bitwise complement: falling order without overflow
                order = np.lexsort((i, ~s))[: self.most]
                self.kept[k] = i[order], s[order]


def search(made: list[Bucket], ids: np.ndarray, anchor_id: int, anchor: np.ndarray, norm: float, wanted: Wanted) -> None:
    focus = np.argsort(-np.abs(anchor), kind="stable")[:FOCUS]
    for bucket in made:
        near = bucket.candidates(anchor, norm, focus, wanted.least())
        at, rows = (bucket.at, bucket.rows) if near is None else (bucket.at[near], bucket.rows[near])
        if len(at):
            other = ids[at] != anchor_id
            wanted.offer(ids[at][other], scores(rows[other], anchor))


def band(score: int, low: int, high: int) -> tuple[int, int]:
    """First and last whole number n with low * score <= 100 * n <= high * score."""
    return -(-low * score // 100), high * score // 100


@dataclass(frozen=True)
class Bands:
    """Percent of a positive's score between which negatives lie."""

    low: int
    high: int

    def of(self, goals: list[dict]) -> tuple[list[int], list[int]]:
        pairs = [band(g["score"], self.low, self.high) for g in goals]
        return [lo for lo, _ in pairs], [hi for _, hi in pairs]


_GOALS = "array<struct<id: bigint, score: bigint, floor: bigint>>"
_FOUND = {"anchor_id": pa.int64(), "goal_id": pa.int64(), "goal_score": pa.int64(), "id": pa.int64(), "score": pa.int64()}


def _block(bands: Bands | None, most: int):
    """Anchors (anchor_id, vec, norm, goals) searched in the rows (id, vec, norm) of a block; without bands any score will do."""

    def run(data: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if data.num_rows and asked.num_rows:
            ids, made = data.column("id").to_numpy(), buckets(_matrix(data.column("vec")), data.column("norm").to_numpy())
            vectors = _matrix(asked.column("vec"))
            for k, (a, norm, goals) in enumerate(zip(*(asked.column(c).to_pylist() for c in ("anchor_id", "norm", "goals")), strict=True)):
                low, high = bands.of(goals) if bands else ([-LONGEST - 1], [LONGEST])
                wanted = Wanted(low, high, [g["floor"] for g in goals], most)
                search(made, ids, a, vectors[k], norm, wanted)
                for g, (near, found) in zip(goals, wanted.kept, strict=True):
                    out += [(a, g["id"], g["score"], i, s) for i, s in zip(near.tolist(), found.tolist(), strict=True)]
        return pa.table({name: pa.array([r[k] for r in out], kind) for k, (name, kind) in enumerate(_FOUND.items())})

    return run


def _first_floors(asked: DataFrame, sample: pa.Table, bands: Bands | None, most: int) -> DataFrame:
    """``asked`` with the score, in each goal's floor, that rows of the sample reach ``most`` times; least: the smallest that matters, or null."""
    dims = sample.column("dim").to_numpy()
    parts = {int(d): sample.filter(pa.array(dims == d)) for d in np.unique(dims)}
    held = {d: (t.column("id").to_numpy(), t.column("label").to_numpy(), _matrix(t.column("vec"))) for d, t in parts.items()}
    sent = asked.sparkSession.sparkContext.broadcast(held)  # about SAMPLE rows

    def floor(found: np.ndarray) -> int | None:
        return int(np.partition(found, len(found) - most)[len(found) - most]) if len(found) >= most else None

    def of(anchor: dict) -> tuple[list[dict], float | None]:
        goals = anchor["goals"]
        low, high = bands.of(goals) if bands else ([-LONGEST - 1], [LONGEST])
        floors: list[int | None] = [None] * len(goals)
        if anchor["dim"] in sent.value:
            ids, labels, rows = sent.value[anchor["dim"]]
            fit = (ids != anchor["anchor_id"]) & ((labels == anchor["label"]) == (bands is None))
            found = scores(rows[fit], np.array(anchor["vec"], float))
            floors = [floor(found[(found >= lo) & (found <= hi)]) for lo, hi in zip(low, high, strict=True)]
        needed = [lo if f is None else f for lo, f in zip(low, floors, strict=True)]
        return [g | {"floor": f} for g, f in zip(goals, floors, strict=True)], float(min(needed))

    def run(batches):
        for batch in batches:
            made = [of(anchor) for anchor in batch.select(["anchor_id", "label", "dim", "vec", "goals"]).to_pylist()]
            goals = pa.array([g for g, _ in made], batch.schema.field("goals").type)
            columns = {n: batch.column(n) for n in ("anchor_id", "label", "dim", "vec", "norm", "part")}
            yield pa.RecordBatch.from_pydict(columns | {"goals": goals, "least": pa.array([x for _, x in made], pa.float64())})

    return asked.mapInArrow(run, f"anchor_id long, label long, dim int, vec array<double>, norm double, part int, goals {_GOALS}, least double")


def _few(df: DataFrame) -> DataFrame:
    """Hint to broadcast a stored table that was counted to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _searched(rows: DataFrame, classes: DataFrame, asked: DataFrame, own: bool, run, scratch: Scratch) -> DataFrame:
    """Anchors with the blocks of rows, of their own label or of the others, that can hold what they need."""
    sides = classes.select(F.col("dim").alias("d"), F.col("label").alias("row_label"), "kind", "blocks", "longest")
    labels = F.col("label") == F.col("row_label") if own else F.col("label") != F.col("row_label")
    reach = (F.col("least") <= 0) | (F.col("norm") * F.col("longest") * (1 + 1e-9) >= F.col("least"))
    met = asked.join(_few(sides), (F.col("dim") == F.col("d")) & labels & reach)
    met = met.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = scratch.keep(met.select("anchor_id", "dim", "row_label", "kind", "block", "part", "vec", "norm", "goals"), f"met-{own}")
    keys = ["dim", "row_label", "kind", "block"]
    pairs = scratch.keep(met.select(*keys, "part").distinct(), f"pairs-{own}")
    data = rows.withColumnsRenamed({"label": "row_label"}).join(_few(pairs), keys).select(*keys, "part", "id", "vec", "norm")
    schema = ", ".join(f"{name} long" for name in _FOUND)
    return data.groupBy(*keys, "part").cogroup(met.groupBy(*keys, "part")).applyInArrow(lambda a, b: run(a, b), schema)


def _first(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The ``most`` best of each group; a block gives no more than that of each."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def hard_negatives(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``every``; a positive's
    negatives score from ``low`` to ``high`` percent of what it scores.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "negatives")
    rows = scratch.keep(prepared(vectors), "prepared")
    total = rows.count()
    kind = F.when((F.col("norm") > 0) & (F.col("norm") < float("inf")), F.floor(F.log("norm") / F.lit(float(np.log(CLASS)))).cast("int")).otherwise(-1)
    blocks = F.ceil(F.count(F.lit(1)) / ROWS_PER_BLOCK).cast("int")
    rows = rows.withColumn("kind", kind)
    classes = scratch.keep(rows.groupBy("dim", "label", "kind").agg(blocks.alias("blocks"), F.max("norm").alias("longest")), "classes")
    dealt = rows.join(_few(classes.drop("longest")), ["dim", "label", "kind"])
    dealt = scratch.keep(dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks"), "dealt")
    slot = F.pmod(F.xxhash64(F.lit(29), "id"), F.lit(1 << 40))
    sample = rows.where(slot < int((1 << 40) * min(1.0, SAMPLE / max(1, total)))).select("id", "label", "dim", "vec").limit(2 * SAMPLE).toArrow()

    chosen = rows.where(F.col("id") % every == 0)
    parts = -(-max(1, chosen.count()) // ANCHORS_PER_BLOCK)
    part = F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(parts)).cast("int")
    asked = chosen.select(F.col("id").alias("anchor_id"), "label", "dim", "vec", "norm", part.alias("part"))
    any_score = F.array(F.struct(F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("score"), F.lit(None).cast("long").alias("floor")))
    first = scratch.keep(_first_floors(asked.withColumn("goals", any_score), sample, None, positives), "asked")
    found = _searched(dealt, classes, first, True, _block(None, positives), scratch)
    near = scratch.keep(_first(found, ["anchor_id"], positives).select("anchor_id", "id", "score"), "positives")

    goal = F.struct("id", "score", F.lit(None).cast("long").alias("floor"))
    # at most ``positives`` of each anchor
    goals = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(goal)).alias("goals"))
    bands = Bands(low, high)
    second = scratch.keep(_first_floors(asked.join(goals, "anchor_id"), sample, bands, negatives), "goals")
    found = _searched(dealt, classes, second, False, _block(bands, negatives), scratch)
    best = _first(found, ["anchor_id", "goal_id"], negatives)
    return best.select("anchor_id", F.col("goal_id").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("goal_score").alias("positive_score"), F.col("score").alias("negative_score"))


def relabelled(vec_id: Column, label: Column) -> Column:
    """The label, one further modulo ten where the id is divisible by seven."""
    return F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
