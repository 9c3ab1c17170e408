"""Breadth-first enumeration, one persisted round for each call.

A round's stored sample forecasts where its children lie, before any is made:
children go to ranges by these boundaries in the one shuffle of states, and
what arrives sorted is merged as it is written.  Counts and the next sample
come from the files' footers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..boards import Board
from ..functions.ranks import Ranks, with_rank
from ..operators import keys as key_ops
from ..operators.routing import expand_routed, forecast, in_ranges
from ..sources.rounds import SAMPLE, Manifest, RoundStore, numbered, order_faults
from .progress import Progress


#: A round of at most so many states is sampled by their places, a larger one by its row groups.
SMALL = 4 * SAMPLE


@dataclass(frozen=True)
class Tuning:
    """States that a task expands at once; moves that a range takes at most, as forecast, and at least unless a round is small; ranges for each core."""

    rows: int = 1 << 18
    most_moves: int = 8_000_000
    least_moves: int = 200_000
    per_core: int = 3
    #: Seconds between lines on a round's progress.
    interval: float = 60.0

    def ranges(self, moves: float, cores: int) -> int:
        return int(max(1, -(-moves // self.most_moves), min(self.per_core * cores, moves // self.least_moves)))


class VerificationError(RuntimeError):
    """A round on disk differs from its manifest."""


@dataclass(frozen=True)
class RoundResult:
    source: int | None
    destination: int | None
    processed: int
    generated: int
    unique: int
    #: States that were shuffled, after repetitions in a batch were dropped, and tasks that made them.
    submitted: int = 0
    tasks: int = 0
    initialized: bool = False
    terminal: bool = False


def sample_manifest(states: DataFrame, bits: int) -> Manifest:
    """Count and ordinal sample of a round's sorted files by a scan; no state is moved."""
    n = states.count()
    stride = key_ops.ordinal_stride(n, SAMPLE)
    picked = sorted((r["ordinal"], r["state"]) for r in numbered(states).where(F.col("ordinal") % stride == 0).collect())  # at most SAMPLE rows
    return Manifest(bits, n, [state for _, state in picked], [min(stride, n - place) for place, _ in picked], stride)


class Enumerator:
    """ranked: rounds whose states all have one number of pegs and one parity class are stored as ranks in it."""

    def __init__(self, spark: SparkSession, board: Board, root: str, verify: bool = False, ranked: bool = False, tuning: Tuning | None = None, tell=None):
        self.spark, self.board, self.verify, self.ranked = spark, board, verify, ranked
        self.tuning, self.tell = tuning or Tuning(), tell
        self.store = RoundStore(spark, root)

    def run_one_round(self) -> RoundResult:
        """Make round 1, or the round after the latest; nothing if that is empty."""
        self.store.files.make_root()
        latest = self.store.latest()
        return self._initialize() if latest is None else self._advance(latest)

    def _initialize(self) -> RoundResult:
        start = self.board.canonical(self.board.start)
        self.store.write(1, self.spark.createDataFrame([(start,)], "state long"), 1)
        self.store.publish(1, Manifest(self.board.size, 1, [start], [1], 1))
        return RoundResult(None, 1, 0, 0, 1, initialized=True)

    def _domain(self, known: Manifest) -> tuple[int, int] | None:
        """Population and parities of the children, if the sampled states agree in theirs."""
        found = {(k.bit_count(), self.board.syndrome(k)) for k in known.keys}
        if not self.ranked or len(found) != 1:
            return None
        population, parity = found.pop()
        return (max(0, population - 1), parity) if population > 1 else None

    def _advance(self, source: int) -> RoundResult:
        # a malformed manifest fails here, before anything is written; a missing one is rebuilt in memory
        known = self.store.manifest(source, self.board.size) or sample_manifest(self.store.stored(source), self.board.size)
        if known.count == 0:
            return RoundResult(source, None, 0, 0, 0, terminal=True)
        states = self.store.decoded(self.store.stored(source), known)
        cores = self.spark.sparkContext.defaultParallelism
        expected = forecast(self.board, known.keys, known.weights, lambda moves: self.tuning.ranges(moves, cores))
        seen, merged = Observation(f"round {source + 1} routed"), Observation(f"round {source + 1} merged")
        routed = expand_routed(states, self.board, expected.bounds, self.tuning.rows).observe(seen, F.sum("n").alias("submitted"), F.sum("moves").alias("generated"))
        made = in_ranges(routed, len(expected.bounds) + 1).observe(merged, F.count(F.lit(1)).alias("unique"))
        domain = self._domain(known)
        ordered = made if domain is None else in_class(made, self.board, *domain)
        with Progress(self.spark, f"round {source + 1}", known.count, self.tuning.interval, self.tell):
            written = self.store.write_ranges(source + 1, ordered, int(expected.moves) // SAMPLE, domain is not None)
        manifest = self._manifest(source + 1, written, domain)
        # of a round without states nothing is observed
        unique = merged.get["unique"] if manifest.count else 0
        if manifest.count != unique:
            raise VerificationError(f"round {source + 1}: {unique} states made, {manifest.count} written")
        if self.verify:
            check_files(written, manifest)
        self.store.publish(source + 1, manifest)
        submitted, generated = (seen.get["submitted"], seen.get["generated"]) if unique else (0, 0)
        return RoundResult(source, source + 1, known.count, generated, unique, submitted, states._jdf.rdd().getNumPartitions())

    def _manifest(self, number: int, written: DataFrame, domain: tuple[int, int] | None) -> Manifest:
        """From footers; by a scan where the round is small or tasks can't open the files themselves."""
        try:
            keys, weights, stride = *self.store.summary(number, finished=False), 0
        except Exception as e:  # noqa: BLE001
            if "Unrecognized filesystem" not in str(e) and "libhdfs" not in str(e):
                raise
            found = sample_manifest(written, 63)
            keys, weights, stride = found.keys, found.weights, found.stride
        if sum(weights) <= SMALL and not stride:
            every = sorted(r["state"] for r in written.collect())  # at most SMALL
            stride = key_ops.ordinal_stride(len(every), SAMPLE)
            keys, weights = every[::stride], [min(stride, len(every) - k) for k in range(0, len(every), stride)]
        if domain is not None:
            population, parity = (np.full(len(keys), d) for d in domain)
            keys = Ranks.of(self.board).unrank(population, parity, np.array(keys, np.int64)).tolist()
        return Manifest(self.board.size, sum(weights), keys, weights, stride, *(domain or (None, None)))


def in_class(states: DataFrame, board: Board, population: int, parity: int) -> DataFrame:
    """(state): the rank of each state in its class, in the order of the states; one of another class is an error."""
    ranked = with_rank(states, Ranks.of(board))
    own = (F.col("population") == population) & (F.col("parity") == parity)
    return ranked.select(F.when(own, F.col("rank")).otherwise(F.raise_error(F.lit("a state is of another class")).cast("long")).alias("state"))


def check_files(states: DataFrame, manifest: Manifest) -> None:
    """A whole scan of a round's files in order must give ascending distinct keys, as many as the manifest says."""
    n, faults = order_faults(states)
    if n != manifest.count:
        raise VerificationError(f"{n} states, the manifest has {manifest.count}")
    if faults:
        raise VerificationError(f"{faults} states aren't above the ones before them")


def check_round(states: DataFrame, manifest: Manifest) -> None:
    """States in any order must be distinct and as many as the manifest says."""
    keys = states.select(F.col("state").alias("key"))
    n = keys.count()
    if n != manifest.count:
        raise VerificationError(f"{n} states, the manifest has {manifest.count}")
    if keys.distinct().count() != n:
        raise VerificationError("a state is there twice")


def round_counts(store: RoundStore) -> list[tuple[int, int]]:
    """(round, states) by a scan of every finished round."""
    numbers = store.completed()
    if not numbers:
        return []
    parts = [store.stored(n).select(F.lit(n).alias("round")) for n in numbers]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    found = {r["round"]: r["n"] for r in whole.groupBy("round").agg(F.count(F.lit(1)).alias("n")).collect()}
    return [(n, found.get(n, 0)) for n in numbers]


def frontier(spark: SparkSession, board: Board, rounds: int, root: str) -> list[RoundResult]:
    """The first ``rounds`` rounds, or as many as there are."""
    enumerator = Enumerator(spark, board, root)
    out = []
    while len(out) < rounds:
        out.append(enumerator.run_one_round())
        if out[-1].terminal:
            break
    return out
