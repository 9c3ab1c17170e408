"""Commands: ``count`` makes the next round of a board, ``stats`` counts the states of all rounds.

    python -m stateloom.cli count -b cross33 -d DIR [-w WORKERS] [-q QUEUE] [--verify-ready]
                                 [--ranked] [--rows ROWS] [--interval SECONDS]
    python -m stateloom.cli stats -d DIR
"""

from __future__ import annotations

import argparse
import sys
import time
from dataclasses import dataclass

from .boards import BOARDS, Board, board


class UsageError(Exception):
    pass


@dataclass(frozen=True)
class Configuration:
    action: str
    board: Board
    directory: str
    workers: int
    queue: int
    verify: bool
    #: Store rounds as ranks; states that a task expands at once; seconds between lines on progress.
    ranked: bool = False
    rows: int = 1 << 18
    interval: int = 60


class _Parser(argparse.ArgumentParser):
    def error(self, message: str) -> None:
        raise UsageError(message)


def _between(low: int, high: int):
    def of(text: str) -> int:
        value = int(text)
        if not low <= value <= high:
            raise ValueError(text)
        return value

    of.__name__ = f"number from {low} to {high}"
    return of


def parse(arguments: list[str]) -> Configuration | None:
    """The configuration, or None if help is asked for anywhere."""
    if not arguments or {"-h", "--help", "help"} & set(arguments):
        return None
    parser = _Parser(prog="stateloom", add_help=False)
    actions = parser.add_subparsers(dest="action", required=True, parser_class=_Parser)
    count, stats = actions.add_parser("count", add_help=False), actions.add_parser("stats", add_help=False)
    for p in (count, stats):
        p.add_argument("-b", "--board", default="cross33")
        p.add_argument("-d", "--directory", required=True)
    count.add_argument("-w", "--workers", type=_between(1, 256), default=8)
    count.add_argument("-q", "--queue", type=_between(1, 1_000_000), default=32)
    count.add_argument("--verify-ready", action="store_true")
    count.add_argument("--ranked", action="store_true")
    count.add_argument("--rows", type=_between(1, 1 << 24), default=1 << 18)
    count.add_argument("--interval", type=_between(1, 86_400), default=60)
    found = parser.parse_args(arguments)
    try:
        chosen = board(found.board)
    except ValueError as e:
        raise UsageError(str(e)) from e
    if not found.directory.strip():
        raise UsageError("an empty directory")
    if found.action == "stats":
        return Configuration("stats", chosen, found.directory, 8, 32, False)
    return Configuration("count", chosen, found.directory, found.workers, found.queue, found.verify_ready, found.ranked, found.rows, found.interval)


def stats_table(rows: list[tuple[int, int]]) -> str:
    line = "%-18s %20s"
    out = [line % ("Round", "States"), "-" * 39, *(line % (f"{n}", f"{count:,}") for n, count in rows), "-" * 39, line % ("Total", f"{sum(c for _, c in rows):,}")]
    return "\n".join(out)


def run(arguments: list[str], spark=None, out=sys.stdout) -> int:
    """Exit code: 0 done, 1 failed, 2 wrong arguments (before anything is touched)."""
    try:
        config = parse(arguments)
    except UsageError as e:
        print(f"error: {e}\n\n{__doc__}", file=out)
        return 2
    if config is None:
        print(f"{__doc__}\nBoards: {', '.join(BOARDS)}", file=out)
        return 0
    from pyspark.sql import SparkSession

    from .plans.enumeration import Enumerator, Tuning, round_counts
    from .plans.shipping import ship
    from .sources.rounds import RoundStore

    began = time.monotonic()
    try:
        spark = spark or SparkSession.builder.appName("stateloom").master(f"local[{config.workers}]").getOrCreate()
        ship(spark)
        if config.action == "stats":
            print(stats_table(round_counts(RoundStore(spark, config.directory))), file=out)
            return 0
        tuning = Tuning(rows=config.rows, interval=config.interval)
        result = Enumerator(spark, config.board, config.directory, config.verify, config.ranked, tuning).run_one_round()
        if result.initialized:
            print("Initialized round 1 with 1 state", file=out)
        elif result.terminal:
            print(f"Round {result.source} is empty: the enumeration is complete", file=out)
        else:
            print(f"Completed round {result.source} -> {result.destination}: {result.processed:,} states, {result.generated:,} moves, {result.unique:,} unique, {time.monotonic() - began:.1f} s", file=out)
        return 0
    except Exception as e:  # noqa: BLE001
        print(f"failed: {e}", file=out)
        return 1


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
