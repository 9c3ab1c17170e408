"""Periodic runs in texts, found on line by catchers over dyadic blocks of words.

Words come one after another.  Whenever a block of a power of two many words,
at a multiple of its length, is complete, a catcher stands over it.  A catcher
over L words looks for periods p of its own range only: those for which L is
the largest power of two with 2 L - 1 + p <= exponent * p.  So every stretch
with period p that is ``exponent`` periods long holds a whole block and the
block's copy p words on, and each period has one length of blocks.  Each
appended word ends one suffix of L words for each L; it is compared (by
fingerprints) with the few catchers whose distance is a period in their range.
Equal ones are squares, or repetitions of that exponent in the making: they
are extended word by word to both sides, and as further words come, and
squares that lie in a stretch already known, of their period or of one that
divides it, merge into it.

Words are numbers here, so ``append`` takes any number of them at once; what
comes out doesn't depend on how they are cut into calls.

A row is one text: documents are independent, nothing is shuffled.

Defined cases: words are runs of other characters than the six white space
ones; a text that is null, empty or without words has no runs; rows are kept
as they are, with all columns that ``keep`` names, repeated ones too; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import map_arrow, text_or_empty

#: Least exponent and least length, in words, of a run.
EXPONENT = 4
LENGTH = 6
#: Words that are appended at once.
CHUNK = 1 << 16
_BASE = np.uint64(0x9E3779B97F4A7C15)


def periods_of(block: int, exponent: int) -> tuple[int, int]:
    """First and last period of catchers over ``block`` words: 2 block - 1 <= (exponent - 1) p < 4 block - 1."""
    first = -(-(2 * block - 1) // (exponent - 1))
    return first, -(-(4 * block - 1) // (exponent - 1)) - 1


class Catchers:
    """The words so far, the stretches found in them, and the catchers of all completed blocks."""

    def __init__(self, exponent: int = EXPONENT, length: int = LENGTH):
        if exponent < 2:
            raise ValueError("a run has two periods at least")
        self.exponent, self.length = exponent, length
        self.n = 0
        self.words = np.empty(0, np.int64)
        self.power = np.ones(1, np.uint64)
        self.total = np.zeros(1, np.uint64)  # fingerprints of the prefixes
        #: period: starts and ends of its stretches, both ascending
        self.found: dict[int, tuple[list[int], list[int]]] = {}

    def append(self, words: np.ndarray) -> None:
        for start in range(0, len(words), CHUNK):
            self._append(words[start : start + CHUNK])

    def _append(self, words: np.ndarray) -> None:
        before, self.n = self.n, self.n + len(words)
        self._grow(words)
        # stretches that ended where the words ended go on
        for p, (_, ends) in self.found.items():
            if ends[-1] == before:
                ends[-1] = self._right(before, p)
        caught = [c for c in self._caught(before) if len(c[0])]
        if not caught:
            return
        block_start, period = (np.concatenate(x) for x in zip(*caught, strict=True))
        order = np.lexsort((block_start, period))
        block_start, period = block_start[order], period[order]
        cuts = np.flatnonzero(np.diff(period)) + 1
        for starts in np.split(np.arange(len(period)), cuts):
            self._merge(int(period[starts[0]]), block_start[starts])

    def _grow(self, words: np.ndarray) -> None:
        if self.n > len(self.words):
            size = max(self.n, 2 * len(self.words))
            held, total, power = np.empty(size, np.int64), np.zeros(size + 1, np.uint64), np.ones(size + 1, np.uint64)
            held[: len(self.words)], total[: len(self.total)], power[: len(self.power)] = self.words, self.total, self.power
            np.multiply.accumulate(np.concatenate((power[len(self.power) - 1 : len(self.power)], np.full(size + 1 - len(self.power), _BASE))), out=power[len(self.power) - 1 :])
            self.words, self.total, self.power = held, total, power
        start = self.n - len(words)
        self.words[start : self.n] = words
        parts = words.view(np.uint64) * self.power[start : self.n]
        self.total[start + 1 : self.n + 1] = self.total[start] + np.cumsum(parts, dtype=np.uint64)

    def _caught(self, before: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(block start, period) of the suffixes of all lengths, of each new word, that equal the block of a catcher."""
        block = 1
        while True:
            first, last = periods_of(block, self.exponent)
            if block + first > self.n:
                return
            if last >= first:
                # suffixes of ``block`` words that new words end and that leave room for a block a period before
                suffix = np.arange(max(before - block + 1, first), self.n - block + 1)
                sums = self.total[suffix + block] - self.total[suffix]
                nearest = (suffix - first) // block * block
                for step in range((last - first) // block + 1):
                    at = nearest - step * block
                    able = np.flatnonzero((at >= 0) & (suffix - at <= last))
                    a, j = at[able], suffix[able]
                    equal = (self.total[a + block] - self.total[a]) * self.power[j - a] == sums[able]
                    yield a[equal], (j - a)[equal]
            block *= 2

    def _merge(self, p: int, blocks: np.ndarray) -> None:
        """Stretches of period p around blocks (ascending) that have a copy p words on, unless they lie in a known one."""
        block = 1
        while periods_of(block, self.exponent)[1] < p:
            block *= 2
        for q in [q for q in self.found if p % q == 0]:
            blocks = blocks[~self._covered(q, blocks, blocks + p + block)]
            if not len(blocks):
                return
        starts, ends = self.found.get(p, ([], []))
        fresh_start, fresh_end = [], []
        reached = 0
        for a in blocks.tolist():
            if a + p + block <= reached:
                continue
            end = self._right(a + p, p)
            if end < a + p + block:
                continue  # equal fingerprints of different words
            fresh_start.append(self._left(a, p))
            fresh_end.append(end)
            reached = end
        if fresh_start:
            both = sorted({*zip(starts, ends, strict=True), *zip(fresh_start, fresh_end, strict=True)})
            self.found[p] = [s for s, _ in both], [e for _, e in both]

    def _covered(self, q: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        starts, ends = (np.array(x) for x in self.found[q])
        at = np.searchsorted(starts, start, "right") - 1
        return (at >= 0) & (ends[at] >= end)

    def _right(self, i: int, p: int) -> int:
        """First place from i on whose word differs from the one p before."""
        step = 32
        while i < self.n:
            stop = min(self.n, i + step)
            differs = self.words[i:stop] != self.words[i - p : stop - p]
            k = int(differs.argmax())
            if differs[k]:
                return i + k
            i, step = stop, step * 4
        return self.n

    def _left(self, i: int, p: int) -> int:
        """Last place up to i from which on words are equal to those p after them."""
        step = 32
        while i > 0:
            stop = max(0, i - step)
            differs = (self.words[stop:i] != self.words[stop + p : i + p])[::-1]
            k = int(differs.argmax())
            if differs[k]:
                return i - k
            i, step = stop, step * 4
        return 0

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, smallest period) of all runs so far, by start, then period."""
        seen: dict[tuple[int, int], int] = {}
        for p in sorted(self.found):
            for s, e in zip(*self.found[p], strict=True):
                if e - s >= max(self.length, self.exponent * p):
                    # a stretch that is long enough has a smaller period only if that divides p, over the same words
                    seen.setdefault((s, e), p)
        return sorted(((s, e - s, p) for (s, e), p in seen.items()), key=lambda r: (r[0], r[2]))


def runs_of(words: list, exponent: int = EXPONENT, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """All runs of a list of words."""
    if len(words) < max(length, exponent):
        return []
    catchers = Catchers(exponent, length)
    catchers.append(np.fromiter(map(hash, words), np.int64, len(words)))
    found = catchers.runs()
    # words stood for by their hashes: what was found is compared in full
    if all(words[s : s + n - p] == words[s + p : s + n] for s, n, p in found):
        return found
    numbers: dict = {}
    catchers = Catchers(exponent, length)
    catchers.append(np.array([numbers.setdefault(w, len(numbers) + 1) for w in words], np.int64))
    return catchers.runs()


def collapsed(words: list, runs: Iterable[tuple[int, int, int]]) -> list:
    """The words without those that a run holds after its first period."""
    kept = np.ones(len(words), bool)
    for s, n, p in runs:
        kept[s + p : s + n] = False
    return words if kept.all() else [words[i] for i in np.flatnonzero(kept).tolist()]


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), exponent: int = EXPONENT, length: int = LENGTH) -> DataFrame:
    """The columns in ``keep``, runs (by start, then period) and the text with each run cut to its first period."""
    columns = docs.select(*keep, text_or_empty().alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, left = [], []
            for text in batch.column(len(keep)).to_pylist():
                # the six white space characters of ASCII, as split() takes bytes
                words = text.encode().split()
                runs = runs_of(words, exponent, length)
                found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                left.append(b" ".join(collapsed(words, runs) if runs else words))
            made = [pa.array(found, _RUNS), pa.array(left, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), *made], names=[*keep, "runs", "collapsed"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.schema.fields[:-1])
    return map_arrow(columns, run, f"{kept}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def planted(doc_id: Column, text: Column) -> Column:
    """The text, its tail made periodic where crc32 of the decimal id is divisible by ten; a null id leaves it as it is.

    With h the checksum, g = h div 10 and n words, each word i from a = g mod n
    on becomes word a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8).
    """
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    g = F.floor(F.crc32(doc_id.cast("string").cast("binary")) / 10).cast("long")

    def rewritten(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.element_at(w, (place(i) + 1).cast("int"))), " ")

    # a value that is computed once
    changed = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, rewritten(w)).otherwise("")), 1)
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, changed).otherwise(text)


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id with the number of runs, the longest one, and digests of all runs and of the collapsed text."""
    best = F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], F.sign(y["length"] - x["length"])).when(x["start"] != y["start"], F.sign(x["start"] - y["start"])).otherwise(F.sign(x["period"] - y["period"])).cast("int"))
    best = F.get(best, F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(F.lit(1000) * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
