"""Benchmark decontamination: which documents hold which test items.

The test items form an inverted index with BM25 impacts, each divided by the
score of the item for its own text, so that one threshold suits all items.
Every passage of every document is a query: overlapping windows of twice the
longest item's length, so that each occurrence lies whole inside one.
Block-max WAND retrieves all items above the threshold: the sum of the terms'
largest impacts bounds a passage's scores, block maxima bound them for
stretches of items, and only what passes both bounds is scored.  A retrieved
pair counts if enough word n-grams of both the question and the answer of the
item stand in the passage; of an item that has no question mark, and so no
answer that is known, enough n-grams of the whole will do.

Items are indexed in shards of bounded size and of like length; a shard's
index is what is broadcast.  Counts of terms are over all items.

Defined cases: words are runs of word characters in lower case; an item
without words is never found; a null or empty text holds nothing; items with
equal texts are all reported; a repeated document row is reported once; empty
tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import map_arrow, text_or_empty

K1, B = 1.2, 0.75
#: Share of an item's own BM25 score that a passage must reach.
THRESHOLD = 0.5
#: Share of the n-grams of question and answer that must stand in the passage.
OVERLAP = 0.5
GRAM = 3
#: Items in a shard, and postings in a block.
SHARD_ITEMS = 4096
BLOCK = 16
#: Words in the windows of the shortest items; longer items have twice, four times ... as many.
LEAST_WINDOW = 32

#: Stretches of a shard's items that are bounded one by one before a passage is searched.
STRETCHES = 32
#: Half windows whose bounds are computed at a time.
PIECE = 1024

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def split_item(text: str) -> tuple[list[str], list[str]]:
    """Question and answer of an item: around its last question mark, else its first three quarters and the rest."""
    head, mark, tail = text.rpartition("?")
    question, answer = words_of(head), words_of(tail)
    if mark and question and answer:
        return question, answer
    words = words_of(text)
    cut = len(words) - max(1, len(words) // 4)
    return words[:cut], words[cut:]


def asks(text: str) -> bool:
    """Whether an item has a question and an answer around a question mark."""
    head, mark, tail = text.rpartition("?")
    return bool(mark and words_of(head) and words_of(tail))


def grams(words: list[str], n: int) -> set[tuple[str, ...]]:
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def overlap(part: list[str], passage: list[str]) -> float:
    """Share of the n-grams of ``part`` that stand in ``passage``; of an empty part all do."""
    wanted = grams(part, GRAM)
    if not wanted:
        return 1.0
    n = min(GRAM, len(part))
    return len(wanted & {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)}) / len(wanted)


@dataclass
class Shard:
    """Inverted index of items of like length."""

    window: int
    items: list[int] = field(default_factory=list)
    parts: list[tuple[list[str], list[str]]] = field(default_factory=list)
    asks: list[bool] = field(default_factory=list)  # whether the parts are a question and its answer
    terms: dict[str, int] = field(default_factory=dict)
    postings: list[tuple[list[int], list[float], list[float]]] = field(default_factory=list)  # items, impacts, block maxima
    most: np.ndarray | None = None

    def retrieve(self, found: list[int], threshold: float, low: int = 0, high: int | None = None) -> list[tuple[int, float]]:
        """Items from ``low`` to before ``high`` whose score for the terms ``found`` reaches the threshold, by block-max WAND."""
        most, postings = self.most, self.postings
        end = len(self.items) if high is None else high
        cursors = []
        for t in found:
            ids = postings[t][0]
            at = bisect_left(ids, low)
            if at < len(ids) and ids[at] < end:
                cursors.append((ids[at], at, t))
        out = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(cursors):
                bound += most[t]
                if bound >= threshold - 1e-9:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            # block maxima at the pivot item, and the first item at which one of them changes
            bound, change = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else end
            for _, at, t in cursors[: pivot + 1]:
                ids, _, tops = postings[t]
                block = bisect_left(ids, item, at) // BLOCK
                if block < len(tops):
                    bound += tops[block]
                    change = min(change, ids[min(len(ids), block * BLOCK + BLOCK) - 1] + 1)
            if bound < threshold - 1e-9:
                target = max(item + 1, change)
            elif cursors[0][0] == item:
                score = sum(postings[t][1][at] for _, at, t in cursors[: pivot + 1])
                if score >= threshold - 1e-9:
                    out.append((item, score))
                target = item + 1
            else:
                target = item
            left = cursors[pivot + 1 :]
            for first, at, t in cursors[: pivot + 1]:
                if first < target:
                    ids = postings[t][0]
                    at = bisect_left(ids, target, at)
                    if at == len(ids) or ids[at] >= end:
                        continue
                    first = ids[at]
                left.append((first, at, t))
            cursors = left
        return out

    def passages(self, tops: np.ndarray, ids: np.ndarray, at: np.ndarray, n_words: int, threshold: float) -> Iterator[tuple[int, int, int]]:
        """Windows (first and past last indexed word, first word) whose indexed words ``ids``, at places ``at``, reach the threshold for some stretch of items when their largest impacts are summed."""
        half = self.window // 2
        for base in range(0, max(1, n_words - half), PIECE * half):
            first, last = np.searchsorted(at, (base, base + (PIECE + 1) * half))
            if first == last:
                continue
            sums = np.zeros((last - first + 1, tops.shape[1]))
            np.cumsum(tops[ids[first:last]], axis=0, out=sums[1:])
            starts = base + np.arange(0, min(PIECE * half, max(1, n_words - half - base)), half)
            edges = np.searchsorted(at[first:last], np.concatenate((starts, starts + self.window)))
            bounds = sums[edges[len(starts) :]] - sums[edges[: len(starts)]]
            for k in np.flatnonzero(bounds.max(1) >= threshold - 1e-4).tolist():
                yield int(first + edges[k]), int(first + edges[len(starts) + k]), int(starts[k])


class Index:
    """Shards that are searched together, with one dictionary of terms."""

    def __init__(self, shards: list[Shard]):
        self.shards = shards
        self.terms: dict[str, int] = {}
        for s in shards:
            for t in s.terms:
                self.terms.setdefault(t, len(self.terms))
        n = len(self.terms)
        #: For each shard: its own number of each term (-1: none), and the largest impact in each stretch of items.
        self.own, self.stretches = [], []
        for s in shards:
            at = np.array([self.terms[t] for t in s.terms], np.int64)
            own = np.full(n + 1, -1, np.int32)
            own[at] = np.arange(len(at))
            width = -(-len(s.items) // STRETCHES)
            # by the shard's own numbers; the last row is for terms that it hasn't
            tops = np.zeros((len(at) + 1, STRETCHES), np.float32)
            for t, (ids, values, _) in enumerate(s.postings):
                np.maximum.at(tops[t], np.array(ids) // width, np.array(values, np.float32))
            self.own.append(own)
            self.stretches.append(tops)

    def search(self, text: str | None, threshold: float = THRESHOLD, least: float = OVERLAP) -> dict[int, tuple[float, float, float]]:
        """Of the items that a text holds: best score, overlap of question and of answer."""
        words = words_of(text)
        found: dict[int, tuple[float, float, float]] = {}
        if not words:
            return found
        every = np.fromiter(map(self.terms.get, words, repeat(-1)), np.int64, len(words))
        at = np.flatnonzero(every >= 0)
        ids = every[at]
        for shard, own, tops in zip(self.shards, self.own, self.stretches, strict=True):
            width = -(-len(shard.items) // STRETCHES)
            numbers = own[ids]
            for first, last, start in shard.passages(tops, numbers, at, len(words), threshold):
                # repeated words count once; and only a stretch of items whose own bound reaches the threshold can hold one
                terms = np.sort(numbers[first:last])
                terms = terms[np.append(True, terms[1:] != terms[:-1]) & (terms >= 0)]
                alive = np.flatnonzero(tops[terms].sum(0) >= threshold - 1e-4)
                if not len(alive):
                    continue
                mine = terms.tolist()
                for stretch in alive.tolist():
                    for item, score in shard.retrieve(mine, threshold, stretch * width, (stretch + 1) * width):
                        question, answer = shard.parts[item]
                        passage = words[start : start + shard.window]
                        q, r = overlap(question, passage), overlap(answer, passage)
                        key = shard.items[item]
                        holds = q >= least and r >= least or not shard.asks[item] and overlap(question + answer, passage) >= least
                        if holds and (key not in found or score > found[key][0]):
                            found[key] = score, q, r
        return found


def build_shard(items: list[tuple[int, str]], window: int, seen: dict[str, int], total: int, average: float) -> Shard:
    """Index of (id, text) items; seen: in how many of all ``total`` items each term stands."""
    shard = Shard(window)
    lists: list[tuple[list[int], list[float]]] = []
    for item_id, text in items:
        counts = Counter(words_of(text))
        if not counts:
            continue
        n = sum(counts.values())
        impact = {t: math.log(1 + (total - seen[t] + 0.5) / (seen[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * n / average)) for t, c in counts.items()}
        whole = sum(impact.values())
        number = len(shard.items)
        shard.items.append(item_id)
        shard.parts.append(split_item(text))
        shard.asks.append(asks(text))
        for t, value in impact.items():
            at = shard.terms.setdefault(t, len(shard.terms))
            if at == len(lists):
                lists.append(([], []))
            lists[at][0].append(number)
            lists[at][1].append(value / whole)
    shard.postings = [(ids, values, [max(values[i : i + BLOCK]) for i in range(0, len(values), BLOCK)]) for ids, values in lists]
    shard.most = np.array([*(max(values) for _, values in lists), 0.0])
    return shard


def shards_of(items: DataFrame) -> Iterator[Shard]:
    """The index in shards of at most SHARD_ITEMS items (on average), one collected at a time."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).where("item_id is not null and text is not null")
    worded = rows.withColumn("words", F.expr(r"regexp_extract_all(lower(text), '(?U)\\w+', 0)"))
    size = F.size("words")
    total, average = worded.where(size > 0).agg(F.count(F.lit(1)), F.avg(size)).first()
    if not total:
        return
    level = F.ceil(F.log2(F.greatest(F.lit(1.0), 2.0 * size / LEAST_WINDOW))).cast("int")
    dealt = worded.where(size > 0).withColumn("level", F.greatest(F.lit(0), level))
    many = F.pmod(F.xxhash64("item_id"), F.lit(-(-total // SHARD_ITEMS)))
    dealt = dealt.withColumn("shard", many)
    term_counts = dealt.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    for key in sorted(dealt.select("level", "shard").distinct().collect()):
        mine = dealt.where((F.col("level") == key["level"]) & (F.col("shard") == key["shard"]))
        texts = [(r["item_id"], r["text"]) for r in mine.select("item_id", "text").orderBy("item_id", "text").toLocalIterator()]
        terms = mine.select(F.explode("words").alias("term")).distinct()
        seen = {r["term"]: r["n"] for r in terms.join(term_counts, "term").collect()}
        # Spark and Python may differ on a word of rare characters; such a term counts as standing in one item
        yield build_shard(texts, LEAST_WINDOW << key["level"], _Counts(seen), total, average)


class _Counts(dict):
    def __missing__(self, key: str) -> int:
        return 1


def _finder(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                rows, found = [], []
                for k, text in enumerate(part.column(1).to_pylist()):
                    for item, values in index.value.search(text).items():
                        rows.append(k)
                        found.append((item, *values))
                columns = list(zip(*found, strict=True)) if found else [()] * 4
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int64())), pa.array(columns[0], pa.int64()), *(pa.array(c, pa.float64()) for c in columns[1:])],
                    names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"],
                )

    return run


#: Shards that one pass over the documents searches.
SHARDS_PER_PASS = 8


def _passes(items: DataFrame) -> Iterator:
    """Broadcast indexes of at most SHARDS_PER_PASS shards, so of bounded size."""
    context = items.sparkSession.sparkContext
    held: list[Shard] = []
    for shard in shards_of(items):
        held.append(shard)
        if len(held) == SHARDS_PER_PASS:
            yield context.broadcast(Index(held))
            held = []
    if held:
        yield context.broadcast(Index(held))


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: one row for each item that a document holds."""
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("body"))
    out = docs.sparkSession.createDataFrame([], schema)
    for index in _passes(items):
        out = out.unionByName(map_arrow(rows, _finder(index), schema))
    best = F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item."""

    def keeper(index, column: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = [not index.value.search(text) for text in batch.column(column).to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

        return run

    for index in _passes(items):
        docs = map_arrow(docs, keeper(index, docs.columns.index("text")), docs.schema)
    return docs
