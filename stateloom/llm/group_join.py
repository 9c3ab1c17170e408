"""Similarity join of documents on word n-grams by grouped prefixes.

A document is its set of distinct 5-word shingles.  Sets of Jaccard similarity
of at least 0.8 share a shingle of their prefixes, the first fifth of each set
in an order common to all (frequent shingles last, else by hash).

1. Documents with the same prefix and set size are one group, documents with
   the same set one class of it.
2. Groups are listed under the shingles of their prefixes.  The pairs of a short
   list are rows, at most SHORT / 2 for each entry; a pair ties its groups if
   what it has in common in such lists, and what the rest of both can add, reach
   the similarity.  An entry of a long list stays only if another group under
   its shingle is near enough in size for what both can still have in common
   from that place on; entries of one shingle and of like size tie their groups
   to one of them.  So the number of ties is that of the entries.  Groups tied
   to each other, directly or through others, are a family.
3. A family is one cell, or where it is large a cell for each pair of its
   blocks.  First a cell holds prefixes and filters group pairs: those that
   can't reach the similarity by what both prefixes show go.  What is left ties
   groups to smaller families.
4. These are expanded to the classes in their groups.  Now a cell holds whole
   sets, verifies all pairs, and returns for each class the number of its links
   and one class of its component.  So the pairs of large groups are looked at
   where they meet and never become rows.

Every link between different sets is found and counted: two linked sets are in
one family in both steps, and each pair of blocks of a family is a cell.

Defined cases: words are runs of other characters than the six white space
ones, A-Z in lower case; with fewer than five words the sequence is one
shingle; without words or text the set is empty and linked with nothing; a
null id takes no part in links and its component is null; equal sets are
linked; rows that repeat an id with other texts are documents of their own,
each in the component of its text; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch, map_arrow, text_or_empty

WORDS = 5
PERCENT = 80
#: Share of the hash range whose shingles are counted to find the frequent ones, and the standard deviations by which
#: what is counted of a set reaches beyond the length of its prefix (a common line of short texts would be missed else).
COUNTED = 0.25
MARGIN = 6
#: Shingles of at least so many documents come last in the order, or of more where those are too many to broadcast.
FREQUENT = 8
FREQUENT_ROWS = 1_000_000
#: The pairs of lists of at most so many groups become rows; of longer ones all groups of like size are tied.
SHORT = 16
#: Classes, and hashes, in a block of a family.
BLOCK = 512
BLOCK_HASHES = 1 << 20
#: Slots of the bits that tell shingles of several prefixes; a power of two.
SLOTS = 1 << 26
#: Blocks of a band are numbered below this.
UNITS = 1 << 32
#: Cells of at most so many classes are compared together, by sorting.
SMALL = 24
#: Sets whose sizes differ by more than this ratio can't be linked (1.25 can); bands of sizes grow by it.
BAND = 1.3
#: Keys and bytes of a table that may be broadcast; beyond, the join is shuffled.
BROADCAST_KEYS = 1_000_000
BROADCAST_BYTES = 16 << 20

_LOWER_AND_SPACES = bytes(32 if b in (9, 10, 11, 12, 13) else b + 32 if 65 <= b <= 90 else b for b in range(256))
_FACTOR = 0xD1342543DE82EF95


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the factor and of its inverse modulo 2 ** 64."""

    def of(base: int) -> np.ndarray:
        out = np.ones(n, np.uint64)
        size, step = 1, base
        while size < n:
            out[size : 2 * size] = (out[:size] * np.uint64(step))[: n - size]
            size, step = 2 * size, step * step % (1 << 64)
        return out

    return of(_FACTOR), of(pow(_FACTOR, -1, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(29))


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of a text that ends with a space."""
    space = data == 32
    before = np.concatenate(([True], space[:-1]))
    start = np.flatnonzero(~space & before)
    end = np.flatnonzero(space & ~before)
    size = 1 << max(16, (len(data) - 1).bit_length())
    power, inverse = _powers(size)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_byte_values()[data] * power[: len(data)], dtype=np.uint64)))
    return start, _mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def _combined(parts: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(parts[0]), len(parts), np.uint64)
    for p in parts:
        h = (h * np.uint64(0xBF58476D1CE4E5B9)) ^ p
        h = h ^ (h >> np.uint64(31))
    return _mix(h)


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorting is much faster here than numpy's hash table."""
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Sorted 64-bit hashes of the distinct shingles of each text."""
    out: list[np.ndarray] = [np.empty(0, np.uint64)] * len(texts)
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) < 1 << 20):
            size += len(texts[last]) + 1
            last += 1
        joined = b" ".join(texts[first:last]) + b" "
        data = np.frombuffer(joined.translate(_LOWER_AND_SPACES), np.uint8)
        start, hashes = _word_hashes(data)
        edges = np.cumsum([len(t) + 1 for t in texts[first:last]])
        number = np.searchsorted(edges, start, side="right")
        counts = np.bincount(number, minlength=last - first)
        n = len(hashes)
        full = _combined([hashes[i : n - words + 1 + i] for i in range(words)]) if n >= words else np.empty(0, np.uint64)
        at = 0
        for k in range(last - first):
            c = int(counts[k])
            if c >= words:
                out[first + k] = _distinct(full[at : at + c - words + 1])
            elif c:
                out[first + k] = _combined([hashes[at + i : at + i + 1] for i in range(c)])
            at += c
        first = last
    return out


def _signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def _length(n: int) -> int:
    """Shingles in the prefix of a set of ``n``."""
    return n - -(-n * PERCENT // 100) + 1 if n else 0


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bound = np.uint64(int(COUNTED * 2**64))
    for batch in batches:
        for start in range(0, batch.num_rows, 2048):
            sets = shingle_sets([t.encode() for t in batch.slice(start, 2048).column(0).to_pylist()])
            low = [s[: max(np.searchsorted(s, bound), _length(len(s)) + int(MARGIN * (len(s) * PERCENT * (100 - PERCENT)) ** 0.5 / 100))] for s in sets]
            found, n = np.unique(np.concatenate(low), return_counts=True) if low else (np.empty(0, np.uint64), np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(_signed(found)), pa.array(n.astype(np.int64))], names=["shingle", "n"])


def _described(frequent):
    """doc_id, set size, digest of the set, group, prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        last = frequent.value
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                sizes, digests, groups, prefixes = [], [], [], []
                for s in shingle_sets([t.encode() for t in part.column(1).to_pylist()]):
                    n = len(s)
                    length = _length(n)
                    prefix = s[:0]
                    if n:
                        # the order common to all: frequent ones last, else by hash
                        often = last[np.searchsorted(last, s)] == s
                        prefix = np.sort(s >> np.uint64(1) | often.astype(np.uint64) << np.uint64(63))[:length]
                    sizes.append(n)
                    digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                    groups.append(xxhash.xxh3_64_intdigest(n.to_bytes(8, "little") + prefix.tobytes()) - (1 << 63))
                    prefixes.append(_signed(prefix))
                offsets = np.concatenate(([0], np.cumsum([len(p) for p in prefixes]))).astype(np.int32)
                values = np.concatenate(prefixes) if prefixes else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(groups, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                    names=["doc_id", "n", "digest", "grp", "prefix"],
                )

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            sets = shingle_sets([t.encode() for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["w", "own", "hashes"])


def _overlaps(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """Size of the intersection of each set on the left with each on the right; without right, with each other.

    Shingles of many sets are counted by a product of matrices, the others pair by pair.
    """
    other = left if right is None else right
    sides = [(np.concatenate(x), np.repeat(np.arange(len(x)), [len(v) for v in x])) for x in (left, other)]
    if right is None:
        values, n = np.unique(sides[0][0], return_counts=True)
        common = values[n > 1]
    else:
        common = np.intersect1d(_distinct(sides[0][0]), _distinct(sides[1][0]), assume_unique=True)
    codes, first, count = [], [], []
    for values, owner in sides:
        at = np.searchsorted(common, values)
        held = np.append(common, np.uint64(0))[at] == values
        held &= at < len(common)
        order = np.argsort(at[held], kind="stable")
        codes.append((at[held][order], owner[held][order]))
        count.append(np.bincount(codes[-1][0], minlength=len(common)))
        first.append(np.cumsum(count[-1]) - count[-1])
    both = np.zeros(len(left) * len(other), np.int64)
    dense = count[0] * count[1] > max(16, len(left) * len(other) // 512)
    # pair by pair: each entry on the left meets the list of its shingle on the right, some entries at a time
    at, owner = codes[0]
    at, owner = at[~dense[at]], owner[~dense[at]]
    wide = count[1][at]
    edges = np.searchsorted(np.cumsum(wide), np.arange(0, wide.sum() + BLOCK_HASHES, BLOCK_HASHES))
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        w, v = wide[low:high], at[low:high]
        within = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        both += np.bincount(np.repeat(owner[low:high], w) * len(other) + codes[1][1][np.repeat(first[1][v], w) + within], minlength=len(both))
    both = both.reshape(len(left), len(other))
    number = np.cumsum(dense) - 1
    heavy = [(number[at[dense[at]]], owner[dense[at]]) for at, owner in codes]
    for low in range(0, int(dense.sum()), 2048):
        parts = []
        for (at, owner), n in zip(heavy, (len(left), len(other)), strict=True):
            start, stop = np.searchsorted(at, (low, low + 2048))
            m = np.zeros((n, 2048), np.float32)
            m[owner[start:stop], at[start:stop] - low] = 1
            parts.append(m)
        both += (parts[0] @ parts[1].T).astype(np.int64)
    return both


def _linked(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """Which sets are linked with which."""
    both = _overlaps(left, right)
    sizes = [np.array([len(v) for v in x], np.int64) for x in (left, left if right is None else right)]
    return 100 * both >= PERCENT * (sizes[0][:, None] + sizes[1][None, :] - both)


def _plausible(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """Which groups may hold linked sets by their set sizes (first number of each) and prefixes (the others).

    Up to where the shorter-reaching prefix ends both are known whole; beyond,
    at most the smaller rest is common.
    """
    other = left if right is None else right
    n, m = (np.array([v[0] for v in x]).astype(np.int64) for x in (left, other))
    left, other = [v[1:] for v in left], [v[1:] for v in other]
    both = _overlaps(left, None if right is None else other)
    ends = np.array([v[-1] for v in other])
    values = np.concatenate(other)
    starts = np.cumsum([0, *(len(v) for v in other[:-1])])
    for k in np.flatnonzero(both.any(axis=1)):
        mine = np.searchsorted(left[k], np.minimum(left[k][-1], ends), "right")
        theirs = np.add.reduceat(values <= left[k][-1], starts)
        most = both[k] + np.minimum(n[k] - mine, m - theirs)
        both[k] = (both[k] > 0) & (100 * most >= PERCENT * (n[k] + m - most))
    return both.astype(bool)


def _least_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest of ``n`` nodes that each reaches over the edges (a, b)."""
    label = np.arange(n)
    while len(a):
        old = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if np.array_equal(old, label):
            break
    return label


def _small_pairs(sets: list[np.ndarray], cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (positions) of sets of one cell that have anything in common, and how much; ``cell`` is ascending."""
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.lexsort((values, cell[owner]))
    values, owner = values[order], owner[order]
    of = cell[owner]
    same = (values[1:] == values[:-1]) & (of[1:] == of[:-1])
    pairs, shift = [], 1
    while same.any():
        at = np.flatnonzero(same)
        pairs.append(owner[at] * len(sets) + owner[at + shift])
        shift += 1
        same = same[:-1] & (values[shift:] == values[:-shift]) & (of[shift:] == of[:-shift])
    code, both = np.unique(np.concatenate(pairs), return_counts=True) if pairs else (np.empty(0, np.int64),) * 2
    return code // len(sets), code % len(sets), both


def _small_linked(sets: list[np.ndarray], cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b, both = _small_pairs(sets, cell)
    size = np.array([len(s) for s in sets])
    linked = 100 * both >= PERCENT * (size[a] + size[b] - both)
    return a[linked], b[linked]


def _small_plausible(sets: list[np.ndarray], cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    prefixes = [s[1:] for s in sets]
    a, b, both = _small_pairs(prefixes, cell)
    n = np.array([s[0] for s in sets]).astype(np.int64)
    end = np.array([p[-1] for p in prefixes])
    rest = np.array([[n[i] - np.searchsorted(prefixes[i], e, "right") for i in pair] for pair, e in zip(zip(a.tolist(), b.tolist(), strict=True), np.minimum(end[a], end[b]), strict=True)], np.int64).reshape(-1, 2)
    most = both + rest.min(axis=1)
    kept = 100 * most >= PERCENT * (n[a] + n[b] - most)
    return a[kept], b[kept]


def _compared(decide, decide_small):
    """For each node of each cell its pairs there and the first node that it reaches by them.

    Rows (family, i, j, side, node, values) come in order of the first five; a
    cell may go over several batches and is held whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list = []
        weight = 0
        key, nodes, sides, sets = None, [], [], []
        kind = None

        def out(nodes: list, links: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array(links.astype(np.int64)), pa.array([nodes[k] for k in label], kind)], names=["node", "n_links", "reached"])

        def single(nodes: list, sides: np.ndarray, sets: list[np.ndarray]) -> pa.RecordBatch:
            left = int(np.count_nonzero(sides == 0))
            if left in (0, len(sets)):
                pairs = decide(sets)
                np.fill_diagonal(pairs, False)
                a, b = np.nonzero(np.triu(pairs))
                links = pairs.sum(1)
            else:
                pairs = decide(sets[:left], sets[left:])
                a, b = np.nonzero(pairs)
                b = b + left
                links = np.concatenate((pairs.sum(1), pairs.sum(0)))
            return out(nodes, links, _least_reached(len(sets), a, b))

        def small() -> pa.RecordBatch:
            nodes = [d for c in waiting for d in c[0]]
            sets = [s for c in waiting for s in c[2]]
            a, b = decide_small(sets, np.repeat(np.arange(len(waiting)), [len(c[0]) for c in waiting]))
            links = np.bincount(a, minlength=len(sets)) + np.bincount(b, minlength=len(sets))
            return out(nodes, links, _least_reached(len(sets), a, b))

        def finish() -> Iterator[pa.RecordBatch]:
            nonlocal weight
            # a cell of two blocks has pairs between its sides only
            if len(nodes) > 1 and len(nodes) <= SMALL and key[1] == key[2]:
                waiting.append((nodes, sides, sets))
                weight += sum(len(s) for s in sets)
                if weight >= BLOCK_HASHES:
                    yield small()
                    waiting.clear()
                    weight = 0
            elif len(nodes) > 1 and (key[1] == key[2] or 0 < sum(sides) < len(sides)):
                yield single(nodes, np.array(sides), sets)

        for batch in batches:
            kind = batch.column(4).type
            columns = [batch.column(k).to_pylist() for k in range(5)]
            values = batch.column(5)
            for row, (family, i, j, side, node) in enumerate(zip(*columns, strict=True)):
                if (family, i, j) != key:
                    yield from finish()
                    key, nodes, sides, sets = (family, i, j), [], [], []
                if nodes and nodes[-1] == node and sides[-1] == side:
                    continue  # rows that repeat an id and a text
                nodes.append(node)
                sides.append(side)
                sets.append(np.frombuffer(values[row].as_py(), np.uint64))
        yield from finish()
        if waiting:
            yield small()

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last two columns, set size and prefix, as one value."""
    for batch in batches:
        n, prefix = batch.column(batch.num_columns - 2).to_numpy(), batch.column(batch.num_columns - 1)
        packed = [n[k].tobytes() + prefix[k].values.to_numpy().tobytes() for k in range(batch.num_rows)]
        columns = [batch.column(k) for k in range(batch.num_columns - 2)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(packed, pa.binary())], names=[*batch.schema.names[:-2], "packed"])


def _sifted(bits):
    """(shingle, grp, n, place, last) of the places of prefixes whose shingle may be in several prefixes.

    ``last`` is the end of the prefix, as a number that compares like the order of shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            prefix = batch.column(2)
            values, offsets = prefix.values.to_numpy(), prefix.offsets.to_numpy()
            values = values[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
            slot = values & (SLOTS - 1)
            kept = np.flatnonzero(held[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
            row = np.searchsorted(offsets, kept, "right") - 1
            n = batch.column(1).to_numpy()[row]
            last = values[offsets[row + 1] - 1] ^ np.int64(-(1 << 63))
            yield pa.RecordBatch.from_arrays([pa.array(values[kept]), batch.column(0).take(pa.array(row)), pa.array(n), pa.array((kept - offsets[row]).astype(np.int64)), pa.array(last)], names=["shingle", "grp", "n", "place", "last"])

    return run


def _bounded(df: DataFrame, width: int = 8) -> DataFrame:
    """Hint to broadcast a stored table of keys, ``width`` bytes each, only if it was counted to be small."""
    return F.broadcast(df) if df.count() <= min(BROADCAST_KEYS, BROADCAST_BYTES // width) else df


def connected(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """node, comp: the smallest node that each node of ``edges`` (a, b) reaches.

    Every round all nodes of one label take the smallest label next to any of
    them, and then what that label's own nodes take, so the number of rounds
    is about the logarithm of the longest chain.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    both = scratch.keep(both, f"{label}-edges")
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), f"{label}-0")
    # as many labels in each round as nodes; where they were counted to be few, joins with them need no shuffle
    few = labels.count() <= min(BROADCAST_KEYS, BROADCAST_BYTES // 96)
    sent = F.broadcast if few else lambda df: df
    turn = 0
    while True:
        turn += 1
        near = both.join(sent(labels.withColumnRenamed("node", "b")), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("around"))
        step = scratch.keep(near.join(sent(labels), "node").select("node", F.col("comp").alias("old"), F.least("comp", "around").alias("new")), f"{label}-near-{turn}")
        taken = scratch.keep(step.groupBy("old").agg(F.min("new").alias("taken")), f"{label}-taken-{turn}")
        step = step.join(sent(taken), "old").select("node", "old", F.col("taken").alias("new"))
        step = step.join(sent(taken.select(F.col("old").alias("new"), F.col("taken").alias("further"))), "new", "left")
        step = scratch.keep(step.select("node", "old", F.coalesce("further", "new").alias("comp")), f"{label}-{turn}")
        scratch.drop(f"{label}-{turn - 1}", f"{label}-near-{turn}", f"{label}-taken-{turn}")
        labels = step.select("node", "comp")
        if step.where("old != comp").isEmpty():
            scratch.drop(f"{label}-edges")
            return labels


def _most_frequent(counts: DataFrame) -> np.ndarray:
    """At most FREQUENT_ROWS shingles, sorted: those above the least count that leaves no more; then the largest number."""
    least, left = None, FREQUENT_ROWS
    for n, size in counts.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():  # a row for each count
        if size > left:
            break
        least, left = n, left - size
    found = counts.where(F.col("n") >= least).select("shingle").toArrow().column(0).to_numpy() if least is not None else np.empty(0, np.int64)
    return np.append(np.sort(found.astype(np.int64).view(np.uint64)), np.uint64(2**64 - 1))


def _ties(leaders: DataFrame, scratch: Scratch) -> DataFrame:
    """a, b: groups tied by the entries of their prefixes; ``leaders`` has grp, n, prefix of each group."""
    joint = leaders.select(F.explode("prefix").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("k"))
    joint = scratch.keep(joint.where("k > 1"), "joint")
    # a bit for each slot of such a shingle, of fixed size; where it is full, more rows go on to the join
    slot = F.col("shingle").bitwiseAND(F.lit(SLOTS - 1))
    maps = joint.groupBy(F.shiftright(slot, 15).alias("k")).agg(F.bitmap_construct_agg(slot.bitwiseAND(F.lit(32767))).alias("bits")).collect()
    held = bytearray(SLOTS >> 3)
    for r in maps:
        held[r["k"] << 12 : (r["k"] + 1) << 12] = r["bits"]
    bits = scratch.spark.sparkContext.broadcast(bytes(held))
    entries = map_arrow(leaders, _sifted(bits), "shingle long, grp long, n long, place long, last long")
    entries = scratch.keep(entries.join(_bounded(joint, 48), "shingle"), "entries")
    scratch.drop("joint")
    ties = scratch.keep(_short_ties(entries, scratch).union(_long_ties(entries.where(F.col("k") > SHORT), scratch)).distinct(), "ties")
    scratch.drop("entries", "many", "lists", "hubs")
    return ties


def _short_ties(entries: DataFrame, scratch: Scratch) -> DataFrame:
    """a, b: pairs of short lists that can reach the similarity by what both have in common in all short lists.

    Of a pair's long lists at most as many are common as the one in fewer of them
    has.  Up to where the shorter-reaching prefix ends both are known whole, so
    beyond it the rest of that set is common at most, and of the other what
    follows the last common place.
    """
    many = scratch.keep(entries.where(F.col("k") > SHORT).groupBy("grp").agg(F.count(F.lit(1)).alias("held")), "many")
    short = entries.where(F.col("k") <= SHORT)
    sides = [short.select("shingle", *(F.col(c).alias(f"{c}_{side}") for c in ("grp", "n", "place", "last"))) for side in "ab"]
    near = f"grp_a < grp_b and 100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)"
    pairs = sides[0].join(sides[1], "shingle").where(near)
    pairs = pairs.groupBy(F.col("grp_a").alias("a"), F.col("grp_b").alias("b")).agg(
        F.count(F.lit(1)).alias("common"), *(F.max(c).alias(c) for c in ("n_a", "n_b", "place_a", "place_b", "last_a", "last_b"))
    )
    for side in "ab":
        pairs = pairs.join(_bounded(many, 48).select(F.col("grp").alias(side), F.col("held").alias(f"held_{side}")), side, "left")
    # what a prefix leaves of its set of n
    rest = "((" + f"{PERCENT} * {{0}} + 99) div 100 - 1)"
    beyond = f"least(n_a - place_a - 1, n_b - place_b - 1, if(last_a <= last_b, {rest.format('n_a')}, {rest.format('n_b')}))"
    most = F.expr(f"common + least(coalesce(held_a, 0), coalesce(held_b, 0)) + {beyond}")
    return pairs.withColumn("most", most).where(f"100 * most >= {PERCENT} * (n_a + n_b - most)").select("a", "b")


def _long_ties(entries: DataFrame, scratch: Scratch) -> DataFrame:
    """a, b: groups of one list and of like size, tied to one of them, and those to each other."""
    # from its place on, partners of up to ``far`` shingles can have enough in common
    entries = entries.select("shingle", "grp", "n", F.expr(f"(100 * n - {100 + PERCENT} * place) div {PERCENT}").alias("far"))
    reach = entries.groupBy("shingle").agg(F.min("n").alias("least"), F.max("far").alias("reach"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(BAND)))).cast("int")
    lists = entries.join(reach, "shingle").where("far >= n or (reach >= n and least <= far)").select("shingle", band.alias("band"), "grp")
    lists = scratch.keep(lists, "lists")
    hubs = scratch.keep(lists.groupBy("shingle", "band").agg(F.min("grp").alias("hub")), "hubs")
    ties = lists.join(_bounded(hubs, 64), ["shingle", "band"]).select(F.col("grp").alias("a"), F.col("hub").alias("b"))
    above = hubs.select("shingle", (F.col("band") - 1).alias("band"), F.col("hub").alias("b"))
    return ties.union(hubs.join(above, ["shingle", "band"]).select(F.col("hub").alias("a"), "b")).where("a != b")


def _placed(members: DataFrame, weight: str, scratch: Scratch, label: str) -> DataFrame:
    """family, i, j, side, node, doc: the cells of each of ``members`` (family, node, doc, n) of a family of several."""
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum(F.expr(weight)) / BLOCK_HASHES)).cast("int")
    sizes = scratch.keep(members.groupBy("family").agg(F.count(F.lit(1)).alias("m"), blocks.alias("blocks")).where("m > 1"), f"{label}-sizes")
    # a family of several blocks is cut by size: a block is met by the blocks of its own and of the next band
    band = F.when(F.col("blocks") > 1, F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(BAND)))).cast("int")).otherwise(0)
    members = scratch.keep(members.join(_bounded(sizes, 32), "family").select("family", band.alias("band"), "node", "doc", "n"), f"{label}-members")
    bands = scratch.keep(members.groupBy("family", "band").agg(blocks.alias("blocks")), f"{label}-bands")
    number = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1), lambda k: F.col("band").cast("long") * UNITS + k)
    units = scratch.keep(bands.select("family", "band", F.explode(number).alias("unit")), f"{label}-units")
    hint = F.broadcast if units.count() <= BROADCAST_BYTES // 64 else lambda df: df
    near = units.withColumnRenamed("unit", "i").join(hint(units.select("family", F.explode(F.array("band", F.col("band") - 1)).alias("band"), F.col("unit").alias("j"))), ["family", "band"])
    near = scratch.keep(near.where("i <= j").select("family", "i", "j"), f"{label}-near")
    unit = F.col("band").cast("long") * UNITS + F.pmod(F.xxhash64("node"), F.col("blocks"))
    placed = members.join(_bounded(bands, 48), ["family", "band"]).select("family", unit.alias("unit"), "node", "doc")
    few = F.broadcast if near.count() <= BROADCAST_BYTES // 64 else lambda df: df
    first = placed.join(few(near.withColumnRenamed("i", "unit")), ["family", "unit"]).select("family", F.col("unit").alias("i"), "j", F.lit(0).alias("side"), "node", "doc")
    second = placed.join(few(near.where("i < j").withColumnRenamed("j", "unit")), ["family", "unit"]).select("family", "i", F.col("unit").alias("j"), F.lit(1).alias("side"), "node", "doc")
    placed = scratch.keep(first.union(second), f"{label}-placed")
    scratch.drop(*(f"{label}-{x}" for x in ("sizes", "members", "bands", "units", "near")))
    return placed


def _in_cells(dealt: DataFrame, value: str, function, kind: str) -> DataFrame:
    cell = ["family", "i", "j"]
    dealt = dealt.select(*cell, "side", "node", value).repartition(*cell).sortWithinPartitions(*cell, "side", "node")
    return map_arrow(dealt, function, f"node {kind}, n_links long, reached {kind}")


def similar_components(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id and n_links of every row.

    class_id is the smallest id with the same set; n_links counts all links of
    its class to other classes.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "group-join")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("body"))

    counted = map_arrow(rows.select("body"), _counted, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    often = scratch.keep(counted.where(F.col("n") >= FREQUENT), "often")
    frequent = spark.sparkContext.broadcast(_most_frequent(often))
    scratch.drop("often")
    described = scratch.keep(map_arrow(rows, _described(frequent), "doc_id long, n long, digest binary, grp long, prefix array<long>"), "described")
    taking_part = described.where("n > 0 and doc_id is not null")
    # one row of each group stands for it; the other rows are few, so prefixes needn't be shuffled to tell them
    heads = scratch.keep(taking_part.groupBy("grp").agg(F.min("doc_id").alias("doc")), "heads")
    others = taking_part.select("grp", "doc_id").join(heads, "grp").where("doc_id != doc").select(F.col("grp").alias("g"), F.col("doc_id").alias("other"))
    others = scratch.keep(others, "others")
    leaders = taking_part.join(_bounded(others, 32), (F.col("grp") == F.col("g")) & (F.col("doc_id") == F.col("other")), "left_anti").select("grp", "n", "prefix", F.col("doc_id").alias("doc"))
    numbered = not heads.groupBy("doc").count().where("count > 1").isEmpty() or not taking_part.groupBy("doc_id").count().where("count > 1").isEmpty()
    if numbered:
        leaders = leaders.dropDuplicates(["grp"])  # rows that repeat an id

    # group pairs, filtered by prefixes
    families = connected(_ties(leaders.select("grp", "n", "prefix"), scratch), scratch, "family").withColumnsRenamed({"node": "g", "comp": "family"})
    tied = leaders.join(_bounded(families, 48), F.col("grp") == F.col("g")).select("family", F.col("grp").alias("node"), "doc", "n")
    placed = _placed(tied, f"n * {100 - PERCENT} / 100", scratch, "group")
    dealt = leaders.join(_bounded(placed.withColumnRenamed("doc", "d"), 96), F.col("grp") == F.col("node")).select("family", "i", "j", "side", "node", "n", "prefix")
    dealt = map_arrow(dealt, _packed, "family long, i long, j long, side int, node long, packed binary")
    pairs = scratch.keep(_in_cells(dealt, "packed", _compared(_plausible, _small_plausible), "long").where("node != reached"), "group-pairs")
    scratch.drop("group-placed")
    families = connected(pairs.select(F.col("node").alias("a"), F.col("reached").alias("b")), scratch, "group").withColumnsRenamed({"node": "grp", "comp": "family"})

    # classes of the families that have several
    classes = scratch.keep(taking_part.groupBy("digest").agg(F.min("grp").alias("grp"), F.min("n").alias("n"), F.min("doc_id").alias("class_id")), "classes")
    members = classes.join(_bounded(families, 48), "grp", "left").select(F.coalesce("family", "grp").alias("family"), F.col("digest").alias("node"), F.col("class_id").alias("doc"), "n")
    placed = _placed(scratch.keep(members, "members"), "n", scratch, "class")
    scratch.drop("members", "group-pairs")

    # their whole sets, made from one text of each class, dealt to the cells
    asked = scratch.keep(placed.select(F.col("doc").alias("doc_id")).distinct(), "asked")
    texts = rows.join(_bounded(asked, 32), "doc_id", "left_semi")
    sets = map_arrow(texts, _sets, "w long, own binary, hashes binary")
    dealt = sets.join(_bounded(placed, 96), (F.col("w") == F.col("doc")) & (F.col("own") == F.col("node")))
    compared = _in_cells(dealt, "hashes", _compared(_linked, _small_linked), "binary").withColumnRenamed("node", "digest")
    compared = scratch.keep(compared, "compared")
    scratch.drop("class-placed", "asked")
    degree = compared.groupBy("digest").agg(F.sum("n_links").alias("n_links"))
    labels = connected(compared.where("digest != reached").select(F.col("digest").alias("a"), F.col("reached").alias("b")), scratch, "component")

    # only the classes with links have components of several
    linked = scratch.keep(labels.join(classes.select(F.col("digest").alias("node"), "class_id"), "node"), "linked")
    first = scratch.keep(linked.groupBy("comp").agg(F.min("class_id").alias("component_id")), "first")
    linked = linked.join(_bounded(first, 64), "comp").select(F.col("node").alias("l"), "component_id")
    linked = scratch.keep(linked.join(degree, F.col("l") == F.col("digest")).select("l", "component_id", "n_links"), "degrees")
    named = classes.join(_bounded(linked, 96), F.col("digest") == F.col("l"), "left")
    named = scratch.keep(named.select(F.col("digest").alias("d"), "class_id", F.coalesce("component_id", "class_id").alias("component_id"), "n_links"), "named")
    scratch.drop("compared", "classes", "linked", "first", "degrees")
    out = described.select("doc_id", "n", "digest").join(named, (F.col("digest") == F.col("d")) & F.col("doc_id").isNotNull(), "left")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without all but one of each component: that of the smallest id; rows without id stay."""
    scratch, work = Scratch(docs.sparkSession, "one-of-each"), Scratch(docs.sparkSession, "group-join")
    with_id = docs.where("doc_id is not null")
    # the rows that go are told by their ids, which are fewer than those that stay; texts needn't be shuffled for them
    if with_id.groupBy("doc_id").count().where("count > 1").isEmpty():
        found = similar_components(docs, work).where("doc_id != component_id").select(F.col("doc_id").alias("__gone"))
        out = docs.join(_bounded(scratch.keep(found, "gone"), 32), F.col("doc_id") == F.col("__gone"), "left_anti")
    else:
        # an id doesn't name one row: rows are numbered in order of their ids and stand for themselves
        ordered = with_id.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
        numbered = scratch.keep(ordered.withColumn("__row", F.monotonically_increasing_id()), "numbered")
        found = similar_components(numbered.select(F.col("__row").alias("doc_id"), "text"), work).where("doc_id != component_id").select(F.col("doc_id").alias("__gone"))
        out = numbered.join(_bounded(scratch.keep(found, "gone"), 32), F.col("__row") == F.col("__gone"), "left_anti").drop("__row")
        out = out.unionByName(docs.where("doc_id is null"))
    # what is left of the join is a table of ids
    work.close()
    return out
