"""Near-duplicate detection by a multi-index Hamming join of MinHash signatures.

A document is its set of distinct 3-word shingles; documents are linked whose
sets have a Jaccard similarity of at least 0.85.

1. Documents with the same set are one class.  A class has a signature of 70
   values, the lowest 16 bits (b-bit MinHash) of the minima of its set under 70
   orders.  The distance of two signatures is the number of values that differ.
2. Signatures are split into 14 chunks of five values.  At a distance of up to
   27 some chunk has one error at most (pigeonhole: 14 chunks with two each
   make 28).  All that can become of a chunk by one error is enumerated by its
   five forms that leave one value out; classes that share a form of a chunk
   are candidates.  So every pair at a distance of up to 27 is found; a pair of
   similarity 0.85 is further apart with a probability of 4e-7.
3. Of each form's classes one is the hub.  Pairs with it, once each, that are
   near enough by their signatures are verified on whole sets, and linked
   classes make components.  This is done a second time with other hubs for
   forms whose classes aren't all in one component, so what is left are forms
   with classes that are neither.
4. There all pairs of different components are compared by their signatures,
   in cells of two blocks.  A pair in reach ties its components to a family.
5. In a family, cells of two blocks hold whole sets, and pairs of different
   components are verified.
   In both steps one side of a cell are only classes outside of the largest
   component of the form, or family, so a large group of copies, once joined,
   isn't compared with itself.

Pairs are looked at where they meet; only pairs with a hub become rows, one
for each class and hub.

Defined cases: words are runs of other characters than the six white space
ones, A-Z in lower case; with fewer than three words the sequence is one
shingle; without words or text the set is empty and linked with nothing; a
null id takes no part in links and its component is null; rows that repeat an
id with other texts are documents of their own, each in the component of its
text; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .group_join import _bounded, _least_reached, _overlaps, connected, shingle_sets
from .storage import Scratch, map_arrow, text_or_empty

WORDS = 3
PERCENT = 85
CHUNKS = 14
#: Values of a chunk, one of which may be wrong.
WIDTH = 5
VALUES = CHUNKS * WIDTH
#: Largest distance at which some chunk has one error at most.
DISTANCE = 2 * CHUNKS - 1
#: Hubs of each form of a chunk that are tried before blocks.
HUBS = 2
#: Classes with one hub, or of a block, whose sets, or signatures, are compared in one place.
CELL = 128
SIGNED = 768
#: Rows that a task gathers before it gives those that differ.
HELD = 1 << 17


@lru_cache(maxsize=1)
def _orders() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(70)
    return rng.integers(1, 2**63, VALUES, dtype=np.uint64), rng.integers(1, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(29))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, VALUES) of 16 bits; that of an empty set is zero."""
    out = np.zeros((len(sets), VALUES), np.uint16)
    full = np.flatnonzero([len(s) for s in sets])
    if len(full):
        values = np.concatenate([sets[k] for k in full])
        first = np.cumsum([0, *(len(sets[k]) for k in full[:-1])])
        for k, (turn, factor) in enumerate(zip(*_orders(), strict=True)):
            least = np.minimum.reduceat((values ^ turn) * factor, first)
            out[full, k] = (_mix(least) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def forms(signature: np.ndarray) -> np.ndarray:
    """(rows, VALUES) keys: each chunk without each of its values."""
    chunks = signature.reshape(len(signature), CHUNKS, WIDTH).astype(np.uint64)
    out = np.empty((len(signature), CHUNKS, WIDTH), np.uint64)
    for gap in range(WIDTH):
        packed = np.zeros((len(signature), CHUNKS), np.uint64)
        for k in range(WIDTH):
            if k != gap:
                packed = packed << np.uint64(16) | chunks[:, :, k]
        number = _mix(np.arange(CHUNKS, dtype=np.uint64) * np.uint64(WIDTH) + np.uint64(gap + 1))
        out[:, :, gap] = _mix(packed ^ number[None, :])
    return out.reshape(len(signature), VALUES).view(np.int64)


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), VALUES)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            sets = shingle_sets([t.encode() for t in part.column(1).to_pylist()], WORDS)
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            sizes = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), sizes, pa.array(digests, pa.binary()), pa.array([s.tobytes() for s in signatures(sets)], pa.binary())], names=["doc_id", "n", "digest", "signature"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(form, node, lead, gap): lead is whether the chunk's first value is left out, gap the value that is."""
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            part = batch.slice(start, 1024)
            signature = _matrix(part.column(1))
            lead = np.tile(np.arange(VALUES) % WIDTH == 0, len(signature))
            columns = [forms(signature).ravel(), np.repeat(part.column(0).to_numpy(), VALUES), lead, signature.ravel().astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["form", "node", "lead", "gap"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, hashes) of the rows (text, node, digest) whose text has the node's set."""
    import xxhash

    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            sets = [s.tobytes() for s in shingle_sets([t.encode() for t in part.column(0).to_pylist()], WORDS)]
            own = pa.array([xxhash.xxh3_128_digest(s) == d for s, d in zip(sets, part.column(2).to_pylist(), strict=True)])
            yield pa.RecordBatch.from_arrays([part.column(1).filter(own), pa.array(sets, pa.binary()).filter(own)], names=["node", "hashes"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, hub) of the pairs whose signatures are in reach."""
    for batch in batches:
        if batch.num_rows:
            kept = (_matrix(batch.column(2)) != _matrix(batch.column(3))).sum(1) <= DISTANCE
            yield batch.select([0, 1]).filter(pa.array(kept))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of linked sets; of rows (hub, salt, side, node, hashes) each hub's own comes before those of its pairs."""
    key, hub = None, None
    for batch in batches:
        linked = []
        columns = [batch.column(k).to_pylist() for k in range(4)]
        for row, (owner, salt, side, node) in enumerate(zip(*columns, strict=True)):
            hashes = np.frombuffer(batch.column(4)[row].as_py(), np.uint64)
            if side == 0:
                key, hub = (owner, salt), hashes
            elif key == (owner, salt):
                at = np.searchsorted(hub, hashes)
                both = int(np.count_nonzero(hub[np.minimum(at, len(hub) - 1)] == hashes))
                if 100 * both >= PERCENT * (len(hub) + len(hashes) - both):
                    linked.append((node, owner))
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in linked], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _cells(decide):
    """(node, a, b) of what ``decide`` joins between the sides of each cell; rows (group, i, j, side, node, comp, value) come cell by cell.

    node is one that was joined to another component, a its own, b the first of
    the components that are joined in the cell, directly or through others.
    """

    def joined(sides: list[tuple[list, list, list]]) -> np.ndarray:
        (left, left_comp, left_value), (right, right_comp, right_value) = sides
        comps, number = np.unique(left_comp + right_comp, return_inverse=True)
        i, j = number[: len(left)], number[len(left) :]
        apart = i[:, None] != j[None, :]
        if not apart.any():
            return np.empty((0, 3), np.int64)
        met = decide(left_value, right_value) & apart
        x, y = np.nonzero(met)
        label = _least_reached(len(comps), i[x], j[y])
        at = np.concatenate((met.any(1), met.any(0)))
        return np.stack((np.array(left + right)[at], comps[number[at]], comps[label[number[at]]]), axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, 0
        sides: list[tuple[list, list, list]] = [([], [], []), ([], [], [])]
        found: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            # many cells join the same
            rows = np.unique(np.concatenate([np.empty((0, 3), np.int64), *found]), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(rows[:, k]) for k in range(3)], names=["node", "a", "b"])

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for row, (group, i, j, side, node, comp) in enumerate(zip(*columns, strict=True)):
                if (group, i, j) != key:
                    if sides[0][0] and sides[1][0]:
                        found.append(joined(sides))
                        held += len(found[-1])
                    key, sides = (group, i, j), [([], [], []), ([], [], [])]
                    if held > HELD:
                        yield out()
                        found, held = [], 0
                for column, value in zip(sides[side], (node, comp, batch.column(6)[row].as_py()), strict=True):
                    column.append(value)
        if sides[0][0] and sides[1][0]:
            found.append(joined(sides))
        yield out()

    return run


def _in_reach(left: list[bytes], right: list[bytes]) -> np.ndarray:
    a, b = (np.frombuffer(b"".join(x), np.uint16).reshape(len(x), VALUES) for x in (left, right))
    return np.array([np.count_nonzero(b != row, axis=1) <= DISTANCE for row in a])


def _linked(left: list[bytes], right: list[bytes]) -> np.ndarray:
    sets = [[np.frombuffer(v, np.uint64) for v in x] for x in (left, right)]
    both = _overlaps(*sets)
    sizes = [np.array([len(v) for v in x]) for x in sets]
    return 100 * both >= PERCENT * (sizes[0][:, None] + sizes[1][None, :] - both)


class _Join:
    def __init__(self, rows: DataFrame, scratch: Scratch):
        self.rows, self.scratch = rows, scratch
        self.described = scratch.keep(map_arrow(rows, _described, "doc_id long, n long, digest binary, signature binary"), "described")
        taking_part = self.described.where("n > 0 and doc_id is not null")
        classes = taking_part.groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.min("signature").alias("signature"))
        # numbered as they are written
        self.classes = scratch.keep(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    def entries(self) -> DataFrame:
        """(form, node) of the forms that several classes have.

        Classes that agree in a whole chunk have all five of its forms; the one
        without the first value will do, so another form is needed only where
        the values that it leaves out differ.
        """
        made = map_arrow(self.classes.select("node", "signature"), _entries, "form long, node long, lead boolean, gap int")
        ends = made.groupBy("form").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.max("lead").alias("lead"), F.min("gap").alias("low"), F.max("gap").alias("high"))
        several = self.scratch.keep(ends.where("first < last and (lead or low < high)").select("form"), "several")
        return self.scratch.keep(made.select("form", "node").join(_bounded(several), "form"), "entries")

    def unsettled(self, entries: DataFrame, labels: DataFrame | None, least: int, label: str) -> DataFrame:
        """(form, node, comp) of the forms of ``least`` classes or more, of several components."""
        if labels is None:
            return entries.withColumn("comp", F.col("node"))  # each class is a component still
        named = entries.join(_bounded(labels, 48), "node", "left").select("form", "node", F.coalesce("comp", "node").alias("comp"))
        named = self.scratch.keep(named, f"{label}-named")
        open_forms = named.groupBy("form").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m"))
        open_forms = self.scratch.keep(open_forms.where((F.col("lo") < F.col("hi")) & (F.col("m") >= least)).select("form"), f"{label}-forms")
        return self.scratch.keep(named.join(_bounded(open_forms), "form"), f"{label}-open")

    def sets(self, nodes: DataFrame, label: str) -> DataFrame:
        """(node, hashes) of classes, made from the text of one document of each."""
        asked = self.scratch.keep(self.classes.join(_bounded(nodes), "node").select("class_id", "node", "digest"), f"{label}-asked")
        texts = self.rows.join(_bounded(asked, 64), F.col("doc_id") == F.col("class_id")).select("body", "node", "digest")
        # rows that repeat an id and a text
        return self.scratch.keep(map_arrow(texts, _sets, "node long, hashes binary").dropDuplicates(["node"]), f"{label}-sets")

    def with_hubs(self, entries: DataFrame, last: bool, label: str) -> DataFrame:
        """(a, b): linked pairs of classes with the hub of one of their forms, the first class or the last."""
        keep = self.scratch.keep
        ends = (F.max if last else F.min)(F.struct("node", "comp")).alias("hub")
        hubs = keep(entries.groupBy("form").agg(ends).select("form", F.col("hub.node").alias("hub"), F.col("hub.comp").alias("hub_comp")), f"{label}-hubs")
        pairs = entries.join(_bounded(hubs, 64), "form").where((F.col("node") != F.col("hub")) & (F.col("comp") != F.col("hub_comp")))
        pairs = keep(pairs.select("node", "hub").distinct(), f"{label}-pairs")
        met = pairs.select(F.col("node").alias("k")).union(pairs.select("hub")).distinct()
        signed = keep(self.classes.join(_bounded(keep(met, f"{label}-met")), F.col("node") == F.col("k")).select("k", "signature"), f"{label}-signed")
        mine, other = signed.withColumnRenamed("signature", "mine"), signed.withColumnRenamed("signature", "other")
        near = pairs.join(_bounded(mine, 200), F.col("node") == F.col("k")).drop("k").join(_bounded(other, 200), F.col("hub") == F.col("k"))
        near = keep(map_arrow(near.select("node", "hub", "mine", "other"), _near, "node long, hub long"), f"{label}-near")
        return self.verified(near, label)

    def verified(self, pairs: DataFrame, label: str) -> DataFrame:
        """The pairs (node, hub) that are linked; a hub's set goes to as many places as its pairs take."""
        keep = self.scratch.keep
        nodes = keep(pairs.select("node").union(pairs.select("hub")).distinct(), f"{label}-nodes")
        sets = self.sets(nodes, label)
        large = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("places")).where("places > 1")
        large = keep(large, f"{label}-large")
        salted = pairs.join(_bounded(large, 48), "hub", "left").select("hub", "node", F.pmod(F.xxhash64("node"), F.coalesce("places", F.lit(1))).cast("int").alias("salt"))
        salted = keep(salted, f"{label}-salted")
        own = salted.select("hub", "salt").distinct().join(sets, F.col("hub") == F.col("node")).select("hub", "salt", F.lit(0).alias("side"), "node", "hashes")
        rest = salted.join(sets, "node").select("hub", "salt", F.lit(1).alias("side"), "node", "hashes")
        dealt = own.union(rest).repartition("hub", "salt").sortWithinPartitions("hub", "salt", "side", "node")
        return keep(map_arrow(dealt, _verified, "a long, b long"), f"{label}-linked")

    def in_cells(self, left: DataFrame, right: DataFrame, value: DataFrame, decide, cell: int, label: str) -> DataFrame:
        """(node, a, b) of what ``decide`` joins of left (group, node, comp) and right of the same group, in cells of blocks of both."""
        keep = self.scratch.keep
        sizes = [side.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / cell).cast("int").alias(name)) for side, name in ((left, "rows"), (right, "columns"))]
        sizes = keep(sizes[0].join(sizes[1], "group"), f"{label}-sizes")

        def placed(side: DataFrame, mine: str, other: str, number: int) -> DataFrame:
            own = F.pmod(F.xxhash64("node"), F.col(mine)).cast("int")
            every = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
            rows = side.join(_bounded(sizes, 48), "group").join(value, "node")
            rows = rows.select("group", own.alias(mine), every.alias(other), F.lit(number).alias("side"), "node", "comp", value.columns[1])
            return rows.select("group", F.col("rows").alias("i"), F.col("columns").alias("j"), "side", "node", "comp", value.columns[1])

        key = ["group", "i", "j"]
        dealt = placed(left, "rows", "columns", 0).union(placed(right, "columns", "rows", 1))
        dealt = dealt.repartition(*key).sortWithinPartitions(*key, "side", "node")
        return keep(map_arrow(dealt, _cells(decide), "node long, a long, b long"), f"{label}-joined")

    def outside(self, members: DataFrame, label: str) -> DataFrame:
        """Of (group, node, comp) those that aren't of the component with most members in their group."""
        sizes = members.groupBy("group", "comp").agg(F.count(F.lit(1)).alias("m"))
        largest = sizes.groupBy("group").agg(F.max(F.struct("m", "comp")).alias("largest")).select("group", F.col("largest.comp").alias("main"))
        largest = self.scratch.keep(largest, f"{label}-largest")
        return self.scratch.keep(members.join(_bounded(largest, 48), "group").where("comp != main").select("group", "node", "comp"), f"{label}-outside")

    def rest(self, entries: DataFrame) -> DataFrame:
        """(a, b): components with a link that no hub shows; entries are the forms that are open still."""
        keep = self.scratch.keep
        grouped = entries.withColumnRenamed("form", "group")
        ties = self.in_cells(self.outside(grouped, "tie"), grouped, self.classes.select("node", "signature"), _in_reach, SIGNED, "tie")
        # components that are near each other are a family; of their classes only those take part that are near another component
        families = connected(keep(ties.select("a", "b").distinct(), "family-ties"), self.scratch, "family").withColumnsRenamed({"comp": "group", "node": "own"})
        near = keep(ties.select("node", F.col("a").alias("comp")).distinct(), "near")
        members = keep(near.join(_bounded(families, 48), F.col("comp") == F.col("own")).select("group", "node", "comp"), "members")
        outside = self.outside(members, "family")
        sets = self.sets(keep(members.select("node"), "member-nodes"), "family")
        return self.in_cells(outside, members, sets, _linked, CELL, "family").select("a", "b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (whether the row's id is the component's) of every row."""
    scratch = Scratch(docs.sparkSession, "hamming-join")
    join = _Join(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("body")), scratch)
    entries = join.entries()
    links = docs.sparkSession.createDataFrame([], "a long, b long")
    labels = connected(links, scratch, "component")
    for turn in range(HUBS + 1):
        # of three classes or fewer all pairs were with a first or last one in two turns
        still = join.unsettled(entries, labels if turn else None, 4 if turn == HUBS else 2, f"turn-{turn}")
        if still.isEmpty():
            break
        links = links.union(join.with_hubs(still, turn % 2 == 1, f"turn-{turn}") if turn < HUBS else join.rest(still))
        labels = connected(links, scratch, f"component-{turn}")
    named = scratch.keep(labels.join(join.classes.select("node", "class_id"), "node"), "named-classes")
    first = scratch.keep(named.groupBy("comp").agg(F.min("class_id").alias("component_id")), "first")
    named = scratch.keep(named.join(_bounded(first, 48), "comp").select("node", "component_id"), "named")
    classes = join.classes.select(F.col("digest").alias("d"), "class_id", "node").join(_bounded(named, 48), "node", "left")
    classes = scratch.keep(classes.select("d", F.coalesce("component_id", "class_id").alias("component_id")), "result")
    out = join.described.select("doc_id", "n", "digest").join(classes, (F.col("digest") == F.col("d")) & F.col("doc_id").isNotNull(), "left")
    component: Column = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
