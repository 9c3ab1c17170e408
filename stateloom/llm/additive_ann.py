"""Approximate nearest neighbours with additive quantisation.

A vector is stored as its length and, for its direction, the sum of one entry
from each of several full-length codebooks and the squared norm of that sum.  The codebooks start as residual
k-means and are then refitted by least squares to the codes that beam search
finds.  A query scores codes with lookup tables of its products with all
entries; the best of each block of rows are ranked again by the exact measure
on the original vectors.

Rows are dealt to blocks of bounded expected size by a hash, queries to blocks
of their own, and each pair of blocks is one group: no task holds more than
one block of either.

Defined cases: vectors that are null, zero, or hold null or non-finite
components take no part, nor do vectors of another length than most; a query
is never its own candidate; equal scores go to the smaller id, scores that
overflow to no number come last; with fewer candidates than asked for all are
returned; an empty table gives an empty result; of rows with one id the one
with the smallest vector counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import Scratch

#: Rows, at most, on which the codebooks are fitted: those smallest by a hash.
FIT_ROWS = 8192
BOOKS = 16
ENTRIES = 64
BEAM = 4
#: Rows and queries in a block, on average.
ROWS_PER_BLOCK = 8192
QUERIES_PER_BLOCK = 4096
#: Rows of each block that are ranked again for each query.
RERANK = 512


@dataclass
class Codebooks:
    books: np.ndarray  # (BOOKS, ENTRIES, dimension)

    def __post_init__(self):
        m, k, d = self.books.shape
        flat = self.books.reshape(m * k, d)
        self.products = (flat @ flat.T).reshape(m, k, m, k)
        self.norms = (flat * flat).sum(1).reshape(m, k)

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n, BOOKS) by beam search over the books, and squared norms of the sums."""
        m, k, _ = self.books.shape
        n = len(x)
        codes = np.zeros((n, 1, 0), np.int64)
        error = np.zeros((n, 1), np.float32)
        for j in range(m):
            # distance to x of a partial sum plus an entry, less what they all share
            gain = self.norms[j][None, None, :] - 2 * (x @ self.books[j].T)[:, None, :]
            total = error[:, :, None] + gain
            for i in range(j):
                total = total + 2 * self.products[i, :, j, :][codes[:, :, i]]
            wide = total.reshape(n, -1)
            best = np.argpartition(wide, min(beam, wide.shape[1] - 1) - 1, axis=1)[:, :beam]
            error = np.take_along_axis(wide, best, 1)
            parent, entry = best // k, best % k
            codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), entry[:, :, None]], axis=2)
        chosen = codes[np.arange(n), np.argmin(error, axis=1)]
        return chosen.astype(np.uint8), (self.decode(chosen) ** 2).sum(1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.books[j][codes[:, j]] for j in range(len(self.books)))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = np.argmin((centres * centres).sum(1) - 2 * x @ centres.T, axis=1)
        for j in range(x.shape[1]):
            total = np.bincount(near, x[:, j], k)
            size = np.bincount(near, minlength=k)
            centres[:, j] = np.where(size > 0, total / np.maximum(size, 1), centres[:, j])
    return centres, np.argmin((centres * centres).sum(1) - 2 * x @ centres.T, axis=1)


def fit_codebooks(x: np.ndarray, books: int = BOOKS, entries: int = ENTRIES, rounds: int = 2, seed: int = 7) -> Codebooks:
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    rest, made = x.copy(), []
    for _ in range(books):
        centres, near = _kmeans(rest, entries, rng)
        made.append(centres)
        rest -= centres[near]
    model = Codebooks(np.array(made, np.float32))
    for _ in range(rounds):
        codes, _ = model.encode(x)
        slots = codes.astype(np.int64) + np.arange(books) * entries
        both = np.zeros((books * entries, books * entries))
        for i in range(books):
            for j in range(books):
                np.add.at(both, (slots[:, i], slots[:, j]), 1.0)
        right = np.zeros((books * entries, x.shape[1]))
        for i in range(books):
            np.add.at(right, slots[:, i], x)
        # entries that no row uses stay where they are
        flat = model.books.reshape(books * entries, -1)
        keep = 1e-2 * len(x) / entries
        solved = np.linalg.solve(both + keep * np.eye(len(both)), right + keep * flat)
        model = Codebooks(solved.reshape(model.books.shape).astype(np.float32))
    return model


def usable(vectors: DataFrame) -> DataFrame:
    """id and vec (array<double>) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("vec"))
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda v: v != 0.0))
    length = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vec") == (length["n"] if length else 0))


def _matrix(column) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return array.flatten().to_numpy(zero_copy_only=False).reshape(len(array), -1)


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors (float32), and lengths as largest component and length in units of it: no size of component overflows."""
    peak = np.abs(x).max(1)
    scaled = x / peak[:, None]
    length = np.sqrt((scaled * scaled).sum(1))
    return (scaled / length[:, None]).astype(np.float32), peak, length


def build_index(rows: DataFrame, model: Codebooks) -> DataFrame:
    """Every row with its codes and stored norm."""
    sent = rows.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                unit, _, _ = directions(_matrix(batch.column(1)))
                codes, norms = sent.value.encode(unit)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms.astype(np.float32))], names=["id", "vec", "codes", "norm"])

    return rows.mapInArrow(run, "id long, vec array<double>, codes binary, norm float")


def exact_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in order of the components."""
    total = np.zeros(len(x))
    with np.errstate(over="ignore", invalid="ignore"):
        for j in range(x.shape[1]):
            total += x[:, j] * q[j]
    return total


def _search(model_sent, top: int, rerank: int):
    def run(data: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if data.num_rows and queries.num_rows:
            books = model_sent.value.books
            ids, x = data.column("id").to_numpy(), _matrix(data.column("vec"))
            codes = np.frombuffer(b"".join(data.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
            asked, q = queries.column("query_id").to_numpy(), _matrix(queries.column("query"))
            _, peak, length = directions(x)
            # lengths against the block's largest; what underflows ties at zero and is ranked again as a whole
            length = peak / peak.max() * length
            for start in range(0, len(asked), 256):
                part = q[start : start + 256]
                towards, _, _ = directions(part)
                scores = np.zeros((len(part), len(ids)), np.float32)
                for j in range(len(books)):
                    scores += (towards @ books[j].T)[:, codes[:, j]]
                scores = scores * length
                n = min(rerank, len(ids))
                # all that score as the last of the shortlist does belong to it
                least = np.partition(scores, len(ids) - n, axis=1)[:, len(ids) - n]
                for k in range(len(part)):
                    near = np.flatnonzero((scores[k] >= least[k]) & (ids != asked[start + k]))
                    exact = exact_scores(x[near], part[k])
                    first = np.lexsort((ids[near], -exact))[:top]
                    out.append((np.full(len(first), asked[start + k]), ids[near][first], exact[first]))
        columns = [np.concatenate(c) if out else np.array([], t) for c, t in zip(zip(*out, strict=True) if out else [()] * 3, (np.int64, np.int64, np.float64), strict=True)]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    return run


def nearest(vectors: DataFrame, every: int = 20, top: int = 20, rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every``, the ``top`` others of largest inner product."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "additive-ann")
    rows = usable(vectors).groupBy("id").agg(F.min("vec").alias("vec"))
    rows = scratch.keep(rows, "rows")
    total = rows.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not total:
        return empty
    slot = F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(1 << 40))
    sample = rows.where(slot < int((1 << 40) * min(1.0, FIT_ROWS / total))).select("vec").limit(2 * FIT_ROWS).toArrow()
    if sample.num_rows == 0:
        sample = rows.select("vec").limit(FIT_ROWS).toArrow()
    model = fit_codebooks(directions(_matrix(sample.column(0)))[0])
    index = scratch.keep(build_index(rows, model), "index")
    asked = index.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), F.col("vec").alias("query"))
    n_queries = asked.count()
    if not n_queries:
        return empty
    row_blocks, query_blocks = -(-total // ROWS_PER_BLOCK), -(-n_queries // QUERIES_PER_BLOCK)
    deal = lambda c, n: F.pmod(F.xxhash64(F.col(c)), F.lit(n)).cast("int")
    every_block = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = index.select("id", "vec", "codes", deal("id", row_blocks).alias("row_block"), every_block(query_blocks).alias("query_block"))
    asked = asked.select("query_id", "query", deal("query_id", query_blocks).alias("query_block"), every_block(row_blocks).alias("row_block"))
    keys = ["query_block", "row_block"]
    sent = spark.sparkContext.broadcast(model)
    run = _search(sent, top, rerank)
    found = data.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(lambda a, b: run(a, b), "query_id long, vec_id long, score double")
    # at most `top` rows of each block and query
    order = Window.partitionBy("query_id").orderBy(F.isnan("score"), F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
