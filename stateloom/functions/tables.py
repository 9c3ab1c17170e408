"""Table functions on states for SQL.

    register(spark)
    SELECT * FROM successors(TABLE(SELECT state FROM states), 'cross33')
    SELECT s.state, n.jump, n.child FROM states s, LATERAL successors_of(s.state, 'cross33') n

The first takes a table in Arrow batches; Spark lets no such function stand
behind LATERAL, so the second, for few states, takes them one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..boards import board


class Successors:
    """state, jump, child of every legal jump of every state in the first column; null states have none."""

    def __init__(self) -> None:
        self.jumps: dict[str, np.ndarray] = {}

    def eval(self, states: pa.RecordBatch, name) -> Iterator[pa.Table]:
        # a constant comes as it is or as a column of its own
        name = (name.to_pylist() or ["cross33"])[0] if isinstance(name, (pa.Array, pa.ChunkedArray)) else name
        name = name.as_py() if isinstance(name, pa.Scalar) else name
        if name not in self.jumps:
            self.jumps[name] = np.array(board(name).jumps, np.int64)
        found = states.column(0).drop_null().to_numpy(zero_copy_only=False)
        for k, (occupied, target, changed) in enumerate(self.jumps[name]):
            legal = found[(found & (occupied | target)) == occupied]
            if len(legal):
                yield pa.table({"state": legal, "jump": np.full(len(legal), k), "child": legal ^ changed})


class SuccessorsOf:
    """jump, child of every legal jump of one state; a null state has none."""

    def eval(self, state: int, name: str) -> Iterator[tuple[int, int]]:
        if state is not None:
            for k, (occupied, target, changed) in enumerate(board(name).jumps):
                if state & (occupied | target) == occupied:
                    yield k, state ^ changed


def register(spark: SparkSession) -> None:
    spark.udtf.register("successors", F.arrow_udtf(Successors, returnType="state long, jump long, child long"))
    spark.udtf.register("successors_of", F.udtf(SuccessorsOf, returnType="jump long, child long"))
