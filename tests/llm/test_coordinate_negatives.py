import math
import random

import numpy as np

from stateloom.llm import coordinate_negatives, queries
from stateloom.llm.coordinate_negatives import LONGEST, Wanted, band, buckets, hard_negatives, scores, search

SCHEMA = "vec_id long, embedding array<float>, label int, id string, score string"


def usable(rows):
    held = {}
    for i, vec, label, *_ in rows:
        if i is None or label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        row = (label, [math.floor(256 * float(np.float32(x))) for x in vec])
        held[i] = min(held.get(i, row), row)
    return held


def brute(rows, every=50, positives=5, negatives=3, low=50, high=95):
    held = usable(rows)
    dot = lambda a, b: max(-LONGEST - 1, min(LONGEST, sum(x * y for x, y in zip(a, b, strict=True))))
    out = []
    for a, (label, vec) in held.items():
        if a % every:
            continue
        others = [(b, other, dot(vec, v)) for b, (other, v) in held.items() if b != a and len(v) == len(vec)]
        for p, ps in sorted(((b, s) for b, other, s in others if other == label), key=lambda r: (-r[1], r[0]))[:positives]:
            fit = sorted(((b, s) for b, other, s in others if other != label and low * ps <= 100 * s <= high * ps), key=lambda r: (-r[1], r[0]))
            out += [(a, p, k, b, ps, s) for k, (b, s) in enumerate(fit[:negatives], 1)]
    return sorted(out)


def made(seed, n, scale=1.0, labels=4):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(12)] for _ in range(labels)]
    rows = []
    for i in range(n):
        label = 0 if rng.random() < 0.35 else rng.randrange(labels)
        near = centres[label if rng.random() < 0.8 else rng.randrange(labels)]
        length = rng.choice([1, 1, 1, 0.01, 3]) * scale
        rows.append((i, [length * (c + rng.gauss(0, 0.2)) for c in near], label, "x", None))
    return rows


def found(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(coordinate_negatives, "ROWS_PER_BLOCK", 150)
    monkeypatch.setattr(coordinate_negatives, "ANCHORS_PER_BLOCK", 20)
    monkeypatch.setattr(coordinate_negatives, "SAMPLE", 60)
    rows = made(1, 1500)
    assert found(hard_negatives(spark.createDataFrame(rows, SCHEMA), every=10)) == brute(rows, every=10)


def test_odd_rows(spark):
    rows = made(2, 300)
    rows += [rows[0], rows[50], (50, [9.0] * 12, 3, None, None)]  # repeated ids
    rows += [(100, [0.0] * 12, 1, None, None), (150, [-0.001] * 12, 1, None, None), (1000, None, 1, None, None), (1050, [1.0] * 12, None, None, None), (None, [1.0] * 12, 1, None, None)]
    rows += [(1100, [1.0, None], 1, None, None), (1150, [float("nan")] * 12, 1, None, None), (1200, [float("inf")] * 12, 1, None, None), (1250, [], 2, None, None), (1300, [], 2, None, None), (1251, [], 3, None, None)]
    rows += [(1350 + i, [0.5, 0.25, i / 64], i % 2, None, None) for i in range(60)]  # another length, many ties
    rows += [(5000 + i, rows[1][1], 2, None, None) for i in range(200)]  # equal vectors
    rows += [(6000 + 10 * i, [float(2 ** (20 + 3 * i))] * 12, i % 2, None, None) for i in range(6)]  # scores beyond doubles and 64 bits
    rows += [(7000 + i, [3e38, -3e38] * 6, i % 2, None, None) for i in range(2)]
    assert found(hard_negatives(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_no_rows(spark):
    df = spark.createDataFrame([(7, [1.0], 1, None, None)], SCHEMA)
    assert hard_negatives(df).collect() == [] and hard_negatives(df.where("vec_id = 0")).collect() == []


def test_query_changes_labels(spark, tmp_path):
    rows = made(4, 400, labels=10)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    changed = [(i, v, (label + 1) % 10 if i % 7 == 0 else label) for i, v, label, *_ in rows]
    assert found(queries.op11_hard_negatives(spark, f"file://{tmp_path}")) == brute(changed)


def test_pruning_leaves_out_rows_but_no_result():
    rng = np.random.default_rng(3)
    rows = np.floor(256 * rng.normal(0, 0.1, (3000, 32)))
    rows[:3] = rows[3:6] + 1
    norms = np.sqrt((rows * rows).sum(1))
    ids = np.arange(3000)
    looked = []
    for a in range(3):
        wanted = Wanted([-LONGEST], [LONGEST], [None], 5)
        made = buckets(rows, norms)
        search(made, ids, a, rows[a], norms[a], wanted)
        full = scores(rows, rows[a])
        order = [i for i in np.lexsort((ids, -full)) if i != a][:5]
        assert wanted.kept[0][0].tolist() == order
        focus = np.argsort(-np.abs(rows[a]))[: coordinate_negatives.FOCUS]
        least = int(full[a + 3])
        near = [b.at[c] for b in made if (c := b.candidates(rows[a], norms[a], focus, least)) is not None]
        kept = np.concatenate(near)
        looked.append(len(kept))
        assert set(np.flatnonzero(full >= least)) <= set(kept.tolist())
    assert max(looked) < 1500  # of 3000


def test_band():
    for score in (-7, -1, 0, 1, 3, 100, 12345):
        low, high = band(score, 50, 95)
        assert [n for n in range(-200, 13000) if 50 * score <= 100 * n <= 95 * score] == list(range(low, high + 1))
