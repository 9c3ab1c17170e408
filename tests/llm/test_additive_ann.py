import numpy as np
import pytest

from stateloom.llm.additive_ann import Codebooks, exact_scores, fit_codebooks, nearest

SCHEMA = "vec_id long, embedding array<float>, rank int, score double"


def brute(rows, every, top):
    seen = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            seen[i] = np.array(v, np.float32).astype(float)
    ids = np.array(sorted(seen))
    x = np.array([seen[i] for i in ids])
    out = []
    for i in ids[ids % every == 0]:
        s = exact_scores(x, seen[i])
        order = [k for k in np.lexsort((ids, -s)) if ids[k] != i][:top]
        out += [(int(i), r, int(ids[k]), float(s[k])) for r, k in enumerate(order, 1)]
    return out


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)], None, None) for i in range(300)]
    rows += [(300 + i, rows[0][1], None, None) for i in range(30)]  # ties
    rows += [(400, None, None, None), (401, [0.0] * 8, None, None), (402, [1.0, None] + [0.0] * 6, None, None), (403, [float("nan")] + [1.0] * 7, None, None), (404, [1.0] * 5, None, None), (405, [float("inf")] * 8, None, None), rows[7], rows[20], (None, [1.0] * 8, None, None)]
    found = [tuple(r) for r in nearest(spark.createDataFrame(rows, SCHEMA)).select("query_id", "rank", "vec_id", "score").collect()]
    assert sorted(found) == sorted(brute(rows, 20, 20))


def test_few_and_none(spark):
    rows = [(i, [float(i + 1)] * 8, None, None) for i in range(5)]
    assert [r["vec_id"] for r in nearest(spark.createDataFrame(rows, SCHEMA)).orderBy("rank").collect()] == [4, 3, 2, 1]
    assert nearest(spark.createDataFrame([], SCHEMA)).collect() == []
    assert nearest(spark.createDataFrame([(1, [1.0] * 8, None, None)], SCHEMA)).collect() == []


def test_recall_over_several_blocks(spark, monkeypatch):
    from stateloom.llm import additive_ann

    monkeypatch.setattr(additive_ann, "ROWS_PER_BLOCK", 1000)
    monkeypatch.setattr(additive_ann, "QUERIES_PER_BLOCK", 60)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 8)).astype(np.float32)
    rows = [(i, [float(a) for a in v], None, None) for i, v in enumerate(x)]
    expected = {(q, v) for q, _, v, _ in brute(rows, 20, 20)}
    found = {(r["query_id"], r["vec_id"]) for r in nearest(spark.createDataFrame(rows, SCHEMA), rerank=60).collect()}
    assert len(found) == len(expected) and len(found & expected) / len(expected) >= 0.9


def test_beam_search_never_does_worse_than_one_path():
    x = np.random.default_rng(3).normal(size=(500, 16)).astype(np.float32)
    model = fit_codebooks(x, books=4, entries=16)
    assert isinstance(model, Codebooks)
    error = lambda beam: ((x - model.decode(model.encode(x, beam)[0])) ** 2).sum()
    assert error(8) <= error(1) * 1.001
    codes, norms = model.encode(x)
    assert np.allclose(norms, (model.decode(codes) ** 2).sum(1), atol=1e-4)


def test_many_equal_vectors(spark):
    rng = np.random.default_rng(5)
    same = rng.normal(size=8).tolist()
    rows = [(i, same if i % 2 else rng.normal(size=8).tolist(), 0) for i in range(1, 2401)]
    rows = [(i, [-x for x in same] if i % 20 == 0 and i != 20 else same if i == 20 else v, n) for i, v, n in rows]
    found = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), rerank=64).where("query_id = 20").orderBy("rank").collect()
    vectors = {i: np.array(v) for i, v, _ in rows}
    score = lambda v: float(exact_scores(v[None, :], np.array(same))[0])
    first = sorted((i for i in vectors if i != 20), key=lambda i: (-score(vectors[i]), i))[:20]
    equal = [i for i in first if score(vectors[i]) == score(np.array(same))]
    assert [r["vec_id"] for r in found if r["score"] == score(np.array(same))] == equal


@pytest.mark.parametrize("factor", [1e19, 1e100, 1e-30, 1e-150])
def test_recall_with_components_of_any_size(spark, factor):
    """Every seventh vector is scaled; overflow of scores is left to doubles, codes don't overflow."""
    x = np.random.default_rng(11).normal(size=(3000, 8))
    x[::7] *= factor
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    expected = {}
    for i in range(0, 3000, 20):
        s = exact_scores(x, x[i])
        expected[i] = [k for k in np.lexsort((np.arange(3000), -s)) if k != i][:20]
    found = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), rerank=200).collect()
    assert len(found) == 150 * 20
    hits = sum(r["vec_id"] in expected[r["query_id"]] for r in found)
    assert hits / len(found) >= 0.9


def test_of_rows_with_one_id_the_smallest_vector_counts(spark):
    rows = [(20, [1.0, 0.0]), (1, [3.0, 1.0]), (1, [2.0, 9.0]), (1, [2.0, 5.0]), (2, [1e200, 1e200])]
    found = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in found] == [(2, 1e200), (1, 2.0)]
