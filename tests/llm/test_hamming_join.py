import random
import re

import numpy as np
import pytest

from stateloom.llm import hamming_join, queries
from stateloom.llm.hamming_join import DISTANCE, VALUES, forms, near_duplicates, signatures
from stateloom.llm.group_join import shingle_sets

SCHEMA = "doc_id long, text string, n long, node string"


def shingles(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 3]) for i in range(len(words) - 2)) if len(words) >= 3 else frozenset([tuple(words)])


def brute(rows):
    sets = [(r[0], shingles(r[1])) for r in rows]
    label = list(range(len(sets)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and sets[i][0] is not None and sets[j][0] is not None and 100 * len(a & b) >= 85 * len(a | b):
                label[find(i)] = find(j)
    out = []
    for i, (doc_id, s) in enumerate(sets):
        least = None if doc_id is None else min(sets[j][0] for j in range(len(sets)) if find(j) == find(i))
        out.append((doc_id, len(s), least, None if doc_id is None else least == doc_id))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def corpus(seed, families, copies, edits=(0, 0, 1, 1, 2, 3)):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 5)))
    line = " ".join(word() for _ in range(40))
    rows = []
    for _ in range(families):
        base = [word() for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(1, copies)):
            words = list(base)
            for _ in range(rng.choice(edits)):
                words[rng.randrange(len(words))] = word()
            rows.append((len(rows), " ".join(words) + ("\n" + line if rng.random() < 0.5 else ""), None, None))
    return rows


@pytest.mark.parametrize("cell", [3, 128])
def test_equals_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(hamming_join, "CELL", cell)
    monkeypatch.setattr(hamming_join, "SIGNED", cell)
    rows = corpus(cell, 40, 9) + [(5000 + i, r[1], None, None) for i, r in enumerate(corpus(7, 1, 300, (1, 2, 3, 4, 6)))]
    assert found(near_duplicates(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (2, "", None, None), (3, " \t\n", None, None), (4, "One two", None, None), (5, "one\ttwo", None, None), (6, "one", None, None), (None, "one two", None, None)]
    rows += [(7, "a b c d", None, None), (7, "x y z w", None, None), (8, "A B C D", None, None), (8, "A B C D", None, None), (9, "x y z w", None, None)]
    rows += [(20, "w " * 50_000, None, None), (21, "w " * 7, None, None), (22, " ".join(map(str, range(30_000))), None, None), (23, " ".join(map(str, range(1, 30_001))), None, None)]
    assert found(near_duplicates(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_no_rows(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query(spark, tmp_path):
    rows = corpus(11, 25, 4)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    df = queries.op12_near_duplicates(spark, f"file://{tmp_path}")
    assert df.columns == ["doc_id", "n_shingles", "component_id", "kept"] and found(df) == brute(rows)


def test_all_pairs_in_reach_share_a_form():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = rng.integers(0, 1 << 16, (1, VALUES)).astype(np.uint16)
        b = a.copy()
        b[0, rng.choice(VALUES, DISTANCE, replace=False)] += 1
        assert (forms(a) == forms(b)).any()
    # one value more, two in each chunk, and nothing is shared
    b = a.copy()
    b[0, np.arange(VALUES) % 5 < 2] += 1
    assert not (forms(a) == forms(b)).any()


def test_signatures_estimate_similarity():
    rng = random.Random(2)
    words = [str(rng.random()) for _ in range(3000)]
    other = words[:2700] + [str(rng.random()) for _ in range(300)]
    sets = shingle_sets([" ".join(w).encode() for w in (words, other)], 3)
    both = len(np.intersect1d(*sets))
    similarity = both / (len(sets[0]) + len(sets[1]) - both)
    a, b = signatures(sets)
    assert abs((a == b).mean() - similarity) < 0.15 and signatures([sets[0][:0]]).sum() == 0
