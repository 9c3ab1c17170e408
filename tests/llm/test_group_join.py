import random
import re

import pytest

from stateloom.llm import group_join
from stateloom.llm.group_join import connected, shingle_sets, similar_components
from stateloom.llm.storage import Scratch

SCHEMA = "doc_id long, text string, n long, comp string"


def shingles(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)])


def brute(rows):
    sets = [(r[0], shingles(r[1])) for r in rows]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and sets[i][0] is not None and sets[j][0] is not None and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    out = []
    for i, (doc_id, s) in enumerate(sets):
        ids = [sets[j][0] for j in range(len(sets)) if find(j) == find(i)]
        out.append((doc_id, len(s), None if doc_id is None else min(ids)))
    return out


def found(df):
    return [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()]


def corpus(seed, families, copies):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 5)))
    line = " ".join(word() for _ in range(12))
    rows, doc_id = [], 0
    for _ in range(families):
        base = [word() for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(1, copies)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                words[rng.randrange(len(words))] = word()
            text = " ".join(words)
            if rng.random() < 0.5:
                text += "\n" + line
            rows.append((doc_id, text, None, None))
            doc_id += 1
    return rows


@pytest.mark.parametrize("seed,families,copies,longest", [(1, 25, 8, 32), (2, 3, 40, 4)])
def test_equals_brute_force(spark, monkeypatch, seed, families, copies, longest):
    monkeypatch.setattr(group_join, "SMALL", longest)
    monkeypatch.setattr(group_join, "BLOCK", 2 * longest)
    monkeypatch.setattr(group_join, "FREQUENT", 6)
    rows = corpus(seed, families, copies)
    rows += [(900, None, None, None), (901, " \n\t", None, None), (902, "One two", None, None), (903, "one  TWO", None, None), (904, "one two three", None, None), (None, rows[0][1], None, None), (0, rows[0][1], None, None)]
    assert sorted(found(similar_components(spark.createDataFrame(rows, SCHEMA))), key=str) == sorted(brute(rows), key=str)


def test_empty_table(spark):
    assert similar_components(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sets_do_not_depend_on_neighbours():
    texts = ["a b c d e f", "", "x", "é B c\x0bd E f g", "a b c d e f"]
    alone = [shingle_sets([t.encode()])[0].tolist() for t in texts]
    assert [s.tolist() for s in shingle_sets([t.encode() for t in texts])] == alone
    assert [len(s) for s in alone] == [len(shingles(t)) for t in texts]


def test_connected_chain(spark, tmp_path):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["comp"] for r in connected(edges, Scratch(spark, "chain"), "t").collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


@pytest.mark.parametrize("longest,block", [(4, 8), (4, 256), (1000, 256)])
def test_links_equal_brute_force(spark, monkeypatch, longest, block):
    monkeypatch.setattr(group_join, "SMALL", longest)
    monkeypatch.setattr(group_join, "FREQUENT", 6)
    monkeypatch.setattr(group_join, "BLOCK", block)
    rows = corpus(3, 4, 45)
    rows += [(900, rows[0][1], None, None), (901, None, None, None), (0, rows[-1][1] + " other", None, None), (0, "a b c d e f g h", None, None)]  # id 0 has three texts
    sets = [(r[0], shingles(r[1])) for r in rows]
    classes = {s for _, s in sets if s}
    degree = {s: sum(100 * len(s & t) >= 80 * len(s | t) for t in classes if t != s) for s in classes}
    out = similar_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["n_links"]) for r in out) == sorted((i, len(s), degree.get(s, 0)) for i, s in sets)
    assert max(degree.values()) > 8
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=str) == sorted(brute(rows), key=str)


def test_one_of_each_where_ids_repeat(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(7, a, 1), (7, b, 2), (3, f"{a} more", 3), (9, b, 4), (9, b, 5), (None, a, 6), (8, None, 7), (8, "", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra int")
    kept = group_join.one_of_each(df)
    assert kept.columns == df.columns
    found = sorted(map(tuple, kept.collect()), key=str)
    assert [r for r in found if r[0] in (7, 3, 9)] == [(3, f"{a} more", 3), (7, b, 2)]
    assert sorted(r[2] for r in found if r[0] not in (7, 3, 9)) == [6, 7, 8]


def test_one_of_each_keeps_the_smallest_id(spark):
    a = " ".join(f"a{i}" for i in range(60))
    df = spark.createDataFrame([(5, a), (2, f"{a} x"), (4, "other words that stand alone here"), (None, a)], "doc_id long, text string")
    assert sorted(r["doc_id"] or 0 for r in group_join.one_of_each(df).collect()) == [0, 2, 4]


@pytest.fixture
def stored(monkeypatch):
    """Rows of each intermediate table of the last call."""
    rows, keep = {}, Scratch.keep

    def counted(self, df, name):
        out = keep(self, df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(Scratch, "keep", counted)
    return rows


@pytest.mark.parametrize("short", [1, 3, 1000])
def test_short_and_long_lists_find_the_same_links(spark, monkeypatch, short):
    monkeypatch.setattr(group_join, "SHORT", short)
    monkeypatch.setattr(group_join, "FREQUENT", 6)
    rows = corpus(5, 12, 14)
    sets = [(r[0], shingles(r[1])) for r in rows]
    classes = {s for _, s in sets}
    degree = {s: sum(100 * len(s & t) >= 80 * len(s | t) for t in classes if t != s) for s in classes}
    out = similar_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["n_links"]) for r in out) == sorted((i, len(s), degree[s]) for i, s in sets)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == sorted(brute(rows))


def test_passages_in_common_by_chance_make_no_family(spark, monkeypatch, stored):
    monkeypatch.setattr(group_join, "BLOCK", 4)
    dealt = []
    for n in (40, 80):
        rng = random.Random(n)
        words = [[f"{rng.getrandbits(40):x}" for _ in range(100)] for _ in range(n)]
        for mine, other in zip(words, words[1:]):  # each shares a passage with the next
            other[:12] = mine[50:62]
        texts = [" ".join(w) for w in words]
        df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *(f"{t} more" for t in texts[: n // 4])])], "doc_id long, text string")
        assert sum(r["n_links"] for r in similar_components(df).collect()) == 2 * (n // 4)
        dealt.append(stored["group-placed"])
    assert dealt == [20, 40]  # the planted copies, each in one cell


def test_common_line_of_short_texts_makes_no_family(spark, stored):
    rng = random.Random(1)
    word = lambda: f"{rng.getrandbits(40):x}"
    line = " ".join(word() for _ in range(12))
    df = spark.createDataFrame([(i, " ".join(word() for _ in range(25)) + f"\n{line}") for i in range(80)], "doc_id long, text string")
    assert all(r["doc_id"] == r["component_id"] for r in similar_components(df).collect())
    assert stored["ties"] == 0


def test_one_of_each_moves_no_texts(spark):
    a = " ".join(f"a{i}" for i in range(60))
    df = spark.createDataFrame([(5, a), (2, f"{a} x"), (None, a)], "doc_id long, text string").repartition(2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = group_join.one_of_each(df)
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["doc_id"] or 0 for r in out.collect()) == [0, 2]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
