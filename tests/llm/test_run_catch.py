import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from stateloom.llm import queries
from stateloom.llm.run_catch import Catchers, collapsed, periodic_runs, runs_of


def brute(words, exponent=4, length=6):
    """Every stretch of every period, word by word, the smallest period of each."""
    n, seen = len(words), {}
    for p in range(1, n // exponent + 1):
        i = p
        while i < n:
            if words[i] != words[i - p]:
                i += 1
                continue
            start = i - p
            while i < n and words[i] == words[i - p]:
                i += 1
            if i - start >= max(length, exponent * p):
                seen.setdefault((start, i), p)
    return sorted(((s, e - s, p) for (s, e), p in seen.items()), key=lambda r: (r[0], r[2]))


def texts(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        letters = "abcdefgh"[: rng.choice([1, 2, 2, 3, 8])]
        out = []
        for _ in range(rng.randint(1, 6)):
            part = [rng.choice(letters) for _ in range(rng.randint(0, 12))]
            out += part * rng.choice([1, 1, 2, 4, 5, 9])
        yield out[: rng.randint(0, 300)]


@pytest.mark.parametrize("exponent", [2, 3, 4])
def test_equals_brute_force(exponent):
    for words in texts(exponent, 400):
        assert runs_of(words, exponent) == brute(words, exponent), words


def test_words_may_come_in_any_portions():
    rng = random.Random(5)
    for words in texts(9, 200):
        catchers, at = Catchers(), 0
        numbers = np.array([ord(w) for w in words], np.int64)
        while at < len(words):
            k = rng.choice([1, 1, 2, 7, 50])
            catchers.append(numbers[at : at + k])
            at += k
            assert catchers.runs() == brute(words[:at])


def test_very_repetitive_texts():
    a, b = ["a"], ["a", "b"]
    while len(b) < 4000:
        a, b = b, b + a
    assert runs_of(b, 3) == brute(b, 3)
    assert runs_of(["x"] * 100_000) == [(0, 100_000, 1)]
    lines = (["same"] * 6 + ["other"]) * 3000
    found = runs_of(lines)
    assert (0, 21_000, 7) in found and len(found) == 3001


def rewritten(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def due(doc_id, text):
    words = rewritten(doc_id, text)
    runs = brute(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, best[1] * 1000 // best[2] if runs else None, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(collapsed(words, runs))))


def test_query_equals_brute_force(spark, tmp_path):
    rows = [(i, " ".join(w), "en") for i, w in enumerate(texts(3, 300))]
    rows += [(1000, None, "x"), (1001, "", None), (1002, " \t\n", None), (None, "a a a a a a a", None), (3, "a\x0bb\x0ca\rb a\tb a b c", None), (3, "é é é é é é é", None)]
    rows += [(2000 + i, "w" + " tok en" * 40, None) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, runs string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op13_periodic_runs(spark, f"file://{tmp_path}")
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted((due(d, t) for d, t, _ in rows), key=str)


def test_a_long_text_and_no_texts(spark):
    rng = random.Random(1)
    words = [str(rng.randrange(50)) for _ in range(150_000)]
    words[90_000:90_000] = ["p", "q", "r"] * 5000
    df = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    (r,) = periodic_runs(df).collect()
    assert [tuple(x) for x in r["runs"] if x["length"] > 100] == [(90_000, 15_000, 3)] and len(r["collapsed"].split()) <= len(words) - 14_997
    assert periodic_runs(df.where("doc_id = 2")).collect() == []
