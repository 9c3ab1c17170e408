import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from stateloom.llm.suffix_dedup import BLOCK, anchor_rows, doubled_ranks, remove_repeats, sliding_minimum, without_repeats

SCHEMA = "doc_id long, text string, body string, spans string"


def brute(rows, threshold):
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(d[i : i + threshold] for _, d in data for i in range(len(d) - threshold + 1))
    out = []
    for doc_id, d in data:
        gone = [False] * len(d)
        for i in range(len(d) - threshold + 1):
            if seen[d[i : i + threshold]] > 1:
                gone[i : i + threshold] = [True] * threshold
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def rows_of(df):
    return [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()]


def corpus(seed, n, size):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(size)) for _ in range(6)]
    docs = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rng.randint(0, size)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            cut = rng.randint(0, len(p))
            parts.append(rng.choice([p, p[:cut], p[cut:], p[:cut] + "X" + p[cut + 1 :]]))
            parts.append(" ".join(word() for _ in range(rng.randint(0, 8))))
        docs.append((i, " ".join(parts), None, None))
    return docs


@pytest.mark.parametrize("threshold,size", [(40, 30), (400, 200), (150, 120)])
def test_equals_brute_force(spark, threshold, size):
    rows = corpus(threshold, 40, size)
    rows += [(100, rows[0][1], None, None), (101, "ab" * 300, "x", "y"), (102, "z" * 500, None, None), (103, None, None, None), (104, "", None, None)]
    found = rows_of(remove_repeats(spark.createDataFrame(rows, SCHEMA), threshold))
    assert sorted(found) == sorted(brute(rows, threshold))


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(str(i) for i in range(300))
    rows = [(7, text, None, None), (7, text, None, None), (None, "short", None, None), (7, "other", None, None)]
    found = rows_of(remove_repeats(spark.createDataFrame(rows, SCHEMA), 400))
    assert sorted(found, key=str) == sorted(brute(rows, 400), key=str)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_kept_text_drops_cut_characters(spark):
    shared = "é" * 250
    rows = [(1, "aé" + shared, None, None), (2, "b" + shared + "c", None, None)]
    found = {r["doc_id"]: r["kept_text"] for r in remove_repeats(spark.createDataFrame(rows, SCHEMA), 400, keep_text=True).collect()}
    assert found[2].startswith("b") and "�" not in found[1] + found[2]


def test_ranks_depend_on_the_bytes_alone():
    data = np.frombuffer(b"abcdefgh" * 3, np.uint8)
    ranks = doubled_ranks(data, 8)
    assert len(ranks) == 17 and ranks[0] == ranks[8] == ranks[16] and len(set(ranks.tolist())) == 8


def test_sliding_minimum():
    values = np.random.default_rng(3).integers(0, 99, 1000).astype(np.uint64)
    assert sliding_minimum(values, 37).tolist() == [values[i : i + 37].min() for i in range(964)]


def test_periodic_texts_equal_brute_force(spark):
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    rows = []
    for period in (1, 2, 3, 7, 64, 128, 129, 200, 272, 273, 300):
        unit = letters(period)
        for length in (399, 400, 401, 400 + period, 400 + 2 * period, 399 + 3 * period, 3000):
            rows.append((len(rows), letters(rng.randint(0, 50)) + (unit * 3000)[:length] + letters(rng.randint(0, 50)), None, None))
        # a stretch that no other text has, one that breaks off, and one window of it
        unit = letters(period)
        rows.append((len(rows), (unit * 3000)[:2500] + letters(500) + (unit * 3000)[:900], None, None))
        rows.append((len(rows), (letters(period) * 3000)[:2500], None, None))
        unit = letters(period)
        rows.append((len(rows), letters(30) + (unit * 3000)[:2000] + letters(30), None, None))
        rows.append((len(rows), letters(30) + (unit * 3000)[5 : 405 + period // 2] + letters(30), None, None))
    found = rows_of(remove_repeats(spark.createDataFrame(rows, SCHEMA), 400))
    assert sorted(found) == sorted(brute(rows, 400))


@pytest.mark.parametrize("unit", [b"a", b"ab", b"lorem ipsum dolor "])
def test_periodic_texts_have_few_rows(unit):
    text = unit * (2 * BLOCK // len(unit))
    rows = list(anchor_rows([text], 400, 128))
    assert len(rows) <= 40 + 4 * (2 * len(unit))
    # settled windows and those of rows are all there are
    covered = np.zeros(len(text) - 399, bool)
    for _, at, lo, hi, core, _ in rows:
        covered[at - hi : at - lo + 1] = True
        assert core is None or hi - lo <= 272
    assert covered.all()


def plain_words(rows, words, threshold=400):
    """Texts without the bytes of repeated strings of ``threshold`` bytes and of repeated passages of ``words`` words."""
    data = {i: (t or "").encode() for i, t in rows}
    at = {i: [m.span() for m in re.finditer(rb"[^ \t-\r]+", d)] for i, d in data.items()}
    grams = {i: [tuple(data[i][a:b] for a, b in s[k : k + words]) for k in range(len(s) - words + 1)] for i, s in at.items()}
    seen = Counter(g for found in grams.values() for g in found)
    strings = Counter(d[k : k + threshold] for d in data.values() for k in range(len(d) - threshold + 1))
    out = {}
    for i, d in data.items():
        gone = bytearray(len(d))
        for k, g in enumerate(grams[i]):
            if seen[g] > 1:
                a, b = at[i][k][0], at[i][k + words - 1][1]
                gone[a:b] = b"1" * (b - a)
        for k in range(len(d) - threshold + 1):
            if strings[d[k : k + threshold]] > 1:
                gone[k : k + threshold] = b"1" * threshold
        out[i] = bytes(b for b, g in zip(d, gone, strict=True) if not g).decode(errors="ignore")
    return out


def test_passages_of_over_50_words(spark):
    """They go from every text, under 400 bytes too; 50 words stay, and white space between the words doesn't count."""
    rng = random.Random(51)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    short, longer, fifty, wide = prose(51), prose(57), prose(50), " ".join("é" * rng.randint(9, 12) + word() for _ in range(30))
    assert len(short.encode()) < 400 and len(longer.encode()) < 400 and len(wide.encode()) > 400
    rows = [(1, f"{prose(20)} {short} {prose(9)}"), (2, f"{short}\n{prose(30)}"), (3, f"{prose(5)} {longer}"), (4, f"{longer.replace(' ', '  ')} {prose(70)} {fifty}")]
    rows += [(5, f"x {fifty} y"), (6, f"{prose(3)} {wide}"), (7, f"{wide} {prose(60)}"), (8, "the " * 90), (9, f"{prose(4)} {short} {longer} {prose(4)} {short}"), (10, None), (11, prose(51)), (12, "a " * 51)]
    rows += [(20 + k, " ".join(longer.split()[k % 7 :]) + " " + prose(k)) for k in range(20)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    found = {r["doc_id"]: r["text"] for r in without_repeats(docs).collect()}
    assert found == plain_words(rows, 51)
    assert short not in "".join(found.values()) and longer not in "".join(found.values())
    assert fifty in found[4] and fifty in found[5] and found[11] == dict(rows)[11]
