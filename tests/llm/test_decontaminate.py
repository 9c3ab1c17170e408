import random

from stateloom.llm.decontaminate import Index, build_shard, find_leaks, overlap, split_item, without_leaks, words_of

DOCS, ITEMS = "doc_id long, text string, item_id long, score string", "item_id long, text string, n long"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.choice([1, 2, 2, 3, 4]))) for _ in range(n))


def brute(docs, items):
    out = set()
    for doc_id, text, *_ in docs:
        joined = " " + " ".join(words_of(text)) + " "
        for item_id, item, *_ in items:
            wanted = words_of(item)
            if item_id is not None and wanted and " " + " ".join(wanted) + " " in joined:
                out.add((doc_id, item_id))
    return out


def corpus():
    rng = random.Random(9)
    items = [(i, prose(rng, rng.randint(14, 120)).capitalize() + ("? " + prose(rng, 4) if i % 3 == 0 else "."), 0) for i in range(60)]
    docs = []
    for i in range(150):
        parts = [prose(rng, rng.randint(0, 300))]
        if i % 5 == 0:
            parts.insert(rng.randint(0, 1), rng.choice(items)[1].upper() if i % 2 else rng.choice(items)[1].replace(" ", "\n  "))
        if i % 7 == 0:
            part = rng.choice(items)[1].split()
            parts.append(" ".join(part[: len(part) // 4]))  # a fragment isn't a leak
        docs.append((i, " . ".join(parts), None, None))
    return docs, items


def test_equals_brute_force(spark):
    docs, items = corpus()
    docs += [(500, None, None, None), (501, "", None, None), (502, items[0][1] + " " + items[1][1], None, None), (502, items[0][1] + " " + items[1][1], None, None), (503, ("zz " * 30_000) + items[2][1], None, None)]
    items += [(900, None, 0), (901, "...", 0), (902, items[4][1], 0), (None, "some words", 0)]
    d, t = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    rows = find_leaks(d, t).collect()
    found = {(r["doc_id"], r["item_id"]) for r in rows}
    assert found == brute(docs, items) and len(found) == len(rows) and found
    assert all(r["question_overlap"] == 1 and r["answer_overlap"] == 1 for r in rows)
    kept = without_leaks(d, t)
    leaks = {i for i, _ in found}
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(r[0] for r in docs if r[0] not in leaks)


def test_empty_tables(spark):
    d, t = spark.createDataFrame([(1, "a b c", None, None)], DOCS), spark.createDataFrame([], ITEMS)
    assert find_leaks(d, t).collect() == [] and without_leaks(d, t).count() == 1
    assert find_leaks(d.limit(0), spark.createDataFrame([(1, "a b c", 0)], ITEMS)).collect() == []


def test_wand_equals_scoring_all():
    rng = random.Random(3)
    items = [(i, prose(rng, rng.randint(5, 40))) for i in range(300)]
    seen = {}
    for _, t in items:
        for w in set(words_of(t)):
            seen[w] = seen.get(w, 0) + 1
    shard = build_shard(items, 128, seen, len(items), 20.0)
    for _ in range(60):
        words = set(words_of(prose(rng, 30) + " " + rng.choice(items)[1]))
        terms = sorted(shard.terms[w] for w in words if w in shard.terms)
        scores = {}
        for t in terms:
            for i, v in zip(*shard.postings[t][:2], strict=True):
                scores[i] = scores.get(i, 0.0) + v
        for threshold in (0.2, 0.5):
            for low, high in ((0, None), (40, 90)):
                expected = {i for i, v in scores.items() if v >= threshold and low <= i < (high or 300)}
                assert {i for i, _ in shard.retrieve(terms, threshold, low, high)} == expected
    assert Index([shard]).search(items[0][1])[0][0] >= 1 - 1e-9


def test_parts():
    assert split_item("Who is it? The king") == (["who", "is", "it"], ["the", "king"])
    assert split_item("a b c d e f g h") == (list("abcdef"), list("gh")) and split_item("one") == ([], ["one"])
    assert overlap(list("abcd"), list("xabcy")) == 0.5 and overlap([], ["a"]) == 1.0


def test_truncated_and_edited_quotations(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(40)).capitalize() + ".", 0) for i in range(30)]
    docs, expected = [], set()
    for i, text, _ in items:
        words = text.split()
        for share in (60, 75, 88, 95):
            n = len(words) * share // 100
            edited = list(words)
            for k in range(len(words) - 9, len(words), 3):
                edited[k] = word()  # edits in the last words
            for part in (words[:n], words[-n:], edited):
                docs.append((len(docs), " ".join(word() for _ in range(20)) + " " + " ".join(part) + " and so on", None, None))
                expected.add((len(docs) - 1, i))
        docs.append((len(docs), " ".join(words[: len(words) // 4]), None, None))
    asked = (100, " ".join(word() for _ in range(30)) + "? " + " ".join(word() for _ in range(8)), 0)
    docs.append((9000, asked[1].split("?")[0], None, None))  # a question without its answer
    rows = find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame([*items, asked], ITEMS)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == expected
