import os
import random

import pytest

import __spark_entry__ as entry
from stateloom.llm.decontaminate import words_of

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the of and house garden with which there when they came back".split(), "fr": "le la de maison jardin avec qui était quand ils sont revenus".split()}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) if rng.random() < 0.5 else "".join(rng.choice("abcdeghilmnorst") for _ in range(rng.randint(3, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(5)
    items = [(i, prose(rng, "en", 40) + "? " + prose(rng, "en", 5)) for i in range(10)]
    rows = [(i, prose(rng, lang := rng.choice(["en", "fr"]), rng.randint(20, 120)), lang) for i in range(150)]
    rows += [(200, rows[3][1], "en"), (201, rows[4][1] + " more", "en"), (202, "... 123 !!!", "en"), (203, None, "en")]
    shared = prose(rng, "en", 90)
    rows += [(210, prose(rng, "en", 60) + " " + shared, "en"), (211, shared + " " + prose(rng, "en", 70), "en")]
    rows += [(220, prose(rng, "en", 50) + " " + items[2][1] + " " + prose(rng, "en", 50), "en")]
    root = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], SCHEMA)
    docs.write.parquet(f"file://{root}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{root}/benchmark.parquet")
    return f"file://{root}", {r[0]: r[1] for r in rows}, shared


def test_stages_take_effect(spark, folder):
    path, texts, shared = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        docs.write.parquet(f"{path}/out-{name}")
        docs = spark.read.parquet(f"{path}/out-{name}")
        seen[name] = docs
        if name != "tokens":
            assert docs.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    ids = {name: {r["doc_id"] for r in df.select("doc_id").collect()} for name, df in seen.items()}
    everything = set(texts)
    assert everything - ids["language"] == {202, 203}
    assert ids["language"] - ids["near_duplicates"] == {200, 201}
    assert ids["repeated_passages"] == ids["near_duplicates"]
    kept = {r["doc_id"]: r for r in seen["repeated_passages"].collect()}
    assert shared not in kept[210]["text"] + kept[211]["text"] and all(kept[i]["n_chars"] == len(kept[i]["text"]) for i in kept)
    assert all(kept[i]["text"] == texts[i] for i in kept if i not in (210, 211))
    assert ids["repeated_passages"] - ids["benchmark_leaks"] == {220}
    assert ids["tokens"] == ids["benchmark_leaks"]
    run = {(r["doc_id"], r["ids_sha256"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, path).collect()}
    assert run == {(r["doc_id"], r["ids_sha256"], tuple(r["ids"])) for r in seen["tokens"].collect()}


def test_registered():
    assert "pipeline" in entry.queries() and {n.split("_")[0] for n in entry.queries() if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_leaks_of_the_tables(spark):
    """Every item that stands in a document word by word is found, and nothing else is."""
    path = "/root/testdata/sf0.001"
    found = {(r["doc_id"], r["item_id"]) for r in entry.queries()["op3_decontamination"](spark, path).collect()}
    joined = {r["doc_id"]: f" {' '.join(words_of(r['text']))} " for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    items = {r["item_id"]: f" {' '.join(words_of(r['text']))} " for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()}
    assert found == {(d, i) for d, text in joined.items() for i, item in items.items() if item in text}


def test_a_stage_drops_the_tables_before(spark, folder, monkeypatch):
    from pathlib import Path

    from stateloom.llm.storage import shared_folder

    path, texts, _ = folder
    same = lambda spark, docs, sf_dir: docs
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, same) for name in "abcd"])
    root = Path(shared_folder(spark).removeprefix("file://"))
    before = set(root.glob("pipeline-*"))
    assert corpus_pipeline.run(spark, path).count() == len(texts)
    (made,) = set(root.glob("pipeline-*")) - before
    assert [p.name for p in made.iterdir() if not p.name.startswith(".")] == ["c"]
