import os
import zlib

import pytest
from pyspark.sql import functions as F

from stateloom.llm.lang_hierarchy import accepted, family_of, features, fit, held_out, identify

DATA = "/root/testdata/sf0.01"
SAMPLES = {
    "en": "the house and the garden with those things which were there when they came back",
    "de": "das haus und der garten mit den dingen die dort waren als sie wieder zurück kamen",
    "fr": "la maison et le jardin avec les choses qui étaient là quand ils sont revenus hier",
    "es": "la casa y el jardín con las cosas que estaban allí cuando ellos volvieron ayer",
}


def test_two_levels():
    rows = [(" ".join(t.split()[i:] + t.split()[:i]), lang) for lang, t in SAMPLES.items() for i in range(10)]
    model = fit(rows)
    assert model.families == ["germanic", "romance"] and model.languages["romance"] == ["es", "fr"]
    assert all(model.predict(t)[0] == lang for lang, t in SAMPLES.items())
    assert model.predict(None) == model.predict("123 ...") == ("und", 0.0)
    assert fit([]).predict("text") == ("und", 0.0) and fit([("abc", "xx"), ("abd", "xx")]).predict("zzz")[0] == "xx"


def test_blocks_of_long_texts(monkeypatch):
    from stateloom.llm import lang_hierarchy

    text = "Añb çde " * 400
    whole = features(text)
    monkeypatch.setattr(lang_hierarchy, "BLOCK", 64)
    assert abs(features(text) - whole).max() < 0.1 and family_of("pt-BR") == "romance" and family_of("tlh") == "tlh"


def test_rows(spark):
    rows = [(i, t, lang, "s", "s") for i, (lang, t) in enumerate(list(SAMPLES.items()) * 30)] + [(900, None, "en", "s", "s"), (901, "...", None, "s", "s"), (None, "der garten", None, "s", "s"), (5, "...", "de", "s", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, lang_pred string")
    found = identify(df).collect()
    assert len(found) == len(rows)
    by = {r["doc_id"]: r for r in found}
    assert by[900]["lang_pred"] == by[901]["lang_pred"] == "und" and by[None]["held_out"] is False
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found if r["doc_id"] is not None)
    kept = accepted(df)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3
    assert identify(df.limit(0)).collect() == []


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    right, n = found.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("long")), F.count(F.lit(1))).first()
    assert n > 100 and right / n >= 0.98
    assert docs.where(held_out()).count() > 0
