import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
import sentencepiece  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from stateloom.llm import token_cache  # noqa: E402

SCHEMA = "doc_id long, text string, digest string, n_tokens string"
ATOMS = list("ab  \n\t.'1é 　中\U0001f600sS’… ") + ["<|endoftext|>", "'s", " \x1c", "\x85", "don't ", "  12", "ͅ", "Ǆ"]


def texts(n):
    rng = random.Random(n)
    return ["".join(rng.choice(ATOMS) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_counts_equal_the_library(name):
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    some = texts(3000)
    assert token_cache.count_tokens(some, path) == [len(e.ids) for e in library.encode_batch(some, add_special_tokens=False)]


def test_piece_model():
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    assert token_cache.count_tokens(["", "a b", "中"], path) == [len(library.encode(t)) for t in ("", "a b", "中")]


def test_cache_is_filled_once_and_used(spark, tmp_path, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    some = texts(40)
    rows = [(i, some[i % 30], None, None) for i in range(60)] + [(3, some[3], None, None), (None, "null id", None, None), (77, None, None, None), (78, "x" * 40_000, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    cache = f"file://{tmp_path}/cache"
    expected = sorted(((r[0], len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows), key=str)

    def counts():
        return sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_cache.with_token_counts(df, path, cache).collect()), key=str)

    assert counts() == expected
    stored = spark.read.parquet(cache).count()
    assert stored == len({r[1] or "" for r in rows})
    assert counts() == expected and spark.read.parquet(cache).count() == stored
    # another tokenizer version has entries of its own
    monkeypatch.setattr(token_cache, "tokenizer_version", lambda p: "other")
    assert counts() == expected and spark.read.parquet(cache).count() == 2 * stored
    out = token_cache.token_counts(df.where("doc_id = 78"), path).first()
    assert out["over_limit"] == (out["n_tokens"] > 512)
    assert token_cache.token_counts(spark.createDataFrame([], SCHEMA), path).collect() == []
