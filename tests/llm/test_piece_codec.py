import hashlib
import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
import sentencepiece  # noqa: E402

from stateloom.llm.piece_codec import codec, encode_decode  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")
ATOMS = list("abcdeth  \n\t.é 　中\U0001f600▁<>0xA/s\u0000") + ["the ", "</s>", "<0x0A>", "  ", "in", "er", " tion", "ﬁ", "é", "{\n    return x;\n}"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts(n, longest):
    rng = random.Random(n)
    return ["".join(rng.choice(ATOMS) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_equals_the_library(library):
    for text in texts(4000, 25) + texts(20, 3000) + ["a" * 5000, " " * 300, "▁▁", "1234567890" * 30]:
        ids = library.encode(text, add_eos=True)
        assert codec(PATH).encode(text) == ids, text
        assert codec(PATH).decode(ids) == library.decode(ids), text


def test_decoding_any_ids(library):
    rng = random.Random(8)
    for _ in range(300):
        ids = [rng.choice([1, 2, *range(3, 3 + 128), *range(259, 32000)]) for _ in range(rng.randint(0, 20))]
        assert codec(PATH).decode(ids) == library.decode(ids), ids


def test_rows(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(texts(50, 40))] + [(50, None, "x"), (50, None, "x"), (None, "a b", None)]
    found = encode_decode(spark.createDataFrame(rows, "doc_id long, text string, ids string"), PATH, keep_text=True).collect()
    expected = []
    for doc_id, text, _ in rows:
        ids = library.encode(text or "", add_eos=True)
        expected.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(), ids, library.decode(ids)))
    assert sorted((tuple(r) for r in found), key=str) == sorted(expected, key=str)
    assert encode_decode(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
