"""Token counts through a digest cache.

A text's key is the SHA-256 digest of its normalised content together with the
digest of the tokenizer's file and library version.  Keys are joined to a
stored table of counts; one text for each missing key is encoded and its count
is appended to the table, which the final join then reads.

Defined cases: null counts as the empty text (0 bytes, 0 tokens); repeated
texts are encoded once and every row gets its count; repeated rows stay
repeated; an empty table gives an empty result; further columns of the input
are ignored and cannot clash.  The tokenizer has no normaliser, so the
normalised content is the text itself.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Scratch, map_arrow, text_or_empty

#: Texts of these characters alone may go through the rank encoder: the letter,
#: digit and space classes of all Unicode versions agree on them.
_SETTLED = re.compile(r"[\x00-\u024f\u2010-\u2027]*")

@lru_cache(maxsize=4)
def _json_tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def _piece_processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=4)
def _specials(path: str) -> tuple[str, ...]:
    tokenizer = _json_tokenizer(path)
    return tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for bytes."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def _rank_encoder(path: str):
    """The same byte-level vocabulary as a rank encoder, or None where its ids aren't merge ranks.

    It gives the same tokens several times faster.  That holds if there is
    no normaliser, the pre-tokenizer is the plain byte-level one, and merge
    number i makes id 256 + i.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space", True) and pre.get("use_regex", True) and model.get("type") == "BPE" and not model.get("ignore_merges") and not model.get("dropout")
    if not plain:
        return None
    vocab = model["vocab"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
        return None
    import tiktoken

    alphabet = _byte_alphabet()
    ranks = {bytes(alphabet[c] for c in token): i for token, i in vocab.items() if i < 256 + len(pairs)}
    # fixed value: the pattern of the byte-level pre-tokenizer
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(texts: list[str], path: str) -> list[int]:
    """Token counts of whole texts as the library for ``path`` gives them."""
    if path.endswith(".model"):
        return [len(ids) for ids in _piece_processor(path).encode(texts, num_threads=1)]
    tokenizer, ranks, specials = _json_tokenizer(path), _rank_encoder(path), _specials(path)
    out = []
    for text in texts:
        if ranks is not None and _SETTLED.fullmatch(text) and not any(s in text for s in specials):
            out.append(len(ranks.encode_ordinary(text)))
        else:
            out.append(len(tokenizer.encode(text, add_special_tokens=False).ids))
    return out


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file and of the library that reads it."""
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        for block in iter(lambda: f.read(1 << 20), b""):
            digest.update(block)
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    digest.update(library.__version__.encode())
    return digest.hexdigest()


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                counts = count_tokens(part.column(1).to_pylist(), path)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return run


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def with_token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each input row: id, n_bytes, digest, n_tokens.

    ``cache_path`` names the Parquet table of counts (digest, n_tokens,
    tokenizer); it is made when absent, and the misses are appended to it.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer_path)
    text = text_or_empty(text_column)
    light = docs.select(F.col(id_column).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("digest"))

    def stored() -> DataFrame:
        found = spark.read.schema("digest string, n_tokens long, tokenizer string").parquet(cache_path)
        return found.where(F.col("tokenizer") == version).select("digest", "n_tokens")

    # one row id for each missing digest; the join on (digest, row) is even however many copies a text has
    wanted = light.groupBy("digest").agg(F.min("id").alias("rep"))
    if _exists(spark, cache_path):
        wanted = wanted.join(stored(), "digest", "left_anti")
    full = docs.select(F.col(id_column).alias("id"), text.alias("body"), F.sha2(text, 256).alias("digest"))
    wanted = wanted.withColumnRenamed("digest", "want")
    misses = full.join(wanted, (F.col("digest") == F.col("want")) & F.col("id").eqNullSafe(F.col("rep")), "left_semi")
    encoded = map_arrow(misses.select("digest", "body"), _encoder(tokenizer_path), "digest string, n_tokens long")
    encoded = encoded.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    encoded.withColumn("tokenizer", F.lit(version)).write.mode("append").parquet(cache_path)
    counts = stored().groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return light.join(counts, "digest").select(F.col("id").alias(id_column), "n_bytes", "digest", "n_tokens")


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, cache_path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""
    cache_path = cache_path or Scratch(docs.sparkSession, "token-cache").path("counts")
    counted = with_token_counts(docs, tokenizer_path, cache_path)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
