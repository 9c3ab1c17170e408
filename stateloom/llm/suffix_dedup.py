"""Removal of long repeated byte strings by distributed prefix doubling.

What a suffix order of a corpus tells of repeats is found by doubling: positions
that share a prefix share a rank, ranks are refined with what follows at growing
offsets, and a position leaves once its rank is unique or its prefix has reached the
threshold.  Two things keep the work near the size of the input:

* Ranks of the shortest prefixes are doubled inside each task (1, 2, 4 ...
  bytes), without a shuffle.
* Neighbouring positions go together.  Each window of ``threshold`` bytes is
  put to the position inside it whose ``CORE``-byte rank is smallest (the
  anchor).  Equal windows have equal anchors at equal offsets, so a row stands
  for a run of windows around one anchor: anchor, and least and largest offset.

A rank is a 64-bit hash made by doubling: equal bytes have equal ranks, and
different ones other ranks all but surely, but ranks don't follow the bytes'
order and aren't numbered anew.  So Spark groups rows of equal rank instead of
sorting them.  A row whose rank is unique leaves.  Rows with equal bytes all
over their windows are repeated and leave too (told by 128 bits of their bytes,
which alone decide what is removed).  The others are cut into runs of fewer
windows, whose common part is longer: at first twice the core, in the end the
threshold.  A common part is ranked by a pair, the rank of its first bytes and
the rank at a growing offset (128 after 128 bytes, then 256 after up to 144
bytes), so pairs are grouped until a row is unique, settled, or one window
whose pair covers the threshold.

A text with a short period has an anchor each period.  Where anchors of one
core follow each other at one distance and the bytes agree, a window equals the
one a period before: the stretch is settled in the task, as one span, and only
the windows of its first period stay as rows, as witnesses for other texts.

Passages counted in words (``words``) are found the same way: each word becomes a
code of ``CODE`` characters, so that many words are a string of one length in the
coded text, and windows that start at a word's code are taken back to the words.
Codes have 35 bits: other words in a window of otherwise equal ones have other codes
all but surely.  Cuts then begin and end at words.

A document's spans meet in one row: at most one for each anchor, so they are
bounded by its own length.

Defined cases: a null text is empty; texts shorter than the threshold are kept;
windows never cross documents; rows repeated in the input count as documents
of their own; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Scratch, map_arrow, text_or_empty

#: Bytes of the ranks that tasks build by doubling; a power of two.
CORE = 128
#: Characters of a word's code, and bytes of the ranks that tasks build of codes; a power of two.
CODE, CODED_CORE = 5, 64
#: Windows in a row at each refinement after that by twice the core.
RUNS = (32, 8, 1)
#: Bytes that a task ranks at a time.
BLOCK = 1 << 20

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def doubled_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit rank of the ``length`` bytes at each position, by doubling the offset."""
    rank = (data.astype(np.uint64) + np.uint64(1)) * _ODD
    rank ^= rank >> np.uint64(29)
    offset = 1
    factor = 0xD6E8FEB86659FD93
    while offset < length:
        rank = rank[:-offset] * np.uint64(factor) + rank[offset:]
        rank ^= rank >> np.uint64(31)
        factor = (factor * factor + 2 * offset) % (1 << 64)
        offset *= 2
    return rank


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def periodic_stretches(data: np.ndarray, ends: np.ndarray, piece: np.ndarray, anchor: np.ndarray, cores: np.ndarray, threshold: int, core: int) -> list[tuple[int, int, int, int]]:
    """(piece, first window, last window, period) of stretches of windows that equal the one a period before or after."""
    gap = np.diff(anchor)
    linked = np.flatnonzero((np.diff(piece) == 0) & (np.diff(cores) == 0) & (gap > 0) & (gap <= threshold - core))
    found = []
    for chain in np.split(linked, np.flatnonzero((np.diff(linked) != 1) | (np.diff(gap[linked]) != 0)) + 1) if len(linked) else ():
        period, first, stop = int(gap[chain[0]]), int(anchor[chain[0]]), int(anchor[chain[-1] + 1]) + core
        if not np.array_equal(data[first + period : stop], data[first : stop - period]):
            continue
        # the last windows have their anchor at their start: the period goes on behind its core
        ahead = data[stop : min(stop + threshold - core, int(ends[piece[chain[0]]]))]
        differ = np.flatnonzero(ahead != data[stop - period : stop - period + len(ahead)])
        last = stop + (int(differ[0]) if len(differ) else len(ahead)) - threshold
        if last >= first + 2 * period:
            found.append((int(piece[chain[0]]), first, last, period))
    return found


def anchor_rows(texts: list[bytes], threshold: int, core: int) -> Iterator[tuple[int, int, int, int, int | None, bytes]]:
    """(text number, anchor, least offset, largest offset, rank of the core, digest of all windows).

    Without a rank the row is a settled stretch of windows.
    """
    import xxhash

    digest = xxhash.xxh3_128_digest
    pending: list[tuple[int, int, bytes]] = []  # text number, where the piece starts in it, piece
    size = 0

    def rows() -> Iterator[tuple[int, int, int, int, int | None, bytes]]:
        joined = b"".join(p[2] for p in pending)
        lengths = np.array([len(p[2]) for p in pending])
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        data = np.frombuffer(joined, np.uint8)
        rank = doubled_ranks(data, core)
        # the smallest rank, the first of equal ones: rank above, position below
        packed = ((rank >> np.uint64(24)) << np.uint64(23)) | np.arange(len(rank), dtype=np.uint64)
        least = sliding_minimum(packed, threshold - core + 1)
        windows = lengths - threshold + 1
        number = np.repeat(np.arange(len(pending)), windows)
        first_window = np.concatenate(([0], np.cumsum(windows)[:-1]))
        at = np.arange(len(number)) - first_window[number] + starts[number]
        anchor = (least[at] & np.uint64((1 << 23) - 1)).astype(np.int64)
        change = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (number[1:] != number[:-1])))
        new = np.flatnonzero(change)
        stretches = periodic_stretches(data, starts + lengths, number[new], anchor[new], rank[anchor[new]].astype(np.int64), threshold, core)
        if stretches:
            settled = np.zeros(len(at) + 1, bool)
            for k, first, last, period in stretches:
                text, base, _ = pending[k]
                yield text, base + first - int(starts[k]), first - last, 0, None, b""
                shift = int(first_window[k] - starts[k])
                settled[first + period + shift : last + 1 + shift] = True
            new = np.flatnonzero(change | np.concatenate(([True], settled[1:-1] != settled[:-2])))
        low, high = at[new], at[np.concatenate((new[1:], [len(at)])) - 1]
        if stretches:
            wanted = ~settled[new]
            new, low, high = new[wanted], low[wanted], high[wanted]
        piece, anchor = number[new], anchor[new]
        cores = rank[anchor].astype(np.int64)
        for k, a, lo, hi, c in zip(piece.tolist(), anchor.tolist(), low.tolist(), high.tolist(), cores.tolist(), strict=True):
            text, base, _ = pending[k]
            yield text, base + a - int(starts[k]), a - hi, a - lo, c, digest(joined[lo : hi + threshold])

    for k, text in enumerate(texts):
        # long texts go in pieces that share all but one byte of a window
        for base in range(0, max(1, len(text) - threshold + 1), BLOCK):
            piece = text[base : base + BLOCK + threshold - 1]
            if len(piece) < threshold:
                continue
            pending.append((k, base, piece))
            size += len(piece)
            if size >= BLOCK:
                yield from rows()
                pending.clear()
                size = 0
    if pending:
        yield from rows()


_KEY = ("doc_id", "mark")


def _keyed(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("body"))


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each body as the codes of its words; the other columns stay."""
    from xxhash import xxh3_64_digest

    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            words = [_WORD.findall(t.encode()) for t in part.column(2).to_pylist()]
            digests = np.frombuffer(b"".join(xxh3_64_digest(w) for text in words for w in text), np.uint8).reshape(-1, 8)
            codes = (digests[:, :CODE] & 127).tobytes()
            ends = np.cumsum([0, *(len(text) * CODE for text in words)])
            bodies = [codes[a:b].decode("ascii") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield part.set_column(2, "body", pa.array(bodies, pa.string()))


def _anchors(threshold: int, core: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                found = list(anchor_rows([t.encode() for t in part.column(2).to_pylist()], threshold, core))
                columns = list(zip(*found, strict=True)) if found else [()] * 6
                rows = pa.array(columns[0], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(rows), part.column(1).take(rows), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.int64()), pa.array(columns[5], pa.binary())],
                    names=["doc_id", "mark", "at", "lo", "hi", "core", "whole"],
                )

    return run


def _contexts(threshold: int):
    """The bytes of all windows of each listed row of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows, at, lo, hi, held = [], [], [], [], []
                for k, (body, wanted) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                    data = body.encode()
                    for w in wanted:
                        rows.append(k)
                        at.append(w["at"])
                        lo.append(w["lo"])
                        hi.append(w["hi"])
                        held.append(data[w["at"] - w["hi"] : w["at"] - w["lo"] + threshold])
                index = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(index), part.column(1).take(index), pa.array(at, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(held, pa.binary())], names=["doc_id", "mark", "at", "lo", "hi", "held"])

    return run


def _pairs(run: int, threshold: int, core: int):
    """Rows of at most ``run`` windows: the pair of ranks of their common part, and the digest of all their bytes."""
    common = threshold - run + 1
    half = core
    while half * 2 < common:
        half *= 2

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                held = part.column(5).to_pylist()
                lo, hi = part.column(3).to_numpy(), part.column(4).to_numpy()
                base = np.cumsum([0, *(len(h) for h in held[:-1])])
                rank = doubled_ranks(np.frombuffer(b"".join(held), np.uint8), half).astype(np.int64)
                count = hi // run - lo // run + 1
                row = np.repeat(np.arange(len(held)), count)
                slot = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + (lo // run)[row]
                low, high = np.maximum(lo[row], slot * run), np.minimum(hi[row], slot * run + run - 1)
                start = base[row] + hi[row] - slot * run
                windows = [held[k][a:b] for k, a, b in zip(row.tolist(), (hi[row] - high).tolist(), (hi[row] - low + threshold).tolist(), strict=True)]
                index = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k).take(index) for k in range(3)), pa.array(slot.astype(np.int32)), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), pa.array(rank[start]), pa.array(rank[start + common - half]), pa.array([xxhash.xxh3_128_digest(w) for w in windows], pa.binary()), pa.array(windows, pa.binary())],
                    names=["doc_id", "mark", "at", "slot", "lo", "hi", "left", "right", "whole", "held"],
                )

    return cut


def _shared(rows: DataFrame, keys: list[str], scratch: Scratch, name: str) -> DataFrame:
    """Rows whose keys occur more than once.

    Counts combine before the shuffle; the join with the stored counts has a
    plain shuffle on both sides, so AQE can split hot keys.
    """
    often = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys)
    return rows.join(scratch.keep(often, name), keys, "left_semi")


def repeated_spans(keyed: DataFrame, threshold: int, scratch: Scratch, core: int = CORE, least: int | None = None, read=iter) -> DataFrame:
    """doc_id, mark, start, stop (bytes) of runs of repeated windows; runs may overlap.

    ``read`` makes the bodies that are searched, in the tasks that search them, of
    texts of ``least`` bytes or more (as a rule ``threshold``).
    """
    while core > threshold:
        core //= 2
    spark = keyed.sparkSession
    schema = "doc_id long, mark long, at long, lo int, hi int, core long, whole binary"
    find = _anchors(threshold, core)
    scratch.keep(map_arrow(keyed.where(F.octet_length("body") >= (least or threshold)), lambda batches: find(read(batches)), schema), "anchors")
    anchors = spark.read.schema(schema).parquet(scratch.path("anchors"))
    alive = scratch.keep(_shared(anchors.where("core is not null"), ["core"], scratch, "shared"), "ranked")

    def spans(rows: DataFrame) -> DataFrame:
        return rows.select(*_KEY, (F.col("at") - F.col("hi")).alias("start"), (F.col("at") - F.col("lo") + threshold).alias("stop"))

    done = [scratch.keep(spans(anchors.where("core is null")), "stretches")]
    scratch.drop("anchors", "shared")

    def settle(alive: DataFrame, core: list[str], row: list[str], name: str) -> tuple[DataFrame, DataFrame]:
        """Spans of the rows that are repeated as a whole, and the rows to look at again.

        Of rows with equal windows one stays, as a witness for others, and
        only where its core has other windows too.
        """
        exact = [*core, "lo", "hi", "whole"]
        groups = scratch.keep(alive.groupBy(*exact).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*row)).alias("one")), name)
        often = groups.where("n > 1").select(*exact)
        differ = groups.groupBy(*core).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*core)
        again = groups.join(differ, core, "left_semi").select("one.*", "lo", "hi")
        return spans(alive.join(often, exact, "left_semi")), again

    found, again = settle(alive, ["core"], [*_KEY, "at"], "groups")
    done.append(scratch.keep(found, "spans"))
    scratch.drop("ranked")
    last = "groups"
    # what is neither unique nor settled is looked at again, with its bytes
    wanted = again.groupBy(*_KEY).agg(F.collect_list(F.struct("at", "lo", "hi")).alias("wanted")).withColumnsRenamed({"doc_id": "w_id", "mark": "w_mark"})
    texts = keyed.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("mark") == F.col("w_mark")))
    contexts = _contexts(threshold)
    held = texts.select(*_KEY, "body", "wanted")
    widest = max(1, threshold - 2 * core + 1)
    cut = "doc_id long, mark long, at long, slot int, lo int, hi int, left long, right long, whole binary, held binary"
    pair = ["slot", "left", "right"]
    for run in [widest, *(r for r in RUNS if r < widest)]:
        ranked = _pairs(run, threshold, core)
        # the first time from the texts, in one Python task
        function = ranked if run < widest else lambda batches, ranked=ranked: ranked(contexts(read(batches)))
        scratch.keep(map_arrow(held, function, cut), f"cut{run}")
        scratch.drop(last)
        rows = spark.read.schema(cut).parquet(scratch.path(f"cut{run}"))
        alive = scratch.keep(_shared(rows, pair, scratch, f"shared{run}"), f"ranked{run}")
        scratch.drop(f"cut{run}", f"shared{run}")
        found, again = settle(alive, pair, [*_KEY, "at", "held"], f"groups{run}")
        done.append(scratch.keep(found, f"spans{run}"))
        scratch.drop(f"ranked{run}")
        last = f"groups{run}"
        held = again.select(*_KEY, "at", "lo", "hi", "held")
    scratch.drop(last)
    return reduce(DataFrame.unionByName, done)


def repeated_words(keyed: DataFrame, words: int, scratch: Scratch) -> DataFrame:
    """doc_id, mark, start, stop (numbers of words) of runs of repeated windows of ``words`` words; runs may overlap."""
    length = words * CODE
    # the shortest text of so many words has a letter for each
    found = repeated_spans(keyed, length, scratch, CODED_CORE, 2 * words - 1, _coded)
    first, last = F.ceil(F.col("start") / CODE), F.floor((F.col("stop") - length) / CODE)
    return found.where(first <= last).select(*_KEY, first.alias("start"), (last + words).alias("stop"))


def _in_bytes(data: bytes, spans: list) -> Iterator[tuple[int, int]]:
    words = None
    for s in spans or ():
        if not s["words"]:
            yield s["start"], s["stop"]
            continue
        words = words or [m.span() for m in _WORD.finditer(data)]
        yield words[s["start"]][0], words[s["stop"] - 1][1]


def _merge(spans: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in sorted(spans):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append([*s])
    return [(a, b) for a, b in out]


def _removed(keep_text: bool, columns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                size, gone, runs, digests, kept_texts = [], [], [], [], []
                for body, spans in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    data = body.encode()
                    merged = _merge(_in_bytes(data, spans))
                    kept = data
                    if merged:
                        edges = [0, *(e for m in merged for e in m), len(data)]
                        kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    size.append(len(data))
                    gone.append(len(data) - len(kept))
                    runs.append(len(merged))
                    digests.append(hashlib.sha256(kept).hexdigest())
                    # a cut inside a character leaves bytes that are no text
                    kept_texts.append(kept.decode("utf-8", errors="ignore") if keep_text else None)
                made = [pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string())]
                names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if keep_text:
                    made.append(pa.array(kept_texts, pa.string()))
                    names.append("kept_text")
                yield pa.RecordBatch.from_arrays([*(part.column(2 + i) for i in range(columns)), *made], names=[*part.schema.names[2 : 2 + columns], *names])

    return run


def remove_repeats(docs: DataFrame, threshold: int = 400, keep: list[str] | None = None, keep_text: bool = False, words: int | None = None) -> DataFrame:
    """The columns in ``keep`` (doc_id if not given), n_bytes, n_removed, n_spans, kept_sha256, and kept_text if asked for.

    With ``words``, passages of that many words that also stand elsewhere go too,
    whatever their bytes.
    """
    spark: SparkSession = docs.sparkSession
    keep = keep or ["doc_id"]
    scratch = Scratch(spark, "suffix-dedup")
    keyed = _keyed(docs)
    spans = repeated_spans(keyed, threshold, scratch).withColumn("words", F.lit(False))
    if words:
        spans = spans.unionByName(repeated_words(keyed, words, Scratch(spark, "suffix-dedup-words")).withColumn("words", F.lit(True)))
    found = spans.groupBy(*_KEY).agg(F.collect_set(F.struct("start", "stop", "words")).alias("__spans")).withColumnsRenamed({"doc_id": "s_id", "mark": "s_mark"})
    text = text_or_empty()
    rows = docs.select(text.alias("__body"), F.col("doc_id").cast("long").alias("__id"), F.xxhash64(text).alias("__mark"), *keep)
    joined = rows.join(found, F.col("__id").eqNullSafe(F.col("s_id")) & (F.col("__mark") == F.col("s_mark")), "left").select("__body", "__spans", *keep)
    schema = ", ".join([*(f"`{n}` {t}" for n, t in joined.dtypes[2:]), "n_bytes long, n_removed long, n_spans long, kept_sha256 string", *(["kept_text string"] if keep_text else [])])
    return map_arrow(joined, _removed(keep_text, len(keep)), schema)


def without_repeats(docs: DataFrame, threshold: int = 400, words: int = 51) -> DataFrame:
    """``docs`` with repeated bytes and repeated passages of words cut out of the texts; n_chars, if there, is counted anew."""
    others = [c for c in docs.columns if c != "text"]
    found = remove_repeats(docs.select("text", *others), threshold, [*others], keep_text=True, words=words)
    text = F.col("kept_text").alias("text")
    count = F.char_length("kept_text").cast("long").alias("n_chars")
    return found.select(*(text if c == "text" else count if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))
