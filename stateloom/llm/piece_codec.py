"""SentencePiece (merge type with byte fallback) encoding and decoding.

Encoding fills a prefix table.  For a merge-type vocabulary every prefix of a
text has one encoding, and dropping its last piece leaves the encoding of the
shorter prefix.  So the table needs one entry for each prefix, its last piece:
an automaton over the vocabulary lists the pieces that end there, and the one
that may follow the last piece of the prefix before it is stored.  The ids are
then recovered backwards from the end of the table.

Whether two pieces may stand next to each other is tested by replaying the
merges inside both: they may unless some merge across the border would come
first.

Defined cases: null and empty texts give the end id alone and decode to the
empty text; characters outside the vocabulary become byte pieces; repeated
rows are encoded again; further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import hold, map_arrow, text_or_empty

SPACE = "▁"
#: Entries of a worker's memos: words in each of two generations, of which the
#: older goes when the younger is full, and piece pairs, emptied when full.
MEMO_WORDS = 120_000
MEMO_PAIRS = 400_000
#: Longer words are not memoised.
MEMO_CHARS = 48


class PieceCodec:
    """Encoder and decoder for one model file; the model is only read, never trained."""

    def __init__(self, model_path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = model.get_piece_size()
        self.end_id = model.eos_id()
        self.unknown_id = model.unk_id()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes_of = {i: b for b, i in enumerate(self.byte_ids) if model.is_byte(i)}
        self.has_bytes = len(self.bytes_of) == 256
        self.silent = {i for i in range(size) if model.is_control(i)}
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        #: What decoding writes for each id.
        self.shown = [b"" if i in self.silent else bytes([self.bytes_of[i]]) if i in self.bytes_of else " ⁇ ".encode() if i == self.unknown_id else self.pieces[i].replace(SPACE, " ").encode() for i in range(size)]
        # a rank: the larger the score the earlier the merge
        order = sorted(plain, key=lambda i: -model.get_score(i))
        ranks: dict[str, int] = {}
        last, rank = None, -1
        for i in order:
            if model.get_score(i) != last:
                last, rank = model.get_score(i), rank + 1
            ranks[self.pieces[i]] = rank
        self.rank_of = ranks
        self.ids = {self.pieces[i]: i for i in plain}
        #: Of each piece, the merges that make it: (rank, leftmost part, rightmost part) after each.
        self.left: dict[int, list[tuple[int, str]]] = {}
        self.right: dict[int, list[tuple[int, str]]] = {}
        self.events: dict[int, list[tuple[int, str, str]]] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            parts, events = self._merged(piece)
            if parts == [piece]:
                self.events[i] = events
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.characters = {p for p in self.ids if len(p) == 1}
        # a space mark inside a piece stands only before or among other space marks; so words can be encoded one by one
        self.by_words = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        known = "".join(re.escape(c) for c in sorted(self.characters))
        self._runs = re.compile(f"[{known}]+|[^{known}]+")
        self._pairs: dict[int, bool] = {}
        self._words: dict[str, tuple[str, tuple[int, ...]]] = {}
        self._older: dict[str, tuple[str, tuple[int, ...]]] = {}

    def _merged(self, text: str) -> tuple[list[str], list[tuple[int, str, str]]]:
        """Merge ``text`` from its characters; the parts, and after each merge its rank and the outer parts."""
        parts: list[str | None] = list(text)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        rank_of = self.rank_of
        queue = []
        for i in range(len(parts) - 1):
            r = rank_of.get(parts[i] + parts[i + 1])
            if r is not None:
                queue.append((r, i, len(parts[i]) + len(parts[i + 1])))
        heapq.heapify(queue)
        events = []
        first, last = 0, len(parts) - 1
        while queue:
            r, i, n = heapq.heappop(queue)
            if parts[i] is None or after[i] >= len(parts):
                continue
            j = after[i]
            if len(parts[i]) + len(parts[j]) != n or rank_of.get(parts[i] + parts[j]) != r:
                continue
            parts[i] += parts[j]
            parts[j] = None
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            if j == last:
                last = i
            events.append((r, parts[first], parts[last]))
            if before[i] >= 0:
                k = before[i]
                r = rank_of.get(parts[k] + parts[i])
                if r is not None:
                    heapq.heappush(queue, (r, k, len(parts[k]) + len(parts[i])))
            if after[i] < len(parts):
                r = rank_of.get(parts[i] + parts[after[i]])
                if r is not None:
                    heapq.heappush(queue, (r, i, len(parts[i]) + len(parts[after[i]])))
        return [p for p in parts if p is not None], events

    def compatible(self, a: int, b: int) -> bool:
        """Whether piece ``b`` may follow piece ``a`` in an encoding."""
        key = a << 20 | b
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= MEMO_PAIRS:
                self._pairs.clear()
            known = self._pairs[key] = self._replay(a, b)
        return known

    def _replay(self, a: int, b: int) -> bool:
        left, right, rank_of = self.events[a], self.events[b], self.rank_of
        tail, head = self.pieces[a][-1], self.pieces[b][0]
        i = j = 0
        far = len(rank_of)
        while True:
            next_left = left[i][0] if i < len(left) else far
            next_right = right[j][0] if j < len(right) else far
            across = rank_of.get(tail + head, far)
            # of equal ranks the leftmost merge comes first
            if across < next_left and across <= next_right and across < far:
                return False
            if next_left == far and next_right == far:
                return True
            if next_left <= next_right:
                tail = left[i][2]
                i += 1
            else:
                head = right[j][1]
                j += 1

    def _known_run(self, text: str) -> list[int]:
        """Ids of a text of known characters."""
        if len(text) == 1:
            return [self.ids[text]]
        table = [-1] * len(text)
        pairs = self._pairs
        for end, (piece, length) in self.automaton.iter(text):
            if table[end] >= 0:
                continue
            start = end - length
            if start < 0:
                table[end] = piece
                continue
            previous = table[start]
            if previous < 0:
                continue
            fits = pairs.get(previous << 20 | piece)
            if fits or fits is None and self.compatible(previous, piece):
                table[end] = piece
        out = []
        at = len(text) - 1
        pieces = self.pieces
        while at >= 0:
            out.append(table[at])
            at -= len(pieces[table[at]])
        out.reverse()
        return out

    def _word(self, word: str) -> tuple[str, tuple[int, ...]]:
        """Ids as text, and as numbers."""
        found = self._older.get(word)
        if found is None:
            ids: list[int] = []
            for run in self._runs.findall(word):
                if run[0] in self.characters:
                    ids += self._known_run(run)
                elif self.has_bytes:
                    ids += [self.byte_ids[b] for b in run.encode()]
                else:
                    ids.append(self.unknown_id)
            found = " ".join(map(str, ids)), tuple(ids)
        if len(word) <= MEMO_CHARS:
            if len(self._words) >= MEMO_WORDS:
                self._older, self._words = self._words, {}
            self._words[word] = found
        return found

    def _split(self, text: str) -> list[str]:
        """The text after normalisation, cut where no piece can stand across."""
        marked = SPACE + text.replace(" ", SPACE)
        if not self.by_words:
            return [marked]
        out, held = [], ""
        for part in marked.split(SPACE)[1:]:
            held += SPACE
            if part:
                out.append(held + part)
                held = ""
        return out + [held] if held else out

    def words(self, text: str) -> list[tuple[str, tuple[int, ...]]]:
        if not text:
            return []
        known, make = self._words.get, self._word
        return [known(w) or make(w) for w in self._split(text)]

    def encode(self, text: str | None) -> list[int]:
        """All ids, the end id last."""
        return [i for w in self.words(text or "") for i in w[1]] + [self.end_id]

    def decode_bytes(self, ids: list[int]) -> bytes:
        """What ``ids`` write: control ids are silent, one leading space mark goes."""
        at = next((k for k, i in enumerate(ids) if i not in self.silent), None)
        if at is None:
            return b""
        raw = b"".join(map(self.shown.__getitem__, ids))
        return raw[1:] if ids[at] not in self.bytes_of and self.pieces[ids[at]].startswith(SPACE) else raw

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``; runs of byte pieces are UTF-8, and what isn't is replaced."""
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


def codec(model_path: str) -> PieceCodec:
    return hold(("pieces", model_path), lambda: PieceCodec(model_path))


def _coder(model_path: str, keep_ids: bool, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(model_path)
        end = str(coder.end_id)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                counts, digests, decoded, all_ids = [], [], [], []
                for text in part.column(1).to_pylist():
                    words = coder.words(text)
                    ids = [*chain.from_iterable([w[1] for w in words]), coder.end_id]
                    counts.append(len(ids))
                    digests.append(hashlib.sha256(" ".join([*(w[0] for w in words), end]).encode()).hexdigest())
                    decoded.append(coder.decode_bytes(ids))
                    if keep_ids:
                        all_ids.append(np.array(ids, np.int32))
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array([hashlib.sha256(t).hexdigest() for t in decoded], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    offsets = np.concatenate(([0], np.cumsum([len(i) for i in all_ids]))).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(all_ids))))
                    names.append("ids")
                if keep_text:
                    columns.append(pa.array([t.decode("utf-8", errors="replace") for t in decoded], pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def encode_decode(docs: DataFrame, model_path: str, keep_ids: bool = True, keep_text: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and, if asked for, ids and the decoded text."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded string" * keep_text
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("body"))
    return map_arrow(rows, _coder(model_path, keep_ids, keep_text), schema)
