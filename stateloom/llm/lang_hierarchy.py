"""Language identification in two steps: family first, then languages within it.

A text is a vector of hashed n-grams (one to four characters of the lower-cased
text, all but letters read as spaces), scaled to unit length.
Linear support vector machines separate the language families one against the
rest; inside a family, one machine for each pair of languages votes.  All are
fitted on the driver on vectors of a bounded sample of labelled rows, made from
whole texts in tasks, and applied in tasks.

Defined cases: a null text and a text without letters give ``und`` with score
0; a language that the training rows don't hold is never predicted; without
training rows every text is ``und``; repeated rows get equal results; further
columns are ignored and never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import map_arrow

#: Labelled rows used for fitting, of each language and in all: the smallest by a hash of id and text.
ROWS_PER_LANGUAGE = 600
ROWS_IN_ALL = 12_000
DIMENSIONS = 1 << 13
#: Characters that are turned into n-grams at a time.
BLOCK = 1 << 20
UNKNOWN = "und"

#: Families of common language codes; other codes are a family each.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs".split(),
    "baltic": "lt lv".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz ky".split(),
    "indo-aryan": "hi bn ur mr pa gu ne".split(),
    "sinitic": "zh yue".split(),
    "semitic": "ar he am mt".split(),
}
_FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes}


def family_of(lang: str) -> str:
    return _FAMILY_OF.get(lang.split("-")[0].lower(), lang)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def features(text: str) -> np.ndarray | None:
    """Unit vector of a text, or None without letters.  Counts are damped by a square root."""
    counts = np.zeros(DIMENSIONS)
    any_letter = False
    for start in range(0, len(text), BLOCK):
        # blocks share three characters, so that no n-gram is lost
        block = text[max(0, start - 3) : start + BLOCK].lower()
        points = np.frombuffer(f" {block} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = _letters()[points]
        any_letter = any_letter or bool(letter.any())
        points = np.where(letter, points, 32).astype(np.uint64)
        hashed = points
        for n in range(1, 5):
            if n > 1:
                hashed = hashed[:-1] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :]
            if len(hashed):
                slots = (hashed * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - 13)
                counts += np.bincount(slots.astype(np.int64), minlength=DIMENSIONS)
    if not any_letter:
        return None
    found = np.sqrt(counts)
    return (found / np.linalg.norm(found)).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, regular: float = 1e-3, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss by Nesterov's gradient method; y is -1 or 1."""
    n, d = x.shape
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    y = y.astype(np.float32)
    w = v = np.zeros(d + 1, np.float32)
    step = 1.0 / (2 * 2.0 + regular)
    for k in range(rounds):
        slack = np.maximum(0.0, 1 - y * (x @ v[:d] + v[d]))
        pull = -2 * weight * y * slack
        grad = np.append(pull @ x + np.float32(regular) * v[:d], pull.sum())
        new = v - np.float32(step) * grad
        v = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w[:d], float(w[d])


@dataclass
class Model:
    """Weights of both levels; ``pairs[family]`` lists (a, b, weights, offset), positive for a."""

    families: list[str] = field(default_factory=list)
    family_weights: np.ndarray | None = None
    family_offsets: np.ndarray | None = None
    languages: dict[str, list[str]] = field(default_factory=dict)
    pairs: dict[str, list[tuple[int, int, np.ndarray, float]]] = field(default_factory=dict)

    def predict(self, text: str | None) -> tuple[str, float]:
        x = features(text) if text and self.families else None
        if x is None:
            return UNKNOWN, 0.0
        if len(self.families) == 1:
            family, sure = self.families[0], 1.0
        else:
            margins = self.family_weights @ x + self.family_offsets
            best = int(np.argmax(margins))
            family, sure = self.families[best], _squash(margins[best])
        languages = self.languages[family]
        if len(languages) == 1:
            return languages[0], sure
        votes = np.zeros(len(languages))
        margin = np.zeros(len(languages))
        for a, b, w, offset in self.pairs[family]:
            m = float(w @ x) + offset
            votes[a if m >= 0 else b] += 1
            margin[a] += m
            margin[b] -= m
        # most votes, then the larger sum of margins, then the first name
        best = max(range(len(languages)), key=lambda i: (votes[i], margin[i], -i))
        return languages[best], float(sure * _squash(margin[best] / (len(languages) - 1)))


def _squash(margin: float) -> float:
    return float(1 / (1 + np.exp(-4 * np.clip(margin, -50, 50))))


def fit(rows: list[tuple[str, str]]) -> Model:
    """Fit both levels on (text, lang) rows."""
    usable = [(x, lang) for text, lang in rows if lang and (x := features(text or "")) is not None]
    return fit_vectors(np.array([u[0] for u in usable]), [u[1] for u in usable])


def fit_vectors(x: np.ndarray, named: list[str]) -> Model:
    model = Model()
    if not len(x):
        return model
    langs = np.array(named)
    families = np.array([family_of(n) for n in named])
    model.families = sorted(set(families))
    fitted = [fit_svm(x, np.where(families == f, 1.0, -1.0)) for f in model.families] if len(model.families) > 1 else []
    if fitted:
        model.family_weights = np.array([w for w, _ in fitted])
        model.family_offsets = np.array([b for _, b in fitted])
    for f in model.families:
        names = model.languages[f] = sorted(set(langs[families == f]))
        model.pairs[f] = []
        for a in range(len(names)):
            for b in range(a + 1, len(names)):
                mine = (langs == names[a]) | (langs == names[b])
                model.pairs[f].append((a, b, *fit_svm(x[mine], np.where(langs[mine] == names[a], 1.0, -1.0))))
    return model


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, slot, and the slots and values of the vector that aren't zero."""
    for batch in batches:
        for start in range(0, batch.num_rows, 64):
            part = batch.slice(start, 64)
            found = [features(t) for t in part.column(2).to_pylist()]
            at = [np.flatnonzero(x).astype(np.uint16) if x is not None else np.empty(0, np.uint16) for x in found]
            values = [x[k].tobytes() if x is not None else b"" for x, k in zip(found, at, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([k.tobytes() for k in at], pa.binary()), pa.array(values, pa.binary())], names=["lang", "slot", "places", "values"])


def fit_on(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """A model of at most ``rows_per_language`` rows of each language, and ROWS_IN_ALL in all, the smallest by a hash."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    shares = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(ROWS_IN_ALL).collect()}
    most = min(rows_per_language, max(1, ROWS_IN_ALL // max(1, len(shares))))
    # a threshold on the hash keeps about that many rows without sorting a hot language; equal rows count once
    slot = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    share = F.create_map(*(F.lit(v) for lang, n in shares.items() for v in (lang, int((1 << 40) * min(1.0, 1.3 * most / n))))) if shares else None
    if share is None:
        return Model()
    chosen = rows.where(slot < share[F.col("lang")]).select("lang", slot.alias("slot"), "text").dropDuplicates(["lang", "slot"])
    found = sorted(map_arrow(chosen, _vectors, "lang string, slot long, places binary, values binary").collect(), key=lambda r: (r["lang"], r["slot"]))
    taken, seen = [], {}
    for r in found:
        seen[r["lang"]] = seen.get(r["lang"], 0) + 1
        if seen[r["lang"]] <= most and r["places"]:
            taken.append(r)
    x = np.zeros((len(taken), DIMENSIONS), np.float32)
    for k, r in enumerate(taken):
        x[k, np.frombuffer(r["places"], np.uint16)] = np.frombuffer(r["values"], np.float32)
    return fit_vectors(x, [r["lang"] for r in taken])


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns in ``keep`` (doc_id if not given), prediction and score of every row."""
    keep = keep or ["doc_id"]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights for each language pair
    width = len(keep)
    # a text that is kept is sent once
    body = keep.index("text") if "text" in keep else width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = sent.value
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                found = [fitted.predict(t) for t in part.column(body).to_pylist()]
                columns = [part.column(i) for i in range(width)] + [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *names])

    chosen = docs.select(*keep, *([F.col("text").alias("__body")] if body == width else []))
    schema = ", ".join([*(f"`{n}` {t}" for n, t in chosen.dtypes[:width]), f"`{names[0]}` string, `{names[1]}` double"])
    return map_arrow(chosen, run, schema)


def held_out(id_column: str = "doc_id"):
    """Whether crc32 of the id's text leaves 2 on division by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score; fitted on the rows that aren't held out."""
    model = fit_on(docs.where(~held_out()), rows_per_language)
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, least_score: float = 0.1, rows_per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known and sure enough."""
    model = fit_on(docs.where(~held_out()), rows_per_language)
    found = predict(docs, model, docs.columns, ("__lang", "__score"))
    return found.where((F.col("__lang") != UNKNOWN) & (F.col("__score") >= least_score)).select(*docs.columns)
