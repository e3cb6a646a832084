"""Language identification by string kernels: blended-spectrum presence kernels, Nystroem landmarks, kernel ridge regression.

The kernel of two texts is the number of byte n-grams (1 to 3 bytes, A-Z lower-cased, other ASCII that is no letter as a
space) that both hold, over those the landmarks hold, normalised to a cosine. A bounded sample of labelled texts gives
landmarks and training rows; one-versus-rest ridge regression on the Nystroem features of the kernel folds into one matrix,
so scoring a batch of texts is two matrix products: n-gram presence by landmarks, then kernels by languages.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm.words import text_slices

ORDERS = 3
CODES = 256 + (1 << 16) + (1 << 24)
_CLEAN = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(code, text) of every n-gram within a text, order by order; a code tells order and bytes."""
    clean = _CLEAN[data].astype(np.int32)
    text = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    yield clean, text
    if len(clean) > 1:
        inside = text[1:] == text[:-1]
        yield (256 + (clean[:-1] << 8) + clean[1:])[inside], text[1:][inside]
    if len(clean) > 2:
        inside = text[2:] == text[:-2]
        yield (256 + (1 << 16) + (clean[:-2] << 16) + (clean[1:-1] << 8) + clean[2:])[inside], text[2:][inside]


def _gram_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct n-gram codes of each text, packed."""
    for batch in batches:
        for low, high, data, offsets in text_slices(batch["text"]):
            sets = []
            parts = list(grams(data, offsets))
            for t in range(high - low):
                sets.append(np.unique(np.concatenate([code[slice(*np.searchsorted(text, [t, t + 1]))] for code, text in parts])).astype("<i4").tobytes())
            part = batch.slice(low, high - low)
            yield pa.RecordBatch.from_arrays([part["lang"], part["n"], pa.array(sets, pa.binary())], ["lang", "n", "grams"])


@dataclass(frozen=True)
class Model:
    """``languages``; codes of the n-grams used; presence of each in each landmark; kernel-to-score matrix and offsets."""

    languages: tuple[str, ...]
    codes: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def kernels(self, presence: np.ndarray) -> np.ndarray:
        sizes = np.sqrt(np.maximum(presence.sum(axis=1), 1))[:, None] * np.sqrt(np.maximum(self.landmarks.sum(axis=1), 1))[None, :]
        return presence @ self.landmarks.T / sizes

    def scores(self, presence: np.ndarray) -> np.ndarray:
        return self.kernels(presence) @ self.weights + self.bias


def fit(sample: Sequence[tuple[str, np.ndarray]], landmarks: int, max_grams: int, ridge: float) -> Model | None:
    """Model from (language, distinct codes) rows; the first ``landmarks`` rows of each language are the landmarks."""
    languages = tuple(sorted({lang for lang, _ in sample}))
    if not languages:
        return None
    seen = dict.fromkeys(languages, 0)
    marks = []
    for lang, codes in sample:
        seen[lang] += 1
        if seen[lang] <= landmarks:
            marks.append(codes)
    every, held = np.unique(np.concatenate([*marks, np.zeros(0, np.int32)]), return_counts=True)
    shared = np.flatnonzero(held > 1) if (held > 1).any() else np.arange(len(every))
    codes = np.sort(every[shared[np.lexsort((every[shared], -held[shared]))[:max_grams]]])

    def presence(sets: Sequence[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(sets), len(codes)), np.float32)
        for i, s in enumerate(sets):
            out[i, np.isin(codes, s, assume_unique=True)] = 1
        return out

    base = Model(languages, codes, presence(marks), np.zeros((len(marks), 0)), np.zeros(0))
    values, vectors = np.linalg.eigh(base.kernels(base.landmarks).astype(np.float64))
    kept = values > 1e-6 * max(values.max(), 1e-12)
    project = vectors[:, kept] / np.sqrt(values[kept])
    features = base.kernels(presence([c for _, c in sample])).astype(np.float64) @ project
    mean = features.mean(axis=0)
    target = np.where(np.array([lang for lang, _ in sample])[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    centred, level = features - mean, target.mean(axis=0)
    solved = np.linalg.solve(centred.T @ centred + ridge * np.eye(centred.shape[1]), centred.T @ (target - level))
    weights = (project @ solved).astype(np.float32)
    return Model(languages, codes, base.landmarks, weights, (level - mean @ solved).astype(np.float32))


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 300, landmarks: int = 64,
    max_grams: int = 4096, ridge: float = 1.0, max_languages: int = 500,
) -> Model | None:
    """A model from at most ``per_language`` texts of each language of ``docs``, chosen by a hash of the id.

    These bounds are all that reaches the driver: packed n-gram sets of the sample and one count per language. Rows with a
    null id, text or language are no examples; without any the model is None; more than ``max_languages`` raise an error.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    counts = rows.groupBy("lang").count().limit(max_languages + 1).collect()
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not counts:
        return None
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, 4 * per_language / r["count"])))])
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    near = rows.where(place < share[F.col("lang")])
    sample = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language).select("lang", "n", "text")
    packed = sorted(sample.mapInArrow(_gram_sets, "lang string, n int, grams binary").collect(), key=lambda r: (r["lang"], r["n"]))
    return fit([(r["lang"], np.frombuffer(bytes(r["grams"]), "<i4")) for r in packed], landmarks, max_grams, ridge)


def _scorer(model: Model, cells: int = 1 << 21):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(CODES, -1, np.int16)
        place[model.codes] = np.arange(len(model.codes), dtype=np.int16)
        width, names = len(model.codes), np.array(model.languages)
        for batch in batches:
            best, sure = [], []
            for low, high, data, offsets in text_slices(batch["text"]):
                score = np.zeros((high - low, len(names)), np.float32)
                step = max(1, cells // max(width, 1))
                for a in range(0, high - low, step):
                    b = min(a + step, high - low)
                    presence = np.zeros((b - a, width), np.float32)
                    for code, text in grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
                        at = place[code]
                        held = at >= 0
                        presence[text[held], at[held]] = 1
                    score[a:b] = model.scores(presence)
                best.append(score.argmax(axis=1))
                sure.append(np.clip((score.max(axis=1).astype(np.float64) + 1) / 2, 0, 1))
            told = np.asarray(batch["has_letter"].fill_null(False))
            best, sure = np.concatenate([*best, np.zeros(0, int)]), np.concatenate([*sure, np.zeros(0)])
            out = {"lang_pred": pa.array(np.where(told, names[best] if len(best) else "", "und").tolist(), pa.string()), "score": pa.array(np.where(told, sure, 0.0))}
            yield pa.RecordBatch.from_arrays([batch["row"], *out.values()], ["row", *out])

    return run


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", carry: Sequence[str] = ("*",)) -> DataFrame:
    """Per row of ``docs``: ``row`` (its columns named in ``carry`` as one struct), ``lang_pred``, ``score`` from 0 to 1.

    The score is the winner's regression value moved from -1..1 to 0..1; equal values go to the first language by name.

    Defined cases: a null text, one without any letter, and every text under a model of no language get ``und`` and 0;
    texts of any length are read whole; repeated rows get equal results; columns of any name may be present, as they
    stay inside ``row``.
    """
    text = F.col(text_col).cast("string")
    work = docs.select(F.struct(*carry).alias("row"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("has_letter"))
    if model is None:
        return work.select("row", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    schema = T.StructType([work.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return work.mapInArrow(_scorer(model), schema)


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: crc32 of its id as text leaves 0 modulo 5; a null id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
