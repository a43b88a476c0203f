"""Language identification: sparse multinomial logistic regression on TF-IDF weights of
character n-grams, trained with follow-the-regularised-leader and elastic-net
penalties, then calibrated by temperature.

Features are runs of one to three characters (letters in lower case; anything else is
one separator), hashed into 65,536 places. Document frequencies are counted over all
learnable documents. The classifier is fitted on a sample of at most about ``per_language``
labelled documents of each language (by a hash of the id), and the temperature on a
fifth of the sample that the fit doesn't see. Prediction reads whole texts.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import payloads

PLACES, LARGEST = 1 << 16, 3
PER_LANGUAGE = 1000
UNKNOWN = "und"
_BLOCK = 1 << 20
_SPREAD = np.uint32(2654435761)  # fixed value: 2^32 over the golden ratio, Knuth's hash multiplier


@dataclass(frozen=True)
class Penalties:
    """Of the learner: step size, its damping, and the elastic net's two weights."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.001
    epochs: int = 3


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), dtype=bool, count=0x110000)


def ngram_counts(text: bytes) -> np.ndarray | None:
    """Occurrences by place of all n-grams; None without a letter."""
    points = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le"), dtype="<u4")
    is_letter = _letters()[points]
    if not is_letter.any():
        return None
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # one separator after a word
    words = np.where(is_letter, points, 32)[keep]
    chars = np.concatenate([[32], words, [32] * bool(words[-1] != 32)]).astype(np.uint32)
    counts = np.zeros(PLACES, dtype=np.int64)
    for start in range(0, len(chars), _BLOCK):
        block = chars[start : start + _BLOCK + LARGEST - 1]
        run = np.zeros(len(block), dtype=np.uint32)
        for size in range(1, LARGEST + 1):
            run = (run[: len(block) - size + 1] + block[size - 1 :] + np.uint32(size)) * _SPREAD
            places = run[:_BLOCK] >> np.uint32(16)
            counts += np.bincount(places, minlength=PLACES)
            run = (run ^ (run >> np.uint32(15)))[: max(len(block) - size, 0)]
    return counts


def weights_of(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and TF-IDF weights, of length 1."""
    places = np.flatnonzero(counts)
    values = (1 + np.log(counts[places])) * idf[places]
    return places, values / max(np.linalg.norm(values), 1e-12)


class Learner:
    """Follow the regularised leader, one weight for each place and language, and a bias."""

    def __init__(self, languages: int, penalties: Penalties):
        self.penalties = penalties
        self.z = np.zeros((PLACES + 1, languages))
        self.n = np.zeros((PLACES + 1, languages))

    def weights(self, places: np.ndarray) -> np.ndarray:
        p, z, n = self.penalties, self.z[places], self.n[places]
        l1 = np.where(places < PLACES, p.l1, 0.0)[:, None]
        w = (np.sign(z) * l1 - z) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2)
        return np.where(np.abs(z) > l1, w, 0.0)

    def learn(self, places: np.ndarray, values: np.ndarray, label: int) -> None:
        places, values = np.append(places, PLACES), np.append(values, 1.0)
        w = self.weights(places)
        error = softmax(values @ w)
        error[label] -= 1
        gradient = values[:, None] * error
        n = self.n[places]
        step = (np.sqrt(n + gradient**2) - np.sqrt(n)) / self.penalties.alpha
        self.z[places] += gradient - step * w
        self.n[places] = n + gradient**2


def softmax(logits: np.ndarray) -> np.ndarray:
    powers = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return powers / powers.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits, 0.05 to 20, under which the labels are likeliest."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        return -np.log(softmax(logits / np.exp(log_t))[np.arange(len(labels)), labels] + 1e-300).mean()

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):  # golden section
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


@dataclass(frozen=True)
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # places and the bias, by language
    temperature: float

    def predict(self, text: bytes) -> tuple[str, float]:
        counts = ngram_counts(text) if self.languages else None
        if counts is None:
            return UNKNOWN, 0.0
        places, values = weights_of(counts, self.idf)
        chances = softmax((values @ self.weights[places] + self.weights[PLACES]) / self.temperature)
        best = int(chances.argmax())
        return self.languages[best], float(chances[best])


def held_out() -> Column:
    """Every third document by a checksum of its id; a null id counts as an empty one."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each place occurs, and the number of documents with letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(PLACES + 1, dtype=np.int64)
        for batch in batches:
            for text in payloads(batch.column(0)):
                if (counts := ngram_counts(text)) is not None:
                    seen[:PLACES] += counts > 0
                    seen[PLACES] += 1
        places = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(seen[places])], names=["place", "n"])

    sums = docs.select(F.col("text").cast("string")).mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    total = np.zeros(PLACES + 1, dtype=np.int64)
    found = sums.toArrow()  # at most 65,537 rows
    total[found["place"].to_numpy()] = found["n"].to_numpy()
    return total[:PLACES], int(total[PLACES])


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, penalties: Penalties = Penalties()) -> Model:
    """Learn from the rows of ``docs`` (doc_id, text, lang) that aren't held out.

    Rows with a null lang count in the document frequencies only; texts without a
    letter teach nothing. Without a row to learn from the model knows no language.
    """
    learnable = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(~held_out())
    labelled = learnable.where("lang is not null and text is not null")
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    nothing = Model([], np.zeros(PLACES), np.zeros((PLACES + 1, 0)), 1.0)
    if not languages:
        return nothing
    frequencies, number = document_frequencies(learnable)
    idf = np.log((1 + number) / (1 + frequencies)) + 1
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30))
    rate = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1.0, per_language / n) * (1 << 30)))))
    sample = labelled.where(draw < rate[F.col("lang")]).select("doc_id", "text", "lang")
    shared = docs.sparkSession.sparkContext.broadcast((languages, idf))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, idf = shared.value
        for batch in batches:
            out = []
            for text, lang, order in zip(payloads(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if (counts := ngram_counts(text)) is not None:
                    places, values = weights_of(counts, idf)
                    out.append((languages.index(lang), order, places, values))
            columns = list(zip(*out)) or [()] * 4
            types = (pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["label", "turn", "places", "values"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, kept = [], []
        for batch in batches:
            for label, turn, places, values in zip(*(batch.column(k) for k in range(4))):
                row = (places.values.to_numpy(), values.values.to_numpy().astype(np.float64), label.as_py())
                (kept if turn.as_py() % 5 == 0 else rows).append(row)
        if not rows and not kept:
            return
        learner = Learner(len(languages), penalties)
        for _ in range(penalties.epochs):
            for row in rows or kept:
                learner.learn(*row)
        weights = learner.weights(np.arange(PLACES + 1))
        logits = np.array([values @ weights[places] + weights[PLACES] for places, values, _ in kept]).reshape(-1, len(languages))
        packed = io.BytesIO()
        np.savez_compressed(packed, weights=weights, temperature=temperature(logits, np.array([label for *_, label in kept], dtype=int)))
        yield pa.RecordBatch.from_arrays([pa.array([packed.getvalue()])], names=["model"])

    chosen = sample.select("text", "lang", F.xxhash64("doc_id", F.lit("order")).alias("turn"))
    vectors = chosen.mapInArrow(features, "label int, turn long, places array<int>, values array<float>")
    models = vectors.repartition(1).sortWithinPartitions("turn", "label", "places").mapInArrow(learn, "model binary").collect()
    if not models:
        return nothing
    found = np.load(io.BytesIO(models[0].model))
    return Model(languages, idf, found["weights"], float(found["temperature"]))


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score, from the whole text alone; ``und`` with score 0
    for a null text, one without a letter, or a model that knows no language. Columns
    of these names are replaced; repeated rows and null ids are kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("lang_pred", "score")
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            out = [model.predict(text) for text in payloads(batch["text"])]
            langs, scores = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"]
            )

    from pyspark.sql import types as T

    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return kept.mapInArrow(run, schema)
