"""Operator 8: toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Trained as in Wang and Manning (2012): r = log of the smoothed ratio of the n-gram's document frequency in toxic and other texts;
a logistic regression then weighs presence times r, for every n-gram whose ratio is beyond chance. It learns from a bounded sample of labelled
rows (``SAMPLE``, those of the least hash of their id) and scores every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, materialize, slices, small_batches

#: Labelled rows that take part in the fit, which one task does; all of their n-grams count.
SAMPLE = 6_000
#: A log-count ratio within this many standard errors of none (99 of 100 by chance) counts as none.
ERRORS = 2.58
SIZES, BITS = (3, 4, 5), 20
_SCALE = {n: np.array([pow(0x9E3779B97F4A7C15, j + 1, 2**64) for j in range(n)], np.uint64) for n in SIZES}


def ngrams(text: str) -> np.ndarray:
    """Bucket of each character n-gram of the lower-cased text, repeats included."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    found = []
    for n in SIZES:
        if len(points) >= n:
            h = np.full(len(points) - n + 1, n, np.uint64)
            for j in range(n):
                h += points[j : j + len(h)] * _SCALE[n][j]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            found.append((h >> np.uint64(64 - BITS)).astype(np.int32))
    return np.concatenate(found) if found else np.zeros(0, np.int32)


def _products(rows: list[np.ndarray], width: int):
    """Products of the 0/1 matrix of ``rows`` (sorted columns of each) with a vector, and of its transpose, in blocks of rows."""
    blocks, start, held = [], 0, 0
    for i, r in enumerate(rows):
        held += len(r)
        if held > 1 << 21 or i + 1 == len(rows):
            part = rows[start : i + 1]
            blocks.append((start, i + 1, np.concatenate(part), np.array([len(x) for x in part])))
            start, held = i + 1, 0

    def times(w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows))
        for a, b, at, sizes in blocks:
            total = np.concatenate([[0.0], np.cumsum(w[at])])
            ends = np.cumsum(sizes)
            out[a:b] = total[ends] - total[ends - sizes]
        return out

    def back(e: np.ndarray) -> np.ndarray:
        out = np.zeros(width)
        for a, b, at, sizes in blocks:
            out += np.bincount(at, np.repeat(e[a:b], sizes), minlength=width)
        return out

    return times, back


def ratios(p: np.ndarray, q: np.ndarray, n_p: float, n_q: float) -> np.ndarray:
    """Log-count ratio of each bucket from the toxic and other texts that have it; 0 where chance may well have made it."""
    r = np.log((p + 1) / (n_p + 2)) - np.log((q + 1) / (n_q + 2))
    return np.where((p + q > 0) & (np.abs(r) > ERRORS * np.sqrt(1 / (p + 1) + 1 / (q + 1))), r, 0.0)


def fit(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, penalty: float = 1.0, rounds: int = 200) -> tuple[np.ndarray, float]:
    """(weight of every bucket, bias): logistic regression on presence times ``scale``, by accelerated gradient steps."""
    width, n = len(scale), max(1, len(rows))
    share = min(max(float(labels.mean()) if len(labels) else 0.0, 1e-3), 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    times, back = _products(rows, width)
    w = np.zeros(width)
    if not rows:
        return w, bias
    # Bound on the curvature: a quarter of the largest eigenvalue, by power iteration.
    v, top = np.random.default_rng(1).random(width) + 0.1, 1.0
    for _ in range(8):
        v /= np.linalg.norm(v) or 1.0
        v = scale * back(times(scale * v))
        top = float(np.linalg.norm(v))
    step = 1.0 / (0.25 * (top * 1.1 + n) / n + penalty / n)
    ahead, ahead_bias, t = w.copy(), bias, 1.0
    for _ in range(rounds):
        error = (1 / (1 + np.exp(-np.clip(times(scale * ahead) + ahead_bias, -30, 30))) - labels) / n
        new = ahead - step * (scale * back(error) + penalty / n * ahead)
        new_bias = ahead_bias - step * float(error.sum())
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, ahead_bias = new + (last - 1) / t * (new - w), new_bias + (last - 1) / t * (new_bias - bias)
        moved, w, bias = float(np.linalg.norm(new - w)), new, new_bias
        if moved <= 3e-3 * float(np.linalg.norm(w)):
            break
    return w * scale, bias


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of the sample's texts. They are read twice here: once to count, once for the n-grams that the counts leave."""
    texts, labels, counts = [], [], np.zeros((2, 1 << BITS))
    for batch in slices(batches):
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts[toxic][np.unique(ngrams(text))] += 1
            texts.append(text)
            labels.append(toxic)
    labels = np.array(labels, np.float64)
    scale = ratios(counts[1], counts[0], labels.sum(), len(labels) - labels.sum())
    kept = np.flatnonzero(scale)
    place = np.full(1 << BITS, -1, np.int32)
    place[kept] = np.arange(len(kept), dtype=np.int32)
    rows = [np.unique(at[at >= 0]) for at in (place[ngrams(text)] for text in texts)]
    weights = np.zeros(1 << BITS)
    weights[kept], bias = fit(rows, labels, scale[kept])
    yield pa.RecordBatch.from_arrays([pa.array([weights.astype("<f8").tobytes()], pa.binary()), pa.array([bias])], names=["weights", "bias"])


def train(texts: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """(weight of each bucket, bias) from (doc_id, text) and (doc_id, toxic). The sample's texts are written once, by all the tasks of the scan."""
    sample = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = materialize(texts.join(F.broadcast(sample), "doc_id").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")), "labelled")
    rows = rows.orderBy(F.xxhash64("doc_id", "text"), "doc_id").limit(SAMPLE)  # ids may repeat
    found = rows.select("text", "toxic").coalesce(1).mapInArrow(_fitted, "weights binary, bias double").first()
    return np.frombuffer(found.weights, "<f8"), found.bias


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value
        heavy = weights != 0
        for batch in slices(batches):
            out = np.empty(batch.num_rows)
            for i, text in enumerate(batch.column(batch.schema.get_field_index("text")).to_pylist()):
                at = ngrams(text or "")
                out[i] = bias + weights[np.unique(at[heavy[at]])].sum()
            score = 1 / (1 + np.exp(-np.clip(out, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, "score"])

    return run


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2


def model_of(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str):
    texts = id_text(docs, id_col, text_col)
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "toxic").where(~held_out())
    return docs.sparkSession.sparkContext.broadcast(train(texts, known))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1), predicted (1 if the score is at least ``threshold``).

    Learns from rows of ``labels`` (doc_id, toxic) that aren't held out. A null text scores as an empty one, which gets
    the model's bias. Rows that repeat an id are scored each by its text; a null id is kept, its held_out is null.
    Without labelled rows every score is the same small number. Only id and text are read.
    """
    small_batches(docs.sparkSession)
    model = model_of(docs, labels, id_col, text_col)
    scored = id_text(docs, id_col, text_col).mapInArrow(_score(model), "doc_id bigint, text string, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Rows of ``docs`` that score below ``threshold``, all columns, whatever their names.

    A null text scores as an empty one, rows of a null or repeated id each by their own text. An empty table stays empty; without
    labelled rows nothing goes.
    """
    small_batches(docs.sparkSession)
    model = model_of(docs, labels, id_col, text_col)
    fields = ", ".join(f"`_{i}` {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    names = docs.columns
    text = names.index(text_col)
    plain = docs.toDF(*[f"_{i}" for i in range(len(names))]).withColumn("text", F.coalesce(F.col(f"_{text}").cast("string"), F.lit("")))
    kept = plain.mapInArrow(_score(model), f"{fields}, text string, score double").where(F.col("score") < threshold)
    return kept.drop("text", "score").toDF(*names)
