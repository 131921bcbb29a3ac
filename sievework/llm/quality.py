"""Quality scores from compression with class dictionaries.

Two Zstandard dictionaries are built, from labelled good and bad text. Each chunk of a text is compressed with both; the
difference of the compressed sizes over their sum, over all chunks of the text, says which class it is more like. A
logistic map, fitted to documents that the dictionaries were not built from, makes it a probability; how much text
there was is part of the map, since short texts differ by a byte or two only.

The model is fitted on a bounded sample: MOST_LABELLED rows of each class, chosen by a hash of their ids, with their
whole texts. Every document is then scored over its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.llm.common import arrow_map

CHUNK = 512
LEVEL = 3
DICTIONARY = 64 * 1024
MOST_LABELLED = 2500
TEST_REMAINDER = 1  # rows whose crc32(id as text) mod 3 is this are never learnt from


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == TEST_REMAINDER, F.lit(False))


def chunks(data: bytes) -> list[bytes]:
    return [data[at : at + CHUNK] for at in range(0, len(data), CHUNK)]


def _dictionary(samples: list[bytes]) -> bytes:
    """A dictionary's bytes; where there is too little text to train one, the text itself."""
    try:
        if len(samples) >= 16:
            return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        pass
    return b"".join(samples)[-DICTIONARY:]


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)

    def __post_init__(self):
        self._built = None

    def __getstate__(self):
        return {"good": self.good, "bad": self.bad, "weights": self.weights, "_built": None}

    def _compressors(self):
        if self._built is None:
            self._built = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d)) if d else zstandard.ZstdCompressor(level=LEVEL) for d in (self.good, self.bad)]
        return self._built

    def measures(self, parts: list[bytes]) -> tuple[float, float]:
        """The normalised difference of sizes, positive if the good dictionary fits better, and the bytes there were."""
        good, bad = self._compressors()
        g, b = sum(len(good.compress(p)) for p in parts), sum(len(bad.compress(p)) for p in parts)
        return (b - g) / max(1, b + g), float(sum(map(len, parts)))

    def score(self, data: bytes) -> float:
        return float(_probability(_features(*self.measures(chunks(data))), np.array(self.weights)))


def _features(difference, size) -> np.ndarray:
    difference, short = np.asarray(difference, float), 1 / (1 + np.asarray(size, float) / 128)
    return np.stack([np.ones_like(short), difference * 10, short, difference * short * 10], axis=-1)


def _probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Newton's method; the ridge keeps weights finite where classes are apart."""
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = _probability(x, w)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (y - p)) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(rows: list[tuple[list[bytes], int]], sizes: dict[int, int] | None = None) -> Model:
    """From (chunks of a text, label 0 or 1); sizes says how many rows of each label these stand for. With one class or none, every score is the share of label 1 (0.5 without rows), smoothed."""
    y = np.array([label for _, label in rows], float)

    def built(of: list[tuple[list[bytes], int]]) -> Model:
        return Model(*(_dictionary([p for parts, label in of if label == q for p in parts if len(p) > 8]) for q in (1, 0)))

    if len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(b"", b"", (float(np.log(share / (1 - share))), 0.0, 0.0, 0.0))
    fold = np.arange(len(rows)) % 2
    measured = np.zeros((len(rows), 2))
    for k in (0, 1):
        model = built([r for r, f in zip(rows, fold, strict=True) if f != k])
        for i in np.flatnonzero(fold == k):
            measured[i] = model.measures(rows[i][0])
    whole = built(rows)
    n = {q: max(1, int((y == q).sum())) for q in (0, 1)}
    sizes = sizes or n
    weight = np.where(y == 1, sizes[1] / n[1], sizes[0] / n[0])
    whole.weights = tuple(_logistic(_features(measured[:, 0], measured[:, 1]), y, weight * len(y) / weight.sum()).tolist())
    return whole


def _take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [chunks((text or "").encode("utf-8")) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(parts, pa.list_(pa.binary()))], names=["doc_id", "label", "parts"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", doc_id: str = "doc_id", most: int = MOST_LABELLED) -> Model:
    """Fits a model on labelled rows that are not held out. Labels that are null or contradict each other are left out.

    `most` bounds the rows of a class that are fitted; in the calibration they stand for all labelled rows of it.
    """
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    chosen = None
    for q in (0, 1):
        part = known.where(F.col("label") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # at most 2 * most rows of 12 bytes are broadcast, and the texts of as many come back
    rows = texts.join(F.broadcast(chosen), "doc_id").transform(arrow_map(_take, "doc_id long, label int, parts array<binary>")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["parts"]))
    sizes = {0: 1, 1: 1} | {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    return fit([([bytes(p) for p in r["parts"]], r["label"]) for r in rows], sizes)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with a column score (0 to 1, higher: label 1 is likelier) in place of any of that name. Null texts are scored as empty ones."""
    rest = [c for c in docs.columns if c not in ("score", "_text")]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            measured = np.array([model.measures(chunks((t or "").encode("utf-8"))) for t in texts]).reshape(-1, 2)
            p = _probability(_features(measured[:, 0], measured[:, 1]), np.array(model.weights))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(p, pa.float64())], names=[*rest, "score"])

    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField("score", T.DoubleType())])
    return docs.select(*(F.col(f"`{c}`") for c in rest), F.col(f"`{text}`").alias("_text")).transform(arrow_map(scored, schema))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs.

    Null texts are scored as empty ones; texts of any length are read whole; equal texts have equal scores. Repeated rows count each
    time. A null doc_id stays null and is not held out. An empty table gives none; other columns, of whatever name, are ignored.
    """
    model = train(docs, labels, **options)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return score(base, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """The rows of docs that reach a score, with the columns of docs, one named score among them as it was.

    A null text is scored as an empty one. Rows are judged one by one: repeated rows and rows of equal score go or stay
    together, whatever their doc_id, null or not. Without labels of both classes every row has one and the same score. An empty table stays empty.
    """
    name = "_sievework_score"
    scored = score(docs.withColumnRenamed("score", name) if "score" in docs.columns else docs, train(docs, labels, **options))
    out = scored.where(F.col("score") >= least).drop("score")
    return out.withColumnRenamed(name, "score").select(*docs.columns) if name in out.columns else out.select(*docs.columns)
