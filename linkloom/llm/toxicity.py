"""Toxicity by FTRL-proximal logistic regression over hashed n-grams and skip-grams.

A bounded sample of labelled documents trains one model, with a learning rate per
coordinate and an L1 penalty that leaves few weights; the weights are broadcast, and
every document is scored where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import id_remainder

#: labelled documents that are learned from, at most
SAMPLE = 40_000
BITS = 20
MARKS = "\"'`()[]{}<>.,;:!?*#$%&|=-_"
_M = np.uint64(0x9E3779B97F4A7C15)


def _bucket(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M
    return (x >> np.uint64(64 - BITS)).astype(np.int64)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and buckets of all words, word pairs and pairs around one word, as they occur."""
    words = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    bounds = words.offsets.to_numpy()
    coded = words.flatten().dictionary_encode()
    plain = pc.utf8_trim(pc.utf8_lower(coded.dictionary), characters=MARKS)
    hashes = hash_array(plain.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    h = hashes[coded.indices.to_numpy(zero_copy_only=False)] if len(hashes) else np.zeros(0, np.uint64)
    of = np.repeat(np.arange(len(texts)), np.diff(bounds))
    docs, buckets = [of], [_bucket(h)]
    for gap, salt in ((1, np.uint64(3)), (2, np.uint64(5))):
        if len(h) > gap:
            inside = of[gap:] == of[:-gap]
            docs.append(of[gap:][inside])
            buckets.append(_bucket((h[:-gap] * salt + h[gap:])[inside]))
    return np.concatenate(docs), np.concatenate(buckets)


def train_ftrl(
    rows: list[np.ndarray],
    toxic: np.ndarray,
    epochs: int = 6,
    alpha: float = 2.0,
    beta: float = 1.0,
    l1: float = 6.0,
    l2: float = 0.02,
) -> tuple[np.ndarray, float]:
    """Weights and bias after passes over ``rows``, each the distinct buckets of a text.

    The rarer toxic texts count more, by the root of how much rarer they are.
    """
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias = np.zeros(2)  # its own z and n, without L1
    prior = np.clip(toxic.mean() if len(toxic) else 0.5, 1e-3, 1 - 1e-3)
    start = float(np.log(prior / (1 - prior)))
    more = max(1.0, np.sqrt((1 - prior) / prior))

    def weights(at) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for at, y in zip(rows, toxic):
            w = weights(at)
            b = start - bias[0] / ((beta + np.sqrt(bias[1])) / alpha)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35)))
            g = (p - y) * (more if y else 1.0)
            root = np.sqrt(n[at])
            z[at] += g - (np.sqrt(n[at] + g * g) - root) / alpha * w
            n[at] += g * g
            bias += g - (np.sqrt(bias[1] + g * g) - np.sqrt(bias[1])) / alpha * (b - start), g * g
    return weights(slice(None)), start - bias[0] / ((beta + np.sqrt(bias[1])) / alpha)


def choose_labels(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, toxic`` of at most ``sample`` labels, by a hash of the id; texts are not touched for it."""
    known = labels.where("toxic is not null and doc_id is not null").select("doc_id", F.col("toxic").cast("double").alias("toxic"))
    total = known.count()
    part = int(min(1.0, sample / total) * (1 << 40)) if total else 0
    # labels that repeat an id are chosen together, hence the limit
    return known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < part).limit(sample)


def learn_weights(docs: DataFrame, chosen: DataFrame | None = None, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets, their weights, and the bias, from the texts of ``docs`` that ``chosen`` labels (``doc_id, toxic``).

    ``chosen`` is no longer than ``sample`` (:func:`choose_labels`), so it is sent to the documents, and
    only labelled texts move; without it ``docs`` has ``toxic`` itself.  One task learns from them
    all, since L1 and learning rates hold for what has been seen together.
    """
    texts = docs.where("text is not null")
    if chosen is None:
        labelled = texts.where("toxic is not null").select("doc_id", "text", F.col("toxic").cast("double").alias("toxic"))
        part = int(min(1.0, sample / max(1, labelled.count())) * (1 << 40))
        labelled = labelled.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) < part)
    else:
        labelled = texts.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    labelled = labelled.select("text", "toxic", F.xxhash64("doc_id", "text").alias("h"))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, toxic = [], []
        for batch in batches:
            of, buckets = features(batch.column("text"))
            order = np.argsort(of, kind="stable")
            cuts = np.searchsorted(of[order], np.arange(1, batch.num_rows))
            rows += [np.unique(x).astype(np.int32) for x in np.split(buckets[order], cuts)]
            toxic += batch.column("toxic").to_pylist()
        if rows:
            w, bias = train_ftrl(rows, np.array(toxic))
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(at, -1)), pa.array(np.append(w[at], bias))], ["bucket", "weight"]
            )

    # documents that repeat an id all have its label, hence the limit
    ordered = labelled.orderBy(F.xxhash64("h", F.lit(7)), "toxic", "text").limit(sample)
    model = ordered.select("text", "toxic").mapInArrow(train, "bucket long, weight double").toArrow()
    at, w = (model[c].to_numpy() for c in ("bucket", "weight"))
    return at[at >= 0], w[at >= 0], float(w[at == -1].sum())


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """``docs`` (all columns) with ``score``, from 0 to 1; null and empty texts get that of a text without features."""
    at, w, bias = model
    dense = np.zeros(1 << BITS, np.float32)
    dense[at] = w
    shared = docs.sparkSession.sparkContext.broadcast((dense, bias))

    @F.arrow_udf("double")
    def judge(texts: pa.Array) -> pa.Array:
        dense, bias = shared.value
        of, buckets = features(texts)
        hit = dense[buckets] != 0
        found = np.unique((of[hit] << BITS) | buckets[hit])  # a feature counts once a text
        logit = np.bincount(found >> BITS, dense[found & ((1 << BITS) - 1)], len(texts)) + bias
        return pa.array(1 / (1 + np.exp(-np.clip(logit, -35, 35))))

    return docs.select(*[c for c in docs.columns if c != "score"], judge("text").alias("score"))


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document, learned from labels not held out.

    Held out are documents whose crc32 of the id modulo ``folds`` is ``held``; a
    null id is not held out and has no label.  Repeated labels count repeatedly;
    without any label every score is 0.5.  Very long texts are scored whole; an
    empty table gives no rows; other columns are ignored.
    """
    fold = id_remainder(F.col("doc_id"), folds)
    known = labels.where(id_remainder(F.col("doc_id"), folds) != held).select("doc_id", "toxic")
    model = learn_weights(docs, choose_labels(known))
    rows = docs.select("doc_id", F.coalesce(fold == held, F.lit(False)).alias("held_out"), "text")
    return score(rows, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
