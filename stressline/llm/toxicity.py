"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; a sample of all texts, whatever they are, is
the unlabelled set; the class prior is the toxic share among the labelled
training rows. A linear model over hashed words and word beginnings is fitted to the
class-prior-corrected risk, whose negative part is kept from going below zero.

Labels are read only for training rows (crc32 of the id as text, modulo ``folds``, is not
``held_out``); lang, source, doc_id and labels are no inputs of a score. The fit
uses at most ``positives`` toxic and ``unlabelled`` other whole texts of any length, one for each of the first ids by a hash (of several texts the first by
digest); scores cover whole texts of all rows. A feature gets a weight if at least ``least`` positives have it and their share
exceeds the usual one by ``z_score`` standard errors; features are counted by Spark, and only those with a weight come to the driver. Null, empty and blank texts get the bias; without labels every score is the prior. A score equal to the
threshold is predicted toxic; repeated rows score alike; very long texts are scored whole; an empty table gives no rows. Of a labelled id
that is repeated any toxic row counts. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytehash import LOWER, document_chunks, word_keys, word_prefix, word_spans
from .linear import Rows, fit_nnpu, sigmoid
from .storage import Scratch

BEGINNINGS = (4, 6, 8)


def token_features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of every word without its closing punctuation, and of its first bytes."""
    s, e, doc = word_spans(data, offsets)
    if not len(s):
        return doc, s
    letter = np.ones(256, bool)
    letter[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = False
    for _ in range(4):
        e = np.where((e - s > 1) & ~letter[data[e - 1]], e - 1, e)
    low = LOWER[data]
    pre = word_prefix(low, s)
    shift = np.uint64(64 - bits)
    docs, feats = [doc], [word_keys(low, pre, s, e) >> shift]
    for n in BEGINNINGS:
        long = e - s > n
        docs.append(doc[long])
        feats.append(word_keys(low, pre, s[long], s[long] + n) >> shift)
    return np.concatenate(docs), np.concatenate(feats).astype(np.int64)


def densities(doc: np.ndarray, feat: np.ndarray, words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, value) with each feature of a document once: log2(1 + count), less by the square root in long texts."""
    both, n = np.unique(doc.astype(np.int64) << bits | feat, return_counts=True)
    doc = both >> bits
    return doc, both & ((1 << bits) - 1), np.log2(1.0 + n) * np.sqrt(100.0 / np.maximum(words[doc], 100))


def word_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.bincount(word_spans(data, offsets)[2], minlength=len(offsets) - 1)


_SETS = "key long, toxic int, features array<int>, shares array<float>"


def _feature_sets(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in document_chunks(batch.column("text")):
                doc, feat, value = densities(*token_features(data, offsets, bits), word_counts(data, offsets), bits)
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=hi - lo))]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (feat.astype(np.int32), value.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in ("key", "toxic")), *lists], names=["key", "toxic", "features", "shares"])

    return run


def _score(weights, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = weights.value
        for batch in batches:
            score = np.empty(batch.num_rows)
            for lo, hi, data, offsets in document_chunks(batch.column("text")):
                doc, feat = token_features(data, offsets, bits)
                known = weight[feat] != 0
                doc, feat, value = densities(doc[known], feat[known], word_counts(data, offsets), bits)
                score[lo:hi] = sigmoid(np.bincount(doc, weight[feat] * value, minlength=hi - lo) + weight[-1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return run


def fold_of(doc_id: Column, folds: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def _only(known):
    """Keeps the features with a weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = known.value
        for batch in batches:
            lists, shares = batch.column("features"), batch.column("shares")
            flat, ends = lists.flatten().to_numpy(), np.asarray(lists.offsets)
            keep = mask[flat]
            upto = pa.array(np.concatenate([[0], np.cumsum(keep)])[ends - ends[0]].astype(np.int32))
            kept = [pa.ListArray.from_arrays(upto, pa.array(x[keep])) for x in (flat, shares.flatten().to_numpy())]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("toxic"), *kept], names=["key", "toxic", "features", "shares"])

    return run


def _rows(table: pa.Table) -> Rows:
    lists, shares = table["features"].combine_chunks(), table["shares"].combine_chunks()
    ends = np.asarray(lists.offsets).astype(np.int64)
    return Rows(lists.flatten().to_numpy().astype(np.int64), shares.flatten().to_numpy().astype(float), ends[1:] - ends[0])


def train(docs: DataFrame, labels: DataFrame, *, folds: int = 4, held_out: int = 2, bits: int = 18, positives: int = 3000, unlabelled: int = 9000, least: int = 3, z_score: float = 4.0) -> np.ndarray:
    """Weights of the hashed features and, last, the bias."""
    seen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold_of(F.col("doc_id"), folds) != held_out))
    n, n_toxic = seen.agg(F.count("*"), F.sum("toxic")).first()
    weight = np.zeros((1 << bits) + 1)
    if not n or not n_toxic or n_toxic == n:
        share = min(max((n_toxic or 0) / n if n else 0.0, 1e-4), 1 - 1e-4)
        weight[-1] = np.log(share / (1 - share))
        return weight
    order = F.xxhash64(F.col("doc_id"), F.lit(7))
    p = seen.where("toxic = 1").select("doc_id").distinct().orderBy(order, "doc_id").limit(positives).withColumn("toxic", F.lit(1))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id"), folds) != held_out)).distinct()
    u = ids.orderBy(F.xxhash64(F.col("doc_id"), F.lit(8)), "doc_id").limit(unlabelled).withColumn("toxic", F.lit(0))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = texts.join(F.broadcast(p.union(u)), "doc_id").withColumn("key", F.xxhash64("text"))  # positives + unlabelled ids at most
    sample = sample.groupBy("doc_id", "toxic").agg(F.min(F.struct("key", "text")).alias("one")).select("toxic", "one.text", "one.key")
    sample = Scratch(docs.sparkSession, "toxicity").save(sample.mapInArrow(_feature_sets(bits), _SETS), "sample")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        weight[-1] = np.log(n_toxic / (n - n_toxic))
        return weight
    counted = sample.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(F.count_if(F.col("toxic") == 1).alias("held"), F.count_if(F.col("toxic") == 0).alias("base")).where(F.col("held") >= least).toArrow()  # 2**bits rows at most
    held, base = np.zeros(1 << bits), np.zeros(1 << bits)
    held[counted["f"].to_numpy()], base[counted["f"].to_numpy()] = counted["held"].to_numpy(), counted["base"].to_numpy()
    usual = (base + 0.5) / (sizes[0] + 1)
    known = (held >= least) & ((held / sizes[1] - usual) >= z_score * np.sqrt(usual * (1 - usual) / sizes[1]))
    table = sample.mapInArrow(_only(docs.sparkSession.sparkContext.broadcast(known)), _SETS).toArrow().sort_by("key")
    toxic = table["toxic"].to_numpy() == 1
    weight[:] = fit_nnpu(_rows(table.filter(pa.array(toxic))), _rows(table.filter(pa.array(~toxic))), n_toxic / n, 1 << bits)
    weight[:-1][~known] = 0
    return weight


def score_toxicity(docs: DataFrame, labels: DataFrame, *, folds: int = 4, held_out: int = 2, threshold: float = 0.3, bits: int = 18, **options) -> DataFrame:
    """doc_id, held_out, score, predicted; one row per input row."""
    weight = train(docs, labels, folds=folds, held_out=held_out, bits=bits, **options)
    weights = docs.sparkSession.sparkContext.broadcast(weight.astype(np.float64))  # 2**bits + 1 numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = texts.mapInArrow(_score(weights, bits), "doc_id long, score double")
    held = F.coalesce(fold_of(F.col("doc_id"), folds) == held_out, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
