"""Quality classifier from weak labels.

Overlapping heuristic labellers vote on every text: bad, good or no opinion.
Expectation-maximisation over the vote patterns (counted over all rows; the
number of patterns depends on the labellers alone) estimates how each labeller
votes on good and on bad texts, without any given label, and so the posterior of every
pattern. A linear scorer over hashed word endings, word shapes and
repeats is then fitted to the posteriors of at most ``fit_rows`` whole texts of any length, one for each of the
first ids by a hash, and scores all texts. Of a text in the fit the ``fit_features`` features with the largest shares of its words
are held, which bounds the driver. A text stays when its score is ``keep_from`` or more.

Null, empty and blank texts score 0 and go. Repeated rows score alike; a score equal to ``keep_from`` stays; of several texts
under one sampled id the first by digest is used. Very long texts are scored whole. An empty table gives no rows. Other columns, whatever
their names, are not read; ``keep_good`` passes them through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import document_chunks, ending_keys, mix, word_hashes
from .linear import Rows, fit_soft, sigmoid

#: A labeller says bad from the first value on, good up to the second, nothing between.
LABELLERS: dict[str, tuple[float, float]] = {
    "capitals": (0.5, 0.1),
    "shouted_words": (0.2, 0.02),
    "symbols": (0.04, 0.005),
    "symbol_endings": (0.2, 0.02),
    "adjacent_repeats": (0.3, 0.05),
    "few_distinct": (0.75, 0.55),
    "bars": (0.15, 0.02),
    "no_small_letters": (0.35, 0.12),
}
BAD, GOOD, NONE = 1, 2, 0


Words = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def measures(data: np.ndarray, offsets: np.ndarray, found: Words | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(documents x labellers, words of each document); found is word_hashes where that is known already."""
    n_docs = len(offsets) - 1
    h, s, e, doc = found or word_hashes(data, offsets)
    words = np.bincount(doc, minlength=n_docs)
    owner = np.repeat(np.arange(n_docs), np.diff(offsets))
    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    symbol = np.isin(data, np.frombuffer(b"#$%&*@^~=+<>|{}\\", np.uint8))
    count = lambda x: np.bincount(owner, x, minlength=n_docs)
    by_word = lambda x: np.bincount(doc, x, minlength=n_docs) / np.maximum(words, 1)
    upper_n, lower_n = count(upper), count(lower)
    ends = data[e - 1] if len(e) else np.zeros(0, np.uint8)
    small = np.concatenate([[0], np.cumsum(lower)])
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((h, doc))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order], fresh, minlength=n_docs)
    expected = np.maximum(1.0, np.minimum(words, 3 * np.power(np.maximum(words, 1), 0.75)))
    out = np.stack(
        [
            upper_n / np.maximum(upper_n + lower_n, 1),
            by_word(ends == ord("!")),
            count(symbol) / np.maximum(np.diff(offsets), 1),
            by_word(symbol[e - 1] if len(e) else ends),
            by_word(again),
            1 - distinct / expected,
            by_word((e - s == 1) & (data[s] == ord("|")) if len(s) else ends),
            by_word((small[e] == small[s]) if len(s) else ends),
        ],
        axis=1,
    )
    return out, words


def votes(data: np.ndarray, offsets: np.ndarray, found: Words | None = None) -> np.ndarray:
    """Vote pattern of each document: one base-3 digit a labeller."""
    value, words = measures(data, offsets, found)
    code = np.zeros(len(words), np.int64)
    for j, (bad, good) in enumerate(LABELLERS.values()):
        v = np.where(value[:, j] >= bad, BAD, np.where(value[:, j] <= good, GOOD, NONE))
        code = code * 3 + np.where(words > 0, v, NONE)
    return code


def pattern_votes(codes: np.ndarray, n: int) -> np.ndarray:
    return np.stack([(codes // 3 ** (n - 1 - j)) % 3 for j in range(n)], axis=1)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, *, rounds: int = 200, bad_share: float = 0.2, misfire: float = 0.01) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of good for each pattern, P(vote | class) [labeller, class, vote], share of good).
    Class 0 is bad. It starts from labellers that are right more often than not. Each kind of
    bad text fires a few labellers only, so one kind alone would fit the two classes best; that a
    labeller says bad on at most ``misfire`` of the good texts keeps the kinds together."""
    n = patterns.shape[1]
    theta = np.tile(np.array([[0.3, 0.3, 0.4], [0.3, misfire, 0.7 - misfire]]), (n, 1, 1))
    good = 1 - bad_share
    post = np.full(len(counts), good)
    for _ in range(rounds):
        log = np.log(theta[np.arange(n), :, patterns]).sum(axis=1) + np.log([1 - good, good])
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        done = np.abs(new - post).max() < 1e-7 if len(post) else True
        post = new
        total = counts.sum()
        good = float(np.clip((post * counts).sum() / max(total, 1), 1e-4, 1 - 1e-4))
        for j in range(n):
            for v in range(3):
                at = patterns[:, j] == v
                theta[j, 0, v] = ((1 - post[at]) * counts[at]).sum() + 0.5
                theta[j, 1, v] = (post[at] * counts[at]).sum() + 0.5
        theta /= theta.sum(axis=2, keepdims=True)
        theta[:, 1, BAD] = np.minimum(theta[:, 1, BAD], misfire)
        theta /= theta.sum(axis=2, keepdims=True)
        if done:
            break
    return post, theta, good


def hashed_features(data: np.ndarray, offsets: np.ndarray, bits: int, found: Words | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, value): the share of a document's words with each ending, shape, word start and repeat."""
    n_docs = len(offsets) - 1
    h, s, e, doc = found or word_hashes(data, offsets)
    if not len(h):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0)
    words = np.bincount(doc, minlength=n_docs)
    kind = np.full(256, 4, np.uint8)
    kind[128:] = 1
    kind[97:123] = 1
    kind[65:91] = 2
    kind[48:58] = 3
    shape = kind[data]
    turn = np.ones(len(data), bool)
    turn[1:] = shape[1:] != shape[:-1]
    turns = np.concatenate([[0], np.cumsum(turn)])
    again = np.zeros(len(h), np.int64)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    key = lambda x, salt: (x ^ (np.uint64(salt) * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(64 - bits)
    with np.errstate(over="ignore"):
        feats = [
            key(ending_keys(data, s, e, 2), 1),
            key(ending_keys(data, s, e, 3), 2),
            key(mix(shape[s].astype(np.uint64) * np.uint64(64) + shape[e - 1] * np.uint64(8) + np.minimum(turns[e] - turns[s], 7).astype(np.uint64)), 3),
            key(mix(again.astype(np.uint64) + np.uint64(77)), 4),
            key(mix(np.minimum(e - s, 20).astype(np.uint64) + np.uint64(999)), 5),
        ]
    docs = np.tile(doc, len(feats))
    feat = np.concatenate(feats).astype(np.int64)
    both, n = np.unique(docs << bits | feat, return_counts=True)
    d = both >> bits
    return d, both & ((1 << bits) - 1), n / words[d]


_VOTES = "doc_id long, pattern long, n_words long"


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in document_chunks(batch.column("text")):
            found = word_hashes(data, offsets)
            words = np.bincount(found[3], minlength=hi - lo)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(votes(data, offsets, found)), pa.array(words.astype(np.int64))], names=["doc_id", "pattern", "n_words"])


def largest(doc: np.ndarray, feat: np.ndarray, value: np.ndarray, most: int) -> np.ndarray:
    """Which features stay if every document keeps its ``most`` largest values (ties: smaller feature); in the order given."""
    if not len(doc) or np.bincount(doc).max() <= most:
        return np.ones(len(doc), bool)
    order = np.lexsort((feat, -value, doc))
    n = np.bincount(doc)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    keep = np.empty(len(doc), bool)
    keep[order] = place < most
    return keep


def _features(bits: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in document_chunks(batch.column("text")):
                found = word_hashes(data, offsets)
                doc, feat, value = hashed_features(data, offsets, bits, found)
                keep = largest(doc, feat, value, most)
                doc, feat, value = doc[keep], feat[keep], value[keep]
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=hi - lo))]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (feat.astype(np.int32), value)]
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(lo, hi - lo), pa.array(votes(data, offsets, found)), *lists], names=["key", "pattern", "features", "shares"])

    return run


def _score(model, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, post, weight = model.value
        for batch in batches:
            for lo, hi, data, offsets in document_chunks(batch.column("text")):
                found = word_hashes(data, offsets)
                doc, feat, share = hashed_features(data, offsets, bits, found)
                z = np.bincount(doc, weight[feat] * share, minlength=hi - lo) + weight[-1]
                has = np.bincount(doc, minlength=hi - lo) > 0
                pattern = votes(data, offsets, found)
                at = np.minimum(np.searchsorted(codes, pattern), len(codes) - 1)
                words = np.bincount(found[3], minlength=hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(words.astype(np.int64)), pa.array(pattern), pa.array(post[at]), pa.array(np.where(has, sigmoid(z), 0.0))],
                    names=["doc_id", "n_words", "pattern", "posterior", "score"],
                )

    return run


def train(docs: DataFrame, *, bits: int = 16, fit_rows: int = 8000, fit_features: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(patterns, posterior of good, scorer weights, P(vote | class))."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = texts.mapInArrow(_vote, _VOTES).where("n_words > 0").groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect()  # 3**labellers rows at most
    if not counted:
        return np.zeros(1, np.int64), np.ones(1), np.zeros((1 << bits) + 1), np.zeros((len(LABELLERS), 2, 3))
    codes, counts = np.array([r["pattern"] for r in counted]), np.array([r["n"] for r in counted], float)
    post, theta, _ = expectation_maximisation(pattern_votes(codes, len(LABELLERS)), counts)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull()).distinct().orderBy(F.xxhash64(F.col("doc_id"), F.lit(3)), "doc_id").limit(fit_rows)
    sample = texts.join(F.broadcast(ids), "doc_id").withColumn("key", F.xxhash64("text"))
    sample = sample.groupBy("doc_id").agg(F.min(F.struct("key", "text")).alias("one")).select("one.text", "one.key")  # fit_rows texts at most
    sample = sample.mapInArrow(_features(bits, fit_features), "key long, pattern long, features array<int>, shares array<double>").toArrow().sort_by("key")  # in an order of its own
    if not sample.num_rows:
        return codes, post, np.zeros((1 << bits) + 1), theta
    feats, shares = sample["features"].combine_chunks(), sample["shares"].combine_chunks()
    rows = Rows(feats.flatten().to_numpy().astype(np.int64), shares.flatten().to_numpy(), np.asarray(feats.offsets)[1:] - np.asarray(feats.offsets)[0])
    target = post[np.minimum(np.searchsorted(codes, sample["pattern"].to_numpy()), len(codes) - 1)]
    return codes, post, fit_soft(rows, target, 1 << bits), theta


def score_quality(docs: DataFrame, *, keep_from: float = 0.4, bits: int = 16, fit_rows: int = 8000) -> DataFrame:
    """doc_id, n_words, pattern (the votes), posterior (of good, from the votes), score and keep; one row per input row."""
    codes, post, weight, _ = train(docs, bits=bits, fit_rows=fit_rows)
    model = docs.sparkSession.sparkContext.broadcast((codes, post, weight))  # of fixed size
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = texts.mapInArrow(_score(model, bits), "doc_id long, n_words long, pattern long, posterior double, score double")
    return out.withColumn("keep", F.col("score") >= keep_from)


def _filter(model, bits: int, text_col: str, keep_from: float):
    score = _score(model, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                plain = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(text_col).cast(pa.string())], names=["doc_id", "text"])
                keep = [b.column("score").to_numpy() >= keep_from for b in score(iter([plain]))]
                yield batch.filter(pa.array(np.concatenate(keep)))

    return run


def keep_good(docs: DataFrame, *, keep_from: float = 0.4, bits: int = 16, fit_rows: int = 8000) -> DataFrame:
    """Rows of docs, all columns, that the classifier keeps; nothing is shuffled."""
    codes, post, weight, _ = train(docs, bits=bits, fit_rows=fit_rows)
    model = docs.sparkSession.sparkContext.broadcast((codes, post, weight))
    return docs.mapInArrow(_filter(model, bits, "text", keep_from), docs.schema)
