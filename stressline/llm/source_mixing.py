"""Mixing sources to target weights, with DataFrame functions only.

The words of a source, document after document, form a stream that is cut into
blocks of ``block_words``. Targets: sources by code point, null last, take the
weights in turn and share ``share`` times all words; no target exceeds ``most`` times its
source, and the excess goes to the others by weight (water-filling, solved in
closed form over the sources sorted by their cap per weight).

A source's target fixes its number of draws, so its total is met to the word;
given that, the draws fall on the output shards independently and uniformly, which makes each
shard's source counts multinomial. Draw j of an epoch is
mapped to a block by a pseudorandom permutation of the source's block indices
(swap-or-not, keyed by seed, source and epoch), so an epoch takes no block
twice, and the last draw is shortened to the words still wanted. Draws
meet the documents' pieces by (source, block index).

Offsets in a source are prefix sums in two levels, over about sqrt(rows) buckets, so
a hot source is spread over tasks; draws are made in chunks for the same reason. All is a
function of the rows and the seed: reruns agree.

Null, empty and blank texts have no words and are not taken; repeated rows are separate documents, told apart by a running
number, so ties cannot matter. A very long text spans many blocks and is cut in place. An empty table gives no rows. Other columns, whatever their names, are not read
(``mixed_texts`` passes them through).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import Scratch, fresh

WORD = r"[^\x20\x09-\x0D]+"
_TOKEN = r"(?:^[\x20\x09-\x0D]+)?[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


def _source_key(source: Column) -> Column:
    return F.xxhash64(source.isNull(), source)


def source_targets(sized: DataFrame, *, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """source_key, source_size, target: one row a source."""
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everywhere = Window.partitionBy(F.lit(0))  # one row a source
    nth = F.row_number().over(everywhere.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(nth, F.lit(len(weights))) + 1).cast("int"))
    t = total.withColumn("w", w).withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("w"))
    order = everywhere.orderBy("ratio", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    t = t.withColumn("level", (F.sum("source_size").over(everywhere) * share - before) / left)
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everywhere)
    return t.select(
        _source_key(F.col("source")).alias("source_key"), "source_size", F.least(F.col("cap"), F.coalesce(level["level"] * F.col("w"), F.col("cap"))).alias("target")
    )


def permuted(index: Column, n: Column, key: list[Column], rounds: int, seed: int, inverse: bool = False) -> Column:
    """Swap-or-not: a keyed permutation of 0 .. n-1 for any n."""
    steps = F.array(*(F.lit(r) for r in (reversed(range(rounds)) if inverse else range(rounds))))

    def step(i: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit(seed), r, *key), n) - i, n)
        swap = F.xxhash64(F.lit(seed + 1), r, F.greatest(i, other), *key).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, other).otherwise(i)

    return F.aggregate(steps, index.cast("long"), step)


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    block_words: int = 256,
    shard_blocks: int = 4096,
    rounds: int = 16,
    seed: int = 20240229,
) -> tuple[DataFrame, DataFrame]:
    """(documents, segments).

    documents: doc_id, digest, copy, size, source_size, target, source_key, at (word offset in its source).
    segments: source_key, at, shard, place (order in its shard), epoch, block, first_word, words; one row for
    each run of words of a document that a draw takes."""
    scratch = Scratch(docs.sparkSession, "mixing")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sized = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size")
    )
    sized = scratch.save(sized, "sized")
    targets = scratch.save(source_targets(sized, weights=weights, share=share, most=most), "targets")

    buckets = max(1, math.isqrt(sized.count()))
    sized = sized.withColumn("source_key", _source_key(F.col("source"))).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(buckets)))
    w = Window.partitionBy("source_key", "bucket").orderBy("doc_id", "digest", "size")
    inner = sized.withColumn("inner", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    inner = inner.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "digest").orderBy("source_key")))
    sums = sized.groupBy("source_key", "bucket").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    placed = inner.join(sums.select("source_key", "bucket", before.alias("before")), ["source_key", "bucket"])
    placed = placed.select("doc_id", "digest", "copy", "size", "source_key", (F.col("before") + F.col("inner")).alias("at"))
    documents = scratch.save(placed.join(targets, "source_key"), "documents")

    b = F.lit(block_words)
    plan = targets.where("source_size > 0").select(
        "source_key", F.expr(f"(source_size + {block_words - 1}) div {block_words}").alias("blocks"), "source_size", F.least(F.round("target").cast("long"), F.col("source_size") * math.floor(most)).alias("wanted")
    )
    plan = plan.withColumn("epoch", F.expr("wanted div source_size")).withColumn("rest", F.expr("wanted % source_size"))
    plan = plan.withColumn("missing", F.col("blocks") * b - F.col("source_size"))  # what the last block lacks
    at_last = permuted(F.col("blocks") - 1, F.col("blocks"), [F.col("source_key"), F.col("epoch")], rounds, seed, inverse=True)
    draws = F.expr(f"(rest + {block_words - 1}) div {block_words}")
    plan = plan.withColumn("at_last", at_last).withColumn("draws", draws)
    plan = plan.withColumn("draws", F.when(F.col("at_last") < F.col("draws"), F.expr(f"(rest + missing + {block_words - 1}) div {block_words}")).otherwise(F.col("draws")))
    got = F.col("draws") * b - F.when(F.col("at_last") < F.col("draws"), F.col("missing")).otherwise(F.lit(0))
    plan = plan.withColumn("over", got - F.col("rest"))
    epochs = plan.select("source_key", "blocks", "missing", F.explode(F.sequence(F.lit(0).cast("long"), "epoch")).alias("e"), "epoch", "draws", "over")
    last = F.col("e") == F.col("epoch")
    epochs = epochs.select("source_key", "blocks", "missing", F.col("e").alias("epoch"), F.when(last, F.col("draws")).otherwise(F.col("blocks")).alias("draws"), F.when(last, F.col("over")).otherwise(F.lit(0)).alias("over")).where("draws > 0")
    epochs = scratch.save(epochs, "epochs")  # at most three rows a source
    every = epochs.agg(F.sum("draws")).first()[0] or 0
    chunk = 1 << 12
    # A number of its own, as the few rows that are dealt become very many draws.
    tasks = max(1, min(-(-every // chunk), max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), every >> 20)))
    slots = epochs.withColumn("chunk", F.explode(F.expr(f"sequence(0L, (draws - 1) div {chunk}L)"))).repartition(tasks, "source_key", "epoch", "chunk")
    slots = slots.withColumn("draw", F.explode(F.expr(f"sequence(chunk * {chunk}L, least(draws, (chunk + 1) * {chunk}L) - 1)")))
    key = [F.col("source_key"), F.col("epoch")]
    slots = slots.withColumn("block", permuted(F.col("draw"), F.col("blocks"), key, rounds, seed))
    length = b - F.when(F.col("block") == F.col("blocks") - 1, F.col("missing")).otherwise(F.lit(0))
    take = length - F.when(F.col("draw") == F.col("draws") - 1, F.col("over")).otherwise(F.lit(0))
    shards = F.greatest(F.lit(1), F.lit(-(-every // shard_blocks)))
    place = F.xxhash64(F.lit(seed + 2), F.col("source_key"), F.col("epoch"), F.col("draw"))
    slots = slots.select("source_key", "epoch", "block", take.alias("take"), place.alias("place"), F.pmod(F.xxhash64(place), shards).alias("shard"))

    pieces = documents.where("size > 0").select("source_key", "at", "size", F.explode(F.expr(f"sequence(at div {block_words}, (at + size - 1) div {block_words})")).alias("block"))
    start = F.greatest(F.col("at"), F.col("block") * b)
    pieces = pieces.select("source_key", "block", "at", (start - F.col("at")).alias("first_word"), (start - F.col("block") * b).alias("in_block"), (F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * b) - start).alias("has"))
    words = F.least(F.col("has"), F.col("take") - F.col("in_block"))
    # Sizes after explode are guessed too small: a merge join, so that no side that grows with the data is broadcast.
    segments = pieces.join(slots.hint("merge"), ["source_key", "block"]).withColumn("words", words).where("words > 0")
    return documents, segments.select("source_key", "at", "shard", "place", "epoch", "block", "first_word", "words")


def mix_digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row a document."""
    documents, segments = mix_sources(docs, **options)
    taken = segments.groupBy("source_key", "at").agg(F.sum("words").alias("taken"))
    with_words = documents.where("size > 0").join(taken, ["source_key", "at"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    return with_words.union(documents.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long")))


def mixed_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix as rows of docs, a row for each segment, its text cut to the words taken (white space kept). Columns of any name pass through."""
    documents, segments = mix_sources(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    ident, digest, copy, parts_, words = fresh(docs, "_id", "_digest", "_copy", "_parts", "_words")
    parts = segments.join(documents.select("doc_id", "digest", "copy", "source_key", "at", "size"), ["source_key", "at"]).where("size > 0")
    parts = parts.groupBy(F.col("doc_id").alias("part_id"), F.col("digest").alias("part_digest"), F.col("copy").alias("part_copy")).agg(
        F.sort_array(F.collect_list(F.struct("first_word", "words", "epoch"))).alias(parts_)
    )  # twice the blocks of a text at most
    names = docs.columns
    keyed = docs.withColumns({ident: F.col(id_col).cast("long"), digest: F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))})
    keyed = keyed.withColumn(copy, F.row_number().over(Window.partitionBy(ident, digest).orderBy(_source_key(F.col(source_col).cast("string")))))
    same = F.col(f"k.{ident}").eqNullSafe(F.col("p.part_id")) & (F.col(f"k.{digest}") == F.col("p.part_digest")) & (F.col(f"k.{copy}") == F.col("p.part_copy"))
    both = keyed.alias("k").join(parts.alias("p"), same).select("k.*", f"p.{parts_}")
    # The word array is bound once for all pieces of a text, and not copied beside each of them.
    taken = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(_TOKEN), 0)
    piece_of = lambda w: lambda p: F.array_join(F.slice(w, p["first_word"].cast("int") + 1, p["words"].cast("int")), "")
    both = both.withColumn(words, F.transform(F.array(taken), lambda w: F.transform(parts_, piece_of(w)))[0])
    both = both.select(*(F.col(f"`{c}`") for c in names if c != text_col), F.explode(words).alias(words))
    piece = F.col(words).cast(docs.schema[text_col].dataType).alias(text_col)
    count = {c: F.length(words).cast(docs.schema[c].dataType).alias(c) for c in names if c == "n_chars"}
    return both.select(*(piece if c == text_col else count.get(c, F.col(f"`{c}`")) for c in names))
