"""Exact deduplication by 128-bit content hash, with bytes compared inside a hash group.

Texts are equal when they are identical after every character of
``[\\x20\\x09-\\x0D]`` is deleted; null counts as empty. Of equal texts the row with
the most code points in the original text stays, then the smallest doc_id
(nulls last), then the smallest digest of the original text. Empty and blank texts are one group.

Every row becomes a record of fixed size (ids, lengths, digests and a number of its own), written once; hashes are grouped over those records, with one record of a hot group
left in each task. Bytes are compared where a hash occurs more than once: a blocked Bloom filter of such hashes, of bounded size, says which texts
to read again, and those that pass are merged by (hash, bytes), so a text that occurs once is not moved. A hash with one normalised text names its group;
where bytes of one hash differ (a collision) its rows meet their group by hash and bytes. The join which hands every record its
group has two plain exchanges, which adaptive execution splits on a hot key. Other columns, whatever their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import Scratch, fresh, once_each, without
from .url_filters import build_filter, probe_filter

_SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def normalised(text: Column) -> Column:
    out = F.coalesce(text.cast("string"), F.lit(""))
    for c in _SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def content_hash(norm: Column) -> Column:
    """128 bits of the normalised text."""
    return F.unhex(F.md5(norm.cast("binary")))


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hash_fn=content_hash, with_digest: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256; one row per input row; where asked for, also digest (of the original text).

    One row of each group has kept set. Where the row that stays is repeated
    (same doc_id, same text), any one of the repeats is it."""
    scratch = Scratch(docs.sparkSession, "exact")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("norm"), F.length(text).alias("points"), F.xxhash64(text).alias("digest"))
    keyed = base.withColumn("h", hash_fn(F.col("norm")))
    sha = F.sha2(F.col("norm").cast("binary"), 256).alias("sha")
    short = scratch.save(keyed.select("doc_id", "points", "digest", "h", sha, F.monotonically_increasing_id().alias("u")), "short")
    order = [(-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("digest")]
    groups = scratch.save(short.groupBy("h").agg(F.count("*").alias("group_size"), F.min(F.struct(*order, "u")).alias("best")), "groups")
    blocks, n_blocks = build_filter(groups.where("group_size > 1"), "h")
    again = probe_filter(keyed.select("h", "norm"), "h", scratch.save(blocks, "filter"), n_blocks, "possible").where("possible").select("h", "norm").distinct()
    clash = scratch.save(again.groupBy("h").count().where("count > 1").select("h"), "clash")  # hashes that several texts share
    found = ["doc_id", F.col("best.doc_id").alias("keep_id"), "group_size"]
    ends = [F.col("sha").alias("text_sha256"), *(["digest"] if with_digest else [])]
    out = short.join(groups.hint("merge"), "h")
    if not clash.limit(1).count():
        return out.select(*found, (F.col("u") == F.col("best.u")).alias("kept"), *ends)
    clear = out.join(clash, "h", "left_anti").select(*found, (F.col("u") == F.col("best.u")).alias("kept"), *ends)
    hit = keyed.join(clash.hint("merge"), "h", "left_semi")
    exact = scratch.save(hit.groupBy("h", "norm").agg(F.count("*").alias("group_size"), F.min(F.struct(*order)).alias("best")), "exact")
    rows = hit.select("*", sha).join(exact, ["h", "norm"]).drop("norm")
    nth = F.row_number().over(Window.partitionBy("sha", "doc_id", "digest").orderBy("points"))
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("digest") == F.col("best.digest")) & (F.col("points") == -F.col("best.less"))
    return clear.unionByName(rows.withColumn("nth", nth).select(*found, (stays & (F.col("nth") == 1)).alias("kept"), *ends))


ORACLE_SQL = r"""
with d as (select doc_id, coalesce(text, '') as text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents)
select doc_id,
       first_value(doc_id) over w as keep_id,
       count(*) over (partition by norm) as group_size,
       row_number() over w = 1 as kept,
       sha256(norm) as text_sha256
from d window w as (partition by norm order by length(text) desc, doc_id)
"""


def keep_one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs, all columns, without those that exact_groups does not keep: rows are told apart by id and
    text, and of wholly repeated ones one stays. Columns of any name pass through."""
    scratch = Scratch(docs.sparkSession, "exact")
    ident, digest = fresh(docs, "_id", "_digest")
    found = scratch.save(exact_groups(docs, id_col=id_col, text_col=text_col, with_digest=True), "found").where("group_size > 1")
    pairs = found.groupBy(F.col("doc_id").alias(ident), F.col("digest").alias(digest)).agg(F.max("kept").alias("stays"), F.count("*").alias("times"))
    keyed = docs.withColumns({ident: F.col(id_col).cast("long"), digest: F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))})
    gone = scratch.save(pairs.where("not stays").select(ident, digest), "gone")
    repeats = scratch.save(pairs.where("stays and times > 1").select(ident, digest), "repeats")
    return once_each(without(keyed, gone, [ident, digest]), repeats, [ident, digest]).select(*(F.col(f"`{c}`") for c in docs.columns))
