"""N-gram Jaccard self-join with signature trees.

1. One scan gives each document its number of distinct 5-word shingles, a
   128-bit key of the set, an OR-able bitmap, and the shingles that are common
   inside a task. Documents with equal sets form one class.
2. A second scan emits, for one document of each class and task, the prefix of
   its shingles in a global order with common shingles last. Sets with
   Jaccard >= t share a shingle of these prefixes. The order is a heuristic
   (the ``order_terms`` shingles with the highest counts; any other is held by at most that part of
   all shingles); every order gives all pairs.
3. The classes that hold a shingle are a candidate group, named by the least hash of its members;
   groups of one name are merged, which two groups are with odds equal to the Jaccard index of their members. The classes of a
   common shingle are counted in slices, so none meets in one task. In a
   group a signature tree (OR-combined bitmaps, size ranges) is traversed
   against itself; node pairs whose largest possible overlap is too small are
   pruned. What is left falls apart into candidate components, named and merged in the same way.
4. Only members of those get their sets computed (from the text, once per class) and
   are verified by the shingles they share, pair by pair of the tree's leaves, skipping pairs that
   are connected already. A spanning forest of links leaves each task.
5. Links become components by hooking and contraction in shared tables.

Shingles are compared by hash. Two words get numbers from two tables of random numbers by place and byte (longer
words by xxh3), so different shingles agree with odds of 2**-64 for the first hash, whatever they look like; verification needs
32 bits of the second, independent hash to agree as well, and the key of a class has 64 bits of each.

Groups above ``tile_rows`` members or ``tile_shingles`` shingles are cut into tiles and
every pair of tiles is joined in its own task, so no task holds a whole hot
group. Null, empty and blank texts have no shingles and link with nothing; texts with
fewer than k words have one shingle. Very long texts are hashed whole, one at a time. Repeated rows and repeated doc_ids are
kept, one output row per input row; ties cannot matter, as the component is the smallest id. Other columns, whatever their
names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrowgroups import stream_groups
from .bytehash import mix, shingle_sets
from .graph import components, unite
from .storage import Scratch, fresh, once_each, without

_FAN = 8


def bitmap_words(n: int) -> int:
    """64-bit words of the bitmap of a set of n shingles: 2 to 4 bits a shingle."""
    return max(4, 1 << max(0, (2 * int(n) - 1)).bit_length() >> 6)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    words = bitmap_words(len(hashes))
    bit = hashes & np.uint64(words * 64 - 1)
    out = np.zeros(words, np.uint64)
    np.bitwise_or.at(out, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_or.reduce(bits.reshape(len(bits), -1, words), axis=1)


class SignatureTree:
    """Levels of nodes, leaves first: OR of the bitmaps below, size range, and
    the largest number of shingles that a set has beyond its bits."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray):
        slack = sizes - np.bitwise_count(bits).sum(axis=1)
        self.levels = [(bits, sizes, sizes, slack)]
        while len(self.levels[-1][1]) > 1:
            b, lo, hi, s = self.levels[-1]
            at = np.arange(0, len(lo), _FAN)
            self.levels.append(
                (np.bitwise_or.reduceat(b, at, axis=0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(s, at))
            )


def _passing(a: tuple, b: tuple, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Which node pairs may hold a pair of sets with Jaccard >= percent / 100."""
    (ab, alo, ahi, aslack), (bb, blo, bhi, bslack) = a, b
    ok = (100 * ahi[x] >= percent * blo[y]) & (100 * bhi[y] >= percent * alo[x])
    at = np.flatnonzero(ok)
    for lo in range(0, len(at), 1 << 15):
        part = at[lo : lo + (1 << 15)]
        p, q = x[part], y[part]
        most = np.bitwise_count(ab[p] & bb[q]).sum(axis=1) + np.minimum(aslack[p], bslack[q])
        most = np.minimum(most, np.minimum(ahi[p], bhi[q]))
        ok[part] = (100 + percent) * most >= percent * (alo[p] + blo[q])
    return ok


def traverse(a: SignatureTree, b: SignatureTree, percent: int, connected=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Leaf pairs left by a dual traversal (each once if a is b), in chunks.
    connected(x, y) says which leaf pairs need no further look."""
    same = a is b
    top = max(len(a.levels), len(b.levels)) - 1
    la, lb = (lambda i: min(i, len(a.levels) - 1)), (lambda i: min(i, len(b.levels) - 1))
    stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, x, y = stack.pop()
        if len(x) > 1 << 14:
            half = len(x) // 2
            stack += [(level, x[half:], y[half:]), (level, x[:half], y[:half])]
            continue
        if level == 0:
            if same:
                keep = x < y
                x, y = x[keep], y[keep]
            if connected is not None and len(x):
                keep = ~connected(x, y)
                x, y = x[keep], y[keep]
        if not len(x):
            continue
        ok = _passing(a.levels[la(level)], b.levels[lb(level)], x, y, percent)
        x, y = x[ok], y[ok]
        if not len(x):
            continue
        if level == 0:
            yield x, y
            continue
        below = []
        for tree, at, node in ((a, la, x), (b, lb, y)):
            if at(level) == at(level - 1):
                below.append((node[:, None], np.ones((len(node), 1), bool)))
            else:
                kid = node[:, None] * _FAN + np.arange(_FAN)
                below.append((kid, kid < len(tree.levels[at(level - 1)][1])))
        (kx, okx), (ky, oky) = below
        both = okx[:, :, None] & oky[:, None, :]
        px = np.broadcast_to(kx[:, :, None], both.shape)[both]
        py = np.broadcast_to(ky[:, None, :], both.shape)[both]
        if same:
            keep = px <= py
            px, py = px[keep], py[keep]
        stack.append((level - 1, px, py))


def forest(bits: list[np.ndarray], sizes: np.ndarray, order: np.ndarray, percent: int, verify=None) -> np.ndarray:
    """Component labels of the members under the candidate relation, or, with
    verify(i, j), under the verified one."""
    label = np.arange(len(sizes))
    widths = np.array([len(b) for b in bits])
    by = {}
    for w in np.unique(widths):
        at = np.flatnonzero(widths == w)
        at = at[np.lexsort((order[at], sizes[at] // max(1, w * 4)))]
        by[int(w)] = (at, SignatureTree(np.stack([bits[i] for i in at]), sizes[at]))
    for w, (at, tree) in by.items():
        sides = [(at, tree, at, tree)]
        if 2 * w in by:
            wide, other = by[2 * w]
            sides.append((at, tree, wide, SignatureTree(fold(other.levels[0][0], w), sizes[wide])))
        for xs, xt, ys, yt in sides:
            for x, y in traverse(xt, yt, percent, lambda p, q, xs=xs, ys=ys: label[xs[p]] == label[ys[q]]):
                x, y = xs[x], ys[y]
                if verify is None:
                    label = unite(label, x, y)
                    continue
                for lo in range(0, len(x), 256):
                    p, q = x[lo : lo + 256], y[lo : lo + 256]
                    open_ = label[p] != label[q]
                    for i, j in zip(p[open_].tolist(), q[open_].tolist(), strict=True):
                        if label[i] != label[j] and verify(i, j):
                            label = unite(label, np.array([i]), np.array([j]))
    return label


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).astype(np.uint64, copy=False).view(np.int64))


def _set_keys(counts: np.ndarray, hashes: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each set, of the first and of the second hashes."""
    ends = np.cumsum(counts)
    out = []
    for values, salt in ((hashes, 0x51), (other, 0xA7)):
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(values ^ np.uint64(salt)))])
            out.append(mix(sums[ends] - sums[ends - counts] + counts.astype(np.uint64)))
    return out[0], out[1]


_SCAN = "doc_id long, digest long, n long, c1 long, c2 long, bits binary, term long, held long"


def _scan(k: int, flush: int = 1 << 22, least: int = 4):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("n", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("bits", pa.binary()), ("term", pa.int64()), ("held", pa.int64())])
        kept: list[np.ndarray] = []

        def common() -> pa.RecordBatch:
            terms, held = np.unique(np.concatenate(kept), return_counts=True)
            terms, held = terms[held >= least], held[held >= least]
            none = pa.nulls(len(terms), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, none, pa.nulls(len(terms), pa.binary()), _longs(terms), pa.array(held.astype(np.int64))], schema=schema)

        for batch in batches:
            ids, digests = batch.column("doc_id"), batch.column("digest")
            for lo, counts, hashes, other in shingle_sets(batch.column("text"), k):
                c1, c2 = _set_keys(counts, hashes, other)
                off = np.concatenate([[0], np.cumsum(counts)])
                bits = [bitmap(hashes[off[i] : off[i + 1]]).tobytes() if counts[i] else None for i in range(len(counts))]
                none = pa.nulls(len(counts), pa.int64())
                yield pa.RecordBatch.from_arrays([ids.slice(lo, len(counts)), digests.slice(lo, len(counts)), pa.array(counts.astype(np.int64)), _longs(c1), _longs(c2), pa.array(bits, pa.binary()), none, none], schema=schema)
                kept.append(hashes)
                if sum(map(len, kept)) >= flush:
                    yield common()
                    kept.clear()
        if kept:
            yield common()

    return run


def _postings(k: int, percent: int, terms, slices: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, rank = terms.value
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for _, counts, hashes, other in shingle_sets(batch.column("text"), k):
                c1, c2 = _set_keys(counts, hashes, other)
                new = np.zeros(len(counts), bool)
                for i, c in enumerate(zip(c1.tolist(), c2.tolist(), strict=True)):
                    if counts[i] and c not in seen:
                        seen.add(c)
                        new[i] = True
                if len(seen) > 1 << 20:
                    seen.clear()
                owner = np.repeat(np.arange(len(counts)), counts)
                keep = new[owner]
                owner, h = owner[keep], hashes[keep]
                if not len(h):
                    continue
                place = np.zeros(len(h), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                    place = np.where(common[at] == h, rank[at], 0)
                at = np.lexsort((h, place, owner))
                owner, h, place = owner[at], h[at], place[at]
                n = np.where(new, counts, 0)
                nth = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
                keep = nth < n[owner] + (-percent * n[owner]) // 100 + 1
                owner, h, place = owner[keep], h[keep], place[keep]
                # A common shingle is dealt over slices by the class; 0 where it is not common.
                part = np.where(place > 0, 1 + (mix(c1[owner]) % np.uint64(slices)).astype(np.int64), 0)
                yield pa.RecordBatch.from_arrays([_longs(h), _longs(c1[owner]), pa.array(part.astype(np.int32))], names=["term", "c1", "part"])

    return run


_GROUP = ["g", "ti", "tj"]


def _group_key(members: np.ndarray) -> int:
    return int(mix(members.view(np.uint64)).view(np.int64).min())


def _candidates(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        held = 0
        for t in stream_groups(batches, _GROUP):
            c1, c2 = t["c1"].to_numpy(), t["c2"].to_numpy()
            sizes = t["n"].to_numpy()
            bits = [np.frombuffer(b, np.uint64) for b in t["bits"].to_pylist()]
            label = forest(bits, sizes, c1, percent)
            at = np.argsort(label, kind="stable")
            for part in np.split(at, np.flatnonzero(np.diff(label[at])) + 1):
                if len(part) > 1:
                    out.append((_group_key(c1[part]), c1[part], c2[part]))
                    held += len(part)
            if held > 1 << 16:
                yield _members(out)
                out, held = [], 0
        if out:
            yield _members(out)

    return run


def _members(out: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    names = np.repeat([x[0] for x in out], [len(x[1]) for x in out])
    return pa.RecordBatch.from_arrays([pa.array(names), *(pa.array(np.concatenate([x[i] for x in out])) for i in (1, 2))], names=["g", "c1", "c2"])


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, counts, hashes, other in shingle_sets(batch.column("text"), k):
                c1, c2 = _set_keys(counts, hashes, other)
                off = np.concatenate([[0], np.cumsum(counts)])
                both = [pa.array([x[off[i] : off[i + 1]].tobytes() for i in range(len(counts))], pa.binary()) for x in (hashes, (other >> np.uint64(32)).astype(np.uint32))]
                yield pa.RecordBatch.from_arrays([_longs(c1), _longs(c2), *both], names=["c1", "c2", "shingles", "others"])

    return run


_NODE = pa.struct([("c1", pa.int64()), ("c2", pa.int64())])
_LINKS = "a struct<c1: long, c2: long>, b struct<c1: long, c2: long>"


def shared(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """Shingles of both sets, each given by its hashes in rising order and their second hashes."""
    both, second = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.argsort(both, kind="stable")
    both, second = both[order], second[order]
    return int(((both[1:] == both[:-1]) & (second[1:] == second[:-1])).sum())


def _links(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in stream_groups(batches, _GROUP):
            c1, c2 = t["c1"].to_numpy(), t["c2"].to_numpy()
            sets = [(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint32)) for x, y in zip(t["shingles"].to_pylist(), t["others"].to_pylist(), strict=True)]
            sizes = np.array([len(s) for s, _ in sets])

            def verify(i: int, j: int, sets=sets, sizes=sizes) -> bool:
                common = shared(sets[i], sets[j])
                return 100 * common >= percent * int(sizes[i] + sizes[j] - common)

            label = forest([bitmap(s) for s, _ in sets], sizes, c1, percent, verify)
            at = np.flatnonzero(label != np.arange(len(label)))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([pa.array(c1[x]), pa.array(c2[x])], fields=list(_NODE)) for x in (label[at], at)], names=["a", "b"])

    return run


def _tiled(members: DataFrame, cut: DataFrame) -> DataFrame:
    """One row for each pair of tiles that a member takes part in; cut has g and q, the number of tiles, of groups that are
    cut. They are few: each has more than tile_rows members or tile_shingles shingles."""
    t = F.pmod(F.xxhash64("c1", F.lit(17)), F.col("q"))
    return (
        members.join(F.broadcast(cut), "g", "left")
        .withColumn("q", F.coalesce("q", F.lit(1).cast("long")))
        .withColumn("t", t)
        .withColumn("u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q") - 1)))
        .withColumn("ti", F.least("t", "u"))
        .withColumn("tj", F.greatest("t", "u"))
        .drop("q", "t", "u")
    )


_KEY = ["c1", "c2"]


def _digest(text: str) -> Column:
    return F.xxhash64(F.col(text).cast("string"))


def jaccard_classes(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 5,
    percent: int = 80,
    order_terms: int = 1 << 16,
    tile_rows: int = 2048,
    tile_shingles: int = 1 << 22,
    slices: int = 64,
    broadcast_ids: int = 500_000,
    with_keys: bool = False,
) -> DataFrame:
    """doc_id, n_shingles, class_key (one value per distinct shingle set) and
    component_id (smallest doc_id reachable by links; its own where it has none; null where all are null).
    Where asked for, also component_key (one value per component, whatever its ids; null without shingles)
    and digest (of the text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("digest", _digest("text"))

    scan = scratch.save(docs.mapInArrow(_scan(k), _SCAN), "scan")
    rows = scan.where("term is null").select("doc_id", "digest", "n", "c1", "c2")
    top = (
        scan.where("term is not null").groupBy("term").agg(F.sum("held").alias("held")).orderBy(F.desc("held"), "term").limit(order_terms).collect()
    )  # at most order_terms rows
    common = np.array([r["term"] for r in top], np.int64).view(np.uint64)
    rank = np.array([r["held"] for r in top], np.int64)
    at = np.argsort(common)
    terms = spark.sparkContext.broadcast((common[at], rank[at]))

    held = docs.select("text").mapInArrow(_postings(k, percent, terms, slices), "term long, c1 long, part int").repartition("term", "part").dropDuplicates(["term", "part", "c1"])
    w = Window.partitionBy("term", "part")  # one shingle that is not common, or a slice of a common one
    spread = (
        held.withColumn("m", F.count("*").over(w))
        .withColumn("g", F.min(F.xxhash64("c1")).over(w))
        .where("m > 1 or part > 0")
    )
    spread = scratch.save(spread, "spread")
    slices_of = spread.where("part > 0").groupBy("term", "part").agg(F.first("m").alias("m"), F.first("g").alias("g"))
    whole = scratch.save(slices_of.groupBy("term").agg(F.sum("m").alias("m"), F.min("g").alias("g")).where("m > 1"), "whole")
    sliced = spread.where("part > 0").select("term", "c1").join(F.broadcast(whole), "term")  # at most order_terms rows
    member = scratch.save(spread.where("part = 0").select("g", "c1").union(sliced.select("g", "c1")).dropDuplicates(), "member")
    scratch.drop(spread, whole)
    cut = scratch.save(member.groupBy("g").agg(F.ceil(F.count("*") / tile_rows).cast("long").alias("q")).where("q > 1"), "cut")

    wanted = member.select("c1").distinct()
    # By c1 alone: two classes that share it are both looked at.
    sig = scan.where("term is null and n > 0").select(*_KEY, "n", "bits").join(wanted, "c1", "left_semi").dropDuplicates(_KEY)
    grouped = _tiled(member, cut).join(sig, "c1").select(*_GROUP, *_KEY, "n", "bits")
    grouped = grouped.repartition(*_GROUP).sortWithinPartitions(*_GROUP)
    part = scratch.save(grouped.mapInArrow(_candidates(percent), "g long, c1 long, c2 long").dropDuplicates(), "part")
    scratch.drop(member, cut)
    # A class is fetched by the key of one of its rows (id and text), so that null and repeated ids lose nothing.
    row_key = F.xxhash64("digest", "doc_id")
    held_by = rows.select(*_KEY, "n", row_key.alias("row_key")).join(part.select(*_KEY).distinct(), _KEY, "left_semi").groupBy(*_KEY, "row_key").agg(F.max("n").alias("n"), F.count("*").alias("same"))
    members_n = held_by.groupBy(*_KEY).agg(F.max("n").alias("n"), F.min(F.struct("row_key", "same")).alias("rep")).select(*_KEY, "n", "rep.row_key", "rep.same")
    members_n = scratch.save(members_n, "reps")
    keys = members_n.select("row_key").distinct()
    chosen = F.broadcast(keys) if keys.count() <= broadcast_ids else keys
    sets = docs.withColumn("row_key", row_key).join(chosen, "row_key", "left_semi").select("text").mapInArrow(_sets(k), "c1 long, c2 long, shingles binary, others binary")
    if members_n.where("same > 1").limit(1).count():  # whole rows are repeated
        sets = sets.dropDuplicates(_KEY)
    tiles = F.greatest(F.ceil(F.count("*") / tile_rows), F.ceil(F.sum("n") / tile_shingles)).cast("long")
    heavy = scratch.save(part.join(members_n.select(*_KEY, "n"), _KEY).groupBy("g").agg(tiles.alias("q")).where("q > 1"), "heavy")
    tiled = _tiled(part, heavy)
    tiled = tiled.join(sets, _KEY).select(*_GROUP, *_KEY, "shingles", "others").repartition(*_GROUP).sortWithinPartitions(*_GROUP)
    links = scratch.save(tiled.mapInArrow(_links(percent), _LINKS).dropDuplicates(), "links")
    scratch.drop(part, members_n, heavy)

    label = components(links, scratch).select("node.c1", "node.c2", "label")
    classes = rows.where("n > 0").groupBy(*_KEY).agg(F.min("doc_id").alias("least"))
    classes = classes.join(label, _KEY, "left").withColumn("label", F.coalesce("label", F.struct(*_KEY)))
    lowest = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    named = scratch.save(classes.join(lowest, "label").select(*_KEY, "component_id", "label"), "named")
    out = rows.join(named.hint("merge"), _KEY, "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.struct(*_KEY)).alias("class_key"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        *([F.when(F.col("n") > 0, F.col("label")).alias("component_key"), "digest"] if with_keys else []),
    )


def keep_one_of_component(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs, all columns, without those that link with a row that stays. Of each component one row stays: the smallest
    id (nulls last), then the smallest text digest; rows are told apart by id and text. Rows without shingles all stay.
    Columns of any name pass through."""
    scratch = Scratch(docs.sparkSession, "near")
    ident, text = fresh(docs, "_id", "_text")
    found = jaccard_classes(docs, id_col=id_col, text_col=text_col, with_keys=True).where("component_key is not null")
    pairs = scratch.save(found.groupBy("component_key", F.col("doc_id").alias(ident), F.col("digest").alias(text)).agg(F.count("*").alias("times")), "pairs")
    order = F.struct(F.col(ident).isNull().alias("none"), F.col(ident).alias("id"), F.col(text).alias("text"))
    best = scratch.save(pairs.groupBy("component_key").agg(F.min(order).alias("best"), F.sum("times").alias("size")).where("size > 1"), "best")
    stays = F.col(ident).eqNullSafe(F.col("best.id")) & (F.col(text) == F.col("best.text"))
    pairs = scratch.save(pairs.join(best.hint("merge"), "component_key").select(ident, text, "times", stays.alias("stays")), "marked")
    keyed = docs.withColumns({ident: F.col(id_col).cast("long"), text: _digest(text_col)})
    gone = scratch.save(pairs.where("not stays").select(ident, text), "gone")
    repeats = scratch.save(pairs.where("stays and times > 1").select(ident, text), "repeats")
    return once_each(without(keyed, gone, [ident, text]), repeats, [ident, text]).select(*(F.col(f"`{c}`") for c in docs.columns))


#: For small tables: every pair of rows that shares a shingle, and all rows reachable over links.
ORACLE_SQL = r"""
with recursive w as (select row_number() over () rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
s as (select rid, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')] else list_distinct([array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)]) end) sh from w),
n as (select rid, count(*) n from s group by 1),
pairs as (select a.rid x, b.rid y, count(*) c from s a join s b on a.sh = b.sh and a.rid < b.rid group by 1, 2),
links as (select x, y from pairs join n nx on nx.rid = x join n ny on ny.rid = y where 100 * c >= 80 * (nx.n + ny.n - c)),
edges as (select x, y from links union all select y, x from links),
reach(x, y) as (select rid, rid from n union select r.x, e.y from reach r join edges e on e.x = r.y),
least_ as (select r.x rid, min(w.doc_id) component_id from reach r join w on w.rid = r.y group by 1)
select w.doc_id, coalesce(n.n, 0) n_shingles, case when n.n is null then w.doc_id else l.component_id end component_id from w left join n using (rid) left join least_ l using (rid)
"""
