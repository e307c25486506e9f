"""Trie of conversation prefixes by range minima over sorted LCPs, without building a tree or keeping a stack.

Turns become 128-bit digests of (role, text); a conversation is the string of its digests. Strings are sorted globally, in runs, and each run knows the LCP
(in turns) of every string with the one before. A node is a candidate prefix (string i, depth d); a binary search over a sparse table of range minima finds, for every
candidate on its own, how far its interval of members reaches to the left and to the right. Counts, leaves, savings and children are
differences of prefix sums over that interval, the smallest member a range minimum over ids. Intervals that reach the border of their run are merged over runs; all others are final.

Strings are cut into blocks of ``block`` turns, so no row and no task holds a whole long conversation: a block that several conversations share and
continue after is a group whose next blocks are sorted in a run of their own level; the tail of a conversation that shares its block with no other has one node a turn and
is written row by row. Positions of turns are prefix sums over sorted ranges, so one conversation may hold any share of the rows.

Order within a conversation: turn (null first), then the digest, so ties and repeated rows have a fixed order and all stay. Null role or text is empty. Rows with a null conv_id belong
to no conversation and are left out. Very long texts are hashed once and not moved. An empty table has no node, as a root without a conversation would have no member. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrowgroups import stream_groups
from .storage import Scratch

WIDTH = 16  # bytes of a turn's digest
_EMPTY = hashlib.sha256(b"").hexdigest()


# ---------------------------------------------------------------- intervals of one sorted run


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Level k holds the minimum of 2**k values from each place on."""
    out = [values]
    while 2 * (1 << (len(out) - 1)) <= len(values):
        half = 1 << (len(out) - 1)
        out.append(np.minimum(out[-1][:-half], out[-1][half:]))
    return out


def range_min(table: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum over [lo, hi], both included and lo <= hi."""
    level = np.frexp((hi - lo + 1).astype(float))[1] - 1
    out = np.empty(len(lo), table[0].dtype)
    for k in np.unique(level):
        at = level == k
        out[at] = np.minimum(table[k][lo[at]], table[k][hi[at] - (1 << k) + 1])
    return out


def extents(table: list[np.ndarray], row: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last row that share the first ``depth`` turns with ``row``; table over lcp, lcp[i] between rows i - 1 and i. Two binary searches by powers of two for each candidate."""
    lcp, n = table[0], len(table[0])
    left, right = row.copy(), row.copy()
    for k in range(len(table) - 1, -1, -1):
        step = 1 << k
        ok = left - step >= 0  # rows left - step .. left agree if lcp[left - step + 1 .. left] >= depth
        at = np.flatnonzero(ok)
        at = at[table[k][left[at] - step + 1] >= depth[at]]
        left[at] -= step
        at = np.flatnonzero(right + step < n)
        at = at[table[k][right[at] + 1] >= depth[at]]
        right[at] += step
    return left, right


def neighbour_lcp(words: np.ndarray, starts: np.ndarray, length: np.ndarray, group: np.ndarray) -> np.ndarray:
    """lcp[i] of rows i - 1 and i in turns, -1 where their groups differ; lcp[0] is -1. words: (turns, 2) digests, one row after another."""
    n = len(length)
    lcp = np.full(n, -1, np.int64)
    same = np.flatnonzero(group[1:] == group[:-1]) + 1
    m = np.minimum(length[same], length[same - 1])
    owner = np.repeat(np.arange(len(same)), m)
    j = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
    differ = (words[starts[same][owner] + j] != words[starts[same - 1][owner] + j]).any(axis=1)
    first = m.copy()
    np.minimum.at(first, owner[differ], j[differ])
    lcp[same] = first
    return lcp


_PART = (
    "grp binary, depth long, key binary, run int, conv_id long, up_conv long, up_key binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, is_open boolean, top boolean"
)


def _intervals(edges):
    """Nodes and open pieces of nodes of each run, whose rows come sorted. edges: run -> (lcp with the run before, lcp with the run after)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in stream_groups(batches, ["run"]):
            yield from _one_run(t.combine_chunks(), *edges.value[t["run"][0].as_py()])

    return run


def _one_run(t: pa.Table, before: int, after: int) -> Iterator[pa.RecordBatch]:
    ints = lambda c: t[c].to_numpy().astype(np.int64)
    n, conv, depth0, more, top, leaf_extra, saved_extra, child_extra = t.num_rows, *map(ints, ("conv_id", "depth0", "more", "up_conv", "x_leaves", "x_saved", "x_children"))
    seqs, groups = t["seq"].combine_chunks(), t["grp"].to_pylist()
    off = np.frombuffer(seqs.buffers()[1], np.int32)[seqs.offset : seqs.offset + n + 1].astype(np.int64)
    raw = seqs.buffers()[2]
    words = np.frombuffer(raw, np.uint8)[off[0] : off[-1]].copy().view("<u8").reshape(-1, 2) if raw is not None and off[-1] > off[0] else np.zeros((0, 2), np.uint64)
    starts, length = (off[:-1] - off[0]) // WIDTH, np.diff(off) // WIDTH
    sizes = t["sizes"].combine_chunks().flatten().to_numpy().astype(np.int64)
    total = np.concatenate([[0], np.cumsum(sizes)])
    upto = lambda i, d: total[starts[i] + d] - total[starts[i]]  # noqa: E731 - bytes of the first d turns of row i
    gid = np.unique(np.array([g.hex() for g in groups]), return_inverse=True)[1]
    lcp = neighbour_lcp(words, starts, length, gid)
    table, ids = sparse_table(lcp), sparse_table(conv)
    next_lcp = np.append(lcp[1:], after)
    lcp_here = lcp.copy()
    lcp_here[0] = before
    # Every row brings its new depths as candidates; the first row also those that it shares with the run before.
    fresh = length - lcp
    row = np.repeat(np.arange(n), fresh)
    depth = np.arange(fresh.sum()) - np.repeat(np.cumsum(fresh) - fresh, fresh) + np.repeat(lcp + 1, fresh)
    left, right = extents(table, row, depth)
    on_left, on_right = (left == 0) & (depth <= before), (right == n - 1) & (depth <= after)
    # Sums by row: what a row adds beyond the row before it, within one group.
    leaf = np.where(more > 0, leaf_extra, next_lcp < length)
    kept = np.where(lcp_here >= 0, upto(np.arange(n), np.maximum(lcp_here, 0)), 0)
    sums = [np.concatenate([[0], np.cumsum(x)]) for x in (leaf, kept, saved_extra, child_extra)]
    between = lambda s, lo, hi: s[hi + 1] - s[lo]
    first = np.where(on_left, left, left + 1)  # rows from here on repeat the node
    repeats = right - first + 1
    saved = between(sums[1], first, right) - repeats * upto(left, np.maximum(depth - 1, 0)) + between(sums[2], left, right)
    branch = np.flatnonzero((length > lcp_here) & (lcp_here >= 0))
    events = np.sort(lcp_here[branch] * n + branch)
    count = lambda lo, hi: np.searchsorted(events, depth * n + hi, "right") - np.searchsorted(events, depth * n + lo, "left")
    children = count(first, right) + (~on_left & (length[left] > depth)) + np.where(length[right] == depth, between(sums[3], left, right), 0)
    # Members that end at a node are the first rows of its interval: equal rows that do not go on.
    equal = np.zeros(n + 1, bool)
    equal[1:n] = (lcp[1:] == length[1:]) & (length[1:] == length[:-1]) & (more[1:] == 0)
    breaks = np.flatnonzero(~equal)
    run_end = np.where(more == 0, breaks[np.searchsorted(breaks, np.arange(n), "right")] - 1, -1)
    has_end = (length[left] == depth) & (run_end[left] >= left)
    up = np.where(depth > 0, depth - 1, 0)
    up_left, up_right = extents(table, row, up)
    up_open = ((up_left == 0) & (up <= before)) | ((up_right == n - 1) & (up <= after))
    smallest, up_conv = range_min(ids, left, right), range_min(ids, up_left, up_right)
    is_open, is_top = on_left | on_right, depth == 0
    out: dict[str, list] = {c.split()[0]: [] for c in _PART.split(", ")}
    names = list(out)
    run_id = t["run"][0].as_py()
    raw_bytes = words.tobytes()
    key_of = lambda i, d: hashlib.sha256(groups[i] + raw_bytes[starts[i] * WIDTH : (starts[i] + d) * WIDTH]).digest()[:WIDTH]
    lists = [x.tolist() for x in (row, depth, left, right, is_open, is_top, has_end, up_open, smallest, up_conv, children, saved)]
    leaves = between(sums[0], left, right).tolist()
    for k, (i, d, lo, hi, o, tp, e, uo, small, uc, ch, sv) in enumerate(zip(*lists, strict=True)):
        ends = ",".join(map(str, conv[lo : run_end[lo] + 1].tolist())) if e else ""
        values = (
            groups[i], int(depth0[i]) + d, key_of(i, d) if o else None, run_id, small,
            int(top[i]) if d == 1 else (None if d == 0 else uc), key_of(i, d - 1) if d > 1 and uo else None,
            hi - lo + 1, ch, leaves[k], sv, ends if o else (hashlib.sha256(ends.encode()).hexdigest() if e else _EMPTY), o, tp,
        )
        for c, v in zip(names, values, strict=True):
            out[c].append(v)
        if len(out["run"]) >= 1 << 14:
            yield _batch(out)
            out = {c: [] for c in names}
    if out["run"]:
        yield _batch(out)


_ARROW = {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}


def _batch(columns: dict[str, list]) -> pa.RecordBatch:
    kinds = dict(c.split() for c in _PART.split(", "))
    return pa.RecordBatch.from_arrays([pa.array(v, _ARROW[kinds[c]]) for c, v in columns.items()], names=list(columns))


# ---------------------------------------------------------------- pieces of open nodes


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the pieces of a node in the order of their runs, one piece in hand at a time."""
    node, digest, any_end = None, None, False
    done: dict[str, list] = {c.split()[0]: [] for c in _PART.split(", ")}
    sums = ("n_convs", "n_children", "n_leaves", "saved_tokens")

    def close():
        node["ends"] = digest.hexdigest()
        for c, v in node.items():
            done[c].append(v)

    for batch in batches:
        for piece in batch.to_pylist():
            if node is None or piece["key"] != node["key"]:
                if node is not None:
                    close()
                node, digest, any_end = dict(piece), hashlib.sha256(), False
            else:
                node["conv_id"] = min(node["conv_id"], piece["conv_id"])
                for c in sums:
                    node[c] += piece[c]
            if piece["ends"]:
                digest.update((("," if any_end else "") + piece["ends"]).encode())
                any_end = True
    if node is not None:
        close()
        yield _batch(done)


def _edge_lcp(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for x in batch.to_pylist():
            a, b = x["prev"], x["first"]
            if a is None or a["grp"] != b["grp"]:
                out.append(-1)
                continue
            m = min(len(a["seq"]), len(b["seq"])) // WIDTH
            out.append(next((j for j in range(m) if a["seq"][j * WIDTH : (j + 1) * WIDTH] != b["seq"][j * WIDTH : (j + 1) * WIDTH]), m))
        yield pa.RecordBatch.from_arrays([batch.column("run"), pa.array(out, pa.int64())], names=["run", "before"])


# ---------------------------------------------------------------- conversations to blocks of digests


def digests(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest (hex) of (role, text), size (bytes of the text), and a number that no other row has."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    both = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)  # the length in front keeps role and text apart
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.substring(F.sha2(both.cast("binary"), 256), 1, 2 * WIDTH).alias("digest"), F.octet_length(text).alias("size"), F.monotonically_increasing_id().alias("u")
    ).where("conv_id is not null")


def positions(items: DataFrame, scratch: Scratch) -> DataFrame:
    """items with pos, the place in the conversation from 0. Ranges of (conv_id, turn, digest) are numbered on their own; a conversation
    that runs over several ranges adds the sizes of its earlier ones, of which there are at most two a range."""
    n = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("u")]
    ranged = scratch.save(items.repartitionByRange(n, *order).withColumn("run", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("conv_id", "run").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    late = scratch.save(counts.withColumn("ahead", before).where("ahead is not null").select("conv_id", "run", "ahead"), "late")
    local = F.row_number().over(Window.partitionBy("run", "conv_id").orderBy(*order[1:])) - 1
    return ranged.withColumn("pos", local).join(F.broadcast(late), ["run", "conv_id"], "left").select("conv_id", "digest", "size", (F.col("pos") + F.coalesce("ahead", F.lit(0))).cast("long").alias("pos"))


def head_length(conv_id: Column, bound: int) -> Column:
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(bound)).cast("long")


def conversation_blocks(conversations: DataFrame, scratch: Scratch, *, block: int, graft: tuple[int, int] | None) -> DataFrame:
    """conv_id, blk, total (turns of the conversation), seq (digests of up to ``block`` turns), sizes; a turnless conversation has one empty block.

    graft = (every, bound): the first h turns come from conversation c - c % every, h = crc32(c) % bound; own turns follow after the first h."""
    if graft and graft[1] > block + 1:
        raise ValueError("a grafted head must fit in one block")
    placed = scratch.save(positions(scratch.save(digests(conversations), "items"), scratch), "placed")
    h = head_length(F.col("conv_id"), graft[1]) if graft else F.lit(0).cast("long")
    one = F.struct("pos", "digest", "size")
    convs = placed.groupBy("conv_id").agg(F.count("*").alias("own")).withColumn("h", h)
    if graft:
        heads = placed.where((F.col("pos") < graft[1] - 1) & (F.col("conv_id") % graft[0] == 0)).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(one)).alias("head"))  # bound - 1 turns at most
        convs = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % graft[0]).join(heads, "base", "left")
        convs = convs.withColumn("head", F.slice(F.coalesce("head", F.array().cast("array<struct<pos:long,digest:string,size:int>>")), F.lit(1), F.col("h").cast("int")))
    else:
        convs = convs.withColumn("head", F.array().cast("array<struct<pos:long,digest:string,size:int>>"))
    convs = convs.withColumn("b", F.size("head").cast("long")).withColumn("total", F.col("b") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    convs = scratch.save(convs.select("conv_id", "h", "b", "total", "head"), "convs")
    tail = placed.withColumn("q", F.col("pos") - h).where("q >= 0").groupBy("conv_id", F.expr(f"q div {block}").alias("k")).agg(F.array_sort(F.collect_list(one)).alias("part"))  # block turns at most
    shifted = tail.join(convs.select("conv_id", "b", "total"), "conv_id")
    cut = F.array(
        F.struct(F.col("k").alias("blk"), F.lit(2).alias("ord"), F.slice("part", F.lit(1), (F.lit(block) - F.col("b")).cast("int")).alias("part")),
        F.struct((F.col("k") + 1).alias("blk"), F.lit(1).alias("ord"), F.slice("part", (F.lit(block + 1) - F.col("b")).cast("int"), F.lit(block)).alias("part")),
    )
    pieces = shifted.select("conv_id", "total", F.explode(cut).alias("c")).select("conv_id", "total", "c.*").where(F.size("part") > 0)
    first = convs.select("conv_id", "total", F.lit(0).cast("long").alias("blk"), F.lit(0).alias("ord"), F.col("head").alias("part")).where((F.col("total") == 0) | (F.size("head") > 0))
    whole = pieces.unionByName(first).groupBy("conv_id", "total", "blk").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "part"))), lambda x: x["part"])).alias("part"))  # three pieces at most
    return scratch.save(whole.select("conv_id", "blk", "total", F.unhex(F.array_join(F.transform("part", lambda x: x["digest"]), "")).alias("seq"), F.transform("part", lambda x: x["size"]).alias("sizes")), "blocks")


# ---------------------------------------------------------------- levels

_NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _node_rows(parts: DataFrame) -> DataFrame:
    return parts.select("conv_id", "depth", F.col("up_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256"))


def _tails(blocks: DataFrame, single: DataFrame, k: int, block: int) -> DataFrame:
    """Nodes of conversations that share nothing beyond block k: one a turn."""
    rows = blocks.where(F.col("blk") > k).join(single, "conv_id").select("conv_id", "total", "top", "blk", F.posexplode("sizes").alias("at", "size"))
    rows = rows.withColumn("depth", F.col("blk") * block + F.col("at") + 1)
    last = F.col("depth") == F.col("total")
    one = F.lit(1).cast("long")
    return rows.select(
        "conv_id", "depth", F.when(F.col("depth") == (k + 1) * block + 1, F.col("top")).otherwise(F.col("conv_id")).alias("parent_conv_id"), one.alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(last, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(_EMPTY).alias("ends_sha256"),
    )


def _level(k: int, rows: DataFrame, blocks: DataFrame, scratch: Scratch, block: int) -> tuple[list[DataFrame], DataFrame]:
    """Node rows of block k and below, and the sums of the groups' tops. rows: grp, conv_id, seq, sizes, total, up_conv (smallest member of the group's top)."""
    more = F.col("total") > (k + 1) * block
    rows = scratch.save(rows.withColumns({"depth0": F.lit(k * block).cast("long"), "more": more.cast("long"), "g2": F.substring(F.unhex(F.sha2(F.concat("grp", "seq"), 256)), 1, WIDTH)}), f"rows{k}")
    none = F.lit(0).cast("long")
    found: list[DataFrame] = []
    if rows.where("more = 1").limit(1).count():
        groups = rows.groupBy("g2").agg(F.min("conv_id").alias("top"), F.sum("more").alias("n_more"), F.min(F.when(F.col("more") == 1, F.col("conv_id"))).alias("holder")).where("n_more > 0")
        groups = scratch.save(groups, f"groups{k}")
        going = rows.where("more = 1").select("conv_id", "g2").join(groups, "g2")
        found.append(_tails(blocks, going.where("n_more = 1").select("conv_id", "top"), k, block))
        sums = groups.where("n_more = 1").select("g2", none.alias("s_saved"), F.lit(1).cast("long").alias("s_leaves"), F.lit(1).cast("long").alias("s_children"))
        if groups.where("n_more > 1").limit(1).count():
            shared = going.where("n_more > 1").select("conv_id", F.col("g2").alias("grp"), F.col("top").alias("up_conv"))
            below, tops = _level(k + 1, blocks.where(F.col("blk") == k + 1).join(shared, "conv_id").select("grp", "conv_id", "seq", "sizes", "total", "up_conv"), blocks, scratch, block)
            found += below
            sums = sums.unionByName(tops.select(F.col("grp").alias("g2"), F.col("saved_tokens").alias("s_saved"), F.col("n_leaves").alias("s_leaves"), F.col("n_children").alias("s_children")))
        sums = groups.select("g2", F.col("holder").alias("conv_id")).join(sums, "g2")  # one row of each group carries what lies below
        rows = rows.join(sums, ["g2", "conv_id"], "left")
        extra = {f"x_{c}": F.coalesce(f"s_{c}", none) for c in ("saved", "leaves", "children")}
    else:
        extra = {f"x_{c}": none for c in ("saved", "leaves", "children")}
    rows = rows.withColumns(extra).select("grp", "seq", "more", "conv_id", "sizes", "depth0", "up_conv", *extra)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["grp", "seq", "more", "conv_id"]
    runs = scratch.save(rows.repartitionByRange(n, *order).withColumn("run", F.spark_partition_id()), f"runs{k}")
    key = F.struct(*order)
    edge = runs.groupBy("run").agg(F.min(key).alias("first"), F.max(key).alias("last"))
    edge = edge.select("run", "first", F.lag("last").over(Window.orderBy("run")).alias("prev"))  # a row a run
    edge = {r["run"]: r["before"] for r in edge.mapInArrow(_edge_lcp, "run int, before long").collect()}
    filled = sorted(edge)
    edges = rows.sparkSession.sparkContext.broadcast({r: (edge[r], edge[after] if after is not None else -1) for r, after in zip(filled, [*filled[1:], None], strict=False)})
    parts = scratch.save(runs.repartition(n, "run").sortWithinPartitions("run", *order).mapInArrow(_intervals(edges), _PART), f"parts{k}")
    pieces = parts.where("is_open")
    merged = scratch.save(pieces.repartition(n, "key").sortWithinPartitions("key", "run").mapInArrow(_fold, _PART), f"merged{k}")
    every = parts.where("not is_open").unionByName(merged)
    ups = merged.select(F.col("key").alias("up_key"), F.col("conv_id").alias("_up"))
    ups = F.broadcast(ups) if merged.count() <= 200_000 else ups  # 24 bytes a row
    linked = every.where("not top and up_key is not null").join(ups, "up_key", "left").withColumn("up_conv", F.col("_up")).drop("_up")
    nodes = every.where("not top and up_key is null").unionByName(linked)
    if k == 0:
        nodes = nodes.unionByName(every.where("top"))
    return [*found, _node_rows(nodes)], every.where("top")


def prefix_nodes(conversations: DataFrame, *, graft: tuple[int, int] | None = None, block: int = 1024) -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256; one row a node."""
    scratch = Scratch(conversations.sparkSession, "trie")
    blocks = conversation_blocks(conversations, scratch, block=block, graft=graft)
    root = blocks.agg(F.min("conv_id")).first()[0]
    rows = blocks.where("blk = 0").select(F.lit(b"").alias("grp"), "conv_id", "seq", "sizes", "total", F.lit(root).cast("long").alias("up_conv"))
    parts, _ = _level(0, rows, blocks, scratch, block)
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.select(*_NODE)


def conversation_trie(conversations: DataFrame, *, every: int = 5, bound: int = 9, block: int = 1024) -> DataFrame:
    """Nodes of the conversations rebuilt on the heads of every fifth one."""
    return prefix_nodes(conversations, graft=(every, bound), block=block)


ORACLE_SQL = r"""
with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
                  row_number() over (partition by conv_id order by turn nulls first, left(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 32)) - 1 as pos
           from conversations where conv_id is not null),
c as (select conv_id, xor(4294967295::bigint, list_reduce(list_concat([4294967295::bigint], list_transform(string_split(conv_id::varchar, ''), lambda ch: ascii(ch)::bigint)), lambda a, b:
          list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, y: case when x % 2 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end))) % 9 as h
      from (select distinct conv_id from t)),
r0 as (select c.conv_id, 1 as side, t.pos, t.role, t.text from c join t on t.conv_id = c.conv_id and t.pos >= c.h
       union all select c.conv_id, 0, t.pos, t.role, t.text from c join t on t.conv_id = c.conv_id - c.conv_id % 5 and t.pos < c.h),
r as (select conv_id, row_number() over (partition by conv_id order by side, pos) as d, sha256(strlen(role) || ':' || role || text) as dig, strlen(text) as bytes from r0),
m as (select conv_id, 0 as d, '' as key, 0 as bytes from c
      union all select conv_id, d, sha256(string_agg(dig, '') over (partition by conv_id order by d)), bytes from r),
p as (select *, lag(key) over (partition by conv_id order by d) as up, max(d) over (partition by conv_id) as total from m),
n as (select d, key, max(up) as up, max(bytes) as bytes, min(conv_id) as conv_id, count(*) as n_convs,
             sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where total = d), '')) as ends_sha256 from p group by d, key),
k as (select n.*, q.conv_id as parent_conv_id, (select count(*) from n x where x.up = n.key and x.d = n.d + 1) as n_children from n left join n q on q.key = n.up and q.d = n.d - 1),
s as (select distinct a.d, a.key, b.d as bd, b.key as bkey from m a join m b on a.conv_id = b.conv_id and a.d <= b.d)
select k.conv_id, k.d as depth, k.parent_conv_id, k.n_convs, k.n_children, cast(sum(case when b.n_children = 0 then 1 else 0 end) as bigint) as n_leaves,
       cast(sum((b.n_convs - 1) * b.bytes) as bigint) as saved_tokens, k.ends_sha256
from k join s on s.d = k.d and s.key = k.key join k b on b.d = s.bd and b.key = s.bkey
group by k.conv_id, k.d, k.parent_conv_id, k.n_convs, k.n_children, k.ends_sha256
"""
