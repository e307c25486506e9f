"""Ranked lexical search by Block-Max MaxScore over document shards.

Documents are read twice. The first pass takes the terms of every whole text, counts them and writes for each document those that some item asks for; Spark adds up the
collection's statistics. In the second pass a task indexes its documents in shards of bounded size: postings lie in compressed blocks of 128 with the largest impact of each block.
For an item, the lists in order of their bounds split into non-essential ones, whose bounds together stay below the threshold (the score of the last place so far), and essential
ones. Only documents of essential lists are candidates. Their bound is then narrowed by the maxima of the blocks that could hold them in the non-essential
lists, and only blocks of candidates that are still above the threshold are decompressed. The best of a task's shards are one heap an item; the heaps of all tasks meet in a window that keeps ``k`` rows
on the map side.

Items are a stated query set: they are taken in blocks of at most ``items_at_once`` items and about ``terms_at_once`` terms, which bounds what is broadcast; documents are never
sampled. Terms are runs of ASCII letters, digits and bytes from 0x80 on, A-Z lower-cased, compared by two independent 64-bit hashes. Null and empty texts have no terms and are in no count.
Rows of one item_id, null included, are one item with the terms of all. Repeated documents are ranked each; equal scores go by doc_id, nulls last.
Very long texts are read whole. Empty tables give no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytehash import LOWER, document_chunks, word_keys, word_prefix, word_spans
from .storage import Scratch

#: Bytes that keep terms apart: all ASCII but letters and digits.
APART = np.ones(256, bool)
APART[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

BLOCK = 128


# ---------------------------------------------------------------- terms


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item_id and term of every term of every text."""
    for batch in batches:
        for lo, hi, data, offsets in document_chunks(batch.column("text")):
            s, e, doc = word_spans(data, offsets, APART)
            raw = LOWER[data].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("item_id").slice(lo, hi - lo).take(pa.array(doc)), pa.array([raw[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)], pa.binary())], names=["item_id", "term"])


def term_hashes(terms: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b" ".join(terms), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in terms]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
    return tuple(word_keys(data, word_prefix(data, starts, salt), starts, ends, salt) for salt in (0, 1))


_MATCH = "doc_id long, n long, terms array<int>, tfs array<int>"


def _match(asked):
    """Length of every text in terms, and which asked terms it holds how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = asked.value
        for batch in batches:
            for lo, hi, data, offsets in document_chunks(batch.column("text")):
                s, e, doc = word_spans(data, offsets, APART)
                low = LOWER[data]
                key = word_keys(low, word_prefix(low, s), s, e)
                at = np.minimum(np.searchsorted(first, key), len(first) - 1)
                hit = np.flatnonzero(first[at] == key)
                other = word_keys(low, word_prefix(low, s, 1), s[hit], e[hit], 1)
                hit = hit[second[at[hit]] == other]
                both, tf = np.unique(doc[hit] * len(first) + at[hit], return_counts=True)
                owner = both // len(first)
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=hi - lo))]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (both % len(first), tf)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(np.bincount(doc, minlength=hi - lo).astype(np.int64)), *lists], names=["doc_id", "n", "terms", "tfs"])

    return run


# ---------------------------------------------------------------- a shard's index


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


@dataclass
class Postings:
    """The blocks of one list: first and last document, largest impact, and where the compressed rows lie."""

    first: np.ndarray
    last: np.ndarray
    count: np.ndarray
    top: np.ndarray
    rows: np.ndarray


class Shard:
    """Postings of some documents, in blocks whose gaps and counts take one, two or four bytes each."""

    def __init__(self, terms: np.ndarray, slots: np.ndarray, tf: np.ndarray, m: np.ndarray):
        """Postings sorted by (term, slot); m by slot."""
        self.m = m
        self.lists: dict[int, Postings] = {}
        n = len(terms)
        starts = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if n else np.zeros(0, np.int64)
        size = np.diff(np.append(starts, n))
        blocks = -(-size // BLOCK)
        owner = np.repeat(np.arange(len(starts)), blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        lo = starts[owner] + nth * BLOCK
        count = np.minimum(BLOCK, starts[owner] + size[owner] - lo)
        self._store(slots, tf, lo, count)
        hi = lo + count
        top = np.maximum.reduceat(impacts(tf, m[slots]), lo) if n else np.zeros(0, np.int64)
        cuts = np.concatenate([[0], np.cumsum(blocks)])
        for i, t in enumerate(terms[starts].tolist()):
            a, b = cuts[i], cuts[i + 1]
            self.lists[t] = Postings(slots[lo[a:b]], slots[hi[a:b] - 1], count[a:b], top[a:b], np.arange(a, b))

    def _store(self, slots: np.ndarray, tf: np.ndarray, lo: np.ndarray, count: np.ndarray) -> None:
        self.base, self.kind, self.place = slots[lo], np.zeros(len(lo), np.int8), np.zeros(len(lo), np.int64)
        self.data: list[tuple[np.ndarray, np.ndarray]] = []
        gap = np.diff(slots, prepend=0)
        gap[lo] = 0
        widest = np.maximum(np.maximum.reduceat(gap, lo), np.maximum.reduceat(tf, lo)) if len(lo) else lo
        self.kind[:] = (widest > 0xFF).astype(np.int8) + (widest > 0xFFFF)
        column = np.arange(BLOCK)
        for k, width in enumerate((np.uint8, np.uint16, np.uint32)):
            mine = np.flatnonzero(self.kind == k)
            self.place[mine] = np.arange(len(mine))
            at = np.minimum(lo[mine, None] + column, (lo[mine] + count[mine] - 1)[:, None])
            self.data.append((gap[at].astype(width), tf[at].astype(width)))

    def read(self, blocks: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and counts of some blocks of one list, decompressed, in order."""
        gap, tf = np.empty((len(blocks), BLOCK), np.int64), np.empty((len(blocks), BLOCK), np.int64)
        for k in np.unique(self.kind[blocks]).tolist():
            at = np.flatnonzero(self.kind[blocks] == k)
            gap[at], tf[at] = (x[self.place[blocks[at]]] for x in self.data[k])
        slot = np.cumsum(gap, axis=1) + self.base[blocks][:, None]
        real = np.arange(BLOCK) < count[:, None]
        return slot[real], tf[real]

    def contributions(self, p: Postings, weight: int, which: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        rows, count = (p.rows, p.count) if which is None else (p.rows[which], p.count[which])
        slot, tf = self.read(rows, count)
        return slot, weight * impacts(tf, self.m[slot])

    def search(self, terms: np.ndarray, weight: np.ndarray, k: int, floor: int, acc: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Slots and scores of all documents that score ``floor`` or more and may be among the best k, and how many blocks were decompressed.
        acc is zero for every slot and is left so."""
        have = sorted(x for x in ((int(weight[t]) * int(self.lists[t].top.max()), t) for t in terms.tolist() if t in self.lists) if x[0] > 0)
        bound = np.cumsum([b for b, _ in have])
        seen, at, read = [], len(have), 0
        while at > 0 and bound[at - 1] >= floor:  # the lists before at cannot reach the floor together: the others are essential
            at -= 1
            p, w = self.lists[have[at][1]], int(weight[have[at][1]])
            slot, value = self.contributions(p, w)
            acc[slot] += value
            seen.append(slot)
            read += len(p.rows)
            if len(slot) >= k:  # what k documents have reached already is a lower bound of the last place
                floor = max(floor, int(np.partition(acc[slot], -k)[-k]))
        if not seen:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        cand = np.unique(np.concatenate(seen))
        score = acc[cand]
        acc[cand] = 0
        rest = [(self.lists[t], int(weight[t])) for _, t in have[:at]]
        if len(cand) >= k:
            floor = max(floor, int(np.partition(score, -k)[-k]))
        keep = score + (bound[at - 1] if at else 0) >= floor
        cand, score = cand[keep], score[keep]
        # Maxima of the blocks that may hold a candidate, before anything of them is decompressed.
        most = score.copy()
        for p, w in rest:
            most += w * self._held(p, cand)[1]
        for p, w in rest[::-1]:
            keep = most >= floor
            if not keep.all():
                cand, score, most = cand[keep], score[keep], most[keep]
            block, top = self._held(p, cand)
            ask = np.flatnonzero(top > 0)
            if len(ask):
                which = np.unique(block[ask])
                slot, value = self.contributions(p, w, which)
                read += len(which)
                place = np.minimum(np.searchsorted(slot, cand[ask]), len(slot) - 1)
                gain = np.where(slot[place] == cand[ask], value[place], 0)
                score[ask] += gain
                most[ask] += gain - w * top[ask]
            if len(cand) >= k:
                floor = max(floor, int(np.partition(score, -k)[-k]))
        keep = score >= floor
        return cand[keep], score[keep], read

    def _held(self, p: Postings, cand: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block of a list that could hold each candidate, and its largest impact (0 where the candidate lies between blocks)."""
        b = np.minimum(np.searchsorted(p.last, cand), len(p.last) - 1)
        return b, np.where((p.first[b] <= cand) & (cand <= p.last[b]), p.top[b], 0)


_HIT = "item int, doc_id long, score long"


def _search(model, k: int, shard_rows: int, shard_postings: int):
    """The best k of a task's documents for every item; one shard of documents at a time is in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight, n_docs, length = model.value
        heaps = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)) for _ in items]
        held: list[pa.RecordBatch] = []

        def close() -> None:
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            ids, none = t["doc_id"].fill_null(0).to_numpy(), t["doc_id"].is_null().to_numpy()
            m = 10 + (90 * t["n"].to_numpy() * n_docs) // length
            lists = t["terms"].combine_chunks()
            ends = np.asarray(lists.offsets).astype(np.int64)
            terms, tf = lists.flatten().to_numpy().astype(np.int64), t["tfs"].combine_chunks().flatten().to_numpy().astype(np.int64)
            slots = np.repeat(np.arange(t.num_rows), np.diff(ends))
            order = np.argsort(terms, kind="stable")
            shard, acc = Shard(terms[order], slots[order], tf[order], m), np.zeros(t.num_rows, np.int64)
            for i, asked in enumerate(items):
                d, z, s = heaps[i]
                slot, score, _ = shard.search(asked, weight, k, max(1, int(s[-1])) if len(s) == k else 1, acc)
                if len(slot):
                    d, z, s = np.append(d, ids[slot]), np.append(z, none[slot]), np.append(s, score)
                    best = np.lexsort((d, z, -s))[:k]
                    heaps[i] = (d[best], z[best], s[best])

        rows = postings = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                piece = batch.slice(lo, 4096)
                held.append(piece)
                rows += piece.num_rows
                postings += len(piece.column("terms").flatten())
                if rows >= shard_rows or postings >= shard_postings:
                    close()
                    rows = postings = 0
        if held:
            close()
        for i, (d, z, s) in enumerate(heaps):
            if len(d):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), i, np.int32)), pa.array(d, mask=z), pa.array(s)], names=["item", "doc_id", "score"])

    return run


def _ranked(docs: DataFrame, asked: pa.Table, scratch: Scratch, nth: int, k: int, shard_rows: int, shard_postings: int) -> DataFrame:
    """One block of items. asked: item_id and term, both distinct."""
    sc = docs.sparkSession.sparkContext
    words = sorted(set(asked["term"].to_pylist()))
    first, second = term_hashes(words)
    order = np.argsort(first)
    number = {words[j]: i for i, j in enumerate(order.tolist())}
    matches = scratch.save(docs.mapInArrow(_match(sc.broadcast((first[order], second[order]))), _MATCH), f"matches{nth}")
    n_docs, length = matches.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(words))
    for r in matches.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row an asked term
        df[r["t"]] = r["count"]
    weight = np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * df + 1))).astype(np.int64)
    ids: dict = {}
    for i, t in zip(asked["item_id"].to_pylist(), asked["term"].to_pylist(), strict=True):
        ids.setdefault(i, []).append(number[t])
    names, items = list(ids), [np.array(sorted(v)) for v in ids.values()]
    model = sc.broadcast((items, weight, n_docs, max(length, 1)))
    hits = matches.where(F.size("terms") > 0).mapInArrow(_search(model, k, shard_rows, shard_postings), _HIT)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    best = hits.withColumn("rank", place).where(F.col("rank") <= k)
    table = docs.sparkSession.createDataFrame([(i, None if x is None else int(x)) for i, x in enumerate(names)], "item int, item_id long")
    return best.join(F.broadcast(table), "item").select("item_id", "rank", "doc_id", "score")  # items_at_once rows


def rank_documents(
    docs: DataFrame, items: DataFrame, *, k: int = 10, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", items_at_once: int = 1000, terms_at_once: int = 100_000, shard_rows: int = 1 << 16, shard_postings: int = 1 << 22
) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents, all with a score above 0 where there are fewer."""
    scratch = Scratch(docs.sparkSession, "search")
    docs = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_terms, "item_id long, term binary").distinct()
    asked = scratch.save(asked, "asked")
    n_items, n_terms = asked.select("item_id").distinct().count(), asked.count()
    blocks = max(1, -(-n_items // items_at_once), -(-n_terms // terms_at_once))
    out = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toArrow()
        if part.num_rows:
            found = _ranked(docs, part, scratch, b, k, shard_rows, shard_postings)
            out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")


ORACLE_SQL = r"""
with d as (select row_number() over () as r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
q as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
len as (select r, count(*) as n from d group by r),
tot as (select count(*) as big_n, cast(sum(n) as bigint) as big_l from len),
tf as (select r, doc_id, term, count(*) as tf from d where term in (select term from q) group by r, doc_id, term),
df as (select term, count(*) as df from tf group by term),
w as (select term, cast(floor(1000 * ln((2.0::double * big_n + 2) / (2.0::double * df + 1))) as bigint) as w from df, tot),
s as (select q.item_id, tf.r, tf.doc_id, cast(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (10 + (90 * len.n * tot.big_n) // tot.big_l)))) as bigint) as score
      from q join tf using (term) join w using (term) join len on len.r = tf.r, tot group by q.item_id, tf.r, tf.doc_id),
k as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from k where rank <= 10
"""
