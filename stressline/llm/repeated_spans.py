"""Removal of repeated byte strings by prefix-free parsing.

A rolling hash picks trigger strings; cutting at them turns every text into a
sequence of overlapping phrases (the parse), and the distinct phrases are the
dictionary. Here the trigger of a window of ``length`` bytes is its smallest
``trigger``-byte string (the rightmost of equal ones), so it depends on the window
alone: equal windows, wherever they start, have the same trigger at the same place.
The windows that share one trigger occurrence form a run; their phrase is the
text from the first window's start to the last one's end. As phrases overlap by
``length`` - 1 bytes, every window lies inside one phrase: the place of a text suffix among all
suffixes, up to ``length`` bytes, follows from the dictionary suffix it starts with, and the
parse gives the occurrences of each (its own suffix array is needed to depth one only).

* A trigger string with one occurrence: none of its windows repeats.
* All its phrases equal, two or more: all its windows repeat.
* Phrases that differ: the distinct ones, weighted by their occurrences in the
  parse, are the dictionary. It is cut into blocks of ``block`` windows; a block whose
  common part is unique, or always extends the same way, is settled alike.
* The rest is decided by corpus order: each task sorts lots of dictionary suffixes (a suffix array by the
  first ``length`` bytes; equal ones are one entry with all its places), the lots are merged by ranges of
  prefixes, one range after another in corpus order, and neighbours in that order are compared byte by byte.

Triggers group; phrases and blocks are held equal by their trigger and an xxh3 of their
bytes (64 bits each). Texts that occur more than once as a whole are weighed, not repeated. Matches
never cross documents. Null and empty texts have no bytes; texts shorter than ``length`` bytes are kept whole;
an empty table gives no rows. Every input row gives one row, repeated rows and null ids too: equal texts, equal
results, so ties cannot matter. Other columns of the input, whatever their names, are not read. Very long texts are
hashed and cut whole, one at a time; what is held is a small multiple of the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import BYTE_CODE, document_chunks, exact_keys, mix, prefix, span_hash
from .storage import Scratch

_WHOLE = 1 << 40
#: Bits of a run's place that hold its number of windows, and those for its trigger's place.
_FIELD = 12


def _as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).astype(np.uint64, copy=False).view(np.int64))


def runs(data: np.ndarray, offsets: np.ndarray, length: int, trigger: int) -> tuple[np.ndarray, ...]:
    """(document, trigger hash, phrase hash, trigger position, first and last window start) of every run;
    positions are within the document. The trigger's position in the phrase is part of the phrase hash."""
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    if len(data) < length:
        return none
    pre = prefix(BYTE_CODE[data])
    n = len(data)
    at = np.arange(n - trigger + 1)
    gram = span_hash(pre, at, at + trigger)
    low = np.uint64(0xFFFFFFFF)
    value = (gram & ~low) | (low - at.astype(np.uint64))
    width = length - trigger + 1
    m = len(value) - width + 1
    least, span = value, 1
    while span * 2 <= width:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    least = np.minimum(least[:m], least[width - span : width - span + m])
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:m]
    start = np.arange(m)
    inside = start + length <= offsets[owner + 1]
    start, owner = start[inside], owner[inside]
    if not len(start):
        return none
    anchor = (low - (least[inside] & low)).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    lo, hi = start[first], start[np.append(first[1:], len(start)) - 1]
    a, d = anchor[first], owner[first]
    phrase = exact_keys(data, lo, hi + length) ^ mix((a - lo).astype(np.uint64))
    return d, gram[a], phrase, a - offsets[d], lo - offsets[d], hi - offsets[d]


def _parse(length: int, trigger: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            t1, t2 = (batch.column(c).to_numpy() for c in ("t1", "t2"))
            keep = np.zeros(batch.num_rows, bool)
            for i, key in enumerate(zip(t1.tolist(), t2.tolist(), strict=True)):
                if key not in seen:
                    seen.add(key)
                    keep[i] = True
            if len(seen) > 1 << 19:
                seen.clear()
            text = batch.column("text").filter(pa.array(keep))
            t1, t2 = t1[keep], t2[keep]
            for lo, hi, data, offsets in document_chunks(text):
                d, core, phrase, a, first, last = runs(data, offsets, length, trigger)
                if len(d):
                    place = (first << 2 * _FIELD) | ((last - first) << _FIELD) | (a - first)
                    yield pa.RecordBatch.from_arrays([pa.array(t1[lo:hi][d]), pa.array(t2[lo:hi][d]), _as_long(core), _as_long(phrase), pa.array(place)], names=["t1", "t2", "core", "phrase", "place"])

    return run


_DICTIONARY = "core long, phrase long, held long, rel int, bytes binary"


def _dictionary(length: int):
    """The bytes of each wanted phrase from the text that represents it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = (1 << _FIELD) - 1
        for batch in batches:
            lists = batch.column("wanted")
            ends = np.asarray(lists.offsets)
            for lo, hi, data, offsets in document_chunks(batch.column("text")):
                w = lists.values.slice(ends[lo], ends[hi] - ends[lo])
                core, phrase, held, place = (w.field(c).to_numpy() for c in ("core", "phrase", "held", "place"))
                start = place >> 2 * _FIELD
                start = start + np.repeat(offsets[:-1], np.diff(ends[lo : hi + 1]))
                n = ((place >> _FIELD) & field) + length
                for k in range(0, len(core), 1 << 14):
                    part = slice(k, k + (1 << 14))
                    piece = [data[x : x + m].tobytes() for x, m in zip(start[part].tolist(), n[part].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(core[part]), pa.array(phrase[part]), pa.array(held[part]), pa.array((place[part] & field).astype(np.int32)), pa.array(piece, pa.binary())], names=["core", "phrase", "held", "rel", "bytes"]
                    )

    return run


def _blocks(length: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            core, phrase, held, rel = (batch.column(c).to_numpy() for c in ("core", "phrase", "held", "rel"))
            for lo, hi, data, offsets in document_chunks(batch.column("bytes")):
                r, n = rel[lo:hi].astype(np.int64), np.diff(offsets)
                low, high = (r - (n - length)) // block, r // block
                count = high - low + 1
                own = np.repeat(np.arange(hi - lo), count)
                b = low[own] + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
                s = np.maximum(0, r[own] - block * b - (block - 1))
                e = np.minimum(n[own] - length, r[own] - block * b)
                base = offsets[:-1][own]
                common = base + r[own] - block * b
                q = exact_keys(data, common, common + length - block + 1, 1) ^ mix(b.astype(np.uint64))
                h = exact_keys(data, base + s, base + e + length, 2) ^ mix((r[own] - s).astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(core[lo:hi][own]), pa.array(phrase[lo:hi][own]), pa.array(held[lo:hi][own]), pa.array(b.astype(np.int32)), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32)), _as_long(q), _as_long(h)],
                    names=["core", "phrase", "held", "b", "s", "e", "q", "h"],
                )

    return run


def suffix_classes(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of the given starts by their first ``length`` bytes, and where a
    new class of equal prefixes begins in it."""
    windows = np.lib.stride_tricks.sliding_window_view(data, length)[starts]
    keys = np.ascontiguousarray(windows).view(f"S{length}").ravel()
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.ones(len(order), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    return order, new


_PLACES = pa.struct([("core", pa.int64()), ("phrase", pa.int64()), ("s", pa.int32())])
_SUFFIXES = "prefix binary, held long, places array<struct<core: long, phrase: long, s: int>>"


def _suffixes(length: int, block: int, at_once: int = 40_000):
    """Suffix arrays of lots of unsettled windows: (prefix, held, places) in rising order, equal prefixes once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            core, phrase, held, rel = (batch.column(c).to_numpy() for c in ("core", "phrase", "held", "rel"))
            unsettled = batch.column("blocks").to_pylist()
            for lo, hi, data, offsets in document_chunks(batch.column("bytes")):
                own, starts = [], []
                for i in range(lo, hi):
                    n = int(offsets[i - lo + 1] - offsets[i - lo])
                    for b in unsettled[i]:
                        s, e = max(0, int(rel[i]) - block * b - (block - 1)), min(n - length, int(rel[i]) - block * b)
                        own.append(np.full(e - s + 1, i))
                        starts.append(np.arange(s, e + 1))
                own, starts = np.concatenate(own), np.concatenate(starts)
                for k in range(0, len(own), at_once):
                    o, s = own[k : k + at_once], starts[k : k + at_once]
                    place = offsets[o - lo] + s
                    order, new = suffix_classes(data, place, length)
                    first = np.flatnonzero(new)
                    head = place[order[first]]
                    o, s = o[order], s[order]
                    total = np.add.reduceat(held[o], first)
                    places = pa.StructArray.from_arrays([pa.array(core[o]), pa.array(phrase[o]), pa.array(s.astype(np.int32))], fields=list(_PLACES))
                    for j in range(0, len(first), 4096):
                        f = first[j : j + 4096]
                        end = first[j + 4096] if j + 4096 < len(first) else len(order)
                        ends = np.append(f, end) - f[0]
                        prefixes = np.lib.stride_tricks.sliding_window_view(data, length)[head[j : j + 4096]].tobytes()
                        column = pa.Array.from_buffers(pa.binary(), len(f), [None, pa.py_buffer((np.arange(len(f) + 1) * length).astype(np.int32)), pa.py_buffer(prefixes)])
                        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), places.slice(f[0], end - f[0]))
                        yield pa.RecordBatch.from_arrays([column, pa.array(total[j : j + 4096]), lists], names=["prefix", "held", "places"])

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places of suffixes that are held twice or equal a neighbour; the entries come in corpus order."""
    last: pa.RecordBatch | None = None  # one entry, held back for its next neighbour
    seen = False  # it equals the one before

    def places(part: pa.RecordBatch) -> pa.RecordBatch:
        flat = part.column("places").flatten()
        return pa.RecordBatch.from_arrays([flat.field(i) for i in range(3)], names=["core", "phrase", "s"])

    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column("prefix")
        with_last = text if last is None else pa.concat_arrays([last.column("prefix"), text])
        same = pc.equal(with_last.slice(1), with_last.slice(0, len(with_last) - 1)).to_numpy(zero_copy_only=False)
        rows = batch if last is None else pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
        repeated = rows.column("held").to_numpy() > 1
        repeated[1:] |= same
        repeated[:-1] |= same
        repeated[0] |= seen
        seen = bool(same[-1]) if len(same) else seen
        out = rows.slice(0, rows.num_rows - 1).filter(pa.array(repeated[:-1]))
        if out.num_rows:
            yield places(out)
        last = pa.RecordBatch.from_arrays([pa.concat_arrays([rows.column(c).slice(rows.num_rows - 1)]) for c in rows.schema.names], names=rows.schema.names)
    if last is not None and (seen or last.column("held")[0].as_py() > 1):
        yield places(last)


def merged(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, start and end of the maximal runs that the spans cover; touching spans are one."""
    if not len(owner):
        return owner, start, end
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    step = int(end.max()) + 2
    reach = np.maximum.accumulate(end + owner * step)
    new = np.ones(len(owner), bool)
    new[1:] = (start + owner * step)[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return owner[first], start[first], (reach[np.append(first[1:], len(owner)) - 1] - owner[first] * step)


_SPANS = pa.struct([("s", pa.int64()), ("e", pa.int64())])


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, start and end of each span of a column of span lists; a null list has none."""
    flat = lists.flatten()
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    return np.repeat(np.arange(len(lists)), n), flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy().astype(np.int64)


def _list_of(owner: np.ndarray, start: np.ndarray, end: np.ndarray, n: int, kind: pa.StructType) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(start), pa.array(end)], fields=list(kind)))


def _merge_windows(length: int):
    """Window starts of a phrase, first to last, become spans of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, s, e = _flat(batch.column("found"))
            spans = _list_of(*merged(owner, s, e + length), batch.num_rows, _SPANS)
            yield pa.RecordBatch.from_arrays([batch.column("core"), batch.column("phrase"), spans], names=["core", "phrase", "found"])

    return run


def cut(data: np.ndarray, offsets: np.ndarray, owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that are left of the texts without the (merged) spans, and their offsets."""
    edge = np.zeros(len(data) + 1, np.int8)
    np.add.at(edge, offsets[owner] + start, 1)
    np.add.at(edge, offsets[owner] + end, -1)
    gone = np.bincount(owner, end - start, minlength=len(offsets) - 1).astype(np.int64)
    return data[np.cumsum(edge[:-1], dtype=np.int8) == 0], np.concatenate([[0], np.cumsum(np.diff(offsets) - gone)])


_REMOVED = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _apply(length: int, with_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, spans = batch.column("doc_id"), batch.column("spans")
            for lo, hi, data, offsets in document_chunks(batch.column("text")):
                owner, s, e = _flat(spans.slice(lo, hi - lo))
                n = np.diff(offsets)
                e = np.minimum(e, n[owner])
                inside = n[owner] >= length
                owner, s, e = merged(owner[inside], s[inside], e[inside])
                kept, ends = cut(data, offsets, owner, s, e)
                view = memoryview(kept)
                sha = [hashlib.sha256(view[x:y]).hexdigest() for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                left = pa.array([bytes(view[x:y]) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary()) if with_bytes else pa.nulls(hi - lo, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(n), pa.array(n - np.diff(ends)), pa.array(np.bincount(owner, minlength=hi - lo)), pa.array(sha, pa.string()), _list_of(owner, s, e, hi - lo, _REMOVED), left],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept"],
                )

    return run


def remove_repeats(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 200, trigger: int = 32, block: int = 16, with_bytes: bool = False
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (byte spans) and, where asked for, kept (the bytes left)."""
    if not trigger < length - block or length >= 1 << _FIELD:
        raise ValueError(f"trigger + block must be less than length, and that less than {1 << _FIELD}")
    scratch = Scratch(docs.sparkSession, "repeats")
    docs = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(11), "text")})

    # Every side table below is written before it is joined: a join of plain exchanges is one that adaptive execution splits on a hot key.
    parse = scratch.save(
        docs.select("t1", "t2", "text").where(F.octet_length("text") >= length).mapInArrow(_parse(length, trigger), "t1 long, t2 long, core long, phrase long, place long"),
        "parse",
    )
    known = parse.groupBy("core").agg(F.count("*").alias("n"), F.min("phrase").alias("p"), F.max("phrase").alias("p2")).where("n > 1")
    known = scratch.save(known.select("core", (F.col("p") != F.col("p2")).alias("mixed")), "known")
    again = scratch.save(parse.join(known.hint("merge"), "core"), "again")
    scratch.drop(parse, known)

    mixed = again.where("mixed")
    phrases = mixed.groupBy("core", "phrase").agg(F.count("*").alias("held"), F.min(F.struct("t1", "t2", "place")).alias("at"))
    wanted = phrases.groupBy(F.col("at.t1").alias("t1"), F.col("at.t2").alias("t2")).agg(
        F.collect_list(F.struct("core", "phrase", "held", F.col("at.place").alias("place"))).alias("wanted")
    )  # at most the runs of one text
    wanted = scratch.save(wanted, "wanted")
    dictionary = docs.select("t1", "t2", "text").join(wanted.hint("merge"), ["t1", "t2"]).select("text", "wanted").mapInArrow(_dictionary(length), _DICTIONARY)
    dictionary = scratch.save(dictionary.dropDuplicates(["core", "phrase"]), "dictionary")

    blocks = scratch.save(dictionary.mapInArrow(_blocks(length, block), "core long, phrase long, held long, b int, s int, e int, q long, h long"), "blocks")
    tally = blocks.groupBy("q").agg(F.sum("held").alias("n"), F.min("h").alias("h1"), F.max("h").alias("h2")).where("n > 1")
    tally = scratch.save(tally.select("q", (F.col("h1") != F.col("h2")).alias("open")), "tally")
    every, blocks = blocks, scratch.save(blocks.join(tally.hint("merge"), "q").select("core", "phrase", "b", "s", "e", "open"), "tallied")
    scratch.drop(every)
    unsettled = blocks.where("open").groupBy("core", "phrase").agg(F.collect_list("b").alias("blocks"))  # at most length / block
    # Not written: choosing the ranges sorts the lots a second time, which costs less than a table of all prefixes.
    suffixes = dictionary.join(unsettled, ["core", "phrase"]).mapInArrow(_suffixes(length, block), _SUFFIXES)
    order = suffixes.repartitionByRange("prefix").sortWithinPartitions("prefix")
    decided = order.mapInArrow(_neighbours, "core long, phrase long, s int")
    settled = blocks.where("not open").select("core", "phrase", "s", "e")
    found = settled.union(decided.select("core", "phrase", "s", F.col("s").alias("e")))
    found = found.groupBy("core", "phrase").agg(F.collect_list(F.struct("s", "e")).alias("found"))  # at most the windows of a run
    found = scratch.save(found.mapInArrow(_merge_windows(length), "core long, phrase long, found array<struct<s: long, e: long>>"), "found")
    scratch.drop(dictionary, blocks, wanted, tally)

    lo = F.shiftright("place", 2 * _FIELD)
    n = F.shiftright("place", _FIELD).bitwiseAND(F.lit((1 << _FIELD) - 1))
    spans = (
        again.where("not mixed")
        .select("t1", "t2", lo.alias("s"), (lo + n + length).alias("e"))
        .union(mixed.join(found.hint("merge"), ["core", "phrase"]).select("t1", "t2", lo.alias("lo"), F.explode("found").alias("x")).select("t1", "t2", (F.col("lo") + F.col("x.s")), (F.col("lo") + F.col("x.e"))))
        .union(docs.groupBy("t1", "t2").count().where("count > 1").select("t1", "t2", F.lit(0).cast("long"), F.lit(_WHOLE).cast("long")))
    )
    spans = spans.groupBy("t1", "t2").agg(F.collect_set(F.struct("s", "e")).alias("spans"))  # a few for each run of one text: every task that met a copy brings the same ones
    spans = scratch.save(spans, "spans")
    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start: long, end: long>>, kept binary"
    out = docs.join(spans.hint("merge"), ["t1", "t2"], "left").select("doc_id", "text", "spans").mapInArrow(_apply(length, with_bytes), kind)
    return out if with_bytes else out.drop("kept")
