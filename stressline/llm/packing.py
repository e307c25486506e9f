"""Concatenate and cut: documents become one stream of token ids that is cut into fixed windows.

Pass 1 tokenises every text once and writes (part, position in part, running
total in part, ids). Prefix sums over the parts' totals, one row a part, give each part
its offset in the stream. Pass 2 reads the written table, adds the offset and
cuts each document at the window borders: a document that crosses a border
gives a record on either side. Only the last window can be short, so the padding is
less than one window in all.

Null and empty texts are a single end id; repeated rows are packed once each, and as ids go by place in the stream, ties cannot matter.
A very long text is tokenised whole, in runs that end at blanks, and cut into many pieces. An empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytehash import LOWER, document_chunks, string_buffers, word_spans
from .storage import Scratch

_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_MARK = np.zeros(256, bool)
_MARK[list(_MARKS)] = True
_LETTER = np.array([bytes([c]).isalnum() for c in range(256)])  # ASCII letters and digits
_BLANK = np.zeros(256, bool)
_BLANK[[10, 32]] = True
_LONGEST_MARKS = 16


def _units(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word and end of each part that words are taken apart into: up to _LONGEST_MARKS closing marks after an ASCII letter or digit are
    a part of their own, all else is left whole. Parts follow one another without gaps."""
    at = np.flatnonzero(_MARK[low[end - 1]])
    cut, open_ = end[at] - 1, np.arange(len(at))
    for _ in range(_LONGEST_MARKS):
        open_ = open_[(cut[open_] > start[at[open_]]) & _MARK[low[cut[open_] - 1]]]
        if not len(open_):
            break
        cut[open_] -= 1
    apart = (cut > start[at]) & _LETTER[low[cut - 1]]
    at, cut = at[apart], cut[apart]
    parts = np.ones(len(start), np.int64)
    parts[at] = 2
    word = np.repeat(np.arange(len(start)), parts)
    stop = end[word]
    stop[np.cumsum(parts)[at] - 2] = cut
    return word, stop


def _values(column: pa.Array) -> list[bytes]:
    """What to_pylist gives for binary values without nulls, in a third of the time."""
    if not len(column):
        return []
    _, bounds, raw = column.buffers()
    cuts = np.frombuffer(bounds, np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    raw = raw.to_pybytes()
    return [raw[lo:hi] for lo, hi in zip(cuts, cuts[1:], strict=False)]


def _runs(data: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of one text that end after a blank: up to most bytes, or up to the first blank after that."""
    lo = 0
    while lo < len(data):
        hi = min(lo + most, len(data))
        if hi < len(data):
            blanks = np.flatnonzero(_BLANK[data[lo:hi]])
            while not len(blanks) and hi < len(data):
                start, hi = hi, min(hi + most, len(data))
                blanks = np.flatnonzero(_BLANK[data[start:hi]])[:1] + start - lo
            hi = lo + int(blanks[-1]) + 1 if len(blanks) else hi
        yield lo, hi
        lo = hi


class WordTokenizer:
    """Ids of whole texts for a tokenizer that never joins words across white space.

    Words and the marks that close them are encoded by the tokenizer the first time they come up and taken from a
    cache of at most ``most`` bytes after that; new words are encoded in lots of ``lot`` joined by blanks. In a chunk of texts each distinct word is looked up once,
    and the ids of all words are gathered at once. ASCII upper case is folded before, as the vocabulary is lower case; texts with the strings of special tokens go to the tokenizer whole. A word is taken apart before its closing marks only where the
    tokenizer itself, after its own normalisation, cuts there. What the tokenizer returns takes some hundred bytes an id, so it is handed
    ``new_bytes`` at once, and a long text goes through in runs of ``run_bytes``."""

    ENTRY = 180  # bytes of the objects of a cached word beside its own

    def __init__(self, path: str, most: int = 240_000_000, lot: int = 512, new_bytes: int = 1 << 17, run_bytes: int = 1 << 21):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.kind = "H" if max(vocab.values()) < 1 << 16 else "I"
        self.final = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.final[i] = token.endswith("</w>")
        self.cache: dict[bytes, bytes] = {}
        self.apart: dict[str, bool] = {}
        self.held, self.most, self.lot, self.new_bytes, self.run_bytes = 0, most, lot, new_bytes, run_bytes

    def _ids(self, words: list[bytes]) -> Iterator[list[int]]:
        """Ids of each, by groups of new_bytes or one longer."""
        ends, lo = np.cumsum([len(w) for w in words]), 0
        while lo < len(words):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + self.new_bytes, "right")))
            for e in self.tokenizer.encode_batch_fast([w.decode() for w in words[lo:hi]], add_special_tokens=False):
                yield e.ids
            lo = hi

    def _bytes(self, ids: list[int]) -> bytes:
        return array(self.kind, ids).tobytes()

    def _cuts_after(self, c: str) -> bool:
        """Whether the tokenizer cuts between this character and closing marks: a letter that normalises to letter and mark is not cut there."""
        found = self.apart.get(c)
        if found is None:
            pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(f"{c}."))
            found = self.apart[c] = len(pieces) > 1 and pieces[-1][0] == "."
        return found

    def _keep(self, words: list[bytes], ids: list[bytes]) -> None:
        self.cache.update(zip(words, ids, strict=True))
        self.held += self.ENTRY * len(words) + sum(map(len, words)) + sum(map(len, ids))

    def _learn(self, words: list[bytes]) -> None:
        parts: dict[bytes, int] = {}  # length of the letters of a word that ends in ASCII punctuation
        whole: set[bytes] = set()
        for w in words:
            if w[-1] in _MARKS:
                n = len(w.rstrip(_MARKS))
                if n and (w[n - 1 : n].isalnum() or (w[n - 1] > 127 and self._cuts_after(w[:n].decode()[-1]))):
                    parts[w] = n
                    whole.add(w[:n])
                    whole.add(w[n:])
                    continue
            whole.add(w)
        plain: list[bytes] = []
        other: list[bytes] = []
        for w in whole.difference(self.cache):
            (plain if w.isalpha() or (not w.isascii() and w.decode().isalpha()) else other).append(w)
        lots = [plain[i : i + self.lot] for i in range(0, len(plain), self.lot)]
        step = array(self.kind).itemsize
        for lot, e in zip(lots, self._ids([b" ".join(lot) for lot in lots]), strict=True):
            ids = np.array(e, np.int64)
            ends = np.flatnonzero(self.final[ids]) + 1 if len(ids) else ids
            if len(ends) != len(lot) or ends[-1] != len(ids):  # a word of several parts, or none
                other += lot
                continue
            raw, cuts = ids.astype(self.kind).tobytes(), (ends * step).tolist()
            self._keep(lot, [raw[lo:hi] for lo, hi in zip([0, *cuts], cuts, strict=False)])
        self._keep(other, [self._bytes(e) for e in self._ids(other)])
        self._keep(list(parts), [self.cache[w[:n]] + self.cache[w[n:]] for w, n in parts.items()])

    def encode_chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has; text i is data[offsets[i] : offsets[i + 1]], UTF-8."""
        if len(offsets) != 2 or len(data) <= self.run_bytes:
            return self._encode_run(data, offsets)
        flats = [self._encode_run(data[lo:hi], np.array([0, hi - lo]))[0] for lo, hi in _runs(data, self.run_bytes)]
        return np.concatenate(flats), np.array([sum(map(len, flats))])

    def _encode_run(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.held > self.most:
            self.cache.clear()
            self.held = 0
        low, n = LOWER[data], len(offsets) - 1
        special = np.unique(np.searchsorted(offsets, np.flatnonzero((data[:-1] == 60) & (data[1:] == 124)), "right") - 1).tolist()  # "<|"
        for i in special:
            low[offsets[i] : offsets[i + 1]] = 32
        start, end, doc = word_spans(low, offsets, _BLANK)
        word, stop = _units(low, start, end)
        doc = doc[word]
        low = low[~_BLANK[low]]
        lengths = stop - np.where(np.diff(word, prepend=-1) > 0, start[word], np.concatenate([[0], stop[:-1]]))
        bounds = np.zeros(len(word) + 1, np.int32)
        np.cumsum(lengths, out=bounds[1:])
        found = pa.Array.from_buffers(pa.binary(), len(word), [None, pa.py_buffer(bounds), pa.py_buffer(low)]).dictionary_encode()
        distinct, code = _values(found.dictionary), found.indices.to_numpy()
        ids = list(map(self.cache.get, distinct))
        new = [i for i, known in enumerate(ids) if known is None]
        if new:
            self._learn([distinct[i] for i in new])
            for i in new:
                ids[i] = self.cache[distinct[i]]
        if special:
            whole = [self._bytes(self.tokenizer.encode(data[offsets[i] : offsets[i + 1]].tobytes().decode(), add_special_tokens=False).ids) for i in special]
            code, doc = np.concatenate([code, len(ids) + np.arange(len(whole))]), np.concatenate([doc, special])
            ids += whole
            order = np.argsort(doc, kind="stable")
            code, doc = code[order], doc[order]
        known = np.frombuffer(b"".join(ids), self.kind)
        held = np.fromiter(map(len, ids), np.int64, len(ids)) // known.itemsize
        first = (np.cumsum(held) - held)[code]
        count = held[code]
        ends = np.cumsum(count)
        flat = known[np.repeat(first - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)]
        return flat, np.bincount(doc, count, minlength=n).astype(np.int64)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian ids of each text."""
        raw = [(t or "").encode() for t in texts]
        flat, counts = self.encode_chunk(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        return [x.tobytes() for x in np.split(flat, np.cumsum(counts)[:-1])] if texts else []


_loaded: dict[str, WordTokenizer] = {}


def _tokenise(path: str, end_id: int, bytes_at_once: int = 1 << 21):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _loaded.get(path) or _loaded.setdefault(path, WordTokenizer(path))
        step = array(tok.kind).itemsize
        part = TaskContext.get().partitionId()
        total = row = 0
        for batch in batches:
            for lo, hi, data, offsets in document_chunks(batch.column("text"), bytes_at_once):
                flat, n = tok.encode_chunk(data, offsets)
                n += 1
                last = np.cumsum(n)
                own = np.ones(int(last[-1]), bool)
                own[last - 1] = False
                ids = np.full(len(own), end_id, flat.dtype)
                ids[own] = flat
                bounds = np.concatenate([[0], last * step]).astype(np.int32)
                base = total + last - n
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(np.full(len(n), part, np.int32)), pa.array(row + np.arange(len(n))), pa.array(base), pa.array(n), pa.array(np.full(len(n), step, np.int32)), pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(bounds), pa.py_buffer(ids)])],
                    names=["doc_id", "part", "nth", "base", "doc_tokens", "width", "ids"],
                )
                total += int(n.sum())
                row += len(n)

    return run


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"


def _cut(size: int, with_ids: bool, ids_at_once: int = 1 << 20):
    def pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, n = batch.column("at").to_numpy(), batch.column("doc_tokens").to_numpy()
        count = (at + n - 1) // size - at // size + 1
        own = np.repeat(np.arange(len(n)), count)
        seq = (at // size)[own] + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
        lo = np.maximum(at[own], seq * size)
        hi = np.minimum((at + n)[own], (seq + 1) * size)
        start, length = lo - at[own], hi - lo
        width = batch.column("width")[0].as_py()  # of one tokenizer, so of all rows
        ids = string_buffers(batch.column("ids"))[0].view("<u2" if width == 2 else "<u4").astype("<u4")
        cuts = np.concatenate([[0], np.cumsum(length)])  # the pieces follow one another as the ids do
        crc = [zlib.crc32(ids[a:b]) for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]
        lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids.view(np.int32))) if with_ids else pa.nulls(len(own), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(own)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(n[own]), pa.array(seq), pa.array(lo - seq * size), lists],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, lo = np.cumsum(batch.column("doc_tokens").to_numpy()), 0
            while lo < len(ends):  # whole documents of up to ids_at_once, or one longer document
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + ids_at_once, "right")))
                yield pieces(batch.slice(lo, hi - lo))
                lo = hi

    return run


def pack_documents(
    docs: DataFrame, *, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 1, with_ids: bool = False
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, where asked for, ids."""
    scratch = Scratch(docs.sparkSession, "packing")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tokens = docs.mapInArrow(_tokenise(tokenizer, end_id), "doc_id long, part int, nth long, base long, doc_tokens long, width int, ids binary")
    tokens = scratch.save(tokens, "tokens")
    parts = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("total"))  # one row for each task of pass 1
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    placed = tokens.join(F.broadcast(parts), "part").select("doc_id", "doc_tokens", "width", "ids", (F.col("base") + F.col("before")).alias("at"))
    out = placed.mapInArrow(_cut(size, with_ids), _PIECE)
    return out if with_ids else out.drop("ids")
