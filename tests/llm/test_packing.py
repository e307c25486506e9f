import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stressline.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


def _texts(seed=2):
    r = random.Random(seed)
    odd = ["A", "é", "É", "don't", "it's.", "x..", "3.14", "İstanbul", "ΣΑΣ", "áb", "́", "<|endoftext|>", "<|ENDOFTEXT|>", "a\tb", " ", "\x1c", "日本語", "|", "K", "q,", "!!,", "ſ", "ﬁ", "'S", "a'lls", " ", "2²", "²", "ª.", "_", "🙂."]
    out = [None, "", " ", "\n\n", "Hello World.", "x" * 5000, *odd]
    for _ in range(60):
        out.append("".join(r.choice(odd + ["the", "Rat", "of", "untold"]) + r.choice(["", " ", " ", "\n", "  "]) for _ in range(r.choice([3, 40, 400, 1500]))))
    return out


def test_cached_words_are_the_tokenizers_ids():
    ref = Tokenizer.from_file(PATH)
    tok = P.WordTokenizer(PATH)
    for texts in (_texts(1), _texts(2)):
        for t, raw in zip(texts, tok.encode(texts), strict=True):
            assert np.frombuffer(raw, "<u2").tolist() == ref.encode(t or "", add_special_tokens=False).ids, t


def test_every_letter_before_and_after_marks():
    """Letters such as U+0130 or U+0958 normalise to letter and mark, which joins the marks that follow."""
    ref, tok = Tokenizer.from_file(PATH), P.WordTokenizer(PATH)
    for form in ("a{}, b", "{}. {}", "({}A)!", ".{}\u0301;"):
        texts = [form.format(chr(c), chr(c)) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
        want = ref.encode_batch(texts, add_special_tokens=False)
        assert [t for t, raw, e in zip(texts, tok.encode(texts), want, strict=True) if np.frombuffer(raw, "<u2").tolist() != e.ids] == []


def test_random_strings_of_letters_that_normalise():
    ref, tok = Tokenizer.from_file(PATH), P.WordTokenizer(PATH, most=20_000)
    r = random.Random(5)
    signs = [*"İıŞşaZé.,!?;:)(\"'-_ ", "s", "\u0958", "\u0929", "\u09dc", "\u0a33", "\u0f43", "\ufb1d", "\u05b4", "\u05d9", "\u0301", "\u0307", "\u1100", "\u1161", "\u11a8", "\u212b", "TARİHİ, ŞEHİR."]
    for _ in range(60):
        texts = ["".join(r.choice(signs) for _ in range(r.randint(1, 40))) for _ in range(100)]
        for t, raw in zip(texts, tok.encode(texts), strict=True):
            assert np.frombuffer(raw, "<u2").tolist() == ref.encode(t, add_special_tokens=False).ids, t
        assert tok.held < 20_000 + 200_000


@pytest.mark.parametrize("size", [2048, 16])
def test_round_trip(spark, size):
    ref = Tokenizer.from_file(PATH)
    texts = _texts()
    df = spark.createDataFrame([(i, t, 1, "y") for i, t in enumerate(texts)], "doc_id long, text string, start int, ids string").repartition(4)
    rows = P.pack_documents(df, tokenizer=PATH, size=size, with_ids=True).collect()
    by_doc, by_seq = {}, {}
    for x in rows:
        by_doc.setdefault(x["doc_id"], []).append(x)
        by_seq.setdefault(x["sequence_id"], []).append(x)
    for i, t in enumerate(texts):
        want = [*ref.encode(t or "", add_special_tokens=False).ids, 1]
        pieces = sorted(by_doc[i], key=lambda x: x["start"])
        assert [v for x in pieces for v in x["ids"]] == want
        assert {x["doc_tokens"] for x in pieces} == {len(want)}
        for x in pieces:
            part = want[x["start"] : x["start"] + x["length"]]
            assert x["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    fill = {}
    for s, pieces in by_seq.items():
        at = 0
        for x in sorted(pieces, key=lambda x: x["offset"]):
            assert x["offset"] == at
            at += x["length"]
        fill[s] = at
    assert sorted(fill) == list(range(len(fill)))
    assert all(fill[s] == size for s in range(len(fill) - 1)) and fill[len(fill) - 1] <= size


def test_empty_table(spark):
    assert P.pack_documents(spark.createDataFrame([], "doc_id long, text string"), tokenizer=PATH).count() == 0


def test_closing_marks_make_no_new_words():
    ref, tok, r = Tokenizer.from_file(PATH), P.WordTokenizer(PATH), random.Random(4)
    words = list({"".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(200)})
    marks = [",", ".", "!", "...", "###", ";)", '"', "%"]
    texts = ["\n".join(w + m for w in words) for m in marks]
    assert [np.frombuffer(raw, "<u2").tolist() for raw in tok.encode(texts)] == [e.ids for e in ref.encode_batch(texts, add_special_tokens=False)]
    assert len(tok.cache) <= len(words) + len(marks)


def test_texts_of_a_chunk_do_not_touch():
    """Marks of one text and letters of the next, special tokens between and over texts, long runs of marks."""
    ref, tok = Tokenizer.from_file(PATH), P.WordTokenizer(PATH)
    texts = ["ab", "...", None, "c", "", "x<", "|y", "d <|endoftext|> e.", "f", "<|", " \n ", "g" + "!" * 40 + " h", "i" + "-" * 16, "j" + "-" * 17, "!" * 50, "'s", "k", "'s", "é", ".,", "́", "<|startoftext|>"]
    for lot in (texts, texts[::-1], texts[:1], texts[2:3], ["<|"], []):
        assert [np.frombuffer(raw, "<u2").tolist() for raw in tok.encode(lot)] == [ref.encode(t or "", add_special_tokens=False).ids for t in lot]


def test_the_tokenizer_gets_few_new_words_at_once():
    """What it returns takes some hundred bytes an id, for texts of words that never came up before."""
    ref, tok, r, given = Tokenizer.from_file(PATH), P.WordTokenizer(PATH), random.Random(6), []

    class Noted:
        def __getattr__(self, name):
            return getattr(ref, name)

        def encode_batch_fast(self, texts, **options):
            given.append(sum(len(t.encode()) for t in texts))
            return ref.encode_batch_fast(texts, **options)

    tok.tokenizer = Noted()
    texts = [" ".join("".join(r.choice(signs) for _ in range(7)) for _ in range(40_000)) for signs in ("abcdefghij", "abcde01234-/", "a" + "日本語年月火水木金土")]
    assert [np.frombuffer(raw, "<u2").tolist() for raw in tok.encode(texts)] == [e.ids for e in ref.encode_batch(texts, add_special_tokens=False)]
    assert max(given) <= 200_000 < sum(given)


def test_a_long_text_goes_through_in_runs(monkeypatch):
    ref, tok, seen, spans = Tokenizer.from_file(PATH), P.WordTokenizer(PATH), [], P.word_spans

    def noted(data, *rest):
        seen.append(len(data))
        return spans(data, *rest)

    monkeypatch.setattr(P, "word_spans", noted)
    text = "Untold rats, <|endoftext|> it's.\n" * 70_000 + "x" * 3_000_000 + " the end"
    got = np.frombuffer(tok.encode([text])[0], "<u2")
    parts = [ref.encode(t, add_special_tokens=False).ids for t in ("Untold rats, <|endoftext|> it's.\n", "x" * 3_000_000 + " the end")]
    assert got.tolist() == parts[0] * 70_000 + parts[1]
    assert max(seen) <= 3_000_000 + (1 << 21) < len(text)


def test_runs_end_at_blanks_only():
    ref, tok = Tokenizer.from_file(PATH), P.WordTokenizer(PATH, run_bytes=9)
    for t in _texts(7):
        data = np.frombuffer((t or "").encode(), np.uint8)
        runs = list(P._runs(data, 9))
        assert [i for lo, hi in runs for i in range(lo, hi)] == list(range(len(data)))
        assert all(data[hi - 1] in (10, 32) for _, hi in runs[:-1])
        assert np.frombuffer(tok.encode([t])[0], "<u2").tolist() == ref.encode(t or "", add_special_tokens=False).ids


def test_pieces_of_long_documents_come_in_bounded_batches():
    import pyarrow as pa

    r = np.random.default_rng(8)
    n = np.array([*[300_000] * 12, 1, 3_000_000, *[1] * 50])
    ids = [r.integers(0, 1 << 16, m).astype("<u2") for m in n]
    at = 777 + np.cumsum(n) - n
    whole = {"doc_id": pa.array(range(len(n))), "doc_tokens": pa.array(n), "width": pa.array(np.full(len(n), 2, np.int32)), "ids": pa.array([x.tobytes() for x in ids], pa.binary()), "at": pa.array(at)}
    out = list(P._cut(2048, True)(iter([pa.RecordBatch.from_pydict(whole).slice(0, 5), pa.RecordBatch.from_pydict(whole).slice(5)])))
    assert all(sum(b.column("length").to_pylist()) <= 1 << 20 or len(set(b.column("doc_id").to_pylist())) == 1 for b in out)
    rows = [x for b in out for x in b.to_pylist()]
    for d, (want, first) in enumerate(zip(ids, at.tolist(), strict=True)):
        mine = [x for x in rows if x["doc_id"] == d]
        assert [v for x in mine for v in x["ids"]] == want.tolist()
        assert all(x["sequence_id"] * 2048 + x["offset"] == first + x["start"] and x["offset"] + x["length"] <= 2048 and x["doc_tokens"] == len(want) for x in mine)
        assert all(x["ids_crc32"] == zlib.crc32(want[x["start"] : x["start"] + x["length"]].astype("<u4").tobytes()) for x in mine)
