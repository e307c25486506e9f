"""The pipeline's stages give whole results, with null and repeated ids too."""

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as C
from stressline.llm import jaccard_join as J
from stressline.llm import registry

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s1", None if t is None else len(t)) for d, t in rows], SCHEMA).repartition(3)


def test_packing_stage_keeps_the_token_ids(spark):
    ref = Tokenizer.from_file(registry.tokenizer_path())
    texts = ["plain words of a text " * 30, "", "another text of words " * 900]
    rows = C.packing(spark, _frame(spark, list(enumerate(texts))), "").collect()
    windows = {}
    for x in sorted(rows, key=lambda x: (x["sequence_id"], x["offset"])):
        windows.setdefault(x["sequence_id"], []).extend(x["ids"])
    assert all(len(w) == 2048 for s, w in windows.items() if s < max(windows))
    for i, t in enumerate(texts):
        ids = [v for x in sorted(rows, key=lambda x: x["start"]) if x["doc_id"] == i for v in x["ids"]]
        assert np.array_equal(ids, [*ref.encode(t, add_special_tokens=False).ids, 1])


def _texts():
    words = [f"w{i}" for i in range(100)]
    near = lambda *at: " ".join("other" if i in at else w for i, w in enumerate(words))
    far = " ".join(f"v{i}" for i in range(100))
    return near(), near(0), near(99), near(0, 99), far, far + " end"


def test_links_of_null_ids(spark):
    a, b, c, _, far, far2 = _texts()
    for ids in ([None] * 5, [7] * 5, [None, 1, None, 7, 7]):
        rows = list(zip(ids, [a, b, c, far, far2], strict=True)) + [(ids[0], a)] * 3
        got = J.jaccard_classes(_frame(spark, rows), with_keys=True).collect()
        assert len(got) == 8 and sorted(sum(x["component_key"] == y for x in got) for y in {x["component_key"] for x in got}) == [2, 6]


def test_near_stage_keeps_one_row_of_each_component(spark):
    a, b, c, d, far, far2 = _texts()
    rows = [(None, a), (None, b), (None, None), (None, None), (3, c), (3, d), (3, far), (4, far2), (4, "a clean text of its own"), (4, ""), (5, "x"), (5, "x")]
    got = [(x["doc_id"], x["text"]) for x in C.near(spark, _frame(spark, rows), "").collect()]
    assert sum(t in (a, b, c, d) for _, t in got) == 1 and {i for i, t in got if t in (a, b, c, d)} == {3}
    rest = sorted(str(x) for x in got if x[1] not in (a, b, c, d))
    assert rest == sorted(map(str, [(None, None), (None, None), (3, far), (4, "a clean text of its own"), (4, ""), (5, "x")]))
