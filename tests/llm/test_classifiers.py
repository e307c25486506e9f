import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from stressline.llm import linear as L
from stressline.llm import quality as Q
from stressline.llm import toxicity as X
from stressline.llm.bytehash import document_chunks


def _held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def _toxic_rows(n=900, seed=4, words_of=(8, 120)):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(r.randint(*words_of))]
        toxic = int(r.random() < 0.2)
        if toxic:
            for _ in range(max(3, len(words) // 40)):
                words[r.randrange(len(words))] = r.choice(["vilest,", "Grubby", "zzqqling", "zzqqster", "zzqqish."])
        docs.append((i, " ".join(words), "s"))
        if r.random() < 0.6:
            labels.append((i, 1, toxic))
    truth = {i: x for i, _, x in labels}
    docs += [(n, None, "s"), (n + 1, "", None), (None, "zzqqling vilest", "s"), (5, docs[5][1], "s")]
    labels += [(None, 1, 1), (7, None, None)]
    return docs, labels, truth


def test_held_out_accuracy_and_no_leak(spark):
    docs, labels, truth = _toxic_rows()
    df = spark.createDataFrame([(*d, 1.0, 2) for d in docs], "doc_id long, text string, source string, score double, toxic int")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = X.score_toxicity(df, lab).collect()
    assert len(rows) == len(docs)
    got = {x["doc_id"]: x for x in rows}
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.3) for x in rows)
    assert all(x["held_out"] == (d is not None and _held(d)) for d, x in got.items())
    assert got[900]["score"] == got[901]["score"] and got[None]["score"] > 0.5
    held = [(truth[d], x["predicted"]) for d, x in got.items() if d in truth and _held(d)]
    assert np.mean([a == b for a, b in held]) > 0.9
    flipped = spark.createDataFrame([(d, q, 1 - t if t is not None and d is not None and _held(d) else t) for d, q, t in labels], "doc_id long, quality int, toxic int")
    again = {x["doc_id"]: x["score"] for x in X.score_toxicity(df, flipped).collect()}
    assert again == {d: x["score"] for d, x in got.items()}


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, 1, 1)]])
def test_toxicity_without_usable_labels(spark, labels):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert len({x["score"] for x in X.score_toxicity(df, lab).collect()}) == 1
    assert X.score_toxicity(df.limit(0), lab).count() == 0


def test_nnpu_separates():
    rng = np.random.default_rng(1)
    n, size = 4000, 20
    y = rng.random(n) < 0.3
    x = rng.random((n, size)) < np.where(y[:, None], 0.4, 0.2)
    def rows(at):
        doc, feat = np.nonzero(x[at])
        return L.Rows(feat, np.ones(len(feat)), np.cumsum(np.bincount(doc, minlength=len(at))))
    weight = L.fit_nnpu(rows(np.flatnonzero(y)[:500]), rows(np.arange(2000)), 0.3, size)
    z = rows(np.arange(2000, n)).dot(weight[:-1]) + weight[-1]
    assert np.mean((z > 0) == y[2000:]) > 0.75


def _quality_rows(n=600, seed=8, words_of=(12, 150)):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8)))
    rows, good = [], {}
    for i in range(n):
        words = [word() for _ in range(r.randint(*words_of))]
        kind = r.choice(["good"] * 12 + ["shout", "symbols", "repeat", "bars"])
        if kind == "good":
            text = ". ".join(" ".join(words[k : k + 9]).capitalize() for k in range(0, len(words), 9)) + "."
        elif kind == "shout":
            text = " ".join(w.upper() + "!!" for w in words)
        elif kind == "symbols":
            text = " ".join(w + r.choice(["###", "$$$", "%%%"]) for w in words)
        elif kind == "repeat":
            text = " ".join(w for w in words[:5] for _ in range(len(words) // 4 + 5))
        else:
            text = " | ".join(words)
        rows.append((i, text))
        good[i] = kind == "good"
    return rows, good


def test_quality_against_truth(spark):
    rows, good = _quality_rows()
    rows += [(None, "Some plain words that anyone may have written here today."), (1000, None), (1001, ""), (1002, " \n "), (3, rows[3][1])]
    df = spark.createDataFrame([(d, t, 1, True) for d, t in rows], "doc_id long, text string, score int, keep boolean")
    out = Q.score_quality(df).collect()
    assert len(out) == len(rows)
    got = {x["doc_id"]: x for x in out}
    assert np.mean([got[d]["keep"] == g for d, g in good.items()]) > 0.98
    assert np.mean([got[d]["keep"] for d, g in good.items() if g]) > 0.99
    assert all(got[d]["score"] == 0 and not got[d]["keep"] and got[d]["n_words"] == 0 for d in (1000, 1001, 1002))
    assert Q.score_quality(df.limit(0)).count() == 0


def test_a_corpus_of_long_texts_is_fitted_and_scored(spark):
    """Texts of over 21,000 characters only: the classifiers tell them apart as they do short ones."""
    rows, good = _quality_rows(160, words_of=(4600, 4900))
    assert sum(len(t) > 21_000 for _, t in rows) > 150
    got = {x["doc_id"]: x for x in Q.score_quality(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert np.mean([got[d]["keep"] == g for d, g in good.items()]) > 0.95 and len({x["score"] for x in got.values()}) > 50
    docs, labels, truth = _toxic_rows(240, words_of=(4600, 4900))
    scored = X.score_toxicity(spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    held = [(x["score"], truth[x["doc_id"]]) for x in scored if x["doc_id"] in truth and _held(x["doc_id"])]
    assert min(s for s, t in held if t) > max(s for s, t in held if not t)


def test_the_fit_holds_the_largest_shares():
    doc, feat, value = np.array([0, 0, 0, 2, 2]), np.array([5, 3, 9, 1, 2]), np.array([0.2, 0.5, 0.2, 0.1, 0.9])
    assert Q.largest(doc, feat, value, 2).tolist() == [True, True, False, True, True]
    assert Q.largest(doc, feat, value, 3).all() and Q.largest(doc[:0], feat[:0], value[:0], 1).all()


def test_em_finds_accuracies():
    rng = np.random.default_rng(2)
    n = 20_000
    good = rng.random(n) < 0.8
    votes = np.zeros((n, 4), int)
    for j, (fire, miss) in enumerate([(0.9, 0.005), (0.6, 0.002), (0.5, 0.009), (0.3, 0.001)]):
        p = np.where(good, miss, fire)
        votes[:, j] = np.where(rng.random(n) < p, Q.BAD, np.where(rng.random(n) < 0.7, Q.GOOD, Q.NONE))
    codes = (votes * 3 ** np.arange(3, -1, -1)).sum(axis=1)
    uniq, counts = np.unique(codes, return_counts=True)
    post, theta, share = Q.expectation_maximisation(Q.pattern_votes(uniq, 4), counts.astype(float))
    assert abs(share - 0.8) < 0.03 and np.abs(theta[:, 0, Q.BAD] - [0.9, 0.6, 0.5, 0.3]).max() < 0.05
    assert np.mean((post[np.searchsorted(uniq, codes)] > 0.5) == good) > 0.95


def test_votes_do_not_depend_on_neighbours():
    rows, _ = _quality_rows(40)
    texts = [t for _, t in rows]
    whole = np.concatenate([Q.votes(a, o) for _, _, a, o in document_chunks(pa.array(texts))])
    single = [int(Q.votes(a, o)[0]) for t in texts for _, _, a, o in document_chunks(pa.array([t]))]
    assert whole.tolist() == single


def test_expectation_maximisation_row_by_row():
    """The same rounds with plain loops over rows instead of pattern counts."""
    import math

    r = random.Random(9)
    n = 3
    rows = [tuple(r.choices((0, 1, 2), (5, 4, 1) if bad else (5, 1, 14))[0] for _ in range(n)) for bad in (r.random() < 0.25 for _ in range(200))]
    kinds = sorted(set(rows))
    post, theta, good = Q.expectation_maximisation(np.array(kinds), np.array([rows.count(k) for k in kinds], float), rounds=25)
    t = [[[0.3, 0.3, 0.4], [0.3, 0.01, 0.69]] for _ in range(n)]
    g, p = 0.8, []
    for _ in range(25):
        p = []
        for row in rows:
            a, b = math.log(1 - g), math.log(g)
            for j, v in enumerate(row):
                a, b = a + math.log(t[j][0][v]), b + math.log(t[j][1][v])
            p.append(1 / (1 + math.exp(a - b)))
        g = sum(p) / len(p)
        for j in range(n):
            bad, ok = [0.5] * 3, [0.5] * 3
            for row, w in zip(rows, p, strict=True):
                bad[row[j]] += 1 - w
                ok[row[j]] += w
            bad, ok = [x / sum(bad) for x in bad], [x / sum(ok) for x in ok]
            ok[1] = min(ok[1], 0.01)
            t[j] = [bad, [x / sum(ok) for x in ok]]
    by = dict(zip(rows, p, strict=True))
    assert np.allclose(post, [by[k] for k in kinds], atol=1e-5) and abs(good - g) < 1e-5 and np.allclose(theta, t, atol=1e-5)


def test_unlabelled_risk_and_its_gradient(monkeypatch):
    """One step of the fit against a risk by plain loops and its numerical slope, on both sides of zero."""
    import math

    size = 4
    docs = {"pos": [[(0, 1.0), (1, 0.5)], [(0, 2.0)]], "unl": [[(1, 1.0)], [(2, 1.0), (0, 0.3)], [(3, 1.5)]]}
    made = {k: L.Rows(np.array([i for d in v for i, _ in d]), np.array([x for d in v for _, x in d]), np.cumsum([len(d) for d in v])) for k, v in docs.items()}
    steps = []
    monkeypatch.setattr(L.Adam, "step", lambda self, w, g: steps.append((w.copy(), g.copy())))

    def parts(w, prior):
        score = lambda d: sum(w[i] * x for i, x in d) + w[-1]
        plus = prior * sum(math.log1p(math.exp(-score(d))) for d in docs["pos"]) / 2
        minus = sum(math.log1p(math.exp(score(d))) for d in docs["unl"]) / 3 - prior * sum(math.log1p(math.exp(score(d))) for d in docs["pos"]) / 2
        return plus, minus

    for prior in (0.2, 0.9):
        for beta in (0.0, -10.0):  # the second bound is never met, so the negative part is followed upwards
            steps.clear()
            L.fit_nnpu(made["pos"], made["unl"], prior, size, l2=0.0, steps=1, beta=beta)
            w, g = steps[0]
            assert (parts(w, prior)[1] < -beta) == (beta < 0)
            risk = (lambda v: -parts(v, prior)[1]) if beta < 0 else (lambda v: sum(parts(v, prior)))  # noqa: B023
            for i in range(size + 1):
                e = np.zeros(size + 1)
                e[i] = 1e-6
                assert abs((risk(w + e) - risk(w - e)) / 2e-6 - g[i]) < 1e-6
