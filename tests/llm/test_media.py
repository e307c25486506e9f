import hashlib
import zlib

import numpy as np

from stressline.llm import media as M


def test_round_trip_and_digests(spark):
    texts = [None, "", "a", "x" * 64, "é" * 700, "word " * 9000, "a", "\0" * 10]
    df = spark.createDataFrame([(i, t, "f", 1) for i, t in enumerate(texts)] + [(None, "a", "f", 1)], "doc_id long, text string, feature string, media int").repartition(3)
    out = {x["doc_id"]: x for x in M.media_columns(df).collect()}
    assert len(out) == len(texts) + 1
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\0" * ((-len(raw) % 64) or (0 if raw else 64))
        x = out[i]
        assert (x["n_bytes"], x["payload_bytes"]) == (len(raw), len(payload)) and len(payload) % 64 == 0 < len(payload)
        assert x["payload_sha256"] == hashlib.sha256(payload).hexdigest() and x["tail_crc32"] == zlib.crc32(payload[-64:])
        assert M.read_wav(bytes(x["media"])) == payload and x["media_sha256"] == hashlib.sha256(bytes(x["media"])).hexdigest() and x["media_bytes"] == len(x["media"])
        assert x["fingerprint"] == sorted(x["fingerprint"]) and x["fingerprint"]
    assert out[2]["feature"] == out[6]["feature"] == out[None]["feature"] and out[0]["feature"] == out[1]["feature"]
    assert M.media_columns(df.limit(0)).count() == 0


def test_fingerprint_finds_the_shift():
    rng = np.random.default_rng(0)
    tone = (128 + 90 * np.sin(np.cumsum(rng.random(30_000)))).astype(np.uint8)
    a = M.fingerprint(M.peaks(tone.tobytes()))
    b = M.fingerprint(M.peaks(rng.integers(0, 256, 20 * M.HOP, dtype=np.uint8).tobytes() + tone.tobytes()))
    shift, hits = M.matches(a, b)
    assert shift == 20 and hits > 0.8 * len(a)
    assert M.matches(a, M.fingerprint(M.peaks(rng.bytes(30_000))))[1] < 0.2 * len(a)


def test_peak_of_a_pure_tone():
    n = np.arange(4096)
    wave_ = (128 + 100 * np.sin(2 * np.pi * 200 * n / M.FRAME)).astype(np.uint8)
    assert (M.peaks(wave_.tobytes())[:-1, 4] == 200).all()
