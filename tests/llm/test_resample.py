import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import words_of
from pyspark.sql import functions as F

from faultline.llm import crc, radix, resample


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(max_size=90), max_size=12), st.binary(max_size=70))
def test_checksums(parts, more):
    data = np.frombuffer(b"".join(parts) + b"\0", np.uint8)
    ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
    starts = ends - np.array([len(p) for p in parts], np.int64)
    found = crc.spans(data, starts, ends)
    assert found.tolist() == [zlib.crc32(p) for p in parts]
    second = np.full(len(parts), zlib.crc32(more), np.uint32)
    both = crc.joined(found, second, np.full(len(parts), len(more)))
    assert both.tolist() == [zlib.crc32(p + more) for p in parts]


@pytest.mark.parametrize("chunk_bits, digit_bits", [(18, 11), (3, 4), (1, 1)])
def test_radix_order(spark, monkeypatch, chunk_bits, digit_bits):
    monkeypatch.setattr(radix, "CHUNK_BITS", chunk_bits)
    monkeypatch.setattr(radix, "DIGIT_BITS", digit_bits)
    rng = random.Random(5)
    rows = [(rng.choice([0, 0, 0, 5, 12]), rng.randrange(8) << 2, i * 3, i) for i in range(60)]
    frame = spark.createDataFrame(rows, "a bigint, b bigint, place bigint, name bigint")
    got = {r.name: r.place for r in radix.ordered(frame, ["a", "b"], "place").collect()}
    want = {name: i for i, (_, _, _, name) in enumerate(sorted(rows, key=lambda r: r[:3]))}
    assert got == want
    assert radix.ordered(frame.limit(0), ["a"], "place").count() == 0
    assert radix.ordered(frame.limit(1), ["a"], "place").first().place == 0


def _expected(docs, bench, percent=5):
    def runs(text):
        w = words_of(text)
        return [" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    def bucket(run):
        return zlib.crc32(run.encode()) % 10_000

    s, t = (Counter(bucket(r) for x in texts for r in runs(x)) for texts in ([d[1] for d in docs], bench))
    S, T = sum(s.values()), sum(t.values())
    out = []
    for i, (doc_id, text) in enumerate(docs):
        weight = sum(
            math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in map(bucket, runs(text))
        )
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(runs(text)), weight, score, None, len(words_of(text)), i])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[6]))
    for rank, r in enumerate(able[:len(able) * percent // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_resampling_matches_brute_force(spark, docs):
    rng = random.Random(3)
    vocabulary = [f"wörd{i}" if i % 3 else f"W{i}x" for i in range(60)] + ["x" * 80]
    rows = [(i, " ,".join(rng.choices(vocabulary, k=rng.randrange(0, 60)))) for i in range(150)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1] + " a" * 30), (900, None), (901, ""), (902, "b " * 5000), (-3, rows[3][1])]
    bench = [" ".join(rng.choices(vocabulary[:20], k=30)) for _ in range(5)] + [None]
    target = spark.createDataFrame([(i, t) for i, t in enumerate(bench)], "item_id bigint, text string")
    got = resample.resample(docs(*rows), target, percent=30).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted(map(tuple, got.collect()), key=str) == _expected(rows, bench, 30)


def test_resampling_of_nothing(spark, docs):
    target = spark.createDataFrame([(1, "some words")], "item_id bigint, text string")
    assert resample.resample(docs(), target).count() == 0
    few = resample.resample(docs((1, "too few"), (2, None)), target.where(F.lit(False))).collect()
    assert [(r.doc_id, r.n_features, r["rank"]) for r in sorted(few)] == [(1, 3, None), (2, 0, None)]
