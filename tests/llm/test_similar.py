import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from llm_helpers import lower, shingles, words_of

from faultline.llm import lines, passages, setjoin, similar, words
from faultline.llm.components import components


def classes_of(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    return [find(i) for i in range(n)]


def same_partition(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


def text(rng, n):
    return " ".join("".join(rng.choice("bcdfg") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(n))


def near(rng, words, edits):
    words = words.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = "edit" + str(rng.randrange(10 ** 6))
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    base = [text(rng, rng.randint(3, 120)) for _ in range(40)]
    hot = text(rng, 150)
    out = [*base, *base[:5], *(near(rng, hot, 1) for _ in range(60)), *(near(rng, rng.choice(base), 2) for _ in range(40))]
    rows = [(i, t.capitalize() + ".") for i, t in enumerate(out)]
    return [*rows, (500, None), (501, ""), (502, "?!"), (503, "word"), (504, "Word!"), (0, rows[0][1]), (505, " ".join(out * 3))]


@pytest.mark.parametrize("bucket", [1024, 8])
def test_join_equals_brute_force(docs, corpus, bucket):
    got = {(r.doc_id, r.class_id, r.n_links, r.n_copies) for r in setjoin.join(docs(*corpus), bucket=bucket).collect()}
    sets = [shingles(t) for _, t in corpus]
    names = sorted(set(sets), key=sorted)
    pairs = [(a, b) for a in range(len(names)) for b in range(a)
             if names[a] and names[b] and len(names[a] & names[b]) >= 0.8 * len(names[a] | names[b])]
    classes = dict(zip(names, classes_of(len(names), pairs), strict=True))
    first = {}
    for (i, _), s in zip(corpus, sets, strict=True):
        first[classes[s]] = min(i, first.get(classes[s], i))
    links = {s: sum(k in pair for pair in pairs) for k, s in enumerate(names)}
    want = {(i, i, 0, 1) if not s else (i, first[classes[s]], links[s], sets.count(s)) for (i, _), s in zip(corpus, sets, strict=True)}
    assert got == want


def test_one_per_class_keeps_columns_and_rows_without_words(docs, corpus):
    kept = setjoin.one_per_class(docs(*corpus))
    ids = {r.doc_id for r in kept.collect()}
    assert {500, 501, 502, 503} <= ids and 504 not in ids and kept.columns == docs().columns
    assert setjoin.one_per_class(docs()).count() == 0


def test_one_per_class_tells_rows_apart_by_id_and_text(docs):
    rng = random.Random(12)
    long, other, third = text(rng, 80), text(rng, 80), text(rng, 60)
    rows = [(1, long), (2, near(rng, long, 1)), (2, other), (None, near(rng, long, 1)), (2, other), (None, third), (None, near(rng, third, 1))]
    kept = sorted(((r.doc_id, r.text) for r in setjoin.one_per_class(docs(*rows)).collect()), key=str)
    assert [k for k in kept if k[0]] == sorted([(1, long), (2, other)])
    assert len([k for k in kept if k[0] is None]) == 1 and kept[-1][1] in (third, rows[-1][1])


def test_components_of_random_edges(spark, docs):
    rng = random.Random(1)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    pairs += [(i, i + 1) for i in range(300, 340)] + [(400, i) for i in range(401, 450)] + [(7, 7)]
    got = {r.id: r.root for r in components(spark.createDataFrame(pairs + [(None, 3)], "a bigint, b bigint")).collect()}
    nodes = sorted({x for p in pairs if p[0] != p[1] for x in p})
    classes = classes_of(500, pairs)
    assert sorted(got) == nodes
    assert same_partition([got[n] for n in nodes], [classes[n] for n in nodes])
    assert all(got[n] == min(m for m in nodes if got[m] == got[n]) for n in nodes)


def test_lines_equal_brute_force(docs):
    rng = random.Random(2)
    base = [text(rng, rng.randint(1, 30)) for _ in range(60)]
    near_lines = [near(rng, b, 1) for b in base for _ in range(2)]
    rows = [(i, "\n".join(rng.choice(base + near_lines) for _ in range(6))) for i in range(60)]
    rows += [(100, None), (101, "\n \n"), (102, "ab\r\n\tAB\nab "), (102, "ab"), (None, base[0]), (103, "\n".join([base[1]] * 300))]
    got = lines.classes(docs(*rows)).collect()
    occurrences = [(i, n, b) for i, t in rows for n, x in enumerate((t or "").split("\n"))
                   if (b := lower(x).encode().strip(b" \t\x0b\x0c\r"))]
    assert sorted(((r.doc_id, r.line) for r in got), key=str) == sorted(((i, n) for i, n, _ in occurrences), key=str)
    distinct = sorted({b for _, _, b in occurrences})
    sets = [{b[i:i + 5] for i in range(max(1, len(b) - 4))} for b in distinct]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    classes = dict(zip(distinct, classes_of(len(sets), pairs), strict=True))
    want = sorted(((i, n, classes[b]) for i, n, b in occurrences), key=str)
    have = sorted(((r.doc_id, r.line, r.class_id) for r in got), key=str)
    assert same_partition([w[2] for w in want], [h[2] for h in have])
    kept = {}
    for r in got:
        if r.kept:
            kept.setdefault(r.class_id, set()).add((r.doc_id, r.line))
    assert set(kept) == {r.class_id for r in got} and all(len(k) == 1 for k in kept.values())
    assert lines.classes(docs()).count() == 0


def test_lines_of_one_changed_letter_are_one(docs):
    rng = random.Random(8)
    rows, at = [], 0
    for size in (50, 60, 80, 100):
        for _ in range(15):
            line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz  ") for _ in range(size)).strip().ljust(size, "x")
            k = rng.randrange(size)
            rows += [(at, line), (at + 1, line[:k] + "#" + line[k + 1:])]
            at += 2
    got = {r.doc_id: (r.class_id, r.kept) for r in lines.classes(docs(*rows)).collect()}
    assert all(got[i][0] == got[i + 1][0] and got[i][1] and not got[i + 1][1] for i in range(0, at, 2))
    assert len({c for c, _ in got.values()}) == at // 2


def test_lines_of_repeated_and_null_ids_are_compared(docs):
    rng = random.Random(9)
    one, other = text(rng, 20), text(rng, 20)
    got = lines.classes(docs((1, one), (1, other), (None, near(rng, one[:-1], 0) + "#"), (None, other + "#"), (None, one))).collect()
    assert len({r.class_id for r in got}) == 2 and sum(r.kept for r in got) == 2
    assert all(r.doc_id == 1 for r in got if r.kept)


def test_passages_of_other_documents_are_found(docs):
    rng = random.Random(3)
    passage = text(rng, 70)
    rows = [(i, text(rng, rng.randint(5, 200)) + " " + passage + " " + text(rng, 40) + "\n" + text(rng, 30)) for i in range(30)]
    clean = [(100 + i, text(rng, rng.randint(1, 300))) for i in range(30)]
    copy = [(200, clean[3][1]), (201, None), (202, ""), (203, "\n".join([text(rng, 40)] * 3)), (204, text(rng, 5000) + " " + passage)]
    got = passages.repeats(docs(*rows, *clean, *copy)).collect()
    found = {}
    texts = dict([*rows, *clean, *copy])
    for r in got:
        found.setdefault(r.doc_id, []).append(" ".join(words_of(texts[r.doc_id])[r.first_word:r.last_word + 1]))
    for i, _ in rows:
        assert sum(passage in x or len(set(x.split()) & set(passage.split())) >= 45 for x in found[i])
    long_enough = len(clean[3][1].split()) >= passages.WINDOW
    assert set(found) - {i for i, _ in rows} - {204} == ({103, 200} if long_enough else set())
    assert sum(not r.removed for r in got) == len({r.class_id for r in got})
    assert passages.repeats(docs()).count() == 0


def test_repetitive_paragraphs_are_compared_by_distinct_shingles(docs):
    rng = random.Random(8)
    refrain = text(rng, 26).split() * 3
    edited = [*refrain[:38], "edited", *refrain[39:]]
    rows = [(1, " ".join(refrain)), (2, " ".join(edited)), (3, text(rng, 78))]
    a, b = shingles(rows[0][1]), shingles(rows[1][1])
    assert len(a & b) >= 0.8 * len(a | b)
    got = passages.repeats(docs(*rows)).collect()
    assert {r.doc_id for r in got} == {1, 2}
    assert {r.class_id for r in got if r.doc_id == 1} == {r.class_id for r in got if r.doc_id == 2}


def wrapped(value, width):
    w = value.split()
    return "\n".join(" ".join(w[i:i + width]) for i in range(0, len(w), width))


def test_hard_wrapped_passages_are_found(docs):
    rng = random.Random(9)
    passage = text(rng, 60)
    rows = [(1, wrapped(text(rng, 20) + " " + passage + " " + text(rng, 20), 15)),
            (2, wrapped(text(rng, 8) + " " + passage + " " + text(rng, 30), 12)), (3, wrapped(passage, 13)), (4, wrapped(text(rng, 90), 14))]
    got = passages.repeats(docs(*rows)).collect()
    assert {r.doc_id for r in got} == {1, 2, 3}
    for r in got:
        assert set(passage.split()) <= set(words_of(dict(rows)[r.doc_id])[r.first_word:r.last_word + 1])


def test_passages_of_51_to_60_words_in_long_lines_are_found_and_met_to_their_ends(docs):
    rng = random.Random(10)
    rows, inside = [], {}
    for i, n in enumerate([51, 53, 55, 58, 60] * 8):
        passage = text(rng, n).split()
        for side in (0, 1):
            before = text(rng, rng.randint(100, 300)).split()
            rows.append((2 * i + side, " ".join([*before, *passage, *text(rng, 300).split()])))
            inside[2 * i + side] = (len(before), len(before) + n - 1)
    got = passages.repeats(docs(*rows)).collect()
    assert len({r.doc_id for r in got}) >= 0.95 * len(rows)
    for r in got:
        # A window that links at 0.8 may hold two words from outside the passage.
        assert max(abs(r.first_word - inside[r.doc_id][0]), abs(r.last_word - inside[r.doc_id][1])) <= 2
        assert r.removed == r.doc_id % 2


def test_passages_know_rows_by_id_and_text(docs):
    rng = random.Random(11)
    a, b = text(rng, 60), text(rng, 60)
    got = passages.repeats(docs((1, a), (1, b), (None, b), (2, a), (3, text(rng, 60)), (3, None))).collect()
    by_class = {}
    for r in got:
        by_class.setdefault(r.class_id, []).append((r.doc_id, r.removed))
    assert {tuple(sorted(v, key=str)) for v in by_class.values()} == {((1, False), (2, True)), ((1, False), (None, True))}


def test_texts_to_compare_pass_a_filter_where_they_are(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("own_key"), "id")
    some = keys.where("id % 10 = 0")
    passed = {r.id for r in keys.where(setjoin._among(some)).collect()}
    assert passed >= set(range(0, 3000, 10)) and len(passed) < 310
    assert keys.where(setjoin._among(some.where("false"))).count() == 0


def test_only_lines_of_a_repeated_bucket_go_on():
    """Line by line the buckets that pass the bitmap stay, with the sketch; other lines are left out."""
    class Given:
        bits = value = np.zeros((1 << similar.FILTER_BITS) // 8, np.uint8)

    keys = words.mix(np.arange(1, 8, dtype=np.uint64)).view(np.int64).tolist()
    for key in keys[:3]:
        at = (key & (1 << 64) - 1) >> 64 - similar.FILTER_BITS
        Given.bits[at >> 3] |= 1 << (at & 7)
    batch = pa.record_batch({
        "id": [9, 1, 2, 3, 4],
        "buckets": pa.array([[keys[0]], [keys[0], keys[3], keys[1]], [keys[4], keys[5]], [], [keys[6], keys[2]]], pa.list_(pa.int64())),
        "sketch": pa.array([b"z", b"a", b"b", b"c", b"d"]),
    }).slice(1)
    (got,) = lines._sharing(iter([batch, batch.slice(0, 0)]), Given)
    assert got.to_pylist() == [
        {"id": 1, "buckets": [keys[0], keys[1]], "sketch": b"a"}, {"id": 4, "buckets": [keys[2]], "sketch": b"d"}
    ]


def test_lines_are_stripped_of_few_and_many_blanks():
    texts = [None, "", " \n\t\n", "a", " A\x0b b\n\n" + " " * 300 + "c" + "\t" * 200 + "\n" + " " * 500, "\n\nlast line \r", "é\n é"]
    data, offsets = words.text_bytes(pa.array(texts))
    found = lines.Lines(data, offsets)
    want = [
        (i, k, line.strip(b" \t\r\x0b\x0c").lower())
        for i, t in enumerate(texts) for k, line in enumerate((t or "").encode().split(b"\n")) if line.strip(b" \t\r\x0b\x0c")
    ]
    shown = found.data.tobytes()
    got = [(t, n, shown[a:b]) for t, n, a, b in zip(found.text.tolist(), found.number.tolist(), found.starts, found.ends, strict=True)]
    assert got == want
    hashes, bounds = found.shingles(np.arange(len(got)))
    for (*_, line), a, b in zip(got, bounds[:-1], bounds[1:], strict=True):
        one = np.frombuffer(line, np.uint8)
        prefix = words.prefix_hash(one)
        size = min(len(one), lines.SHINGLE)
        starts = np.arange(len(one) - size + 1)
        assert hashes[a:b].tolist() == words.span_hash(prefix, starts, starts + size).tolist()


def test_pairs_are_compared_like_larger_groups():
    rng = np.random.default_rng(5)
    sets = []
    for root in range(60):
        base = rng.integers(1, 1 << 62, 50, dtype=np.uint64)
        for _ in range(2):
            own = base.copy()
            own[:rng.integers(0, 12)] += np.uint64(len(sets) + 1)
            sets.append((root, len(sets), np.unique(own)))
    batch = pa.record_batch({
        "root": [r for r, *_ in sets], "i": [0] * 120, "j": [0] * 120, "block": [0] * 120, "id": [i for _, i, _ in sets],
        "hashes": pa.array([h.tobytes() for *_, h in sets], pa.binary()),
    })
    rows = pa.Table.from_batches(similar._exact(iter([batch]), 0.8, similar.joined_hashes)).to_pylist()
    want = set()
    for (_, a, x), (_, b, y) in zip(sets[::2], sets[1::2], strict=True):
        both = len(np.intersect1d(x, y))
        if both / (len(x) + len(y) - both) >= 0.8:
            want.add((a, b))
    assert 0 < len(want) < 60
    assert {(r["id"], r["other"]) for r in rows if r["other"] is not None} == want
    assert {r["id"] for r in rows if r["links"]} == {i for pair in want for i in pair}


def test_a_task_bands_a_line_once_and_sketches_it_in_32_bytes():
    """Lines are listed wherever they are; the 2nd batch brings new minima only for what the task has not seen."""
    kinds = {"doc_id": pa.array([1, 2]), "own_key": pa.array([3, 4])}
    first = pa.record_batch({**kinds, "text": pa.array(["a line that comes again\nanother one", "A LINE that comes again "])})
    second = pa.record_batch({**kinds, "text": pa.array(["a line that comes again", "one of the second batch"])})
    got = pa.Table.from_batches(lines._listed(iter([first, second, second]))).to_pylist()
    assert [(r["doc_id"], r["line"]) for r in got] == [(1, 0), (1, 1), (2, 0), (1, 0), (2, 0), (1, 0), (2, 0)]
    assert [r["buckets"] is not None for r in got] == [True, True, False, False, True, False, False]
    assert {len(r["sketch"]) for r in got if r["sketch"] is not None} == {32}
    assert len({r["id"] for r in got}) == 3


@pytest.mark.parametrize("small", [0, 3, 16])
@pytest.mark.parametrize("kind", [similar.HALVES, "u2"])
def test_forests_connect_what_looks_alike_in_groups_of_any_size(monkeypatch, small, kind):
    monkeypatch.setattr(similar, "SMALL_GROUP", small)
    rng = np.random.default_rng(2)
    rows, want = [], []
    for bucket, size in enumerate([1, 2, 3, 5, 16, 17, 40]):
        kept = []
        for k in range(size):
            least = kept[rng.integers(len(kept))].copy() if kept and rng.random() < 0.7 else rng.integers(0, 1 << 32, 64, dtype=np.uint32)
            least[rng.integers(0, 64, 12)] = rng.integers(0, 1 << 32, 12, dtype=np.uint32)
            kept.append(least)
        sketches = similar.half_values(np.array(kept)) if kind == similar.HALVES else pa.array([x.astype("u2").tobytes() for x in kept])
        four = np.array([[b >> s & 15 for b in x.as_py() for s in (0, 4)] if kind == similar.HALVES else list(m.astype("u2")) for x, m in zip(sketches, kept, strict=True)])
        ids = [100 * bucket + k for k in range(size)]
        want += [(ids[x], ids[y]) for x in range(size) for y in range(x) if (four[x] == four[y]).sum() >= 42]
        # Every third row comes twice.
        rows += [(bucket, ids[k], sketches[k].as_py()) for k in range(size) for _ in range(1 + (k % 3 == 0))]
    batch = pa.record_batch({
        "bucket": [r[0] for r in rows], "i": [0] * len(rows), "j": [0] * len(rows), "block": [0] * len(rows),
        "id": [r[1] for r in rows], "sketch": pa.array([r[2] for r in rows], pa.binary()),
    })
    got = pa.Table.from_batches(similar._likely_pairs(iter([batch]), 42, kind)).to_pylist()
    number = {r[1]: k for k, r in enumerate(rows)}
    a = classes_of(len(rows), [(number[x], number[y]) for x, y in want])
    b = classes_of(len(rows), [(number[r["a"]], number[r["b"]]) for r in got])
    assert same_partition(a, b) and len(got) == len({r[1] for r in rows}) - len({a[k] for k in number.values()})


def test_minima_of_32_bits_agree_as_often_as_sets_do():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 32, 400, dtype=np.uint32)
    other = np.concatenate([base[:320], rng.integers(0, 1 << 32, 80, dtype=np.uint32)])
    least = similar.minima(np.concatenate([base, other]), np.array([0, 400, 400, 800]), 256)
    assert least.dtype == np.uint32 and (least[1] == np.iinfo(np.uint32).max).all()
    assert abs((least[0] == least[2]).mean() - 320 / 480) < 0.12
