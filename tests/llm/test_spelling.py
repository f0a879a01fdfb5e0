import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from faultline.llm import spelling


def _vocabulary(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def _expected(counts):
    form, near = {}, {}
    for w, n in counts.items():
        near[w] = [v for v in counts if _near(w, v)]
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def _rows(rng):
    base = ["letters", "lettérs", "aaaaaaaa", "abababab", "ÀÉÎõüßx", "commontail", "z" * 300]
    words = list(base)
    for word in base:
        for _ in range(12):
            i, c = rng.randrange(len(word) + 1), rng.choice("abzé")
            words.append(rng.choice([word[:i] + c + word[i:], word[:i] + word[i + 1:], word[:i] + c + word[i + 1:]]))
    words += ["letter", "lettersx", "lettersxy", "sletters"]
    weights = [rng.choice([1, 3, 10, 60, 400]) for _ in words]
    return [(i, " ".join(rng.choices(words, weights, k=80)).title() if i % 7 == 0 else "-".join(rng.choices(words, weights, k=80)))
            for i in range(60)]


def test_variants_match_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(spelling, "SALT_WORDS", 3)
    rows = [*_rows(random.Random(9)), (None, "letters " * 9), (5, None), (5, ""), (6, "x 12 ... × ÷÷÷÷÷÷ " * 6)]
    got = spelling.variants(docs(*rows)).collect()
    counts = _vocabulary(rows)
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == _expected(counts)
    assert len(got) == len(counts) and len(counts) > 40


def test_chains_of_forms_end_at_their_roots(spark):
    names = [f"w{i}" for i in range(12)]
    forms = spark.createDataFrame([*zip(names, names[1:]), ("w11", None)], "word string, form string")
    roots = spelling._roots(forms)
    assert {(r.word, r.root) for r in roots.collect()} == {(n, "w11") for n in names[:-1]}


def test_no_words_no_variants(spark, docs):
    assert spelling.variants(docs()).count() == 0
    assert spelling.variants(docs((1, "short words only"), (2, None))).count() == 0
    one = spelling.variants(docs((1, "lonely " * 5))).collect()
    assert [tuple(r) for r in one] == [("lonely", None, "lonely", 5, 0, None)]


def test_columns_of_other_names_do_not_clash(spark, docs):
    frame = docs((1, "lonely " * 5)).withColumn("word", F.lit("x")).withColumn("n", F.lit(1)).withColumn("run", F.lit(2))
    assert spelling.variants(frame).count() == 1


def test_no_join_sends_a_table_to_the_driver(spark, docs, monkeypatch):
    """Small as these tables are, which Spark would broadcast by its sizes: they grow with the vocabulary."""
    plans, staged = [], spelling.staged

    def seen(frame, label):
        frame.collect()
        plans.append((label, frame._jdf.queryExecution().executedPlan().toString()))
        return staged(frame, label)

    monkeypatch.setattr(spelling, "staged", seen)
    seen(spelling.variants(docs(*_rows(random.Random(3)))), "spelling-variants")
    joined = {label for label, plan in plans if "SortMergeJoin" in plan}
    assert joined >= {"spelling-paths", "spelling-states", "spelling-pairs", "spelling-forms", "spelling-roots", "spelling-variants"}
    assert [label for label, plan in plans if "Broadcast" in plan] == []
