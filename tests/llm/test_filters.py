import random

from faultline.llm import decontaminate, licences, quality
from llm_helpers import words_of
from test_similar import text

ITEM = ("A train leaves Hamburg at 9 and travels 120 km towards Berlin while another train leaves Berlin at 9 "
        "and travels 80 km towards Hamburg; when do they meet?")
OTHER = ("A train leaves Lisbon at 7 and travels 310 miles towards Porto while another train leaves Porto at 7 "
         "and travels 45 miles towards Lisbon; when do they meet?")
MIXED = ("A train leaves Lisbon at 7 and travels 310 miles towards Porto while another train leaves Madrid at 8 "
         "and travels 45 miles towards Paris; when do they meet?")


def test_items_are_found_with_other_values_if_consistent(spark, docs):
    rng = random.Random(1)
    around = lambda x: f"{text(rng, 30)} {x} {text(rng, 30)}"
    rows = [(1, around(ITEM)), (2, around(OTHER)), (3, around(MIXED)), (4, text(rng, 200)), (5, None), (6, ""),
            (7, ITEM.lower()), (8, "1 2 3 4 5 6 7 8 9 10 km 11 12"), (None, around(ITEM)), (9, text(rng, 30_000) + " " + ITEM)]
    bench = spark.createDataFrame([(10, ITEM), (11, ITEM), (12, None), (13, ""), (14, text(rng, 30)), (15, "3 km")], "item_id bigint, text string")
    for part in (decontaminate.PART_WINDOWS, 10):
        got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs(*rows), bench, part_windows=part).collect()}
        assert set(got) == {(1, 10), (2, 10), (7, 10), (None, 10), (9, 10)}
        assert got[1, 10].n_changed == 0 and got[2, 10].n_changed > 0 and got[1, 10].cover > 0.9
    kept = decontaminate.clean(docs(*rows), bench)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [3, 4, 5, 6, 8]
    assert decontaminate.leaks(docs(), bench).count() == 0
    assert decontaminate.clean(docs(*rows), bench.limit(0)).count() == len(rows)


def brute(value):
    w = words_of(value)
    places = [(i, label) for p, label in licences.PHRASES.items() for i in range(len(w))
              if w[i:i + len(p.split())] == p.split()]
    return len(w), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), \
        ",".join(sorted({x for _, x in places}))


def test_licence_phrases_equal_brute_force_and_templates_are_chained(docs):
    rng = random.Random(3)
    parts = ["mit license", "MIT  License", "apache", "license", "the gnu general public license", "general public", "und", "é", "mit-license"]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))) for i in range(80)]
    notice = licences.TEMPLATES["mit"][1]
    edited = notice.replace("obtaining a copy", "obtaining one copy")
    rows += [(100, None), (101, ""), (102, text(rng, 200) + " " + notice.upper() + " " + text(rng, 5)), (103, edited),
             (104, notice[:60]), (104, notice[:60]), (None, "Apache License"), (105, text(rng, 20_000) + " MIT license")]
    got = licences.scan(docs(*rows)).collect()
    key = lambda x: str(x)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=key) == \
        sorted(((i, *brute(t)) for i, t in rows), key=key)
    by = {r.doc_id: r for r in got}
    assert by[102].labels == "mit" and by[102].spans[0]["first"] == 200 and by[103].labels == "mit" and by[104].labels == ""
    assert 0.8 <= by[103].score < 1 and by[105].score == 1 and by[101].score == 0
    assert licences.scan(docs()).count() == 0


def test_matching_statistics_equal_brute_force():
    rng = random.Random(4)
    lists = [[rng.randrange(3) for _ in range(12)] for _ in range(4)]
    automaton = licences.Automaton()
    for x in lists:
        automaton.add(x)
    for _ in range(200):
        query = [rng.randrange(3) for _ in range(10)]
        state = length = 0
        for place, token in enumerate(query):
            while state > 0 and token not in automaton.next[state]:
                state = automaton.link[state]
                length = automaton.length[state]
            if token in automaton.next[state]:
                state, length = automaton.next[state][token], length + 1
            want = max(n for n in range(place + 2) if any(
                query[place + 1 - n:place + 1] == x[i:i + n] for x in lists for i in range(len(x) - n + 1)))
            assert length == want


def test_grades_on_held_out_rows(spark, docs):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(900):
        t, kind = text(rng, rng.randint(5, 120)), rng.random()
        if kind < 0.15:
            w = t.split()
            w.insert(rng.randrange(len(w)), rng.choice(["nasty", "awful", "rotten"]))
            t, grade = " ".join(w), (1, 1)
        elif kind < 0.35:
            t, grade = t.replace(" ", "%%% "), (0, 0)
        else:
            grade = (1, 0)
        rows.append((i, t))
        labels.append((i, *grade))
    rows += [(2000, None), (2001, ""), (None, "text"), (3, rows[3][1]), (2002, text(rng, 30_000))]
    known = spark.createDataFrame([*labels[:600], (5000, 1, 0), (None, 1, 1), (700, None, None)], "doc_id bigint, quality int, toxic int")
    model = quality.train(docs(*rows), known, quality.GRADE, quality.GRADES)
    assert (model.thresholds[1:] > model.thresholds[:-1]).all()
    got = {r.doc_id: r for r in quality.grade(docs(*rows), model).collect()}
    held = labels[600:]
    assert sum(got[i].kept == (q == 1 and t == 0) for i, q, t in held) / len(held) > 0.97
    assert got[2000].kept and got[2001].kept and got[2002].kept and got[2001].tails == sorted(got[2001].tails, reverse=True)
    assert quality.kept(docs(*rows), known).columns == docs().columns
    assert quality.kept(docs(*rows), known.limit(0)).count() == len(rows)
    assert quality.grade(docs(*rows), None).where("kept").count() == len(rows)
    assert quality.grade(docs(), model).count() == 0


def test_at_most_the_bound_of_labels_is_used(spark, docs):
    rows = [(i, f"text {i}") for i in range(50)]
    known = spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id bigint, quality int, toxic int")
    assert quality.train(docs(*rows), known, quality.GRADE, quality.GRADES, labelled=10) is not None


def test_labels_without_documents_leave_a_model(spark, docs):
    rows = [*((i, f"plain clean text number {i}") for i in range(60)), *((i, f"awful nasty words number {i}") for i in range(60, 100)),
            *((5, f"plain clean text number 5") for _ in range(40))]
    known = [(i, int(i < 60), 0) for i in range(100)] + [(i, 1, 0) for i in range(1000, 9900)]
    known = spark.createDataFrame(known, "doc_id bigint, quality int, toxic int")
    assert quality.train(docs(*rows), known, quality.GRADE, quality.GRADES, labelled=50) is not None


def test_clean_keeps_other_texts_of_an_id_and_drops_rows_without_one(spark, docs):
    rng = random.Random(4)
    own = text(rng, 60)
    bench = spark.createDataFrame([(10, ITEM)], "item_id bigint, text string")
    kept = decontaminate.clean(docs((1, ITEM), (1, own), (None, ITEM), (None, own)), bench).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(1, own), (None, own)], key=str)


def test_items_are_found_with_ties_opening_names_and_names_of_other_lengths(spark, docs):
    rng = random.Random(11)
    items = [
        (1, "Together they buy 3 apples and 5 pears at the market, so how much fruit do they carry home?"),
        (2, "Tom has 5 apples in all. Tom buys 3 more today. Tom eats 2 of them. How many are left?"),
        (3, "Yesterday the teacher told Paul that the red box holds more books than what Paul had counted."),
    ]
    rows = [
        (1, "Together they buy 4 apples and 4 pears at the market, so how much fruit do they carry home?"),
        (2, "Ann has 9 apples in all. Ann buys 4 more today. Ann eats 1 of them. How many are left?"),
        (3, "Yesterday the teacher told Mary Ann Jones that the red box holds more books than what Mary Ann Jones had counted."),
        (4, "Tom has 5 apples in all but nobody asked how many of them are left for the others."),
        (5, "Yesterday the teacher told Rita that the red box holds more books than what Otto had counted."),
    ]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    full = [(i, f"{text(rng, 30)}. {t} {text(rng, 30)}") for i, t in rows]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs(*full), bench).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 3)}
    assert got[1, 1].n_changed == 2 and got[2, 2].cover == 1
