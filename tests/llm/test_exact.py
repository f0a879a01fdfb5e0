import hashlib
from functools import partial

import pytest
from llm_helpers import lower

from faultline.llm import chunks

LONG = "".join(f"word{i} and {i * 7919 % 1013} more, " for i in range(20_000))
ROWS = [(1, "Same text"), (5, "same TEXT"), (2, None), (3, ""), (4, LONG), (9, LONG.upper()), (9, LONG.upper()),
        (6, LONG + "x"), (None, "no id"), (None, "no id"), (7, "É"), (8, "é"), (10, "x" * 300)]


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[lower(t)]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [16, 1])
def test_classes_equal_brute_force_even_if_digests_clash(docs, size):
    digest = partial(chunks.digest_of, size=size)
    got = chunks.classes(docs(*ROWS), digest).drop("n_chunks").collect()
    assert sorted(map(tuple, got), key=str) == expected(ROWS)


def test_deduplicated_rows_keep_their_columns(docs):
    out = chunks.deduplicated(docs(*ROWS)).collect()
    assert sorted((r.doc_id for r in out), key=str) == sorted([5, 3, 9, 6, None, 7, 8, 10], key=str)
    assert out[0]._id == 4 and out[0].recipe == "y"


def test_rows_are_told_apart_by_id_and_text(docs):
    rows = [(1, "same"), (2, "same"), (1, "unique text"), (None, "same"), (3, "Case"), (3, "case"), (None, "alone"), (None, "ALONE")]
    out = sorted(((r.doc_id, lower(r.text)) for r in chunks.deduplicated(docs(*rows)).collect()), key=str)
    assert out == sorted([(2, "same"), (1, "unique text"), (3, "case"), (None, "alone")], key=str)


def test_empty_table(docs):
    assert chunks.classes(docs()).count() == 0
    assert chunks.deduplicated(docs()).count() == 0


def test_cuts_follow_content():
    import numpy as np

    from faultline.llm import words
    data, offsets = words.text_bytes(__import__("pyarrow").array([LONG, "prefix " + LONG]))
    a, b = chunks.cuts(data, offsets)
    first = {x for x in a}
    second = {x - len(LONG.encode()) - 7 for x in b}
    assert len(first & second) > 0.9 * len(first)
    assert max(np.diff([0, *a])) <= chunks.LONGEST
