import hashlib
import zlib
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from faultline.llm import chat, packing, shards, words

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t aé's1.　")), max_size=60), max_size=8))
def test_words_are_encoded_as_whole_texts(texts):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    encoder, got = packing.encoder(PATH), []
    for _, _, data, offsets in words.blocks(pa.array(texts, pa.string())):
        ids, bounds = encoder.encode(data, offsets)
        got += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert got == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_pieces_fill_sequences(docs, tokenizer):
    rows = [(i, f"some words {i} " * (i * 37 % 900)) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "x"), (502, "x"), (None, "y"), (503, "long text of many words " * 9000)]
    got = packing.pack(docs(*rows), PATH, with_ids=True).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r.ids)) and len(r.ids) == r.length
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END_ID]
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert [x for r in pieces for x in r.ids] == ids * (2 if i == 502 else 1)
        assert all(r.doc_tokens == len(ids) for r in pieces)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted(sequences) == list(range(len(sequences)))
    assert sum(r.length for r in got) > 0.97 * 2048 * len(sequences)
    assert packing.pack(docs(), PATH).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 4), min_size=1, max_size=6))
def test_fill_is_closest_to_capacity(stock):
    chosen = packing.fill(stock, 20)
    assert all(chosen[n] <= stock[n] for n in chosen) and max(stock) in chosen
    sums = {0}
    for n in (Counter(stock) - Counter({max(stock): 1})).elements():
        sums |= {s + n for s in sums if s + n + max(stock) <= 20}
    assert sum(n * k for n, k in chosen.items()) == max(sums) + max(stock)


def test_plan_places_every_piece():
    counts = {2048: 3, 1500: 4, 700: 9, 548: 2, 3: 100}
    rows = packing.plan(counts)
    assert sum(counts.values()) == sum(
        (next((r[1] for r in rows[i + 1:] if r[0] == row[0]), counts[row[0]]) - row[1]) for i, row in enumerate(rows))


TURNS = [(1, 0, "user", "Hello"), (1, 1, "assistant", "Hé 👩‍👩‍👧 \\### </turn>\n### user: x </turn>\n"), (1, 2, "assistant", ""),
         (2, None, None, None), (2, 1, "assi:stant\n", ": \\h \\"), (3, 0, "assistant", "#"), (3, 0, "assistant", "#"),
         (None, 5, "user", "lost"), (4, 0, "assistant", " lead and trail \n\n")]
TURNS += [(9, n, "user" if n % 2 else "assistant", f"turn {n} ") for n in range(400)]


def conversation(turns):
    key = lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")
    turns = sorted(turns, key=key)
    loss = "".join(t[3] or "" for t in turns if t[2] == "assistant")
    every = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in turns)
    return len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_conversations_round_trip(spark, docs, tokenizer):
    frame = spark.createDataFrame([(*t, "more") for t in TURNS], "conv_id bigint, turn bigint, role string, text string, block string")
    formatted = chat.format_conversations(frame, PATH)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(formatted).collect()}
    assert got == {c: conversation([t for t in TURNS if t[0] == c]) for c in {t[0] for t in TURNS}}
    rows = formatted.where("conv_id = 9").orderBy("block").collect()
    assert len(rows) > 1
    # Blocks encoded by themselves are the whole conversation encoded once.
    assert [i for r in rows for i in r.ids] == tokenizer.encode("".join(r.formatted for r in rows), add_special_tokens=False).ids
    assert all(len(r.ids) == len(r.mask) for r in rows)
    assert chat.format_conversations(frame.limit(0), PATH).count() == 0


def test_mask_follows_offsets():
    tokens = [(0, 3), (3, 5), (5, 5), (5, 6), (5, 6), (6, 9), (9, 12)]
    mask, covered = chat.loss_mask(tokens, [(4, 6), (6, 7), (10, 11)])
    assert mask == [0, 1, 0, 1, 1, 1, 1]
    assert covered == [(4, 6), (6, 7), (10, 11)]


def test_shards_hold_the_mixture(docs):
    rows = [(i, "x" * (i % 50), "abc"[i % 3] if i % 6 else None) for i in range(1000)]
    rows += [(1000, None, "d"), (1001, "", "d"), (5, "x" * 5, "c"), (None, "é", "a")]
    got = shards.shards(docs(*rows), 7).collect()
    assert len(got) == len(rows)
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    for shard in range(7):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(counts[shard]))
        for source, n in Counter(s for _, _, s in rows).items():
            assert abs(sum(r.shard == shard and r.source == source for r in got) - n / 7) <= 2
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == {
        (i, 16 + len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t, _ in rows}
    assert shards.shards(docs()).count() == 0
    assert len(shards.shards(docs((1, "a"), (2, "b")), 40).collect()) == 2


def test_workers_get_bounded_batches_and_drop_their_encoder(docs):
    texts = docs(*((i, "words " * 50_000) for i in range(60))).select("text").coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch({"bytes": [batch.nbytes]})

    found = [r.bytes for r in texts.mapInArrow(sizes, "bytes bigint").collect()]
    assert sum(found) >= 60 * 300_000 and max(found) < 6 << 20
    batch = pa.record_batch({"doc_id": [1], "text": ["a text"]})
    assert sum(b.num_rows for b in packing._pieces(iter([batch]), PATH, 2048, False)) == 1
    assert packing.encoder.cache_info().currsize == 0
