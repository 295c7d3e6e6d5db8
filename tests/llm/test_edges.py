"""Rows without an id, repeated rows, very long texts and clashing columns, for the operators whose own tests have none of them."""

from __future__ import annotations

import random
import weakref

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from casework.llm import chaining, cotrain, decontaminate, ngram_join, sentencepiece_bpe, toxicity

from .test_operators import make


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(31)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9)))
    plain = lambda n: " ".join(word() for _ in range(n))
    return plain


def test_quality_keeps_a_row_for_a_row(spark, texts):
    rows = [(i, texts(50) if i % 4 else texts(50).replace(" ", "### ")) for i in range(200)]
    odd = [(None, texts(60)), (None, texts(60)), (7, rows[7][1]), (7, rows[7][1]), (8, texts(40)), (500, texts(150_000)), (501, "x" * 1_000_000)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(100)] + [(3, 1), (None, 1)], "doc_id long, quality int").withColumn("text", F.lit("x"))
    docs = make(spark, *rows, *odd)
    got = cotrain.score_quality(docs, cotrain.fit_quality(docs, labels), keep=("text",)).collect()
    assert len(got) == 207 and sum(r.doc_id is None for r in got) == 2 and sum(r.doc_id == 7 for r in got) == 3
    assert len({r.keep for r in got if r.doc_id == 7}) == 1 and sorted(r.doc_id for r in got if r.doc_id in (500, 501)) == [500, 501]


def test_a_kept_text_is_sent_to_tasks_once(spark):
    """A batch's texts are most of its memory, in the executor and in Python; a kept null stays one."""
    docs = make(spark, (1, "some words"), (2, None), (3, ""))
    model = cotrain.fit_quality(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"), rounds=0)
    sent = cotrain._prepare(docs, "doc_id", "text", "source", "lang", "n_chars", keep=("text", "lang"))
    assert len(sent.columns) == 6 and sorted(r.text or "" for r in sent.collect()) == ["", "", "some words"]
    got = {r.doc_id: r for r in cotrain.score_quality(docs, model, keep=("text", "lang")).collect()}
    assert [got[i].text for i in (1, 2, 3)] == ["some words", None, ""] and got[2].quality_score == got[3].quality_score == 0


@pytest.mark.parametrize("stage", [cotrain._featurize, cotrain._proposer([], [], [0, 0], 1.0), cotrain._scorer(None, [])])
def test_quality_drops_the_encoder_that_its_worker_has_kept(stage):
    """Workers outlive their tasks: what a run of the tokenizer has left would count against the classifier."""
    kept = sentencepiece_bpe._of_worker(public_tokenizers.path("piece_bpe_32k.model"))
    assert sentencepiece_bpe._of_worker(public_tokenizers.path("piece_bpe_32k.model")) is kept
    gone = weakref.ref(kept)
    del kept
    assert gone() is not None
    list(stage(iter([])))
    assert gone() is None


def test_the_encoder_keeps_a_part_in_few_bytes():
    """Entries are most of what a worker of the tokenizer holds: ids as bytes, keys without the two-byte mark, pieces of pairs not copied."""
    encoder = sentencepiece_bpe.PieceEncoder(public_tokenizers.path("piece_bpe_32k.model"))
    text = "unbelievable words of some▁length are repeated, unbelievable words"
    assert encoder.encode(text) == encoder.library.encode(text)
    assert all(k.isascii() and isinstance(v, bytes) and len(v) % 2 == 0 for k, v in encoder.encoded.items()) and " unbelievable" in encoder.encoded
    own = {id(p) for p in encoder.ids}
    assert encoder.compatible and all(id(p) in own for pair in encoder.compatible for p in pair if p in encoder.ids)


def test_chains_that_are_left_out_give_no_passage():
    """Many short chains are extended at once; those left out are just such as give nothing one by one."""
    rnd, kept, gone = random.Random(5), 0, 0
    for n in range(40):
        phrases = [[rnd.randrange(60) for _ in range(rnd.randint(4, 30))] for _ in range(12)]
        texts_ = [sum((rnd.choice(phrases) + [rnd.randrange(60 + n * 20) for _ in range(rnd.randint(0, 6))] for _ in range(25)), []) for _ in range(2)]
        x, y = (np.array(t, np.int32) for t in texts_)
        found = chaining.chains(chaining.anchors_of(chaining.Side(x, 4), chaining.Side(y, 4)))
        some = chaining.promising(x, y, found, 4, 50, 80)
        useful = [c for c in found if chaining.passages_of(x, y, c, 4, 50, 80)]
        assert [c for c in some if c in useful] == useful
        kept, gone = kept + len(useful), gone + len(found) - len(some)
    assert kept >= 10 and gone > 200


def test_few_chains_are_aligned_in_vain(monkeypatch):
    """The chains of many pairs are judged at once, also where a pair has few; passages and open parts are those of all chains one by one."""
    rnd, rows = random.Random(8), []
    for n in range(300):
        own = lambda m: [rnd.randrange(1 << 30) for _ in range(m)]
        x, y = own(20), own(20)
        for _ in range(rnd.randint(1, 6)):
            part = own(rnd.randint(4, 70))
            x += part + own(rnd.randint(1, 9))
            y += [w if rnd.random() > 0.1 else own(1)[0] for w in part] + own(rnd.randint(1, 9))
        rows.append((n // 3, 1000 + n, n % 2 == 0, x, y if n % 3 == 0 else rows[-1][4]))
    cut = lambda a, b: pa.record_batch({c: pa.array([r[i] for r in rows[a:b]], t) for i, (c, t) in enumerate({"hub": pa.int64(), "id": pa.int64(), "both": pa.bool_(), "x": pa.list_(pa.int32()), "y": pa.list_(pa.int32())}.items())})
    want, calls, judge = [], [], chaining.passages_of
    for hub, id_, both, x, y in rows:
        x, y = np.array(x, np.int32), np.array(y, np.int32)
        found = chaining.chains(chaining.anchors_of(chaining.Side(x, 4), chaining.Side(y, 4)))
        told = chaining.passages_between(x, y, found, 4, 50, 80)
        want += [(id_, *p[:2], hub, *p[2:]) for p in told] + [(hub, *p[2:4], id_, *p[:2], p[4]) for p in told if both]
        if found and not told:
            (a, b), (c, d) = found[0][0], found[0][-1]
            want.append((id_, a, c + 4, hub, b, d + 4, chaining.OPEN))
    monkeypatch.setattr(chaining, "passages_of", lambda *a: calls.append(judge(*a)) or calls[-1])
    got = [tuple(r.values()) for batch in chaining._aligner(4, 50, 80)(iter([cut(0, 0), cut(0, 100), cut(100, 300).slice(0, 150), cut(250, 300)])) for r in batch.to_pylist()]
    assert sorted(got) == sorted(want) and sum(not c for c in calls) < 8 and sum(bool(c) for c in calls) > 50


def test_rounds_read_the_texts_of_the_round_before(spark, monkeypatch):
    """A further round joins with the texts of the documents that it may still pair, not with all documents again."""
    rnd = random.Random(9)
    words = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    ids, docs = iter(rnd.sample(range(10_000), 700)), [(20_000 + i, " ".join(words(60))) for i in range(300)]
    pairs = []
    for _ in range(4):
        p = words(100)
        q = [words(1)[0] if i % 8 == 7 else w for i, w in enumerate(p)]
        a, b = next(ids), next(ids)
        pairs.append({a, b})
        docs += [(a, " ".join(words(60) + p + words(60))), (b, " ".join(words(60) + q + words(60)))]
        for text in (p, q) * 20:
            at = rnd.randrange(66)
            docs.append((next(ids), " ".join(words(40) + text[at : at + 35] + words(40))))
    sizes, join = {}, chaining.bloom_join

    def counted(scratch, name, large, small, key, then):
        sizes[name] = large.count()
        return join(scratch, name, large, small, key, then)

    monkeypatch.setattr(chaining, "bloom_join", counted)
    found = [{r.doc_id, r.other_id} for r in chaining.repeated_passages(make(spark, *docs)).collect()]
    assert all(p in found for p in pairs)
    later = {k: n for k, n in sizes.items() if k.startswith(("again-", "words-"))}
    assert later and all(n < 200 for n in later.values()) and len(docs) > 400


def test_rounds_have_plans_of_one_size(spark, monkeypatch):
    """The driver plans every round; what each has found is read as one table, not as the union of all rounds before."""
    rnd = random.Random(16)
    words = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    docs = []
    for i in range(6):
        p = words(50)
        for j in range(50):
            at = rnd.randint(0, len(p) - 35)
            docs.append((100 * i + j, " ".join(words(9) + p[at : at + 35] + words(9))))
        docs += [(100 * i + at, " ".join(words(20) + p + words(20))) for at in (60, 61)]
    sizes, table = {}, chaining.Scratch.table
    leaves = lambda df: df._jdf.queryExecution().optimizedPlan().collectLeaves().size()

    def counted(self, df, name, *more):
        sizes[name] = leaves(df)
        return table(self, df, name, *more)

    monkeypatch.setattr(chaining.Scratch, "table", counted)
    found = chaining.repeated_passages(make(spark, *docs))
    assert leaves(found) == 1 and all(any({r.doc_id, r.other_id} == {100 * i + 60, 100 * i + 61} for r in found.collect()) for i in range(6))
    rounds = [[n for name, n in sizes.items() if name.endswith(f"-{turn}")] for turn in range(1 + max(int(x.split("-")[1]) for x in sizes if "-" in x))]
    assert len(rounds) >= 3 and max(map(max, rounds[2:])) <= max(rounds[1])


def test_rounds_are_few_in_a_large_crowd(spark, monkeypatch):
    """Hubs resolve a crowd a few documents at a time; as crowds that pair in full double, the rounds grow with the logarithm of the crowd. A hub's pairs dealt to several tasks give the same."""
    rnd = random.Random(3)
    words = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    p, docs = words(60), []
    for i in range(50):
        at = rnd.randint(0, 24)
        docs.append((i, " ".join(words(9) + p[at : at + 36] + words(9))))
    docs += [(i, " ".join(words(9) + p + words(9))) for i in (1000, 1001)]
    names, table = [], chaining.Scratch.table
    monkeypatch.setattr(chaining.Scratch, "table", lambda self, df, name, *more: names.append(name) or table(self, df, name, *more))
    monkeypatch.setattr(chaining, "HUB_PAIRS", 5)
    monkeypatch.setattr(chaining, "TASK_PAIRS", 20)
    found = chaining.repeated_passages(make(spark, *docs)).collect()
    assert {frozenset((r.doc_id, r.other_id)) for r in found} == {frozenset((1000, 1001))}
    assert sum(name.startswith("found-") for name in names) <= 5  # 13 with hubs alone


def test_known_documents_pair_with_others_only():
    """Documents of a seed: all open ones pair as long as they are few, more with the open ones' hubs; a known one pairs with open ones, never with its like, and is no hub."""
    text, known = " ".join(f"w{i}" for i in range(10)), {1, 4, 30}
    for crowd, ids in ((8, range(1, 9)), (8, range(1, 31))):
        part = lambda some: [[{"from": 0, "to": 10}] if (i in known) == some else [] for i in ids]
        kind = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
        batch = pa.record_batch({"id": pa.array(ids, pa.int64()), "text": pa.array([text] * len(ids)), "parts": pa.array(part(False), kind), "known": pa.array(part(True), kind)})
        sent = pa.Table.from_batches(list(chaining._sender(1, 4, 36, 50)(iter([batch]))))
        got = {(r["a"], r["b"]): r["told"] for r in chaining._owner(crowd, 7)(sent).to_pylist()}
        alone = [i for i in ids if i not in known]
        every = {(a, b) for a in ids for b in ids if a < b and not {a, b} <= known}
        hubs = {alone[0], alone[-1]}
        want = every if len(alone) <= crowd else {(a, b) for a, b in every if {a, b} & hubs}
        assert set(got) == want
        if len(alone) > crowd:
            assert got[alone[0], alone[-1]] == 3 and got[1, alone[0]] == 2 and got[1, alone[-1]] == 2 and got[alone[0], 5] == 1 and got[alone[-1], 30] == 1


def test_toxicity_scores_a_row_for_a_row(spark, texts):
    rows = [(i, texts(50) + (" stinker" if i % 5 == 0 else "")) for i in range(300)]
    odd = [(None, texts(30) + " stinker"), (None, texts(30)), (5, rows[5][1]), (5, rows[5][1]), (6, texts(30) + " stinker"), (500, texts(100_000) + " stinker " + texts(100)), (501, texts(100_000))]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    chain = toxicity.fit_chain(make(spark, *rows, *odd), labels, ["toxic"])
    got = toxicity.score_toxicity(make(spark, *rows, *odd), chain).collect()
    assert len(got) == 307 and sorted(r.toxic for r in got if r.doc_id is None) == [False, True] and [r.toxic for r in got if r.doc_id == 5] == [True] * 3
    assert [r.toxic for r in got if r.doc_id == 500] == [True] and [r.toxic for r in got if r.doc_id == 501] == [False]


def test_long_texts(spark, texts):
    passage, item = texts(80), texts(30)
    long = texts(150_000)
    docs = make(spark, (1, f"{long[:400_000]} {passage} {long[400_000:]}"), (2, f"{texts(40)} {passage} {texts(40)}"), (3, f"{long} {item} end"), (4, f"{long} {item} ende"), (4, f"{long} {item} ende"), (None, passage))
    found = {(r.doc_id, r.other_id) for r in chaining.repeated_passages(docs).collect()}
    assert any({1, 2} == set(p) for p in found) and all(None not in p for p in found)
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    assert sorted((r.doc_id, r.distance) for r in decontaminate.find_leaks(docs, bench).collect()) == [(3, 0), (4, 0), (4, 0)]
    got = [(r.doc_id, r.component_id) for r in ngram_join.jaccard_components(docs).collect()]
    assert len(got) == 6 and sorted((i, c) for i, c in got if i in (3, 4)) == [(3, 1), (4, 1), (4, 1)]  # all three hold the same long text
