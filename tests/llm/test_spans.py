import random

import numpy as np
import pytest

from packetlens.llm import spans


def brute(docs, length):
    where = {}
    for d, t in docs:
        for i in range(len(t or "") - length + 1):
            where.setdefault(t[i : i + length], set()).add(d)
    out = []
    for d, t in dict(docs).items():
        shared = [i for i in range(len(t or "") - length + 1) if len(where[t[i : i + length]]) > 1]
        run = None
        for i in shared:
            if run and i <= run[1]:
                run[1] = i + length
            else:
                run = [i, i + length]
                out.append((d, run))
    return {(d, a, b) for d, (a, b) in out}


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgé中🙂 .,") for _ in range(rnd.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(rnd.randrange(15, 60)) for _ in range(6)] + ["=" * 130, "ab" * 80]
    docs = []
    for i in range(60):
        parts = [text(rnd.randrange(0, 30)) for _ in range(rnd.randrange(1, 4))]
        for _ in range(rnd.randrange(0, 3)):
            p = rnd.choice(passages)
            a = rnd.randrange(0, len(p) // 2)
            parts.insert(rnd.randrange(len(parts) + 1), p[a : a + rnd.randrange(20, 300)])
        docs.append((i, "".join(parts)))
    docs += [(100, None), (101, ""), (102, " "), (103, docs[0][1]), (104, passages[0] * 2), (105, "z" * 500), (106, "z" * 99 + "y")]
    return docs


@pytest.mark.parametrize("seed, part", [(1, 1 << 19), (2, 300), (3, 1 << 19)])
def test_against_all_windows(spark, monkeypatch, seed, part):
    monkeypatch.setattr(spans, "PART", part)
    docs = corpus(seed)
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, h int").repartition(5)
    for few in ({}, {"segment_keys": 50, "broadcast_hashes": 10}):
        got = {(r.doc_id, r.span_start, r.span_end) for r in spans.shared_spans(df, doc_id="doc_id", text="text", length=90, **few).collect()}
        assert got == brute(docs, 90)
    assert spans.shared_spans(df.limit(0), doc_id="doc_id", text="text").count() == 0


def test_repeats_inside_one_document_are_not_shared(spark):
    text = "".join(random.Random(0).choice("abcdef ") for _ in range(300))
    df = spark.createDataFrame([(1, text + text), (1, text + text), (2, "other")], "doc_id long, text string")
    assert spans.shared_spans(df, doc_id="doc_id", text="text").count() == 0


def test_share(spark):
    text = "".join(random.Random(0).choice("abcdef ") for _ in range(300))
    df = spark.createDataFrame([(1, text + "x" * 100), (2, "y" + text), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: (r.shared_chars, r.share) for r in spans.shared_share(df, spans.shared_spans(df, doc_id="doc_id", text="text"), doc_id="doc_id", text="text").collect()}
    assert got == {1: (300, 0.75), 2: (300, 300 / 301), 3: (0, None), 4: (0, None)}


def test_long_text_in_parts(monkeypatch):
    monkeypatch.setattr(spans, "PART", 1000)
    text = "".join(random.Random(1).choice("abcdefgh ") for _ in range(5000))
    seen = set()
    for b in spans.blocks([text, text[:150]], 200):
        starts, part = b.windows()
        seen |= set(b.place(starts, part))
    assert sorted(seen) == list(range(5000 - 200 + 1))


def test_runs_lie_inside_their_windows():
    text = "".join(random.Random(2).choice("abcdefgh ") for _ in range(3000)) + "=" * 400
    for b in spans.blocks([text], 200):
        starts, _ = b.windows()
        cut = b.cut[starts]
        assert (cut >= starts).all() and (b.settled(cut) <= starts + 200).all()
        assert set(cut) <= set(b.runs()[0])


def test_short_length_is_refused(spark):
    with pytest.raises(ValueError):
        spans.shared_spans(spark.createDataFrame([(1, "x")], "doc_id long, text string"), doc_id="doc_id", text="text", length=10)
