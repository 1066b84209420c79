import base64
import random

import pytest
from pyspark.sql import functions as F

from millrace.llm import encoding, packing

TEXTS = ["", None, " ", "Hello world", "don't  stop\n\n\tnow", "naïve 日本語 🙂🙂 é", "=" * 5000, "a" * 3000, "1234567890" * 50, "x\u0000y", "  \n ", "<|endoftext|>"]


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    with open(encoding.RANKS_FILE, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=encoding.PIECES, mergeable_ranks=ranks, special_tokens={})


def random_text(rng):
    return "".join(rng.choice(["a", "e", "th", "ing", "é", "日", "🙂", " ", "  ", "\n", "1", "23", "==", "((", "_", "ation", "'s", "Z"]) for _ in range(rng.randint(0, 60)))


def test_same_ids_as_the_public_encoder(spark, reference):
    rng = random.Random(2)
    texts = TEXTS + [random_text(rng) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in encoding.encode_documents(df.union(df)).collect()}
    assert got == {i: reference.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert encoding.encode_documents(df.limit(0)).count() == 0


def test_appends_and_edits(reference):
    rng, e = random.Random(4), encoding.encoder()
    last = e.extend(b"tokeni", [])
    assert e.extend(b"tokenization", last) == e.extend(b"tokenization", [])
    for _ in range(400):
        text = random_text(rng)
        start = rng.randint(0, len(text))
        end = rng.randint(start, len(text))
        changed, encoded = e.edit(text, e.encode_pieces(text), start, end, random_text(rng)[:5])
        assert encoded == e.encode_pieces(changed) and encoded[0] == reference.encode_ordinary(changed)


def test_an_edit_is_local(monkeypatch):
    e = encoding.encoder()
    text = "some words of a text, " * 20_000
    encoded, touched = e.encode_pieces(text), []
    monkeypatch.setattr(e, "remembered", lambda piece, own=e.remembered: touched.append(piece) or own(piece))
    for start in (len(text) - 9, len(text), len(text) // 2, 0):
        changed, found = e.edit(text, encoded, start, min(start + 3, len(text)), "new")
        assert len(touched) < 10
        touched.clear()
        assert found == encoding.encoder().encode_pieces(changed)
        touched.clear()


def test_edited_documents(spark):
    df = spark.createDataFrame([(i, t, s, "clash") for i, t in enumerate(TEXTS) for s in ("web 9", None)], "doc_id long, text string, source string, edited string")
    rows = encoding.edited_documents(df.union(df)).collect()
    assert len(rows) == 2 * len(TEXTS) and all(r.edited_same and r.appended_same for r in rows)
    assert encoding.edited_documents(df.limit(0)).count() == 0


def test_best_fit_decreasing_by_hand():
    import numpy as np

    sizes = np.array([6, 5, 4, 3, 2, 10])
    got = packing.best_fit_decreasing(sizes, 10)
    assert got[5] == 0 and got[0] == got[2] and got[1] == got[3] == got[4]
    rng = random.Random(1)
    sizes = np.array([rng.randint(1, 40) for _ in range(500)])
    fast, free, want = packing.best_fit_decreasing(sizes, 50), [], {}
    for k in np.argsort(-sizes, kind="stable"):
        fits = [(f, -i) for i, f in enumerate(free) if f >= sizes[k]]
        at = -min(fits)[1] if fits else len(free)
        if not fits:
            free.append(50)
        free[at] -= sizes[k]
        want[int(k)] = at
    assert len(set(fast)) == len(free)
    used = [sizes[fast == c].sum() for c in set(fast)]
    assert max(used) <= 50 and sorted(used) == sorted(50 - f for f in free)


def test_pack(spark):
    items = [(i, (i * 37) % 90 + 1) for i in range(3000)] + [(9001, 250), (9002, 100), (9003, 0), (9004, None), (9005, 300)]
    df = spark.createDataFrame(items, "item long, size long")
    got = packing.pack(df, 100, bucket_items=500).cache()
    assert {r["sum(n)"] for r in got.groupBy("item").sum("n").where("item = 9001").collect()} == {250}
    assert got.agg(F.sum("n")).first()[0] == sum(s or 0 for _, s in items)
    assert got.groupBy("container_id").sum("n").where("container_id is not null and sum(n) > 100").count() == 0
    assert {r.item for r in got.where("container_id is null").collect()} == {9003, 9004}
    assert got.where("piece > 0").select("item").distinct().count() == 2
    report = packing.fill_report(got.withColumnRenamed("n", "n_tokens"), 100).first()
    assert report.unused_share < 0.03
    assert packing.pack(df.limit(0), 100).count() == 0
