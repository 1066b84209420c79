import random

import numpy as np

from millrace.llm import overlap

SCHEMA = "example_id long, split string, source string, messages array<struct<role:string,content:string>>, class string"


def records(spark, rows):
    return spark.createDataFrame([(i, s, "x", None if t is None else [("system", "same words for all"), (r, t), ("assistant", "ok")], "clash") for i, s, r, t in rows], SCHEMA)


def brute(rows):
    import re

    words = {i: re.findall(r"\w+", (t or "").lower()) for i, _, _, t in rows if i is not None}
    side = {i: overlap_side(s) for i, s, _, _ in rows}
    found = set()
    for a in words:
        for b in words:
            if a < b and words[a] and words[b] and {side[a], side[b]} == {"train", "eval"} and overlap.common_words(words[a], words[b]) >= 0.8 * max(len(words[a]), len(words[b])):
                found.add((a, b))
    return found


def overlap_side(split):
    label = (split or "").strip().lower()
    return "train" if label.startswith("train") else "eval" if label.startswith(("val", "test")) else None


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(40, 90))]
        for split in rng.choices(["train", " Train", "VAL", "validation", "test ", None], k=5):
            text = [rng.choice(vocabulary) if rng.random() < rng.choice([0, 0.03, 0.1, 0.25]) else w for w in base]
            n += 1
            rows.append((n, split, rng.choice(["user", "human", "User "]), " ".join(text).replace("w1", "W1")))
    hot = "a message that very many records share word for word in both of the splits"
    rows += [(1000 + i, "train" if i % 2 else "test", "user", hot) for i in range(40)]
    df = records(spark, rows)
    got = {tuple(r) for r in overlap.cross_split_pairs(df.union(df)).collect()}
    assert got == brute(rows)


def test_every_fifth_word_replaced(spark):
    rng, rows = random.Random(5), []
    for i in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(100)]
        rows += [(2 * i, "train", "user", " ".join(base)), (2 * i + 1, "test", "user", " ".join(f"x{rng.randrange(10**6)}" if k % 5 == 4 else w for k, w in enumerate(base)))]
    assert {tuple(r) for r in overlap.cross_split_pairs(records(spark, rows)).collect()} == {(2 * i, 2 * i + 1) for i in range(40)}


def test_many_copies_of_one_template(spark, monkeypatch):
    monkeypatch.setattr(overlap, "ROWS", 30)
    monkeypatch.setattr(overlap, "SUFFIXES", 500)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, "train" if i < 50 else "val", "user", " ".join(f"x{rng.randrange(10**6)}" if k % 7 == 6 else w for k, w in enumerate(base))) for i in range(100)]
    assert overlap.cross_split_pairs(records(spark, rows)).count() == 2500


def test_changes_that_leave_only_two_words_together(spark):
    """Deletions and insertions in turn: nothing longer than two words is shared."""
    rng, rows = random.Random(7), []
    for i in range(10):
        base = [f"w{rng.randrange(60)}" for _ in range(100)]
        other = [x for k, w in enumerate(base) if k % 5 != 4 for x in ([w, "new"] if k % 5 == 1 else [w])]
        rows += [(2 * i, "train", "user", " ".join(base)), (2 * i + 1, "test", "user", " ".join(other))]
    got = {tuple(r) for r in overlap.cross_split_pairs(records(spark, rows)).collect()}
    assert got == brute(rows) and len(got) >= 10


def test_suffix_order_alone(spark):
    """What the suffix array shows without the filter behind it, over texts of few words from templates."""
    rng = random.Random(8)
    frames = [[f"f{i}{k}" for k in range(8)] for i in range(20)]
    rows, n = [], 0
    for _ in range(60):
        base = [w for _ in range(10) for w in [*rng.choice(frames), f"s{rng.randrange(200)}"]]
        for split in ("train", "test"):
            n += 1
            rows.append((n, split, "user", " ".join(f"y{rng.randrange(10**5)}" if rng.random() < 0.1 else w for w in base)))
    _, texts = overlap.message_classes(records(spark, rows))
    texts = texts.cache()
    true = brute(rows)
    shown = {tuple(sorted(r)) for r in overlap.verified(overlap.spanned_pairs(texts), texts).collect()}
    assert shown <= true and len(shown) >= 0.95 * len(true)


def test_edges(spark):
    rows = [(1, "train", "user", None), (2, "test", "user", "  "), (3, "train", "user", "one two three four five"), (4, "test", "user", "one two three four"), (5, "test", "user", "one"), (6, "train", "human", "ONE!"), (7, None, "user", "one"), (8, "test", "user", "two one")]
    assert {tuple(r) for r in overlap.cross_split_pairs(records(spark, rows)).collect()} == {(3, 4), (5, 6)}
    assert overlap.cross_split_pairs(records(spark, rows).limit(0)).count() == 0
    report = {(r.split, r.n_records, r.n_overlapping) for r in overlap.overlap_report(records(spark, rows)).collect()}
    assert report == {("train", 3, 2), ("test", 4, 2), ("?", 1, 0)}


def test_texts_of_other_kinds(spark):
    long = " ".join(f"w{i % 977}" for i in range(6000))
    same = "a third of all records share this text of eleven words here"
    rows = [(1, "train", "user", long), (2, "test", "user", long + " end"), (3, "test", "user", "w1 " * 100_000), (4, "train", "user", "w1 " * 90_000)]
    rows += [(10 + i, "train" if i % 3 else "test", "user", same) for i in range(30)]
    rows += [(50, "train", "user", "a b"), (50, "test", "user", "a b"), (51, "dev", "user", "\u00e9t\u00e9 \u0434\u043e\u043c"), (52, "training", "human", "\u00c9T\u00c9 \u0414\u041e\u041c")]
    got = {tuple(r) for r in overlap.cross_split_pairs(records(spark, rows)).collect()}
    copies = {(a, b) for a in range(10, 40) for b in range(a + 1, 40) if ((a - 10) % 3 == 0) != ((b - 10) % 3 == 0)}
    assert got == copies | {(1, 2), (3, 4), (51, 52)}


def test_rare_words_hold_a_partner():
    rng = random.Random(9)
    counts = np.array([rng.randrange(50) for _ in range(overlap.COUNTS)])
    for _ in range(200):
        a = [rng.randrange(12) for _ in range(rng.randint(1, 30))]
        b = [w if rng.random() < 0.8 else rng.randrange(12) for w in a]
        if overlap.common_words(a, b) >= 0.8 * max(len(a), len(b)):
            keys = [set(overlap.rare_words(np.array(x, dtype=np.int64) * 7919, counts).tolist()) for x in (a, b)]
            assert keys[0] & keys[1]


def test_common_words():
    assert overlap.common_words("a b c d".split(), "a x c d".split()) == 3
    assert overlap.common_words([], ["a"]) == 0
