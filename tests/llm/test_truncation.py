import random

import numpy as np
import pandas as pd

from millrace.llm import truncation


def test_finds_cut_logs_and_diffs(spark):
    rng = random.Random(7)
    words = "alpha beta gamma delta ledger harbor willow spindle marker cursor".split()
    rows, cut = [], set()
    for i in range(900):
        body = [f"tests/{rng.choice(words)}_{rng.choice(words)}.py::test_{rng.choice(words)} PASSED" for _ in range(rng.randint(3, 60))]
        text = "\n".join(body) + f"\n==== {len(body)} passed in {rng.random():.2f}s ====\n"
        patch = f"--- a/{rng.choice(words)}.py\n+++ b/x.py\n@@ -1,6 +1,6 @@\n" + "".join(f"     {rng.choice(words)} = {rng.choice(words)}({rng.choice(words)})\n" for _ in range(6))
        if len(text) > 2000 and i % 3:  # a limit
            text = text[:2000]
            cut.add((i, "test_stdout"))
        elif i % 29 == 0:  # a transfer that broke off
            text = text[: len(text) // 2]
            cut.add((i, "test_stdout"))
        if i % 31 == 0:
            patch = patch[: len(patch) * 2 // 3]
            cut.add((i, "patch"))
        rows.append((i, "o/r", patch, text, "clash"))
    df = spark.createDataFrame(rows, "entry_id long, repo string, patch string, test_stdout string, kind string")
    none = spark.createDataFrame([(1, None, None), (2, "t", "")], "result_id long, tool_name string, output string")
    found = truncation.cut_values(truncation.text_values(df.union(df), none)).cache()
    assert found.count() == 1800
    got = {(r.row_id, r.field) for r in found.where("odds > 0").collect()}
    assert len(got & cut) / len(got) > 0.97 and len(got & cut) / len(cut) > 0.9
    rates = {r.field: r.n_cut for r in truncation.cut_rates(found).collect()}
    assert sum(rates.values()) == len(got)


def test_nothing_to_do(spark):
    entries = spark.createDataFrame([(1, None, None, ""), (None, "a/b", "x", "y")], "entry_id long, repo string, patch string, test_stdout string")
    results = spark.createDataFrame([], "result_id long, tool_name string, output string")
    assert truncation.cut_values(truncation.text_values(entries, results)).count() == 0
    one = spark.createDataFrame([(1, None, "x", None)], "entry_id long, repo string, patch string, test_stdout string")
    assert truncation.cut_values(truncation.text_values(one, results)).count() == 1


def test_censored_fit_recovers_the_distribution():
    rng = np.random.default_rng(1)
    x = np.exp(rng.normal(7, 0.6, 20_000))
    kept, bound = np.log(x[x < 1500]), 1500
    row = pd.DataFrame([("k", "s", "chars", bound, float(len(kept)), kept.sum(), (kept**2).sum(), float((x >= 1500).sum()), 0.0)], columns="kind source unit bound n s1 s2 at above".split())
    assert truncation.fit_censored(row)["posterior"][0] == truncation.SURE
    none = row.assign(at=2.0, above=float((x >= 1530).sum()))
    assert truncation.fit_censored(none)["posterior"][0] < 0.3


def test_weights_stay_finite_when_separable():
    x = np.array([[8.0, 8.0], [-8.0, -8.0]] * 50)
    w = truncation.logistic_weights(x, np.array([1.0, 0.0] * 50))
    assert np.isfinite(w).all() and np.abs(w).max() < 10


def test_limits_far_from_all_lengths():
    """A limit so far out that both probabilities vanish, single values, and lengths of one character."""
    base = {"kind": "k", "source": "s", "unit": "chars", "s2": 0.0, "shared": 0.5}
    rows = truncation.pd.DataFrame([
        base | {"bound": 10**9, "n": 50.0, "s1": 0.0, "at": 1.0, "above": 5.0}, base | {"bound": 1, "n": 0.0, "s1": 0.0, "at": 3.0, "above": 0.0}, base | {"bound": 7, "n": 1.0, "s1": 2.0, "at": 1.0, "above": 1.0},
    ])
    found = truncation.fit_censored(rows)["posterior"]
    assert all(truncation.TRANSFER_RATE <= p <= truncation.SURE for p in found)
