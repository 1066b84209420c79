"""Texts that lost their end, to a limit on their length or during transfer.

Two kinds of evidence are combined as odds. Lengths: for every source a log-normal distribution is fitted by maximum
likelihood, with the values that stand exactly at a candidate limit as right-censored, which gives the probability
that a value of that length was censored. Endings: values as they are, and the same values cut at a random place,
show how often an ending looks one way or the other; a naive Bayes model of that is fitted on a bounded sample, and
needs no labels.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.splits import normal_repo, repository_names
from millrace.session import checkpointed

#: Values whose endings the model of endings is fitted on, at most (about); each is used whole and cut.
TRAINING_VALUES = 30_000
#: Where the fit of the share of values that lost their end in transfer begins, and in how many rounds.
TRANSFER_RATE, ROUNDS = 0.02, 8
#: A length alone never makes a cut more probable than this: complete values may have any length.
SURE = 0.9
#: A length is a candidate limit if the number of values that have it is so many times the mean of the lengths around, and
#: so many standard deviations of a count above it.
LIMIT_EXCESS, LIMIT_DEVIATIONS = 6.0, 8.0
#: Width of the bins of lengths that are the surroundings of a length, and how many of them on either side.
BIN, AROUND = 0.01, 5
#: So many limits of sources are broadcast at most; beyond that the values are shuffled to them.
BROADCAST_LIMITS = 500_000
#: Weight, in observations, of the pooled distribution in the smoothed counts of endings.
SMOOTHING = 2.0
#: Values taken as whole with larger odds of a cut under one model are left out of the next. Weighing them by their probability
#: instead (expectation and maximisation) was tried and lost 8 to 12 per cent of the true cases.
DOUBTFUL = 1.5
#: No single feature speaks for or against a cut with more than this many log odds.
STRONGEST = 8.0
FEATURES = ["shape", "piece", "joint", "declared", "open", "listed"]
#: Features that mean the same in all kinds of values and are counted over all of them.
COMMON = {"declared", "open"}


def text_values(trajectories: DataFrame, tool_results: DataFrame, moves: DataFrame | None = None) -> DataFrame:
    """(table_name, row_id, field, kind, source, value) of all non-empty values. ``kind`` is what has its own model,
    a field or tool; ``source`` is the repository under its common name, or the tool. A null repository or tool is
    the source '?'. Rows without an id are dropped."""
    repo = normal_repo(F.col("repo"))
    rows = trajectories.where("entry_id is not null").select("entry_id", repo.alias("repo"), "patch", "test_stdout")
    if moves is not None:
        homes = repository_names(moves).withColumnRenamed("repo", "_r")
        rows = rows.join(F.broadcast(homes) if homes.limit(100_001).count() <= 100_000 else homes, F.col("repo") == F.col("_r"), "left").withColumn("repo", F.coalesce("home", "repo"))
    attempts = rows.select(
        F.lit("trajectories").alias("table_name"), F.col("entry_id").alias("row_id"), F.coalesce("repo", F.lit("?")).alias("source"),
        F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("patch", "test_stdout")))).alias("v"),
    ).select("table_name", "row_id", "v.field", F.col("v.field").alias("kind"), "source", "v.value")
    tool = F.coalesce(F.lower(F.trim("tool_name")), F.lit("?"))
    outputs = tool_results.where("result_id is not null").select(
        F.lit("tool_results").alias("table_name"), F.col("result_id").alias("row_id"), F.lit("output").alias("field"), tool.alias("kind"), tool.alias("source"), F.col("output").alias("value")
    )
    return attempts.unionByName(outputs).where("value <> ''")


def hunk_state(value: Column) -> Column:
    """Whether the lines of the last hunk of a unified diff are as many as its header declares: exact, over, or
    short by 1, 2, or 3 and more (headers written by hand are often off by a line or two); 'head' if the header
    itself is incomplete."""
    tail = F.concat(F.lit("@@"), F.substring_index(F.concat(F.lit("\n"), value), "\n@@", -1))
    counts = [F.regexp_extract(tail, r"^@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@", k) for k in (1, 2)]
    old, new = (F.when(c == "", 1).otherwise(c.try_cast("int")) for c in counts)
    body = F.slice(F.split(F.regexp_replace(tail, r"\n$", ""), "\n"), 2, 2_000_000_000)
    have_old = F.size(F.filter(body, lambda x: ~x.rlike(r"^[+\\]")))
    have_new = F.size(F.filter(body, lambda x: ~x.rlike(r"^[-\\]")))
    missing = F.greatest(old - have_old, new - have_new)
    state = F.when(missing > 0, F.concat(F.lit("short "), F.least(missing, F.lit(3)).cast("string"))).when((have_old > old) | (have_new > new), "over").otherwise("exact")
    return F.when(tail.rlike(r"^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@"), state).otherwise("head")


def ending_features(value: Column) -> dict[str, Column]:
    """What the end of a value looks like.

    shape: the pattern of the last line, words as a, digits as 9, closed strings as S, runs of a sign once, by its hash;
    piece: the last word, or part of a joined word, or sign, and whether a line break follows; joint: both;
    declared: whether as many lines are there as a diff's last hunk declares; listed: how the lines below the first stand to
    the number it begins with or has in brackets ("12 of anything"), which means something only in kinds of values where
    it usually agrees; open: quotes and brackets of the last line that are open.
    """
    body = F.regexp_replace(value, r"\r?\n$", "")
    broken = F.when(value.endswith("\n"), "n").otherwise("-")
    last = F.substring_index(body, "\n", -1)
    shape = F.regexp_replace(last, r'"[^"]*"', "S")
    for pattern, to in ((r"[\p{L}_]+", "a"), (r"[0-9]+", "9"), (r"([^a9S])\1+", "$1"), (r"(?:[/.]a)+", "/a")):
        shape = F.regexp_replace(shape, pattern, to)
    piece = F.lower(F.regexp_extract(last, r"(\p{Lu}?[\p{Ll}\p{Lo}]+|\p{Lu}+|[0-9]+|.)$", 1))
    piece = F.when(piece.rlike("^[0-9]+$"), "9").otherwise(piece)
    first = F.substring_index(value, "\n", 1)
    declares = F.regexp_extract(first, r"(?:^|\()(\d+) \p{L}+", 1).try_cast("int")
    remarks = F.when(last.rlike(r"^(?:…|\.\.\.|\[).*\d"), 1).otherwise(0)
    below = F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) - remarks
    listed = F.when(declares.isNull(), "none").when(below < declares, "short").when(below > declares, "over").otherwise("exact")
    is_diff = value.rlike(r"(?m)^(?:diff --git |--- |@@ -\d)")
    declared = F.when(is_diff, F.when(value.rlike(r"(?m)^@@"), hunk_state(value)).otherwise("no hunk")).otherwise("none")
    quotes = F.length(last) - F.length(F.replace(last, F.lit('"'), F.lit("")))
    opened = F.length(F.regexp_replace(last, r"[^(\[{]", "")) - F.length(F.regexp_replace(last, r"[^)\]}]", ""))
    shape, piece = F.hex(F.xxhash64(shape)), F.concat(broken, piece)
    return {
        "shape": shape,
        "piece": piece,
        "joint": F.concat_ws(" | ", shape, piece),
        "declared": declared,
        "open": F.concat_ws(",", (quotes % 2).cast("string"), F.signum(opened).cast("int").cast("string")),
        "listed": listed,
    }


def described(values: DataFrame, total: int) -> DataFrame:
    """Values with ``chars`` and ``bytes``, the units in which a limit may count, their ``digest``, the features of their ends, and, for a sample
    of about TRAINING_VALUES of ``total``, those of the value cut at a random place as ``cut``; instead of the text. This is
    the one pass over the texts; all else reads its narrow rows."""
    rate = max(1, min(1_000_000, round(1_000_000 * TRAINING_VALUES / max(total, 1))))
    chosen = F.pmod(F.xxhash64("table_name", "row_id", "field"), F.lit(1_000_000)) < rate
    share = F.pmod(F.xxhash64("row_id", "field", F.lit("at")), F.lit(9_500)) / 10_000 + 0.05
    at = F.greatest(F.floor(share * F.length("value")), F.lit(1)).cast("int")
    # A cut between the bytes of one character leaves a replacement character; one in twenty is made to.
    split = F.when(F.pmod(F.xxhash64("row_id", F.lit("split")), F.lit(20)) == 0, "\ufffd").otherwise("")
    rows = values.withColumn("_cut", F.when(chosen, F.concat(F.substring(F.col("value"), F.lit(1), at), split)))
    half = F.pmod(F.xxhash64("row_id", "field", F.lit("half")), F.lit(2)) == 0
    own = F.struct(*(c.alias(k) for k, c in ending_features(F.col("value")).items()))
    cut = F.when(F.col("_cut").isNotNull(), F.struct(*(c.alias(k) for k, c in ending_features(F.col("_cut")).items())))
    return rows.select("table_name", "row_id", "field", "kind", "source", F.length("value").alias("chars"), F.octet_length("value").alias("bytes"), F.xxhash64("value").alias("digest"), half.alias("half"), own.alias("whole"), cut.alias("cut"))


def candidate_limits(sized: DataFrame) -> DataFrame:
    """(kind, unit, bound, n) of lengths that far more values of a kind have than the lengths around, at any length and
    any number of values. Equal values count once, since a message that is repeated speaks for no limit.

    What is usual around a length is the mean count of the lengths in the bins on either side, each BIN of the length wide
    (a bin of short lengths has less than one length in it; those around are then at least ten). Bins, not lengths, meet
    each other, so the work is in proportion to the different lengths.
    """
    values = sized.select("kind", "digest", "chars", "bytes").distinct()
    units = values.select("kind", F.explode(F.create_map(F.lit("chars"), F.col("chars"), F.lit("bytes"), F.col("bytes"))).alias("unit", "bound"))
    counts = units.groupBy("kind", "unit", "bound").agg(F.count(F.lit(1)).alias("n"))
    place = F.when(F.col("bound") <= 1 / BIN, F.col("bound")).otherwise(F.floor(1 / BIN + F.log(F.col("bound") * BIN) / BIN))
    counts = counts.withColumn("bin", place.cast("bigint"))
    sums = counts.groupBy("kind", "unit", "bin").agg(F.sum("n").alias("all"))
    near = sums.select("kind", "unit", "all", F.explode(F.sequence(F.col("bin") - AROUND, F.col("bin") + AROUND)).alias("bin")).groupBy("kind", "unit", "bin").agg(F.sum("all").alias("all"))
    width = F.greatest(2 * AROUND * BIN * F.col("bound"), F.lit(2.0 * AROUND))
    usual = F.greatest((F.col("all") - F.col("n")) / width, F.lit(0.1))
    found = counts.join(near, ["kind", "unit", "bin"]).where(F.col("n") > F.greatest(LIMIT_EXCESS * usual, usual + LIMIT_DEVIATIONS * F.sqrt(usual)))
    # A text of plain ASCII has the same length in both units; the unit with more values is the limit's.
    best = found.groupBy("kind", "bound").agg(F.max_by("unit", F.struct("n", "unit")).alias("unit"), F.max("n").alias("n"))
    return best.select("kind", "unit", "bound", "n")


def normal_tail(z: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(x / math.sqrt(2)) for x in np.atleast_1d(z)])


def fit_censored(rows: pd.DataFrame) -> pd.DataFrame:
    """Maximum likelihood of log-normal lengths of which ``at`` are only known to exceed ``bound``, by EM on the
    sums of the others; adds the probability that a value with length ``bound`` is one of the censored."""
    out = []
    for r in rows.itertuples():
        n, c, edge = max(r.n, 1), r.at, math.log(r.bound)
        mean = r.s1 / n
        spread = math.sqrt(max(r.s2 / n - mean * mean, 1e-3))
        for _ in range(60):
            z = (edge - mean) / spread
            tail = max(float(normal_tail(np.array([z]))[0]), 1e-12)
            hazard = math.exp(-z * z / 2) / math.sqrt(2 * math.pi) / tail
            e1 = mean + spread * hazard
            e2 = mean * mean + spread * spread * (1 + z * hazard) + 2 * mean * spread * hazard
            mean_next = (r.s1 + c * e1) / (n + c)
            spread = math.sqrt(max((r.s2 + c * e2) / (n + c) - mean_next * mean_next, 1e-3))
            done = abs(mean_next - mean) < 1e-6
            mean = mean_next
            if done:
                break
        z = (edge - mean) / spread
        beyond = float(normal_tail(np.array([z]))[0])
        density = math.exp(-z * z / 2) / math.sqrt(2 * math.pi) / spread / r.bound
        # Where a limit holds, nothing is longer; what is longer speaks against the limit.
        holds = max(0.0, 1 - r.above / max(beyond * (n + c), 1e-9)) if c else 0.0
        censored = holds * max(beyond, density)
        # One value alone may stand there by chance; then it counts how many of the kind's sources have the limit.
        out.append(min(SURE, max(TRANSFER_RATE, (1.0 if c > 1 else r.shared) * censored / max(censored + density, 1e-300))))
    return rows.assign(posterior=out)


def censoring_posterior(sized: DataFrame, limits: DataFrame) -> DataFrame:
    """(kind, source, unit, bound, posterior) for each source and candidate limit of its kind that any of its values stands at."""
    length = F.when(F.col("unit") == "chars", F.col("chars")).otherwise(F.col("bytes"))
    bounds = limits.select("kind", "unit", "bound")
    few = F.broadcast(bounds) if bounds.limit(BROADCAST_LIMITS + 1).count() <= BROADCAST_LIMITS else bounds
    both = sized.select("kind", "source", "chars", "bytes").join(few, "kind").withColumn("len", length)
    logs = F.when(F.col("len") != F.col("bound"), F.log("len"))
    stats = both.groupBy("kind", "source", "unit", "bound").agg(
        F.count_if(F.col("len") != F.col("bound")).cast("double").alias("n"),
        F.coalesce(F.sum(logs), F.lit(0.0)).alias("s1"),
        F.coalesce(F.sum(logs * logs), F.lit(0.0)).alias("s2"),
        F.count_if(F.col("len") == F.col("bound")).cast("double").alias("at"),
        F.count_if(F.col("len") > F.col("bound") * 1.02).cast("double").alias("above"),
    ).where("at > 0")
    # The share of the sources with any value at the limit that have several there.
    sharing = stats.groupBy("kind", "unit", "bound").agg((F.count_if(F.col("at") > 1) / F.count(F.lit(1))).alias("shared"))
    stats = stats.join(sharing, ["kind", "unit", "bound"]).select("kind", "source", "unit", "bound", "n", "s1", "s2", "at", "above", "shared")
    schema = "kind string, source string, unit string, bound int, n double, s1 double, s2 double, at double, above double, shared double, posterior double"
    fit = stats.mapInPandas(lambda parts: (fit_censored(p) for p in parts), schema)
    return fit.select("kind", "source", "unit", "bound", "posterior")


class EndingModel:
    """How an ending looks when a value is cut: naive Bayes log odds of each feature, per kind, weighed by a
    logistic regression so that features which say the same aren't counted twice."""

    def __init__(self, examples: pd.DataFrame):
        """``examples``: kind, cut (1 or 0), half (True or False) and the features. Odds counted in one half give
        the weights in the other; the final odds are counted in both."""
        self.weights = np.zeros(len(FEATURES) + 1)
        self.count(examples[examples["half"]])
        rest = examples[~examples["half"]]
        if rest["cut"].nunique() == 2:
            x = np.array([self.odds(k, v) for k, *v in zip(rest["kind"], *(rest[f] for f in FEATURES))])
            self.weights = logistic_weights(x, rest["cut"].to_numpy(dtype=float))
        self.count(examples)

    def count(self, examples: pd.DataFrame) -> None:
        self.table: dict[tuple[str, str], dict[str, float]] = {}
        self.unseen: dict[tuple[str, str], float] = {}
        for feature in FEATURES:
            kinds = pd.Series("", index=examples.index) if feature in COMMON else examples["kind"]
            counts = examples.groupby([kinds, examples[feature].fillna("")])["cut"].agg(["sum", "count"])
            for kind, part in counts.groupby(level=0):
                cut, whole = part["sum"], part["count"] - part["sum"]
                cuts, wholes = cut.sum(), whole.sum()
                pooled = (cut + whole + 0.5) / (cuts + wholes + 1)
                own = np.log((cut + SMOOTHING * pooled) / (cuts + SMOOTHING)) - np.log((whole + SMOOTHING * pooled) / (wholes + SMOOTHING))
                # What whole values almost never look like has few counts of its own; taken together they have many.
                rare = whole <= 2
                together = math.log((cut[rare].sum() + 1) / (cuts + 2)) - math.log((whole[rare].sum() + 1) / (wholes + 2))
                odds = own.where(~rare | (own > together), together) if feature not in COMMON else own
                self.table[kind, feature] = dict(zip(part.index.get_level_values(1), odds))
                self.unseen[kind, feature] = together if feature not in COMMON else 0.0

    def odds(self, kind: str, values: list) -> list[float]:
        found = []
        for feature, value in zip(FEATURES, values):
            key = ("" if feature in COMMON else kind, feature)
            odds = self.table.get(key, {}).get(value or "", self.unseen.get(key, 0.0))
            found.append(min(STRONGEST, max(-STRONGEST, float(odds))))
        return found

    def score(self, kind: str, values: list) -> float:
        return float(self.weights[0] + np.dot(self.weights[1:], self.odds(kind, values)))


def logistic_weights(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Intercept and weights of a logistic regression with a penalty of ``ridge`` per row, by Newton steps that are
    halved until the loss falls, so that nearly separable data can't make it diverge."""
    x = np.column_stack([np.ones(len(x)), x])
    penalty = ridge * len(x)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.sum(np.logaddexp(0, z) - y * z) + penalty / 2 * w @ w)

    w = np.concatenate([[0.0], np.full(x.shape[1] - 1, 0.5)])
    now = loss(w)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), x.T @ (y - p) - penalty * w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > now:
            size /= 2
        if size <= 1e-6 or np.abs(size * step).max() < 1e-6:
            break
        w = w + size * step
        now = loss(w)
    return w


def ending_examples(rows: DataFrame) -> DataFrame:
    """The sample in ``described``, whole and cut, with ``cut`` 1 or 0. Values that stand at a candidate limit must be left
    out before, for most of them are cut already."""
    both = F.explode(F.array(F.struct(F.lit(0).alias("is_cut"), F.col("whole").alias("f")), F.struct(F.lit(1).alias("is_cut"), F.col("cut").alias("f")))).alias("e")
    return rows.where("cut is not null").select("kind", "half", both).select("kind", F.col("e.is_cut").alias("cut"), "half", *(F.col(f"e.f.{k}").alias(k) for k in FEATURES))


def fit_endings(examples: DataFrame) -> EndingModel:
    """The model of a bounded sample from ``ending_examples``. Some of the values taken as whole are cut; those that
    one model finds are left out of the next."""
    sample = examples.toPandas()
    model = EndingModel(sample)
    for _ in range(3):
        odds = np.array([model.score(k, v) for k, *v in zip(sample["kind"], *(sample[f] for f in FEATURES))])
        model = EndingModel(sample[(sample["cut"] == 1) | (odds < DOUBTFUL)])
    return model


def ending_odds(model: EndingModel) -> Column:
    @F.pandas_udf("double")
    def odds(kind: pd.Series, *features: pd.Series) -> pd.Series:
        return pd.Series([model.score(k, v) for k, *v in zip(kind, *features)], dtype="float64")

    return odds("kind", *(F.col(f"whole.{f}") for f in FEATURES))


def transfer_rate(odds: DataFrame, begin: float = TRANSFER_RATE) -> float:
    """The share of values that lost their end though they stand at no limit, by maximum likelihood from the ``odds`` of
    their endings: expectation and maximisation, each round one aggregate."""
    rate = begin
    for _ in range(ROUNDS):
        prior = math.log(rate / (1 - rate))
        found = odds.agg(F.avg(1 / (1 + F.exp(-(F.col("odds") + prior))))).first()[0]
        if found is None:
            break
        rate = min(max(found, 1e-4), 0.5)
    return rate


def cut_values(values: DataFrame) -> DataFrame:
    """(table_name, row_id, field, kind, source, odds) of every value of ``text_values``; ``odds`` are the log odds
    that it lost its end. Rows repeated as a whole come out once."""
    total = values.select("table_name", "row_id", "field").count()
    rows = checkpointed(described(values, total))
    limits = checkpointed(candidate_limits(rows))
    edges = checkpointed(censoring_posterior(rows, limits))
    bounds = edges.groupBy("kind", "source").agg(F.collect_list(F.struct("unit", "bound", "posterior")).alias("edges"))
    standing = rows.join(F.broadcast(bounds) if edges.count() <= BROADCAST_LIMITS else bounds, ["kind", "source"], "left")
    reached = F.array_max(
        F.transform(
            F.col("edges"),
            lambda e: F.when(F.when(e["unit"] == "bytes", F.col("bytes").between(e["bound"] - 3, e["bound"] + 2)).otherwise(F.col("chars") == e["bound"]), e["posterior"]),
        )
    )
    standing = standing.withColumn("posterior", reached).drop("edges")
    model = fit_endings(ending_examples(standing.where("posterior is null")))
    scored = checkpointed(standing.select("table_name", "row_id", "field", "kind", "source", "posterior", ending_odds(model).alias("odds")))
    prior = F.coalesce("posterior", F.lit(transfer_rate(scored.where("posterior is null"))))
    return scored.select("table_name", "row_id", "field", "kind", "source", (F.log(prior / (1 - prior)) + F.col("odds")).alias("odds")).distinct()


def cut_rates(cut: DataFrame) -> DataFrame:
    """(table_name, field, source, n_values, n_cut, rate) from the result of ``cut_values``."""
    return cut.groupBy("table_name", "field", "source").agg(F.count(F.lit(1)).alias("n_values"), F.count_if(F.col("odds") > 0).alias("n_cut")).withColumn("rate", F.round(F.col("n_cut") / F.col("n_values"), 6))
