"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes good (1), bad (0) or abstains (-1) on a document. Vote patterns are counted over the whole
corpus (at most 3^rules rows), and expectation-maximisation over these counts estimates the share of good
documents and, per rule, how often it votes each way on good and on bad documents. The posterior
probability of being good replaces an all-must-pass filter.

Defined results: a null or empty text has no words, fails the base rule and is not kept; a rule that never
votes has no influence; an empty table gives no rows; repeated rows are counted as often as they occur;
other columns are ignored, so clashing names do no harm.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.runtime import materialise, small_table

SPACES = " \t\n\x0b\f\r"
_SPACE_RUN = r"[\x20\x09-\x0D]+"
WINDOW = 8
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bars", "n_stops")
ROUNDS = 25


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, good where ``good`` holds, else abstains. SQL over the features."""

    name: str
    bad: str
    good: str


#: Starting belief: a rule is right in this share of its votes.
PRIOR_ACCURACY = 0.85
PRIOR_GOOD = 0.8
#: Votes that the starting belief weighs in each round, against being led astray by rare patterns.
PRIOR_WEIGHT = 20.0

#: Faults are evidence only where they are found, so those rules abstain otherwise; two rules speak for a text.
RULES = (
    Rule("symbols", "n_symbols > 0.05 * word_chars", "false"),
    Rule("shouting", "n_upper > 0.3 * word_chars", "false"),
    Rule("repeated_words", "n_repeat_words > 0.3 * n_words", "false"),
    Rule("repeated_lines", "n_dup_lines > 0.3 * n_lines", "false"),
    Rule("tables", "n_bars > 0.1 * n_words", "false"),
    Rule("word_length", "word_chars < 2.5 * n_words or word_chars > 12 * n_words", "false"),
    Rule("size", "n_words < 20", "n_words >= 50"),
    Rule("prose", "n_words >= 100 and n_stops < 0.005 * n_words", "n_stops between 0.02 * n_words and 0.5 * n_words and n_symbols <= 0.01 * word_chars and n_upper <= 0.15 * word_chars"),
)


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order; none for a null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPACE_RUN, -1))


def _only(text: Column, characters: str) -> Column:
    """How many characters of the class the text has."""
    return F.length(F.regexp_replace(text, f"[^{characters}]+", "")).cast("long")


def _with_window_hashes(rows: DataFrame) -> DataFrame:
    """Adds ``_hashes``, one for each window of eight words of ``_words``, by doubling.

    Each step is a column of its own, so that it is computed once; nulls from the ragged end are cut off.
    """
    rows = rows.withColumn("_h1", F.when(F.size("_words") >= WINDOW, F.transform("_words", lambda w: F.xxhash64(w))))
    for have in (1, 2, 4):
        last = F.col(f"_h{have}")
        both = F.zip_with(last, F.slice(last, F.lit(have + 1), F.size(last)), lambda x, y: F.xxhash64(x, y))
        rows = rows.withColumn(f"_h{2 * have}", both)
    return rows.withColumn("_hashes", F.slice("_h8", F.lit(1), F.size("_h8") - (WINDOW - 1)))


def covered(starts: Column) -> Column:
    """Positions covered by windows at the ascending ``starts``."""
    state = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).cast("long").alias("last"))
    step = lambda s, p: F.struct((s["n"] + F.least(F.lit(WINDOW).cast("long"), p - s["last"])).alias("n"), p.alias("last"))
    return F.aggregate(starts, state, step, lambda s: s["n"])


def _with_repeated_words(rows: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words``: words in eight-word windows found twice or more.

    Only a text in which a hash recurs has its windows sorted and compared word by word.
    """
    at = F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1))
    windows = F.transform(at, lambda i: F.struct(F.slice("_words", i, WINDOW).alias("w"), i.cast("long").alias("i")))
    recurs = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    rows = rows.withColumn("_order", F.when(recurs, F.sort_array(windows)))
    later = F.slice("_order", F.lit(2), F.size("_order"))
    equal = F.zip_with("_order", later, lambda x, y: F.when(x["w"] == y["w"], F.array(x["i"], y["i"])))
    starts = F.sort_array(F.array_distinct(F.flatten(F.filter(equal, lambda x: x.isNotNull()))))
    return rows.withColumn("n_repeat_words", F.coalesce(covered(starts), F.lit(0).cast("long")))


def features(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Whole-text counts of each document."""
    rows = documents.select(*[F.col(c) for c in keep], F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    rows = rows.select(*keep, "_text", words_of(F.col("_text")).alias("_words"))
    size = F.size("_words")
    rows = _with_repeated_words(_with_window_hashes(rows))
    joined = F.array_join("_words", "")
    lines = F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        *keep,
        size.cast("long").alias("n_words"),
        F.length(joined).cast("long").alias("word_chars"),
        _only(F.col("_text"), r"#*$%&|<>").alias("n_symbols"),
        "n_repeat_words",
        lines.alias("_lines"),
        _only(F.col("_text"), r"\p{Lu}").alias("n_upper"),
        _only(F.col("_text"), r"|").alias("n_bars"),
        _only(F.col("_text"), r".!?").alias("n_stops"),
    )
    return rows.select(
        *keep,
        *[c for c in rows.columns if c not in keep and c != "_lines"],
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
    )


def votes(rules: tuple[Rule, ...] = RULES) -> list[Column]:
    return [F.when(F.expr(r.bad), F.lit(0)).when(F.expr(r.good), F.lit(1)).otherwise(F.lit(-1)).alias(f"vote_{r.name}") for r in rules]


@dataclass(frozen=True)
class Model:
    """Share of good documents; per rule and class the probabilities of voting bad, good and nothing."""

    good: float
    chances: dict[str, dict[int, tuple[float, float, float]]]


def _start(rules: tuple[Rule, ...]) -> Model:
    a = PRIOR_ACCURACY
    only_bad = {1: ((1 - a) * 0.1, 0.001, 0.999 - (1 - a) * 0.1), 0: (a * 0.3, 0.001, 0.999 - a * 0.3)}
    both = {1: ((1 - a) * 0.7, a * 0.7, 0.3), 0: (a * 0.4, (1 - a) * 0.4, 0.6)}
    return Model(PRIOR_GOOD, {r.name: only_bad if r.good == "false" else both for r in rules})


def posterior(model: Model, rules: tuple[Rule, ...] = RULES) -> Column:
    """Probability of being good, from the log-odds that the votes add up to."""
    odds = F.lit(math.log(model.good / (1 - model.good)))
    for r in rules:
        good, bad = model.chances[r.name][1], model.chances[r.name][0]
        weight = [math.log(g / b) for g, b in zip(good, bad)]
        vote = F.col(f"vote_{r.name}")
        odds = odds + F.when(vote == 0, F.lit(weight[0])).when(vote == 1, F.lit(weight[1])).otherwise(F.lit(weight[2]))
    return 1 / (1 + F.exp(-odds))


def fit(patterns: DataFrame, rules: tuple[Rule, ...] = RULES, rounds: int = ROUNDS) -> Model:
    """Expectation-maximisation over counted vote patterns (columns vote_*, n).

    Each round is one aggregation to a single row; only the model's numbers pass through the driver.
    """
    model, first = _start(rules), _start(rules)
    for _ in range(rounds):
        good = posterior(model, rules) * F.col("n")
        bad = F.col("n") - good
        sums = [F.sum(good).alias("good"), F.sum("n").alias("all")]
        for r in rules:
            for vote in (0, 1, -1):
                hit = F.col(f"vote_{r.name}") == vote
                sums += [F.sum(F.when(hit, good).otherwise(0.0)).alias(f"{r.name}_{vote}_1"), F.sum(F.when(hit, bad).otherwise(0.0)).alias(f"{r.name}_{vote}_0")]
        got = patterns.agg(*sums).first()
        if not got["all"]:
            return model
        weight = PRIOR_WEIGHT
        share = (got["good"] + weight * PRIOR_GOOD) / (got["all"] + weight)
        chances = {}
        for r in rules:
            chances[r.name] = {}
            for side, total in ((1, got["good"]), (0, got["all"] - got["good"])):
                prior = first.chances[r.name][side]
                chances[r.name][side] = tuple((got[f"{r.name}_{vote}_{side}"] + weight * p) / (total + weight) for vote, p in zip((0, 1, -1), prior))
        moved = abs(share - model.good)
        model = Model(share, chances)
        if moved < 1e-7:
            break
    return model


def judge(documents: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("doc_id",), text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Features, votes, ``probability`` of good quality, ``base_failed`` and ``kept`` of each document.

    ``kept`` is false where the hard base rule fails (under 20 words, or over 30 % of the words repeated),
    else whether the posterior reaches ``threshold``.
    """
    rows = features(documents, keep, text)
    voted = materialise(rows.select(*keep, *FEATURES, *votes(rules)))
    names = [f"vote_{r.name}" for r in rules]
    patterns = materialise(voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")))
    model = fit(patterns, rules)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return voted.select(
        *keep,
        *FEATURES,
        failed.alias("base_failed"),
        (~failed & (posterior(model, rules) >= threshold)).alias("kept"),
        posterior(model, rules).alias("probability"),
        *names,
    )


def accuracies(model: Model, rules: tuple[Rule, ...] = RULES, spark=None) -> DataFrame:
    """Per rule the estimated share of right votes among all its votes."""
    rows = []
    for r in rules:
        g, b = model.chances[r.name][1], model.chances[r.name][0]
        right = model.good * g[1] + (1 - model.good) * b[0]
        cast = model.good * (g[0] + g[1]) + (1 - model.good) * (b[0] + b[1])
        rows.append((r.name, right / cast if cast else 0.0))
    return small_table(spark, rows, "rule string, accuracy double")
