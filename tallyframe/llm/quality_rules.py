"""Quality rules as weak supervision: rules vote or abstain, EM weighs them.

Every rule looks at counts of one text and votes good (1), bad (-1) or abstains
(0). Expectation-maximisation over the votes of all documents estimates the
accuracy of each rule and the share of good documents; a document's posterior
probability of being good decides, instead of all rules having to pass.

Only DataFrame and SQL functions touch the rows. EM itself runs on the table of
distinct vote patterns, which has at most 3 ** len(RULES) rows however large the
input is.

Defined results: null and empty texts have no words and fail the base rule;
repeated rows are judged one by one; other columns of the input pass through
under their own names; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.session import materialize

BLANKS = " \t\n\x0b\x0c\r"
_BLANK_RUN = r"[\x20\x09-\x0D]+"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
EM_ROUNDS = 50

#: Rule name -> (vote good when, vote bad when); abstains otherwise. A rule that
#: looks for one defect abstains where it finds none: that says little of the rest.
RULES: dict[str, tuple[str, str]] = {
    "length": ("n_words >= 30", f"n_words < {MIN_WORDS}"),
    "word_length": ("word_chars between 2 * n_words and 12 * n_words", "word_chars > 20 * n_words"),
    "lines": ("false", "2 * n_dup_lines > n_lines"),
    "symbols": ("false", "10 * n_symbols > n_words"),
    "shouting": ("false", "100 * n_capitals > 40 * word_chars or 5 * n_marks > n_words"),
    "repeats": ("false", f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"),
}


COUNTS = ("n_words", "word_chars", "n_symbols", "n_capitals", "n_marks", "n_lines", "n_dup_lines", "n_repeat_words")
ADDED = (*COUNTS, "base_failed", "posterior", "kept")


@dataclass(frozen=True)
class VoteModel:
    """Share of good documents and, by rule, how often each class gets each vote.

    ``good[j]`` and ``bad[j]`` are (P(vote bad), P(abstain), P(vote good)).
    """
    prior: float
    good: tuple[tuple[float, float, float], ...]
    bad: tuple[tuple[float, float, float], ...]

    def weight(self, rule: int, vote: int) -> float:
        """Log-odds of being good that one vote, or abstaining (0), adds."""
        return math.log(self.good[rule][vote + 1] / self.bad[rule][vote + 1])

    def log_odds(self, votes: list[Column]) -> Column:
        total = F.lit(math.log(self.prior / (1 - self.prior)))
        for j, vote in enumerate(votes):
            total = total + F.when(vote > 0, F.lit(self.weight(j, 1))).when(
                vote < 0, F.lit(self.weight(j, -1))).otherwise(F.lit(self.weight(j, 0)))
        return total


#: Rules are written to speak against at most one good text in so many.
GOOD_TEXTS_PER_FALSE_VOTE = 200

#: Where EM starts: a rule rarely speaks against a good text and often misses a bad one.
START_PRIOR, START_GOOD, START_BAD = 0.85, (0.002, 0.098, 0.9), (0.3, 0.1, 0.6)


def _repeat_words() -> Column:
    """Words inside windows that occur twice or more, from the window hashes ``_grams``."""
    ordered = ("sort_array(transform(_grams, (g, i) -> struct(g as g, i as i)))")
    return F.expr(f"""
        CASE WHEN size(array_distinct(_grams)) = size(_grams) THEN 0L ELSE
          aggregate(
            sort_array(flatten(transform(array({ordered}), s ->
              filter(transform(s, (x, k) ->
                IF(get(s, k - 1).g = x.g OR get(s, k + 1).g = x.g, x.i, CAST(NULL AS INT))),
                p -> p IS NOT NULL)))),
            struct(-{WINDOW} AS last, 0L AS total),
            (a, p) -> struct(p AS last, a.total + least({WINDOW}, p - a.last) AS total),
            a -> a.total)
        END""")


def text_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the counts the rules look at; no shuffle, one pass over each text."""
    keep = [F.col(f"`{c}`") for c in docs.columns]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    trimmed = F.btrim(text, F.lit(BLANKS))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    first = docs.select(
        *keep,
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _BLANK_RUN)).alias("_words"),
        lines.alias("_lines"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.regexp_count(text, F.lit("!")).cast("long").alias("n_marks"))
    second = first.select(
        *keep, "n_symbols", "n_capitals", "n_marks",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"))
    third = second.withColumn("_grams", F.expr(f"""
        IF(size(_hashes) < {WINDOW}, CAST(array() AS array<bigint>),
           transform(sequence(0, size(_hashes) - {WINDOW}),
                     i -> xxhash64({', '.join(f'_hashes[i + {j}]' for j in range(WINDOW))})))"""))
    return third.withColumn("n_repeat_words", _repeat_words().cast("long")).drop("_hashes", "_grams")


def rule_votes() -> list[Column]:
    return [F.expr(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END") for good, bad in RULES.values()]


def fit_votes(patterns: list[tuple[tuple[int, ...], int]], n_rules: int) -> VoteModel:
    """EM over (votes, documents) pairs.

    One start document per rule and class keeps every share above zero. Two
    limits keep the classes named: no rule speaks against more good texts than
    ``GOOD_TEXTS_PER_FALSE_VOTE`` allows, and voting good or abstaining never
    counts against a text. So a text no rule speaks against is kept.
    """
    model = VoteModel(START_PRIOR, (START_GOOD,) * n_rules, (START_BAD,) * n_rules)
    total = sum(n for _, n in patterns)
    for _ in range(EM_ROUNDS if total else 0):
        good_n, good, bad = 0.0, [list(START_GOOD) for _ in range(n_rules)], [list(START_BAD) for _ in range(n_rules)]
        for votes, n in patterns:
            odds = math.log(model.prior / (1 - model.prior)) + sum(
                model.weight(j, v) for j, v in enumerate(votes))
            p = 1 / (1 + math.exp(-max(-60.0, min(60.0, odds))))
            good_n += p * n
            for j, v in enumerate(votes):
                good[j][v + 1] += p * n
                bad[j][v + 1] += (1 - p) * n
        for j in range(n_rules):
            good[j] = [x / sum(good[j]) for x in good[j]]
            bad[j] = [x / sum(bad[j]) for x in bad[j]]
            good[j][0] = min(good[j][0], 1 / GOOD_TEXTS_PER_FALSE_VOTE)
            bad[j][0] = max(bad[j][0], good[j][0])
            bad[j][1], bad[j][2] = min(bad[j][1], good[j][1]), min(bad[j][2], good[j][2])
        model = VoteModel(min(max(good_n / total, 0.05), 0.99), tuple(map(tuple, good)), tuple(map(tuple, bad)))
    return model


def quality_rules(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Adds the counts, ``base_failed``, ``posterior`` and ``kept`` to each document.

    The counted table is written once to the shared folder, so the texts are
    read and split a single time; it holds the columns ``carry`` (all of the
    input's unless given). Input columns that clash with an added name are
    replaced.
    """
    working = ("_words", "_lines", "_hashes", "_grams")
    kept = [c for c in docs.columns if c == text_col or c not in (*ADDED, *working)]
    counted = text_counts(docs.select(*[F.col(f"`{c}`") for c in kept]), text_col)
    carried = [c for c in kept if carry is None or c in carry]
    return judge(materialize(counted.select(*[F.col(f"`{c}`") for c in (*carried, *COUNTS)]), "quality-counts"))


def fit(counted: DataFrame) -> VoteModel:
    """The vote model of a counted table, from the number of documents per vote pattern."""
    names = [f"v{i}" for i in range(len(RULES))]
    rows = (counted.select(*[v.alias(n) for v, n in zip(rule_votes(), names)])
            .groupBy(*names).agg(F.count("*").alias("n")).collect())
    return fit_votes(sorted((tuple(r[n] for n in names), r["n"]) for r in rows), len(names))


def judge(counted: DataFrame, model: VoteModel | None = None) -> DataFrame:
    """Adds the verdicts to a counted table; the model is fitted to it unless given."""
    model = model or fit(counted)
    failed = F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words")
    return (counted.withColumn("base_failed", failed)
            .withColumn("posterior", 1 / (1 + F.exp(-model.log_odds(rule_votes()))))
            .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5)))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that are kept, all their columns as they were.

    Texts are counted once: documents and counts go to the shared folder, where the
    model is fitted to the counts and applied to them.
    """
    whole = docs.select(F.struct("*").alias("_doc"), F.col(f"`{text_col}`").alias("_text"))  # no column can clash
    counted = materialize(text_counts(whole, "_text").drop("_text"), "quality-counts", "zstd")
    return judge(counted).where("kept").select("_doc.*")
