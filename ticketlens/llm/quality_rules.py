"""Quality by weak supervision: rules vote or abstain, their accuracies are learned without labels.

Every rule looks at a few measures of a text and votes good, bad, or not at all. Documents are
counted per pattern of votes (at most 3 ** rules patterns, whatever the corpus), and
expectation-maximisation over the patterns estimates the share of good documents and, per rule,
how often it votes each way on good and on bad ones. A document's posterior probability of being
good then replaces the conjunction of all rules. A rule's accuracies are smoothed with
pseudo-counts (a share of the corpus) around what is known of such rules beforehand,
which also keeps the two classes from changing places; on good documents they are also bounded from below.

All measures are column expressions over the whole text; a document is one row throughout, so no
text is exploded or shuffled. Repeated eight-word windows are found per row: windows are hashed,
the hashes sorted, and only a text that has two equal ones goes on to mark the words they cover.

Defined results: null text has no words and fails the base rules; texts shorter than a rule's
minimum make it abstain; equal texts have equal results; an empty table gives no rows. Other
columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import text_of
from ticketlens.operators.staging import stage

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
#: Percent of the words that may lie in repeated windows.
MAX_REPEATED = 30
THRESHOLD = 0.5
ROUNDS = 25
#: Before any data: most documents are good; rules seldom vote bad on those, and on bad ones about
#: three times in ten, as a text can be bad in one way and fine in all others.
PRIOR_GOOD, PRIOR_RIGHT_GOOD, PRIOR_RIGHT_BAD = 0.8, 0.995, 0.3
#: Whatever the data, a rule is taken to be right at least so often on good documents: two kinds
#: of bad texts are as frequent as each other, and without the bound one of them could count as
#: what good texts look like.
LEAST_RIGHT_GOOD = 0.995
#: Pseudo-documents behind those two numbers, as a share of all documents.
SMOOTHING = 0.01
#: Learning ends when no number moves by more.
TOLERANCE = 1e-5

GOOD, ABSTAIN, BAD = 1, 0, -1


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, good where ``good`` holds, and abstains otherwise."""

    name: str
    bad: str
    good: str


#: Conditions over the measures. A text that is bad in one way is mostly fine in the others, and
#: each good vote it gets there speaks for it; so there are few rules, and good votes are narrow.
RULES = (
    Rule(
        "shape",
        "n_words < 20 or word_chars < 2 * n_words or word_chars > 12 * n_words",
        "n_words >= 100 and word_chars between 3 * n_words and 10 * n_words",
    ),
    Rule(
        "symbols",
        "n_words >= 10 and 10 * n_symbols > 3 * n_words",
        "n_words >= 20 and 100 * n_symbols <= n_words",
    ),
    Rule(
        "repetition",
        "100 * n_repeat_words > 30 * n_words or (n_dup_lines >= 3 and 10 * n_dup_lines > 3 * n_lines)"
        " or (n_words >= 50 and 10 * n_distinct < n_words and n_distinct < 200)",
        "n_words >= 50 and n_repeat_words = 0 and n_dup_lines = 0",
    ),
    Rule(
        "sentences",
        "n_words >= 100 and 200 * n_stops < n_words",
        "n_words >= 20 and 60 * n_stops >= n_words",
    ),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def _hashed_windows(hashes: Column) -> Column:
    none = F.array().cast("array<bigint>")
    ends = F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1))
    built = F.transform(ends, lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))
    return F.when(F.size(hashes) >= WINDOW, built).otherwise(none)


def _repeated_places(windows: Column) -> Column:
    """Where the windows that occur more than once start, in text order."""

    def places(pairs: Column) -> Column:
        def place(pair: Column, k: Column) -> Column:
            before, after = F.get(pairs, k - 1)["h"], F.get(pairs, k + 1)["h"]
            return F.when((before == pair["h"]) | (after == pair["h"]), pair["i"])

        return F.sort_array(F.filter(F.transform(pairs, place), lambda i: i.isNotNull()))

    pairs = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.when(
        F.size(F.array_distinct(windows)) < F.size(windows), _let(F.sort_array(pairs), places)
    ).otherwise(F.array().cast("array<int>"))


def _covered(places: Column) -> Column:
    """Words that lie in a window that starts at one of the places."""
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))

    def step(acc: Column, p: Column) -> Column:
        new = F.least(F.lit(WINDOW), p - acc["last"])
        return F.struct((acc["n"] + new).alias("n"), p.alias("last"))

    return F.aggregate(places, start, step, lambda acc: acc["n"].cast("bigint"))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the measures of every row."""
    text = text_of(F.col(text_col))
    # Splitting leaves an empty string at either end where the text has white space there.
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))

    def of_words(ws: Column) -> Column:
        def of_hashes(hs: Column) -> Column:
            return F.struct(
                F.size(F.array_distinct(hs)).cast("bigint").alias("n_distinct"),
                _let(_hashed_windows(hs), lambda w: _covered(_repeated_places(w))).alias("n_repeat_words"),
            )

        chars = F.aggregate(ws, F.lit(0).cast("bigint"), lambda n, w: n + F.char_length(w))
        return F.struct(
            F.size(ws).cast("bigint").alias("n_words"),
            chars.alias("word_chars"),
            _let(F.transform(ws, lambda w: F.xxhash64(w)), of_hashes).alias("repeats"),
        )

    def of_lines(ls: Column) -> Column:
        return F.struct(
            F.size(ls).cast("bigint").alias("n_lines"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("bigint").alias("n_dup_lines"),
        )

    return docs.select(
        F.col(id_col).alias("doc_id"),
        _let(words, of_words).alias("w"),
        _let(lines, of_lines).alias("l"),
        F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("bigint").alias("n_symbols"),
        F.regexp_count(text, F.lit("[.!?]")).cast("bigint").alias("n_stops"),
    ).select(
        "doc_id",
        "w.n_words",
        "w.word_chars",
        "n_symbols",
        "l.n_dup_lines",
        "w.repeats.n_repeat_words",
        "l.n_lines",
        "w.repeats.n_distinct",
        "n_stops",
    )


def votes(measured: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add one column per rule: 1 good, -1 bad, 0 abstains. Bad comes first if both hold."""
    return measured.withColumns(
        {
            f"vote_{r.name}": F.when(F.expr(r.bad), BAD).when(F.expr(r.good), GOOD).otherwise(ABSTAIN)
            for r in rules
        }
    )


@dataclass(frozen=True)
class Accuracies:
    """Share of good documents; per rule P(votes good | good, votes) and P(votes bad | bad, votes)."""

    good: float
    right_good: tuple[float, ...]
    right_bad: tuple[float, ...]

    def posterior(self, rules: Sequence[Rule]) -> Column:
        odds = F.lit(math.log(self.good / (1 - self.good)))
        for r, g, b in zip(rules, self.right_good, self.right_bad, strict=True):
            vote = F.col(f"vote_{r.name}")
            odds = odds + F.when(vote == GOOD, math.log(g / (1 - b))).when(
                vote == BAD, math.log((1 - g) / b)
            ).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def learn(voted: DataFrame, rules: Sequence[Rule] = RULES, rounds: int = ROUNDS) -> Accuracies:
    """Expectation-maximisation over the patterns of votes."""
    names = [f"vote_{r.name}" for r in rules]
    patterns = stage(voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")), "vote_patterns")
    now = Accuracies(
        PRIOR_GOOD, (PRIOR_RIGHT_GOOD,) * len(rules), (PRIOR_RIGHT_BAD,) * len(rules)
    )
    for _ in range(rounds):
        weighed = patterns.withColumn("g", now.posterior(rules) * F.col("n")).withColumn(
            "b", F.col("n") - F.col("g")
        )
        sums = [F.sum("n").alias("n"), F.sum("g").alias("g")]
        for i, name in enumerate(names):
            vote = F.col(name)
            for cls, own in (("g", GOOD), ("b", BAD)):
                sums.append(F.sum(F.when(vote == own, F.col(cls)).otherwise(0.0)).alias(f"{cls}r{i}"))
                sums.append(F.sum(F.when(vote != ABSTAIN, F.col(cls)).otherwise(0.0)).alias(f"{cls}v{i}"))
        row = weighed.agg(*sums).first()
        if not row["n"]:
            break
        extra = SMOOTHING * row["n"]

        def right(cls: str, prior: float, row=row, extra=extra) -> tuple[float, ...]:
            return tuple(
                (row[f"{cls}r{i}"] + extra * prior) / (row[f"{cls}v{i}"] + extra)
                for i in range(len(names))
            )

        good = (row["g"] + extra * PRIOR_GOOD) / (row["n"] + extra)
        sure = tuple(max(LEAST_RIGHT_GOOD, x) for x in right("g", PRIOR_RIGHT_GOOD))
        new = Accuracies(good, sure, right("b", PRIOR_RIGHT_BAD))
        moved = max(
            abs(x - y)
            for x, y in zip(
                (new.good, *new.right_good, *new.right_bad), (now.good, *now.right_good, *now.right_bad), strict=True
            )
        )
        now = new
        if moved < TOLERANCE:
            break
    return now


def judge(
    docs: DataFrame,
    rules: Sequence[Rule] = RULES,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Measures, base_failed, p_good (the posterior) and kept of every row."""
    # Written, because learning and judging both read the measures.
    voted = stage(votes(measures(docs, id_col, text_col), rules), "quality_votes")
    learned = learn(voted, rules)
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")
    )
    p_good = learned.posterior(rules)
    return voted.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (p_good >= threshold)).alias("kept"),
        F.round(p_good, 6).alias("p_good"),
    )
