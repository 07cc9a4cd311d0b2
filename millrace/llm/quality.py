"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them. DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import common
from millrace.session import durable

# Fixed value: the blanks between words.
BLANKS = " \t\n\x0b\x0c\r"
_NOT_BLANK = r"[^\x20\x09-\x0D]"
# A word of letters, with an apostrophe or hyphen inside, and one stop or comma behind.
_PLAIN = r"^[\p{L}\p{M}]+(?:['’\-][\p{L}\p{M}]+)*[.,;:!?]?$"
WINDOW_WORDS = 8


def _let(value: Column, then) -> Column:
    """``then`` applied to a value that is computed once, however often ``then`` uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), "")


def _shifted(values: Column, by: int) -> Column:
    return F.slice(values, by + 1, F.greatest(F.size(values) - by, F.lit(0)))


def _pairs(values: Column, by: int) -> Column:
    """Number for each two neighbours at distance ``by``; positions without a neighbour fall away."""
    both = F.zip_with(values, _shifted(values, by), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))
    return F.slice(both, 1, F.greatest(F.size(values) - by, F.lit(0)))


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of eight words found twice or more in the text, first occurrence included.

    Windows are hashed by doubling (1, 2, 4, 8 words). Texts whose windows all differ are done then; else windows are sorted by hash
    with their places, equal neighbours give the repeated places, and the gaps between those give the words covered.
    """
    singles = F.transform(words, lambda w: F.xxhash64(w))
    windows = _let(singles, lambda a: _let(_pairs(a, 1), lambda b: _let(_pairs(b, 2), lambda c: _pairs(c, 4))))

    def covered(hashes):
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s):
            follows = F.zip_with(s, _shifted(s, 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
            return F.array_sort(F.array_distinct(F.flatten(F.filter(follows, lambda x: x.isNotNull()))))

        def count(p):
            gaps = F.zip_with(p, _shifted(p, 1), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW_WORDS)), F.lit(WINDOW_WORDS)))
            return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda n, g: n + g)

        return _let(_let(placed, places), count)

    return _let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(covered(h)))


def measure(documents: DataFrame, raw_text: str = "raw_text", file_id: str = "fileId") -> DataFrame:
    """``id`` and the base measures of every record's whole text, in one projection without a shuffle."""
    rows = common.records(documents, file_id, raw_text).withColumn("text", F.coalesce("text", F.lit("")))
    text = F.col("text")

    def from_words(w):
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("bigint"), lambda n, x: n + F.length(x)).alias("word_chars"),
            F.size(F.array_distinct(w)).cast("bigint").alias("n_distinct_words"),
            F.size(F.filter(w, lambda x: x.rlike(_PLAIN))).cast("bigint").alias("n_plain_words"),
            repeated_words(w).alias("n_repeat_words"),
        )

    def from_lines(lines):
        return F.struct(F.size(lines).cast("bigint").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"))

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(_NOT_BLANK))
    measured = rows.select(
        "id", _let(_words(text), from_words).alias("w"), _let(lines, from_lines).alias("l"), F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"[\p{Lu}]")).cast("bigint").alias("n_capitals"), F.regexp_count(text, F.lit(r"[.!?](?=\s|$)")).cast("bigint").alias("n_stops"),
    )
    return measured.select("id", "w.*", "l.*", "n_symbols", "n_capitals", "n_stops")


@dataclass(frozen=True)
class Rule:
    """Votes 1 (good) where ``good`` holds, else 0 (bad) where ``bad`` holds, else abstains."""

    name: str
    good: str
    bad: str


# Most rules know one side only and abstain on the other.
RULES = (
    Rule("symbols", "false", "n_symbols * 12 > word_chars"),
    Rule("plain_words", "false", "n_plain_words * 2 < n_words"),
    Rule("repeats", "false", "n_repeat_words * 4 > n_words"),
    Rule("lines", "false", "n_dup_lines * 10 > 4 * n_lines"),
    Rule("variety", "n_distinct_words * 3 >= n_words AND n_words >= 20 AND n_dup_lines = 0 AND n_symbols * 50 <= word_chars", "n_distinct_words * 8 < n_words"),
    Rule("sentences", "n_stops * 40 >= n_words AND n_words >= 20 AND n_symbols * 50 <= word_chars AND n_capitals * 5 <= word_chars", "n_stops * 150 < n_words AND n_words >= 50"),
    Rule("prose", "n_plain_words * 10 >= 8 * n_words AND n_words >= 20 AND n_repeat_words * 10 <= n_words", "false"),
    Rule("length", "false", "n_words < 20"),
    Rule("word_size", "false", "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
    Rule("capitals", "false", "n_capitals * 2 > word_chars"),
)


def _votes(rules: Sequence[Rule]) -> list[Column]:
    return [F.when(F.expr(r.good), 1).when(F.expr(r.bad), 0).otherwise(-1).alias(f"vote_{r.name}") for r in rules]


def _evidence(accuracy: float) -> float:
    return math.log(accuracy / (1 - accuracy))


def weigh_rules(patterns: Sequence[tuple[Sequence[int], int]], rules: Sequence[Rule], share: float = 0.5, rounds: int = 100) -> list[float]:
    """Accuracy of each rule (how often its vote is right), by expectation-maximisation.

    ``patterns`` are vote patterns with their counts (at most 3 to the power of the number of rules). The prior ``share`` of good
    records is given, not fitted: fitted, it would drown the rules that speak of few records. Accuracies start at 0.8; each is
    smoothed by ten votes of which eight are right and stays over 0.5, so that good stays good.
    """
    accuracy = [0.8] * len(rules)
    for _ in range(rounds if patterns else 0):
        posterior = []
        for votes, _n in patterns:
            logit = _evidence(share) + sum(_evidence(a) * (1 if v else -1) for a, v in zip(accuracy, votes) if v >= 0)
            posterior.append(1 / (1 + math.exp(-max(-500.0, min(500.0, logit)))))
        before, accuracy = accuracy, []
        for k in range(len(rules)):
            told = [(p if v[k] else 1 - p, n) for p, (v, n) in zip(posterior, patterns) if v[k] >= 0]
            accuracy.append(min(0.99, max(0.51, (8 + sum(p * n for p, n in told)) / (10 + sum(n for _, n in told)))))
        if max(abs(a - b) for a, b in zip(before, accuracy)) < 1e-9:
            break
    return accuracy


def judge_quality(
    documents: DataFrame, raw_text: str = "raw_text", file_id: str = "fileId", rules: Sequence[Rule] = RULES, share: float = 0.5, least_posterior: float = 0.5,
) -> DataFrame:
    """Quality of every document record from rules that vote good or bad or abstain.

    The accuracies of the rules are estimated without labels by expectation-maximisation over the counts of all vote patterns (one
    grouped aggregation, at most 3 to the power of the number of rules rows), and each record gets the posterior probability of
    being good, from the prior ``share`` of good ones. ``base_failed`` holds for fewer than 20 words, or more than 30 % of the words in eight-word windows that repeat in
    the text. ``kept`` is false for those, else it is whether the posterior is at least ``least_posterior``.

    Words are runs without ASCII white space. Returns ``id``, the measures, ``vote_*``, ``base_failed``, ``posterior`` and ``kept``.
    NULL and empty texts have no words and fail. NULL ids and repeated rows get a row each; an empty table gives an empty result.
    """
    measured = measure(documents, raw_text, file_id)
    failed = F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")
    voted = durable(measured.select("*", *_votes(rules), failed.alias("base_failed")))
    names = [f"vote_{r.name}" for r in rules]
    patterns = [(tuple(r[n] for n in names), r["n"]) for r in voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).orderBy(*names).collect()]
    accuracy = weigh_rules(patterns, rules, share)
    logit = F.lit(_evidence(share))
    for a, name in zip(accuracy, names):
        logit = logit + F.when(F.col(name) == 1, _evidence(a)).when(F.col(name) == 0, -_evidence(a)).otherwise(0.0)
    posterior = 1.0 / (1.0 + F.exp(-logit))
    return voted.withColumn("posterior", posterior).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least_posterior))
