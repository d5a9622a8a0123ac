"""Quality rules by weak supervision.

Each rule looks at a few counts of a text and votes for it (1), against it
(-1) or abstains (0).  Expectation-maximisation over all rows estimates, without
labels, how common good texts are and each rule's two accuracies: how often
its vote on a good text is for it, and its vote on a bad text against it (a
rule that votes for nearly everything says little by that).  A text is kept
by its posterior probability of being good, not by passing every rule.

Only DataFrame functions are used.  The counts of a text come from its own
arrays, so nothing as long as the texts is shuffled.  The estimation reads
the number of rows of each combination of votes: at most three to the number
of rules, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetframe.llm.common import col, without, written

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = "[#*$%&|<>]"
NO_LETTER = r"[\x21-\x40\x5B-\x60\x7B-\x7E]"  # ASCII digits and punctuation
WINDOW = 3
# Frequent words of the languages at hand.
COMMON = ("the of and to in is that der die und zu le la et de les que el y en los").split()

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
COUNTS = (*BASE, "n_lines", "n_common", "n_other")
LEAST_WORDS, MOST_REPEATED = 50, 50  # of the base test: words, percent

TURNS = 12  # of expectation-maximisation
# A rule's accuracies on good and on bad texts before any vote is seen, and the votes that belief counts for.
START_GOOD, START_BAD, WEIGHT = 0.95, 0.5, 10.0
LOW, HIGH = 0.01, 0.99  # bounds of an accuracy
LEAST_GOOD, MOST_GOOD = 0.5, 0.95  # bounds of the share of good texts
CUT = 0.5


def _c(name: str) -> Column:
    return F.col(name)


@dataclass(frozen=True)
class Rule:
    """Votes 1 where ``good`` holds, -1 where ``bad`` does, else 0 (``bad``
    wins where both do; a null condition does not hold)."""

    name: str
    good: Column
    bad: Column

    def vote(self) -> Column:
        no, yes = F.coalesce(self.bad, F.lit(False)), F.coalesce(self.good, F.lit(False))
        return F.when(no, -1).when(yes, 1).otherwise(0)


def default_rules() -> list[Rule]:
    """Rules on the columns ``COUNTS``, compared as whole numbers."""
    n = _c("n_words")
    return [
        Rule("size", n >= 100, n < LEAST_WORDS),
        Rule("word_length", _c("word_chars").between(3 * n, 7 * n), ~_c("word_chars").between(2 * n, 10 * n)),
        Rule("symbols", 100 * _c("n_symbols") <= n, 10 * _c("n_symbols") > n),
        Rule("lines", _c("n_dup_lines") == 0, 10 * _c("n_dup_lines") > 3 * _c("n_lines")),
        Rule("repeats", 10 * _c("n_repeat_words") <= n, 2 * _c("n_repeat_words") > n),
        Rule("common", _c("n_common") >= 2, _c("n_common") == 0),
        Rule("letters", 100 * _c("n_other") <= 15 * _c("word_chars"), 4 * _c("n_other") > _c("word_chars")),
    ]


def _repeated_words(words: Column, n: Column) -> list[tuple[str, Column]]:
    """The steps that count the words in windows of three that a text holds
    twice or more.  Sorted by the windows' 64-bit hashes, equal windows are
    neighbours; the words they cover are counted over their sorted places."""
    hashed = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.struct(
        F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]).alias("h"), i.alias("i")))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    windows = F.sort_array(F.when(n >= WINDOW, hashed).otherwise(none))
    s = F.col("_ff_windows")

    def doubled(x: Column, j: Column) -> Column:
        return (F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))

    places = F.sort_array(F.transform(F.filter(s, doubled), lambda x: x["i"]))
    covered = F.aggregate(
        places, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")), lambda a: a["n"])
    return [("_ff_windows", windows), ("n_repeat_words", covered)]


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts of each whole text (longs): ``n_words`` (runs of
    anything but space and ASCII controls 9 to 13), ``word_chars`` (their
    code points), ``n_symbols``, ``n_dup_lines`` (lines with a word equal to an
    earlier line), ``n_repeat_words``, ``n_lines`` (lines with a word),
    ``n_common`` (different frequent words), ``n_other`` (digits and ASCII
    punctuation).

    Null texts count as empty ones.  Rows that repeat are counted each, ids
    are not read, and the columns replace input columns of their names.
    """
    t = F.col("_ff_text")
    rows = without(docs, *COUNTS).withColumn("_ff_text", F.coalesce(col(text), F.lit("")))
    rows = (rows.withColumn("_ff_words", F.regexp_extract_all(t, F.lit(WORD), F.lit(0)))
            .withColumn("_ff_lines", F.filter(F.split(t, "\n", -1), lambda x: F.rlike(x, F.lit(WORD))))
            .withColumn("_ff_n", F.size("_ff_words")))
    for name, value in _repeated_words(F.col("_ff_words"), F.col("_ff_n")):
        rows = rows.withColumn(name, value)
    counts = {
        "n_words": F.col("_ff_n"), "word_chars": F.length(F.concat_ws("", F.col("_ff_words"))),
        "n_symbols": F.regexp_count(t, F.lit(SYMBOL)),
        "n_dup_lines": F.size("_ff_lines") - F.size(F.array_distinct("_ff_lines")),
        "n_repeat_words": F.col("n_repeat_words"), "n_lines": F.size("_ff_lines"),
        "n_common": F.size(F.array_intersect("_ff_words", F.array(*map(F.lit, COMMON)))),
        "n_other": F.regexp_count(t, F.lit(NO_LETTER)),
    }
    kept = [col(c) for c in rows.columns if not c.startswith("_ff_") and c not in counts]
    return rows.select(*kept, *[v.cast("bigint").alias(k) for k, v in counts.items()])


def base_failed(n_words: str = "n_words", n_repeat_words: str = "n_repeat_words") -> Column:
    """Texts that no vote can save: too few words, or over half of them in
    repeated windows."""
    n = F.col(n_words)
    return (n < LEAST_WORDS) | (100 * F.col(n_repeat_words) > MOST_REPEATED * n)


@dataclass(frozen=True)
class Model:
    """The share of good texts; for each rule, how often its votes on good
    texts are for them and its votes on bad texts against them."""

    prior: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]

    def posterior(self, votes: Sequence[Column]) -> Column:
        """The probability that a text with these votes is good."""
        s = F.lit(math.log(self.prior / (1 - self.prior)))
        for v, g, b in zip(votes, self.on_good, self.on_bad, strict=True):
            s = s + F.when(v == 1, math.log(g / (1 - b))).when(v == -1, math.log((1 - g) / b)).otherwise(0.0)
        return 1 / (1 + F.exp(-s))


def _clipped(x: float, low: float, high: float) -> float:
    return min(high, max(low, x))


def fit(voted: DataFrame, votes: Sequence[str], turns: int = TURNS) -> Model:
    """Expectation-maximisation over the rows of ``voted`` by their vote columns
    (null: abstains).  Each turn sums the posteriors of the combinations of
    votes; what reaches the driver is one row of four numbers a rule.  A rule
    that never votes, and a table without rows, keep the start values."""
    names = [f"v{i}" for i in range(len(votes))]
    cells = [F.coalesce(col(c), F.lit(0)).cast("int").alias(v) for c, v in zip(votes, names, strict=True)]
    seen = written(voted.select(*cells).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
                   .coalesce(1).sortWithinPartitions(*names))
    v = [F.col(x) for x in names]
    model = Model(0.5, (START_GOOD,) * len(votes), (START_BAD,) * len(votes))
    for _ in range(turns):
        good, bad = F.col("good"), F.col("n") - F.col("good")
        sums = [F.sum(F.when(hit, w).otherwise(0.0)) for x in v
                for w, hit in ((good, x == 1), (good, x != 0), (bad, x == -1), (bad, x != 0))]
        total, mass, *s = (seen.withColumn("good", F.col("n") * model.posterior(v))
                           .agg(F.sum("n"), F.sum(good), *sums).first())
        if not total:
            break
        model = Model(
            _clipped(mass / total, LEAST_GOOD, MOST_GOOD),
            tuple(_clipped((s[i] + START_GOOD * WEIGHT) / (s[i + 1] + WEIGHT), LOW, HIGH) for i in range(0, len(s), 4)),
            tuple(_clipped((s[i + 2] + START_BAD * WEIGHT) / (s[i + 3] + WEIGHT), LOW, HIGH) for i in range(0, len(s), 4)))
    return model


def with_votes(counted: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``counted`` with one column a rule, ``vote_<name>``."""
    out = without(counted, *[f"vote_{r.name}" for r in rules])
    return out.select(*[col(c) for c in out.columns], *[r.vote().alias(f"vote_{r.name}") for r in rules])


def judged(counted: DataFrame, rules: Sequence[Rule] | None = None, turns: int = TURNS) -> DataFrame:
    """``counted`` (from :func:`with_counts`, best written before, as it is read
    twice) with ``vote_<rule>`` columns, ``posterior``, ``base_failed`` and
    ``kept``: not failed, and good with a probability of a half or more."""
    rules = default_rules() if rules is None else rules
    names = [f"vote_{r.name}" for r in rules]
    voted = with_votes(without(counted, "posterior", "base_failed", "kept"), rules)
    model = fit(voted, names, turns)
    return (voted.withColumn("posterior", model.posterior([F.col(f"`{x}`") for x in names]))
            .withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= CUT)))


def judge(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, the counts of each text, its votes, posterior, ``base_failed``
    and ``kept``, a row for each row of ``docs``.

    Null and blank texts have no words and fail the base test; null and
    repeated keys keep their rows; an empty table gives no rows.  The
    counts, a few numbers a row, are written once and read twice.
    """
    counted = with_counts(docs.select(col(key).alias("_id"), col(text).alias("_text")), "_text")
    out = judged(written(counted.drop("_text")))
    return out.withColumnRenamed("_id", key)
