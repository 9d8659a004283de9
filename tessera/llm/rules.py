"""Quality rules as a learned decision list over text statistics, in DataFrame and SQL functions alone.

Statistics of a text are whole numbers, so that every machine has the same. Rules are found by sequential covering:
a rule is a conjunction of thresholds, grown one threshold at a time on two thirds of the labelled rows by the gain in
information, cut back on the other third, and taken if it is precise there; rows that it covers are set aside and the
next is grown. Each step is one aggregate over all labelled rows; the driver sees counts by statistic and level only,
at most ``LEVELS`` of each statistic. The list becomes one ordered conditional expression.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import crc_mod, discard, written
from tessera.llm.learning import in_fold

WINDOW = 5
#: Statistics that rules may use have levels from 0 to LEVELS.
LEVELS = 1000
WORD = r"[^\x20\x09-\x0D]"
#: What a text without words lacks; and what rules may ask for: statistic to what it says.
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
STATISTICS = {
    "symbols": "symbols in 1000 characters of words",
    "duplicate_lines": "lines equal to an earlier one in 1000 lines that hold a word",
    "repeats": "words in repeated windows in 1000 words",
    "distinct": "different words in 1000 words",
    "upper": "upper-case letters in 1000 characters of words",
    "digits": "digits in 1000 characters of words",
    "marks": "characters other than letters, digits and white space in 1000 characters of words",
    "word_length": "tenths of a character in a word on average",
    "line_words": "words in a line that holds one on average",
    "ended": "lines that end in a full stop, question or exclamation mark in 1000 lines that hold a word",
    "length": "eighths of a power of two of words",
}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: what a lambda refers to would else be computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words in WINDOW-word windows found twice or more in the text. Windows are told apart by hashes of 64 bits.

    Within the row, in the order of n log n steps: windows are sorted by hash, those equal to a neighbour come back
    in order of place, and each covers the words up to the next one's start. No row leaves its task.
    """

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twin = lambda s, e, j: (e["h"] == F.get(s, j - 1)["h"]) | (e["h"] == F.get(s, j + 1)["h"])
        places = _let(placed, lambda s: F.sort_array(F.filter(F.transform(s, lambda e, j: F.when(twin(s, e, j), e["i"])), lambda x: x.isNotNull())))
        each = _let(places, lambda p: F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)))))
        return F.aggregate(each, F.lit(0), lambda a, x: a + x)

    hashes = lambda w: F.slice(F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, WINDOW)])), 1, F.size(w) - (WINDOW - 1))
    either = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(_let(_let(words, hashes), either))


def statistics(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of df, with BASE (long) and STATISTICS (int, 0 to LEVELS) of its text.

    A null text counts as empty: it has no words and all its statistics are 0. Columns of keep must not be named like
    a statistic. Rows are independent: nothing is shuffled, repeated rows have equal statistics.
    """
    clash = set(keep) & {*BASE, *STATISTICS}
    if clash:
        raise ValueError(f"columns named like statistics: {sorted(clash)}")
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    kept = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    parts = df.select(*kept, whole.alias("t")).select(
        "*", F.filter(F.split("t", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)).alias("l")
    )
    t = F.col("t")
    counted = parts.select(
        *[f"k{i}" for i in range(len(keep))],
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("w")).cast("long").alias("n_repeat_words"),
        F.size("l").alias("lines"),
        F.size(F.array_distinct("w")).alias("kinds"),
        F.regexp_count(t, F.lit(r"\p{Lu}")).alias("uppers"),
        F.regexp_count(t, F.lit(r"\p{Nd}")).alias("numerals"),
        F.regexp_count(t, F.lit(r"[^\p{L}\p{N}\p{M}\s]")).alias("others"),
        F.size(F.filter("l", lambda x: x.rlike(r"[.!?]['\")]*\s*$"))).alias("stops"),
    )

    def share(part: str, whole: str, of: int = LEVELS) -> Column:
        return F.least(F.lit(LEVELS), F.coalesce(F.expr(f"{of}L * {part} div nullif({whole}, 0)"), F.lit(0))).cast("int")

    found = {
        "symbols": share("n_symbols", "word_chars"),
        "duplicate_lines": share("n_dup_lines", "lines"),
        "repeats": share("n_repeat_words", "n_words"),
        "distinct": share("kinds", "n_words"),
        "upper": share("uppers", "word_chars"),
        "digits": share("numerals", "word_chars"),
        "marks": share("others", "word_chars"),
        "word_length": share("word_chars", "n_words", 10),
        "line_words": share("n_words", "lines", 1),
        "ended": share("stops", "lines"),
        "length": F.floor(8 * F.log2(F.col("n_words") + 1)).cast("int"),
    }
    return counted.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *BASE, *[c.alias(name) for name, c in found.items()])


def base_failed() -> Column:
    """Fewer than 10 words, or more than a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Threshold:
    """One condition: a statistic is at least, or at most, a level."""

    statistic: str
    at_least: bool
    level: int

    def __str__(self) -> str:
        return f"{self.statistic} {'>=' if self.at_least else '<='} {self.level}"

    def column(self) -> Column:
        return F.col(self.statistic) >= self.level if self.at_least else F.col(self.statistic) <= self.level


@dataclass(frozen=True)
class Rule:
    """Documents that meet all thresholds are rejected; caught and lost count labelled rows of the pruning third."""

    thresholds: tuple[Threshold, ...]
    caught: int = 0
    lost: int = 0

    def __str__(self) -> str:
        return " and ".join(map(str, self.thresholds))

    def column(self) -> Column:
        return _all(t.column() for t in self.thresholds)


def _all(columns: Iterable[Column]) -> Column:
    found = F.lit(True)
    for column in columns:
        found = found & column
    return found


def rule_number(rules: list[Rule]) -> Column:
    """The ordered conditional expression: the number (from 1) of the first rule that a row meets, 0 if none."""
    found = None
    for number, rule in enumerate(rules, 1):
        found = F.when(rule.column(), F.lit(number)) if found is None else found.when(rule.column(), F.lit(number))
    return F.lit(0) if found is None else found.otherwise(F.lit(0))


def as_sql(rules: list[Rule]) -> str:
    """The same list as SQL text, to be read or run elsewhere."""
    return "case " + " ".join(f"when {rule} then {i}" for i, rule in enumerate(rules, 1)) + " else 0 end" if rules else "0"


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _best(rows: DataFrame) -> tuple[Threshold | None, int, int]:
    """The threshold of most gain over rows (statistics, bad), and the bad and good rows that meet it.

    One aggregate: counts by statistic and level. Of equal gains the simpler one, by name, direction and level, counts.
    """
    pairs = F.array(*[F.struct(F.lit(i).alias("s"), F.col(name).alias("v")) for i, name in enumerate(STATISTICS)])
    counts = rows.select("bad", F.explode(pairs).alias("x")).groupBy("x.s", "x.v").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n"))
    levels: dict[int, list[tuple[int, int, int]]] = {}
    for s, v, p, n in counts.collect():  # at most LEVELS + 1 rows of a statistic
        levels.setdefault(s, []).append((v, p, n))
    best = (0.0, None, 0, 0)
    for i, name in enumerate(STATISTICS):
        found = sorted(levels.get(i, []))
        p0, n0 = sum(x[1] for x in found), sum(x[2] for x in found)
        for at_least in (True, False):
            p = n = 0
            for v, dp, dn in reversed(found) if at_least else found:
                p, n = p + dp, n + dn
                gain = _gain(p, n, p0, n0)
                if gain > best[0] + 1e-9:
                    best = (gain, Threshold(name, at_least, v), p, n)
    return best[1:]


def learned(labelled: DataFrame, most_rules: int = 12, most_thresholds: int = 4, precision: float = 0.95, least: int = 5) -> list[Rule]:
    """The decision list of labelled rows (doc_id, STATISTICS, bad boolean), all of which count.

    A rule is taken if at least ``least`` rows of the pruning third meet it and ``precision`` of them are bad; the first
    rule that is not ends the list. Rows are dealt to the two parts by a hash of doc_id; those with null bad or doc_id
    are not learned from. Without bad rows or without good ones the list is empty.
    """
    part = F.pmod(F.xxhash64(F.lit("prune"), "doc_id"), F.lit(3)) == 0
    table = written(labelled.where(F.col("bad").isNotNull() & F.col("doc_id").isNotNull()).select("bad", part.alias("pruning"), *STATISTICS), "rules")
    rules: list[Rule] = []
    while len(rules) < most_rules:
        rest = table.where(rule_number(rules) == 0)
        growing, grown = rest.where(~F.col("pruning")), []
        while len(grown) < most_thresholds:
            found, _, wrong = _best(growing.where(_all(t.column() for t in grown)))
            if found is None:
                break
            grown.append(found)
            if not wrong:
                break
        if not grown:
            break
        prefixes = [grown[: k + 1] for k in range(len(grown))]
        each = [F.struct(F.count_if(F.col("bad") & m).alias("p"), F.count_if(~F.col("bad") & m).alias("n")) for m in (_all(t.column() for t in x) for x in prefixes)]
        counts = rest.where("pruning").agg(F.array(*each).alias("x")).first()["x"]
        worth = [((c["p"] - c["n"]) / (c["p"] + c["n"]) if c["p"] + c["n"] else -1.0, -k) for k, c in enumerate(counts)]
        k = -max(worth)[1]
        p, n = counts[k]["p"], counts[k]["n"]
        if p + n < least or p < precision * (p + n):
            break
        rules.append(Rule(tuple(prefixes[k]), p, n))
    discard(table)
    return rules


def judged(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """stats with base_failed, rule (the rule that rejects it, 0 if none) and kept; columns so named are replaced."""
    number = rule_number(rules)
    return stats.withColumns({"base_failed": base_failed(), "rule": number, "kept": ~base_failed() & (number == 0)})


def quality_rules(documents: DataFrame, labels: DataFrame, fold: int = 0, folds: int = 5) -> DataFrame:
    """doc_id, BASE, base_failed, kept, held_out, rule of every document, judged by rules learned from labels.quality.

    Rows whose crc32(doc_id as text) mod ``folds`` is ``fold`` are held out: their labels teach nothing. Labels are those of quality 0 (bad) and 1
    among documents that pass the base; an id's repeated labels count once, by the largest. Documents of null doc_id are
    judged like any other, repeated rows alike, and an empty table gives none. Other columns of documents play no part.
    Texts are read once: their statistics are a written table, from which the rules are learned and applied.
    """
    stats = written(statistics(documents.select("doc_id", "text"), ["doc_id"]), "statistics")
    one = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    out = in_fold(crc_mod("doc_id", folds), fold)
    taught = stats.where(~base_failed() & ~out).join(one, "doc_id").withColumn("bad", F.col("quality") == 0)
    found = judged(stats.withColumn("held_out", out), learned(taught))
    return found.select("doc_id", *BASE, "base_failed", "kept", "held_out", "rule")
