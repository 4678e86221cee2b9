"""Quality rules: ordered decision lists learned by sequential covering. Native: DataFrame expressions only.

``text_statistics`` measures every whole text with built-in expressions. ``learn_rules`` takes a bounded sample of
labelled statistics, grows conjunctions of thresholds by information gain, prunes them on held-back rows and keeps
those that stay precise. ``rules_column`` turns the list into one ordered ``CASE WHEN``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Aside, words_of

#: Symbols that the statistic counts.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
STATISTICS = ("n_words", "n_lines", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "distinct_rate", "digit_rate", "upper_rate", "words_per_line")


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the rates that rules test.

    Null and empty texts count as texts without words: every statistic is 0. Columns of ``docs`` with the name of a
    statistic are replaced. A document is measured inside its own row, so nothing is shuffled and no document meets
    another; a long text is one array of words. Each array is a column of its own projection: a lambda that read an
    inlined expression would rebuild the array for every element.
    """
    aside = Aside(tuple(docs.columns))
    keep = aside.names
    t = F.coalesce(F.col(text), F.lit(""))
    count_of = lambda chars: (F.length("_q_t") - F.length(F.translate("_q_t", chars, ""))).cast("long")
    out = docs.select(*aside.columns, t.alias("_q_t")).withColumn("_q_w", words_of(F.col("_q_t")))
    lines = F.filter(F.split("_q_t", "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    out = out.select(*keep, "_q_t", F.transform("_q_w", lambda x: F.xxhash64(x)).alias("_q_h"), lines.alias("_q_l"))
    n = F.size("_q_h")
    out = out.select(
        *keep, "_q_h", n.cast("long").alias("n_words"),
        (F.length("_q_t") - count_of(SPACE)).cast("long").alias("word_chars"), count_of(SYMBOLS).alias("n_symbols"),
        count_of("0123456789").alias("_q_digits"), (F.length("_q_t") - F.length(F.regexp_replace("_q_t", "[A-Z]", ""))).alias("_q_upper"),
        F.size("_q_l").cast("long").alias("n_lines"), (F.size("_q_l") - F.size(F.array_distinct("_q_l"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("_q_h")).alias("_q_distinct"),
        F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_q_h", i, WINDOW)))).otherwise(F.array().cast("array<long>")).alias("_q_g"),
    )
    # Only texts with a window found twice sort their windows; equal ones are then neighbours.
    pairs = F.sort_array(F.transform("_q_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = F.size(F.array_distinct("_q_g")) < F.size("_q_g")
    out = out.withColumn("_q_s", F.when(twice, pairs).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))).drop("_q_g", "_q_h")
    at = lambda k: F.get("_q_s", k)
    same = lambda k: F.coalesce(at(k)["h"] == at(k - 1)["h"], F.lit(False)) | F.coalesce(at(k)["h"] == at(k + 1)["h"], F.lit(False))
    starts = F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size("_q_s") - 1), same), lambda k: at(k)["i"]))
    out = out.withColumn("_q_p", F.when(F.size("_q_s") > 0, starts).otherwise(F.array().cast("array<int>"))).drop("_q_s")
    gaps = F.transform("_q_p", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_q_p", k + 1), x + WINDOW) - x))
    out = out.withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)).drop("_q_p")
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0)).cast("double")
    out = out.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
        rate("word_chars", "n_words").alias("mean_word"), rate("n_symbols", "word_chars").alias("symbol_rate"),
        rate("n_dup_lines", "n_lines").alias("dup_line_rate"), rate("n_repeat_words", "n_words").alias("repeat_rate"),
        rate("_q_distinct", "n_words").alias("distinct_rate"), rate("_q_digits", "word_chars").alias("digit_rate"),
        rate("_q_upper", "word_chars").alias("upper_rate"), rate("n_words", "n_lines").alias("words_per_line"),
    )
    return aside.back(out, *_OUT)


#: What text_statistics adds, in this order.
_OUT = tuple(dict.fromkeys(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", *STATISTICS)))


def base_failed() -> Column:
    """Too short, or repeating itself: n_words < 20 or over 30 % of the words in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """Rejects a text for which every test holds; ``tests`` are (statistic, '<=' or '>', threshold)."""

    tests: tuple[tuple[str, str, float], ...]
    precision: float
    covered: int

    def holds(self, row) -> bool:
        return all(row[c] <= v if op == "<=" else row[c] > v for c, op, v in self.tests)

    def column(self) -> Column:
        out = F.lit(True)
        for c, op, v in self.tests:
            out = out & (F.col(c) <= v if op == "<=" else F.col(c) > v)
        return out


def learn_rules(sample: list[dict], max_rules: int = 12, max_tests: int = 4, min_precision: float = 0.9, min_cover: int = 4, cuts: int = 48) -> list[Rule]:
    """Sequential covering over rows with STATISTICS, ``bad`` (0/1) and ``fold`` (0 to 2; fold 2 prunes).

    A rule grows by the test with the best FOIL gain until it covers no good row, drops its last tests while that
    helps (bad-good)/(bad+good) on the pruning fold, and is kept if both folds stay at ``min_precision``. What it
    covers leaves before the next rule grows. No bad rows: no rules.
    """
    grow, prune = [r for r in sample if r["fold"] < 2], [r for r in sample if r["fold"] == 2]
    rules: list[Rule] = []
    while len(rules) < max_rules and sum(r["bad"] for r in grow) >= min_cover:
        tests: list[tuple[str, str, float]] = []
        inside = grow
        while len(tests) < max_tests and any(not r["bad"] for r in inside):
            best = _best_test(inside, cuts)
            if best is None:
                break
            tests.append(best)
            inside = [r for r in inside if Rule((best,), 0, 0).holds(r)]
        best_rule, best_worth = None, -2.0
        for k in range(len(tests), 0, -1):
            rule = Rule(tuple(tests[:k]), 0, 0)
            p, n = _cover(rule, prune)
            gp, gn = _cover(rule, grow)
            worth = (p - n) / (p + n) if p + n else (gp - gn) / (gp + gn) - 1e-3 if gp + gn else -2.0
            if worth >= best_worth and gp + p:
                best_rule, best_worth = Rule(rule.tests, (p + gp) / (p + n + gp + gn), p + n + gp + gn), worth
                parts = ((p, n), (gp, gn))
        if best_rule is None or best_rule.covered < min_cover or any(p + n and p < min_precision * (p + n) for p, n in parts):
            break
        rules.append(best_rule)
        grow, prune = [r for r in grow if not best_rule.holds(r)], [r for r in prune if not best_rule.holds(r)]
    return rules


def _cover(rule: Rule, rows: list[dict]) -> tuple[int, int]:
    hit = [r["bad"] for r in rows if rule.holds(r)]
    return sum(hit), len(hit) - sum(hit)


def _best_test(rows: list[dict], cuts: int):
    p0 = sum(r["bad"] for r in rows)
    if not p0:
        return None
    before = math.log2(p0 / len(rows))
    best, best_gain = None, 1e-9
    for c in STATISTICS:
        order = sorted((r[c], r["bad"]) for r in rows)
        # Candidate cuts: quantiles of all rows and of the bad rows, midway to the next value.
        bad = [i for i, (_, y) in enumerate(order) if y]
        at = {i * (len(order) - 1) // cuts for i in range(cuts + 1)} | {bad[i * (len(bad) - 1) // cuts] for i in range(cuts + 1)}
        sums = [0]
        for _, y in order:
            sums.append(sums[-1] + y)
        for i in {x for i in at for x in (i - 1, i)}:
            while 0 <= i < len(order) - 1 and order[i][0] == order[i + 1][0]:
                i += 1
            if not 0 <= i < len(order) - 1:
                continue
            v = (order[i][0] + order[i + 1][0]) / 2
            for op, p, n in (("<=", sums[i + 1], i + 1), (">", p0 - sums[i + 1], len(order) - i - 1)):
                if p and n and (gain := p * (math.log2(p / n) - before)) > best_gain:
                    best, best_gain = (c, op, v), gain
    return best


def labelled_sample(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> list[dict]:
    """Statistics of at most about ``max_labelled`` labelled documents, drawn by a hash of doc_id.

    The bound limits the fit only; every document is judged. Null ids and null qualities are not used.
    """
    known = labels.where("doc_id is not null and quality is not null").select("doc_id", F.col("quality").alias("_bad_y"))
    n = known.count()
    share = min(1.0, max_labelled / max(1, n))
    slot = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20))
    ids = known.where(slot < int(share * (1 << 20))).groupBy("doc_id").agg(F.min("_bad_y").alias("_bad_y"))
    # The drawn ids are bounded by max_labelled, so that they can be broadcast at any input size.
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    rows = text_statistics(rows).select((F.col("_bad_y") == 0).cast("int").alias("bad"), F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(3)).alias("fold"), *STATISTICS)
    return [r.asDict() for r in rows.collect()]


def rules_column(rules: list[Rule]) -> Column:
    """1-based number of the first rule that holds, 0 if none does."""
    out = F.lit(0)
    for k in range(len(rules), 0, -1):
        out = F.when(rules[k - 1].column(), F.lit(k)).otherwise(out)
    return out


def apply_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``docs`` with the statistics, base_failed, rule (0: none) and kept."""
    out = text_statistics(docs).withColumn("base_failed", base_failed()).withColumn("rule", rules_column(rules))
    # A filter on kept must not move below the statistics: their arrays would be built again inside its lambdas. The
    # optimizer leaves filters on a column alone that it takes for non-deterministic.
    here = F.monotonically_increasing_id() >= 0
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0) & here)
