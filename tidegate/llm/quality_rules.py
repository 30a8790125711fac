"""Learned quality rules: a decision list of threshold conjunctions, run as ordered Spark conditionals.

Statistics of every text come from array and string functions alone. A list is
learned by sequential covering over labelled statistics: a conjunction grows by
the threshold that gains most, is pruned on rows held back from growing, and the
rows it covers leave before the next one grows. Spark does all counting; the
driver sees one row per feature and threshold.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..session import written
from .tables import TEXT_BLANKS, collected, fresh

_BLANK = "[\\x20\\x09-\\x0D]+"
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_upper", "n_digits", "n_bangs", "n_bars", "n_lines",
)
_STEPS = ("words", "low", "windows", "again")


@dataclass(frozen=True)
class Learning:
    """Bounds of the learner; the sample is the only part that does not see all rows."""

    sample: int = 20_000            # labelled rows the list is learned from, by hash of the id
    rules: int = 12                 # longest list
    literals: int = 4               # longest conjunction
    thresholds: int = 24            # quantiles per class and feature
    precision: float = 0.9          # least share of rejected rows that are bad, on the rows held back
    support: int = 3                # least number of bad rows a rule covers, growing and held back each


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool                     # feature > threshold, else feature <= threshold
    threshold: float


Rule = tuple[Literal, ...]


def with_counts(docs: DataFrame, text: str = "text", hash_bits: int = 64) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the counts of each whole text; the mapping tells a count's column, free of clashes.

    NULL, empty and blank texts have no words and no lines with a word; any other
    column of ``docs`` stays as it is.

    Three-word windows are compared by the upper bits of their 64-bit hash (the
    upper ``hash_bits`` at most). The lower bits, as many as the text's length
    needs, hold the window's position, so one sort of plain longs brings equal
    windows together. The words of neighbours with equal bits are then compared;
    a text where they differ is counted again by sorting the words themselves.
    """
    names = (*_STEPS, *COUNTS)
    c = dict(zip(names, fresh(docs, *(f"q_{n}" for n in names))))
    t = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(t, F.lit(TEXT_BLANKS))
    words, low, windows, again = (F.col(c[s]) for s in _STEPS)

    def only(kept: str) -> Column:
        return F.length(F.regexp_replace(t, f"[^{kept}]+", "")).cast("bigint")

    def alike(x: Column, other: Column) -> Column:
        return F.coalesce(x.bitwiseXOR(other).bitwiseAND(F.bitwise_not(low)) == 0, F.lit(False))

    def three(i: Column) -> Column:
        return F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))

    def place(x: Column) -> Column:
        return x.bitwiseAND(low).cast("int")

    split = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _BLANK))
    out = docs.withColumn(c["words"], split)
    out = out.withColumn(c["low"], F.pow(F.lit(2.0), F.ceil(F.log2(F.size(words) + 2))).cast("bigint") - 1)
    marked = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
        .bitwiseAND(F.lit(-1 << (64 - hash_bits))).bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("bigint")),
    )
    none = F.array().cast("array<bigint>")
    out = out.withColumn(c["windows"], F.when(F.size(words) >= 3, F.sort_array(marked)).otherwise(none))
    out = out.withColumn(c["again"], F.filter(
        windows, lambda x, i: alike(x, F.get(windows, i + 1)) | alike(x, F.get(windows, i - 1))))
    # neighbours with equal bits and other words: some hash of the text stands for two windows
    clashes = F.filter(again, lambda x, i: alike(x, F.get(again, i + 1)) & (
        three(place(x)) != three(place(F.get(again, i + 1)))))
    by_words = F.array_sort(F.transform(again, lambda x: F.struct(three(place(x)).alias("w"), place(x).alias("at"))))
    exact = F.flatten(F.transform(F.array(by_words), lambda e: F.filter(e, lambda x, i: F.coalesce(
        (x["w"] == F.get(e, i + 1)["w"]) | (x["w"] == F.get(e, i - 1)["w"]), F.lit(False)))))
    out = out.withColumn(c["again"], F.when(F.size(clashes) > 0, F.transform(exact, lambda x: x["at"])).otherwise(
        F.transform(again, place)))
    lines = F.filter(F.split(t, "\n"), lambda line: F.btrim(line, F.lit(TEXT_BLANKS)) != "")
    covered = F.array_distinct(F.flatten(F.transform(again, lambda p: F.array(p, p + 1, p + 2))))
    counts = {
        "n_words": F.size(words).cast("bigint"),
        "word_chars": F.length(F.array_join(words, "")).cast("bigint"),
        "n_symbols": only("#*$%&|<>"),
        "n_repeat_words": F.size(covered).cast("bigint"),
        "n_upper": only("\\p{Lu}"),
        "n_digits": only("0-9"),
        "n_bangs": only("!"),
        "n_bars": only("|"),
    }
    out = out.withColumns({c[k]: v for k, v in counts.items()} | {c["windows"]: lines})
    return out.withColumns({
        c["n_lines"]: F.size(windows).cast("bigint"),
        c["n_dup_lines"]: (F.size(windows) - F.size(F.array_distinct(windows))).cast("bigint"),
    }).drop(*(c[s] for s in _STEPS)), {k: c[k] for k in COUNTS}


def features(c: dict[str, str]) -> dict[str, Column]:
    """Ratios a rule may test, over the count columns; 0 where a text has no words, lines or characters."""

    def share(a: Column, b: Column) -> Column:
        return F.coalesce(a.cast("double") / F.nullif(b, F.lit(0)), F.lit(0.0))

    n, chars, lines = F.col(c["n_words"]), F.col(c["word_chars"]), F.col(c["n_lines"])
    return {
        "words": n.cast("double"),
        "word_length": share(chars, n),
        "symbol_share": share(F.col(c["n_symbols"]), chars),
        "dup_line_share": share(F.col(c["n_dup_lines"]), lines),
        "repeat_share": share(F.col(c["n_repeat_words"]), n),
        "upper_share": share(F.col(c["n_upper"]), chars),
        "digit_share": share(F.col(c["n_digits"]), chars),
        "bang_share": share(F.col(c["n_bangs"]), n),
        "bar_share": share(F.col(c["n_bars"]), n),
        "line_words": share(n, lines),
    }


def labelled_features(
    docs: DataFrame, labels: DataFrame, learning: Learning = Learning(), doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Stored features and ``bad`` of the sample, without texts that fail the base limits.

    One row per labelled id; of two labels the worse counts.
    """
    sample = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(
        F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(learning.sample)
    pick = F.broadcast(sample.select(F.col("doc_id").alias("picked"), (F.col("quality") == 0).alias("bad")))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(pick, F.col("id") == F.col("picked"))
    counted, c = with_counts(rows.select("id", "text", "bad"))
    found = features(c)
    rows = written(counted.select(base_failed(c).alias("failed"), "id", "bad", *(v.alias(k) for k, v in found.items())))
    return rows.where(~F.col("failed")).groupBy("id", "bad").agg(*(F.min(k).alias(k) for k in found))


def _binned(rows: DataFrame, names: list[str], learning: Learning) -> tuple[DataFrame, dict[str, list[float]]]:
    """The sample with each feature as the number of thresholds below its value."""
    shares = [k / (learning.thresholds - 1) for k in range(learning.thresholds)]
    per_class = rows.groupBy("bad").agg(*(F.percentile_approx(n, shares, 10_000).alias(n) for n in names)).collect()
    cuts = {}
    for n in names:
        points = sorted({v for r in per_class for v in r[n]})
        cuts[n] = sorted({*points, *((a + b) / 2 for a, b in zip(points, points[1:]))})
    bins = {n: _below(n, cuts[n]) for n in names}
    held = F.pmod(F.xxhash64("id", F.lit("hold")), F.lit(3)) == 0
    return written(rows.select("bad", held.alias("held"), *(b.alias(n) for n, b in bins.items()))), cuts


def _below(name: str, cuts: list[float]) -> Column:
    value = F.col(name)
    return F.size(F.filter(F.array(*(F.lit(float(x)) for x in cuts)), lambda t: t < value))


def _covers(rule: list[tuple[str, bool, int]]) -> Column:
    out = F.lit(True)
    for name, above, k in rule:
        out = out & ((F.col(name) > k) if above else (F.col(name) <= k))
    return out


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """FOIL's information gain of a literal that keeps p of p0 bad and n of n0 good rows."""
    if p == 0:
        return 0.0
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))


def _middle(cuts: list[float], k: int, filled: set[int]) -> int:
    """Of the thresholds from k on with the same rows on either side, the one nearest to the middle of the gap."""
    end = k
    while end + 1 < len(cuts) and end + 1 not in filled:
        end += 1
    middle = (cuts[k] + cuts[end]) / 2
    return min(range(k, end + 1), key=lambda j: (abs(cuts[j] - middle), -j))


def learn(sample: DataFrame, learning: Learning = Learning()) -> list[Rule]:
    """The ordered rules; each describes rows to reject. No labels, or one class only: no rules.

    Equal gains are settled by feature order, direction and threshold.
    """
    names = [c for c in sample.columns if c not in ("id", "bad")]
    rows, cuts = _binned(sample, names, learning)
    long = F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.col(n).alias("bin")) for i, n in enumerate(names))))
    most = sum(len(c) + 1 for c in cuts.values())
    left, rules = F.lit(True), []
    while len(rules) < learning.rules:
        rule: list[tuple[str, bool, int]] = []
        while len(rule) < learning.literals:
            counts = collected(
                rows.where(left & ~F.col("held") & _covers(rule)).select("bad", long.alias("x")).groupBy("x").agg(
                    F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")), most, "feature bins")
            table = {(r.x.f, r.x.bin): (r.p, r.n) for r in counts}
            p0, n0 = (sum(v[k] for (f, _), v in table.items() if f == 0) for k in (0, 1))
            if p0 < learning.support or n0 == 0:
                break
            best = (0.0, None)
            for f, name in enumerate(names):
                p = n = 0
                for k in range(len(cuts[name])):
                    q, m = table.get((f, k), (0, 0))
                    p, n = p + q, n + m
                    for above, (a, b) in ((True, (p0 - p, n0 - n)), (False, (p, n))):
                        gain = _gain(a, b, p0, n0) if a >= learning.support else 0.0
                        if gain > best[0] + 1e-9:
                            best = (gain, (name, above, f, k))
            if best[1] is None:
                break
            name, above, f, k = best[1]
            rule.append((name, above, _middle(cuts[name], k, {b for g, b in table if g == f})))
        if not rule:
            break
        # drop last literals as long as the rows held back are covered better
        ends = range(1, len(rule) + 1)
        held = rows.where(left & F.col("held")).agg(*(
            x for e in ends for x in (
                F.count_if(F.col("bad") & _covers(rule[:e])).alias(f"p{e}"),
                F.count_if(~F.col("bad") & _covers(rule[:e])).alias(f"n{e}"))
        )).first()
        worth = [((held[f"p{e}"] - held[f"n{e}"]) / max(1, held[f"p{e}"] + held[f"n{e}"]), -e) for e in ends]
        end = -max(worth)[1]
        rule, p, n = rule[:end], held[f"p{end}"], held[f"n{end}"]
        if p < learning.support or p < learning.precision * (p + n):
            break
        left = left & ~_covers(rule)
        rules.append(tuple(Literal(name, above, cuts[name][k]) for name, above, k in rule))
    return rules


def verdict(rules: list[Rule], c: dict[str, str]) -> Column:
    """Position (from 1) of the first rule that rejects a row, NULL where none does."""
    found = features(c)
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules, 1))):
        covers = F.lit(True)
        for x in rule:
            covers = covers & ((found[x.feature] > x.threshold) if x.above else (found[x.feature] <= x.threshold))
        out = F.when(covers, F.lit(k)).otherwise(out)
    return out


def base_failed(c: dict[str, str], min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    n = F.col(c["n_words"])
    return (n < min_words) | (100 * F.col(c["n_repeat_words"]) > max_repeat_percent * n)


def judge(
    docs: DataFrame, labels: DataFrame, learning: Learning = Learning(), doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """doc_id, the five counts, base_failed, kept and the position of the rejecting rule: one row per row of ``docs``.

    NULL and blank texts have no words and fail; repeated rows are judged each.
    """
    rules = learn(labelled_features(docs, labels, learning, doc_id, text), learning)
    rows, c = with_counts(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    by_rule = verdict(rules, c)
    return rows.select(
        "doc_id", *(F.col(c[n]).alias(n) for n in COUNTS[:5]), base_failed(c).alias("base_failed"),
        (~base_failed(c) & by_rule.isNull()).alias("kept"), by_rule.alias("rule"),
    )


def keep_good(
    docs: DataFrame, labels: DataFrame, learning: Learning = Learning(), doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that pass the base limits and no rule rejects, with all their columns.

    The condition stands in a generator: a filter would be pushed below the
    counts, and their expressions be repeated inside it.
    """
    rules = learn(labelled_features(docs, labels, learning, doc_id, text), learning)
    rows, c = with_counts(docs, text)
    good = ~base_failed(c) & verdict(rules, c).isNull()
    return rows.select(*docs.columns, F.explode(F.when(good, F.array(F.lit(True)))).alias("q_good")).select(
        *(rows[x] for x in docs.columns))
