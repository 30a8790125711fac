"""URL verdicts from rules and from a logistic regression on hashed character n-grams of host and path.

The model is trained by accelerated full-batch gradient steps: each is one
aggregation over a small stored table, and the driver holds one weight per
bucket. Scoring is a sum over an array, inside one scan.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import written
from .tables import collected

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# Names of the labelled URL table, unwanted ones by kind, and ordinary ones.
UNWANTED = {
    "ads": "ad ads adclick adserver adtech advert adverts banner clickads popads popunder",
    "adult": "adult adults escort nude nudes porn porno sexchat xxx",
    "drugs": "cialis drugstore meds pharmacy pill pills pillshop pillstore steroids viagra",
    "gambling": "bet bets betting bingo casino casinos gambling jackpot lottery poker roulette slots",
    "spam": "crack keygen linkfarm loans payday phishing scam spam spammer spamming warez",
    "tracking": "clicktrack pixeltrack track tracker trackers tracking",
}
ORDINARY = (
    "airport animal archive art bakery bank bird blog book books bridge camera chemistry chess children church cinema city "
    "clinic coffee college computer council court design dictionary doctor energy family farmer fashion film fish football "
    "forest forum furniture gallery garden government health history home horse hospital hotel house island journal "
    "kitchen language law library magazine maps market maths mountain museum music news ocean orchestra paper parliament "
    "photo physics poetry radio railway recipes research restaurant river school science shoes software sports station "
    "summer television tennis theatre things thought together train translate travel university water weather wiki winter "
    "winery writer"
)
# What names of both classes are joined with, so that it tells nothing.
PREFIXES, SUFFIXES = ("", "www.", "m.", "blog."), ("", "-24", "-best", "-blog", "-info", "-online", "-site", "-top", "-world")
ENDINGS, PATHS = (".com", ".example.org", ".net", ".example.com", ".org", ".example.net", ".info"), ("/", "/en/{n}", "/de/{n}.html", "/fr/{n}/", "/index.html?page={n}", "/{word}/{n}")


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host and its subdomains, where the path begins as the rule's."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Training:
    rows: int = 2_000           # labelled URLs of each class that are learned from, by hash of the URL
    buckets: int = 16_384
    grams: int = 3              # characters of an n-gram; host and path begin and end with a mark
    steps: int = 60
    rate: float = 20.0
    decay: float = 1e-5


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]
    bias: float


def host(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for NULL."""
    found = F.regexp_extract(_rest(url), "^[^/?#]*", 0)
    return F.translate(found, _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def ruled(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, NULL where none does; rules are a short list.

    Equal lengths: the rule listed first.
    """
    name = verdict = None
    for r in sorted(rules, key=lambda r: -len(r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        name = F.when(fits, r.name) if name is None else name.when(fits, r.name)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def buckets(host: Column, path: Column, training: Training) -> Column:
    """Distinct buckets of the n-grams; a lookahead finds all overlapping ones in one pass over the text."""

    def of(text: Column, kind: str) -> Column:
        found = F.regexp_extract_all(
            F.concat(F.lit("\x02"), text, F.lit("\x03")), F.lit(f"(?s)(?=(.{{{training.grams}}}))"), F.lit(1))
        return F.transform(found, lambda g: F.pmod(F.xxhash64(F.lit(kind), g), F.lit(training.buckets)).cast("int"))

    return F.array_distinct(F.concat(of(host, "host"), of(path, "path")))


def _margin(grams: Column, weights: Column, bias: float) -> Column:
    total = F.aggregate(grams, F.lit(0.0), lambda s, i: s + F.get(weights, i))
    return F.lit(bias) + F.when(F.size(grams) > 0, total / F.sqrt(F.size(grams))).otherwise(F.lit(0.0))


def _array(values) -> Column:
    """A constant array, folded once by the optimiser."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def learn(labelled: DataFrame, training: Training = Training(), url: str = "url", label: str = "label") -> Model:
    """Weights from (url, label 1 for block, 0 for allow); rows with a NULL are left out, repeats count once.

    No rows: all weights are 0. Beyond ``rows`` of a class those with the smallest hashes are taken.
    """
    known = labelled.select(F.col(url).alias("url"), F.col(label).cast("double").alias("y")).where(
        "url IS NOT NULL AND y IS NOT NULL").groupBy("url").agg(F.max("y").alias("y"))
    order = F.xxhash64("url")
    rows = known.where("y = 1").orderBy(order, "url").limit(training.rows).unionByName(
        known.where("y = 0").orderBy(order, "url").limit(training.rows))
    table = written(rows.select("y", buckets(host(F.col("url")), path(F.col("url")), training).alias("grams")))
    n = table.count()
    weights, bias = [0.0] * training.buckets, 0.0
    ahead, ahead_bias, pace = weights, bias, 1.0
    for _ in range(training.steps if n else 0):
        chance = 1 / (1 + F.exp(-_margin(F.col("grams"), F.col("w"), ahead_bias)))
        wrong = table.select("y", "grams", _array(ahead).alias("w")).select("grams", (chance - F.col("y")).alias("e"))
        cells = F.concat(
            F.array(F.struct(F.lit(-1).alias("i"), F.col("e").alias("g"))),
            F.transform("grams", lambda i: F.struct(i.alias("i"), (F.col("e") / F.sqrt(F.size("grams"))).alias("g"))))
        sums = collected(wrong.select(F.explode(cells).alias("c")).groupBy("c.i").agg(F.sum("c.g").alias("g")),
                         training.buckets + 1, "buckets")
        slope = {r.i: r.g / n for r in sums}
        new = [w - training.rate * (slope.get(i, 0.0) + training.decay * w) for i, w in enumerate(ahead)]
        new_bias = ahead_bias - training.rate / 10 * slope.get(-1, 0.0)
        faster = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        push = (pace - 1) / faster
        ahead = [a + push * (a - b) for a, b in zip(new, weights)]
        ahead_bias = new_bias + push * (new_bias - bias)
        weights, bias, pace = new, new_bias, faster
    return Model(tuple(weights), bias)


def judge(
    pages: DataFrame, rules: list[Rule], model: Model, training: Training = Training(),
    page_id: str = "page_id", url: str = "url",
) -> DataFrame:
    """page_id, host, path, rule, verdict, score: one row per row of ``pages``.

    A rule decides where one fits; else the model blocks above one half. NULL
    and relative URLs have an empty host and path and fit no rule. Only the id
    and the URL are read.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    rule, verdict = ruled(rules, F.col("host"), F.col("path"))
    rows = rows.select("*", rule.alias("rule"), verdict.alias("ruled"),
                       buckets(F.col("host"), F.col("path"), training).alias("grams"),
                       _array(model.weights).alias("w"))
    rows = rows.withColumn("score", 1 / (1 + F.exp(-_margin(F.col("grams"), F.col("w"), model.bias))))
    by_model = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"), "score")


def labelled_urls(spark: SparkSession, kinds: Iterable[str] = tuple(UNWANTED), per_word: int = 12) -> DataFrame:
    """The labelled URL table, (url, label): ``per_word`` addresses of every name, 1 for the unwanted ``kinds``, else 0.

    It has some 1,800 rows whatever is judged. Hosts whose name is not in it,
    those of the judged pages among them, have no label. Prefixes, suffixes,
    endings and paths go round alike in both classes.
    """
    rows = []
    for label, words in ((1, [w for kind in kinds for w in UNWANTED[kind].split()]), (0, ORDINARY.split())):
        for at, word in enumerate(words):
            for k in range(per_word):
                n = at * per_word + k
                host = PREFIXES[n % len(PREFIXES)] + word + SUFFIXES[n % len(SUFFIXES)] + ENDINGS[n % len(ENDINGS)]
                turn = PATHS[n % len(PATHS)].format(n=n * 7_919 % 10_000, word=word)
                rows.append((f"http://{host}{turn}", label))
    return spark.createDataFrame(pa.table({"url": [u for u, _ in rows], "label": [y for _, y in rows]}))
