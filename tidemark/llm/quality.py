"""Quality rules with thresholds that follow the data, per language and source.

Native: DataFrame functions only. Each text is measured in its own row, map-only. The thresholds come
from a mergeable quantile sketch: every measure falls into a bin of a fixed relative width, and
counting rows per (lang, source, measure, bin) is the sketch. Bins add up, so partial counts combine before the
shuffle, a hot source costs no more than its bins, and the result doesn't depend on the order of rows.

No cutoff is fixed. A group's threshold is its `start` quantile plus `spread` times a scale: the greatest of the distance from its `low` to its
`start` quantile, of what the distance from the `start` to the `high` quantile usually is (the median of all groups, if at least three vote), and of a bin's
width. The group's own quantiles are low ones, which junk doesn't reach until it is more than 1 - `start` of a source; the upper tail is a vote of
sources, which a few sources full of junk don't move. A source whose texts are all longer in words or
richer in symbols has its own higher threshold. Measures that are shares of n words or lines may exceed the threshold t by what chance gives in
so few: `noise` * sqrt(t / n) + `noise`**2 / n. Groups under `least` rows take the quantiles
of their language, and languages under it those of all rows. The thresholds, one row a group, are joined back
(broadcast only if counted to be few).

Defined results: a null text counts as empty and fails the base rule, null languages and sources are groups of their
own, repeated rows are judged alike, an empty table gives no rows, further columns are kept or ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small, text_of, words


#: Measures with a threshold, and what the shares among them are shares of.
MEASURES = {"word_length": None, "symbols": "n_words", "dup_lines": "n_lines", "repeats": "n_words"}


@dataclass(frozen=True)
class Rules:
    """Parameters: the base rule, the sketch's relative bin width, and how thresholds follow from quantiles."""

    min_words: int = 50
    max_repeat_percent: int = 50
    width: float = 0.02
    low: float = 0.1
    start: float = 0.25
    high: float = 0.9
    spread: float = 12.0
    noise: float = 3.0
    least: int = 100


def repeated_words(array: Column) -> Column:
    """How many words lie in a 3-word window that the array holds at least twice."""
    windows = F.when(
        F.size(array) >= 3,
        F.transform(F.slice(array, F.lit(1), F.size(array) - 2), lambda x, i: F.xxhash64(x, F.get(array, i + 1), F.get(array, i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    return windows


def covered(windows: Column) -> Column:
    """Positions that repeated windows of three cover, from the windows' hashes."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = lambda s: F.sort_array(F.transform(F.filter(s, lambda e, j: (F.get(s, j - 1)["h"] == e["h"]) | (F.get(s, j + 1)["h"] == e["h"])), lambda e: e["i"]))
    total = lambda at: F.aggregate(F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    return let(pairs, lambda s: let(twice(s), total))


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """docs' columns (or those of keep) with a struct __quality of counts."""
    own = [F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]
    body = text_of(f"`{text}`")
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.length(F.trim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    one = docs.select(
        *own,
        words(body).alias("__words"),
        F.length(F.regexp_replace(body, "[^#*$%&|<>]++", "")).cast("long").alias("__symbols"),
        lines.alias("__lines"),
    )
    two = one.select(
        *own,
        F.struct(
            F.size("__words").cast("long").alias("n_words"),
            F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
            F.col("__symbols").alias("n_symbols"),
            F.size("__lines").cast("long").alias("n_lines"),
            (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        ).alias("__counts"),
        repeated_words(F.col("__words")).alias("__windows"),
    )
    repeats = F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), covered(F.col("__windows"))).otherwise(0)
    return two.select(*own, F.struct("__counts.*", repeats.cast("long").alias("n_repeat_words")).alias("__quality"))


def base_failed(q: Column, rules: Rules) -> Column:
    return (q["n_words"] < rules.min_words) | (100 * q["n_repeat_words"] > rules.max_repeat_percent * q["n_words"])


def ratios(q: Column) -> dict[str, Column]:
    """The measures that get adaptive thresholds; null where a text has no words."""
    per = lambda a, b: F.when(b > 0, a / b)
    return {
        "word_length": per(q["word_chars"], q["n_words"]),
        "symbols": per(q["n_symbols"], q["n_words"]),
        "dup_lines": per(q["n_dup_lines"], q["n_lines"]),
        "repeats": per(q["n_repeat_words"], q["n_words"]),
    }


def sketch(measured: DataFrame, rules: Rules) -> DataFrame:
    """Counts per (lang, source, measure, bin) of the rows that pass the base rule; bin 0 holds zeros."""
    q = F.col("__quality")
    step = F.lit(1.0 + rules.width)
    bins = [F.struct(F.lit(name).alias("measure"), F.when(x > 0, F.floor(F.log(x * 1000000.0) / F.log(step)).cast("int") + 1).otherwise(0).alias("bin")) for name, x in ratios(q).items()]
    rows = measured.filter(~base_failed(q, rules)).select("lang", "source", F.inline(F.array(*bins)))
    return rows.groupBy("lang", "source", "measure", "bin").agg(F.count(F.lit(1)).alias("n"))


def thresholds(sketched: DataFrame, rules: Rules) -> DataFrame:
    """One row per (lang, source): an upper threshold for each measure."""
    merged = lambda *keys: sketched.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n")).groupBy(*keys, "measure").agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"), F.sum("n").alias("rows"))

    def quantile(share: float) -> Column:
        # the lower edge of the bin in which the running count reaches the share
        first = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("int").alias("bin"))
        step = lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.when(a["bin"].isNull() & (a["seen"] + x["n"] >= share * F.col("rows")), x["bin"]).otherwise(a["bin"]).alias("bin"))
        at = F.aggregate("bins", first, step)["bin"]
        return F.when(at == 0, 0.0).otherwise(F.pow(F.lit(1.0 + rules.width), at - 1) / 1000000.0)

    start = quantile(rules.start)
    found = {"start": start, "below": start - quantile(rules.low), "above": quantile(rules.high) - start}

    def level(name: str, *keys: str) -> DataFrame:
        return merged(*keys).filter(F.col("rows") >= (rules.least if keys else 0)).select(*keys, "measure", F.struct(*[c.alias(k) for k, c in found.items()]).alias(name))

    groups = sketched.select("lang", "source", "measure").distinct()
    own, lang, every = level("own", "lang", "source").alias("o"), level("of_lang", "lang").alias("l"), level("of_all").alias("a")
    voted = F.when(F.count(F.lit(1)) >= 3, F.percentile_approx("own.above", 0.5, 10000)).otherwise(0.0)
    usual = own.groupBy("measure").agg(voted.alias("usual")).alias("u")
    g = groups.alias("g")
    same = lambda a, b, *keys: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    joined = (
        g.join(own, same("g", "o", "lang", "source", "measure"), "left")
        .join(lang, same("g", "l", "lang", "measure"), "left")
        .join(every, same("g", "a", "measure"), "left")
        .join(usual, same("g", "u", "measure"), "left")
        .select("g.lang", "g.source", "g.measure", F.coalesce("own", "of_lang", "of_all").alias("q"), "of_all", "usual")
    )
    limit = F.col("q.start") + rules.spread * F.greatest(F.col("q.below"), F.coalesce("usual", "of_all.above"), rules.width * F.col("q.start"))
    return joined.select("lang", "source", "measure", limit.alias("limit")).groupBy("lang", "source").pivot("measure", list(MEASURES)).agg(F.first("limit"))


def judge(measured: DataFrame, limits: DataFrame, rules: Rules) -> DataFrame:
    """measured with base_failed and kept: joined filtering by the group's thresholds."""
    q = F.col("__quality")
    limits = limits.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), *[F.col(n).alias(f"__max_{n}") for n in MEASURES])
    joined = measured.join(small(limits), F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left")
    fine = F.lit(True)
    for name, x in ratios(q).items():
        top = F.col(f"__max_{name}")
        if MEASURES[name]:
            n = F.nullif(q[MEASURES[name]], F.lit(0))
            top = top + rules.noise * F.sqrt(top / n) + rules.noise * rules.noise / n
        fine = fine & F.coalesce(x <= top, F.lit(True))
    own = [F.col(f"`{c}`") for c in measured.columns]
    return joined.select(*own, base_failed(q, rules).alias("__base_failed"), (~base_failed(q, rules) & fine).alias("__kept"))


def judged(measured: DataFrame, rules: Rules) -> DataFrame:
    """The whole method over measured, which is read twice and so should be written first."""
    return judge(measured, thresholds(small(sketch(measured, rules)), rules), rules)
