"""Secret scans: patterns, and a battery of randomness tests for what no pattern knows.

Native: DataFrame functions only, map-only but for one small histogram.

Candidates are the longest runs of `[A-Za-z0-9+/_=-]` of 20 or more characters that no pattern's span touches and that aren't all hex. Each
gets the smallest encoding of its characters (hex, base32 or base36 of one case, base62, base64) and is tested in both directions.

Against chance, for uniform draws from the encoding's alphabet:

* chi-squared over character classes (lower, upper, digit or other; in one case vowel, consonant, digit),
* collisions, the chi-squared of single symbols in the form that holds for short strings,
* runs, the number of changes of class,
* serial correlation of neighbouring symbols' positions in the alphabet.

A candidate whose least p-value, times the number of tests, is under `level` isn't random: a repeated or counted-up string, say.

Against ordinary text (words, names and identifiers run together): the log-likelihood ratio of the two over the same three things, the alphabet
(rare and common consonants), the serial dependence of neighbouring letters (vowels and consonants take turns in text) and the runs (changes of class are fewer). Under ordinary text the
sum has a known mean and variance for the candidate's number of letters and pairs, so a long candidate can give more evidence than a short one; the p-value is the upper tail.
Small p-values speak for a secret, and Benjamini-Hochberg in each band of lengths keeps the share of false ones among the secrets at `fdr`: a short
candidate is judged among short ones, and little evidence means no secret. Ranks come from a histogram of p-values per
band, which adds up over partitions, so every candidate of the corpus counts.

A run of small letters alone is held against base62, where it is ordinary, as most such runs are long words: a lower-case
base32 key without a digit (1.6 % of those of 20 characters, 0.1 % of 32) isn't found.

Defined results: a null or empty text has no spans, texts of any length are read whole, matches that overlap in different kinds all stay, ties (spans with one start) come in
the order of kinds, repeated rows repeat, an empty table gives no rows, columns of docs named __base or __spans are replaced and further ones stay.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, text_of, written

ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "(AKIA[A-Z0-9]{14,})"
HEX = "([0-9a-f]{16,})"
KINDS = ("assign", "access", "hex", "random")
SPAN = "array<struct<start: int, kind_no: int, kind: string, end: int>>"


@dataclass(frozen=True)
class Battery:
    """Parameters: the shortest candidate, the share of false discoveries, the level of the tests against chance, and the histogram's bins (tenths of a power of ten)."""

    least: int = 20
    fdr: float = 0.01
    level: float = 0.0001
    bins: int = 300

    @property
    def run(self) -> str:
        return f"([A-Za-z0-9+/_=-]{{{self.least},}})"


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def starts(gaps: Column, sizes: Column, block: int = 256) -> Column:
    """Where matches begin, from the lengths of the gaps before them and their own: running sums in blocks, so that the cost stays near linear."""
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(sizes)), sizes, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    zero = F.struct(F.lit(0).alias("s"), F.array().cast("array<int>").alias("out"))
    inner = lambda a, x: F.struct((a["s"] + x["g"] + x["m"]).alias("s"), F.array_append(a["out"], a["s"] + x["g"]).alias("out"))
    zeros = F.struct(F.lit(0).alias("s"), F.array().cast("array<array<int>>").alias("out"))

    def outer(a: Column, b: Column) -> Column:
        return F.struct((a["s"] + b["s"]).alias("s"), F.array_append(a["out"], F.transform(b["out"], lambda p: p + a["s"])).alias("out"))

    def of(p: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / block).cast("int")), lambda k: F.aggregate(F.slice(p, k * block + 1, F.lit(block)), zero, inner))
        return F.flatten(F.aggregate(blocks, zeros, outer)["out"])

    return let(pairs, of)


def matches(text: Column, pattern: str, part: int = 1) -> Column:
    """All matches in order as (start, end, value): code points, end exclusive, value the group `part`."""
    size = lambda x: F.length(x)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(part))
    lens = F.transform(whole, size)
    at = starts(F.transform(F.split(text, pattern, -1), size), lens)
    found = F.transform(F.arrays_zip(at.alias("s"), lens.alias("n"), values.alias("v")), lambda x: F.struct(x["s"].alias("start"), (x["s"] + x["n"]).alias("end"), x["v"].alias("value")))
    none = F.array().cast("array<struct<start: int, end: int, value: string>>")
    return F.when(text.rlike(pattern), found).otherwise(none)


def spans_of(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """Spans that the patterns find, by start, then kind as listed."""
    assign = F.filter(matches(text, ASSIGN, 2), lambda x: F.length(x["value"]) >= 12)
    found = [spans_of(x, k) for x, k in ((assign, "assign"), (matches(text, ACCESS), "access"), (matches(text, HEX), "hex"))]
    return F.sort_array(F.concat(*found))


def tail(z: Column) -> Column:
    """The normal distribution's upper tail for z >= 0, by a rational fit of error under 1e-7."""
    fit = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = 1 / (1 + 0.2316419 * z)
    poly = F.lit(0.0)
    for c in reversed(fit):
        poly = (poly + c) * t
    return F.exp(-z * z / 2) * 0.3989422804014327 * poly


#: Ordinary text, as rates: vowels among letters, a vowel after a vowel and after a consonant, rare ones among consonants, changes of class in one case and in mixed case.
VOWELS, AFTER_VOWEL, AFTER_CONSONANT, RARE, CHANGES_ONE, CHANGES_MIXED = 0.39, 0.12, 0.56, 0.10, 0.15, 0.40


def ordinary(token: Column, turn: Column, mixed: Column) -> Column:
    """The p-value of a token as ordinary text; turn: the rate of class changes among random ones, mixed: whether it may have both cases."""
    t = F.translate(F.lower(token), "aeioubcdfghlmnprstyjkqvwxz0123456789+/_=-", "v" * 5 + "c" * 14 + "r" * 7 + "d" * 10 + "o" * 5)
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(token, "[a-z]", "l"), "[A-Z]", "u"), "[^lu]", "d")
    n = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    counts = F.struct(
        n(t, "v(?=v)").alias("vv"),
        n(t, "v(?=[cr])").alias("vc"),
        n(t, "[cr](?=v)").alias("cv"),
        n(t, "[cr](?=[cr])").alias("cc"),
        n(t, "r").alias("rare"),
        n(t, "c").alias("common"),
        n(kinds, "l(?=[ud])|u(?=[ld])|d(?=[lu])").alias("change"),
        (F.length(token) - 1).cast("double").alias("pairs"),
    )
    vowel, rare = 5 / 26, 7 / 21
    after_v = [log(vowel / AFTER_VOWEL), log((1 - vowel) / (1 - AFTER_VOWEL))]
    after_c = [log(vowel / AFTER_CONSONANT), log((1 - vowel) / (1 - AFTER_CONSONANT))]
    of_rare = [log(rare / RARE), log((1 - rare) / (1 - RARE))]
    mean = lambda share, w, k: share * w[0] ** k + (1 - share) * w[1] ** k
    letters = [VOWELS * mean(AFTER_VOWEL, after_v, k) + (1 - VOWELS) * mean(AFTER_CONSONANT, after_c, k) for k in (1, 2)]
    rares = [mean(RARE, of_rare, k) for k in (1, 2)]
    usual = F.when(mixed, CHANGES_MIXED).otherwise(CHANGES_ONE)
    weights = F.struct(F.log(turn / usual).alias("yes"), F.log((1 - turn) / (1 - usual)).alias("no"), usual.alias("usual"))

    def p(c: Column, w: Column) -> Column:
        got = c["vv"] * after_v[0] + c["vc"] * after_v[1] + c["cv"] * after_c[0] + c["cc"] * after_c[1] + c["rare"] * of_rare[0] + c["common"] * of_rare[1] + c["change"] * w["yes"] + (c["pairs"] - c["change"]) * w["no"]
        two, consonants = c["vv"] + c["vc"] + c["cv"] + c["cc"], c["rare"] + c["common"]
        u, step = w["usual"], w["yes"] - w["no"]
        expected = two * letters[0] + consonants * rares[0] + c["pairs"] * (u * w["yes"] + (1 - u) * w["no"])
        variance = two * (letters[1] - letters[0] ** 2) + consonants * (rares[1] - rares[0] ** 2) + c["pairs"] * u * (1 - u) * step * step
        z = (got - expected) / F.sqrt(variance)
        return F.when(z > 0, tail(z)).otherwise(0.5)

    return let(counts, lambda c: let(weights, lambda w: p(c, w)))


def tested(token: Column) -> Column:
    """(n, p, chance) of a token: its length, its p-values as ordinary text and as uniform draws."""
    digits, upper, lower = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    base64 = upper + lower + digits + "+/"
    is_hex, is_32 = token.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), token.rlike("^(?:[A-Z2-7]+|[a-z]*[2-7][a-z2-7]*)$")
    is_36, is_62 = token.rlike("^(?:[A-Z0-9]+|[a-z]*[0-9][a-z0-9]*)$"), token.rlike("^[A-Za-z0-9]+$")
    pick = lambda a, b, c, d, e: F.when(is_hex, F.lit(a)).when(is_32, F.lit(b)).when(is_36, F.lit(c)).when(is_62, F.lit(d)).otherwise(F.lit(e))
    setting = F.struct(
        F.when(is_hex | is_32 | is_36, F.lower(token)).otherwise(F.rtrim(F.translate(token, "-_", "+/"), F.lit("="))).alias("x"),
        pick(digits + "abcdef", lower + "234567", digits + lower, base64[:62], base64).alias("alphabet"),
        pick(6 / 16, 26 / 32, 26 / 36, 26 / 62, 26 / 64).alias("lower"),
        pick(0.0, 0.0, 0.0, 26 / 62, 26 / 64).alias("upper"),
        pick(0.0, 5 / 32, 5 / 36, 0.0, 0.0).alias("vowel"),
    )

    def battery(s: Column) -> Column:
        n = F.length(s["x"])
        chars = F.split(s["x"], "")
        rest = 1.0 - s["lower"] - s["upper"]
        lowers, uppers = F.length(F.regexp_replace(s["x"], "[^a-z]", "")), F.length(F.regexp_replace(s["x"], "[^A-Z]", ""))
        part = lambda seen, share: F.when(share > 0, (seen - n * share) * (seen - n * share) / (n * share)).otherwise(0.0)
        vowels = F.when(s["vowel"] > 0, F.length(F.regexp_replace(s["x"], "[^aeiou]", ""))).otherwise(0)
        chi = part(vowels, s["vowel"]) + part(lowers - vowels, s["lower"] - s["vowel"]) + part(uppers, s["upper"]) + part(n - lowers - uppers, rest)
        p_class = F.when((s["lower"] > 0) & (s["upper"] + s["vowel"] > 0), F.exp(-chi / 2)).otherwise(2 * tail(F.sqrt(chi)))
        # pairs of equal symbols among all pairs: sorted, then runs of equals
        values = F.transform(chars, lambda c: F.instr(s["alphabet"], c))
        same = F.aggregate(F.sort_array(values), F.struct(F.lit(0).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("pairs")), lambda a, v: F.struct(v.alias("last"), F.when(a["last"] == v, a["run"] + 1).otherwise(0).alias("run"), (a["pairs"] + F.when(a["last"] == v, a["run"] + 1).otherwise(0)).alias("pairs")))["pairs"]
        mean = n * (n - 1) / 2 / F.length(s["alphabet"])
        p_same = tail(F.greatest(F.lit(0.0), (same - 0.5 - mean) / F.sqrt(mean)))
        kind = lambda c: F.when(c.rlike("[a-z]"), 0).when(c.rlike("[A-Z]"), 1).otherwise(2)
        changes = F.aggregate(chars, F.struct(F.lit(-1).alias("last"), F.lit(0).alias("n")), lambda a, c: F.struct(kind(c).alias("last"), (a["n"] + F.when((a["last"] >= 0) & (a["last"] != kind(c)), 1).otherwise(0)).alias("n")))["n"]
        turn = 1.0 - s["lower"] * s["lower"] - s["upper"] * s["upper"] - rest * rest
        p_runs = 2 * tail(F.greatest(F.lit(0.0), (F.abs(changes - (n - 1) * turn) - 0.5) / F.sqrt((n - 1) * turn * (1 - turn))))
        zero = F.struct(F.lit(0.0).alias("last"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("squares"), F.lit(0.0).alias("products"))
        sums = lambda v: F.aggregate(v, zero, lambda a, x: F.struct(x.cast("double").alias("last"), (a["sum"] + x).alias("sum"), (a["squares"] + x * x).alias("squares"), (a["products"] + a["last"] * x).alias("products")))

        def serial(q: Column) -> Column:
            # the sequence closed to a circle, so that all pairs of neighbours have one mean
            first = F.get(values, 0)
            m = q["sum"] / n
            spread = q["squares"] / n - m * m
            r = F.when(spread > 0, ((q["products"] + q["last"] * first) / n - m * m) / spread).otherwise(1.0)
            return 2 * tail(F.abs(r + 1 / (n - 1)) * F.sqrt(n - 1.0))

        p_serial = let(sums(values), serial)
        choices = F.when(s["vowel"] > 0, 2).otherwise(1)
        chance = F.least(F.lit(1.0), 4 * choices * F.least(p_class, p_same, p_runs, p_serial))
        p = ordinary(token, turn, s["upper"] > 0)
        return F.struct(F.length(token).alias("n"), F.when(n >= 8, p).otherwise(1.0).alias("p"), F.when(n >= 8, chance).otherwise(0.0).alias("chance"))

    return let(setting, battery)


def band(n: Column) -> Column:
    """Bands of lengths, a factor of two apart by halves."""
    return F.floor(2 * F.log2(n.cast("double"))).cast("int")


def bin_of(p: Column, battery: Battery) -> Column:
    return F.least(F.lit(battery.bins), F.floor(-10 * F.log10(F.greatest(p, F.lit(1e-300)))).cast("int"))


def candidates(text: Column, base: Column, battery: Battery) -> Column:
    """Runs that may be secrets and that no span of base touches, with their test results."""
    runs = F.filter(matches(text, battery.run), lambda x: ~x["value"].rlike("^[0-9a-f]+$") & ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return F.transform(runs, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), tested(x["value"]).alias("t")))


def cutoffs(runs: DataFrame, battery: Battery) -> dict[int, int]:
    """Band to the least bin that Benjamini-Hochberg takes for secrets, from the p-values of every candidate (__runs); one row a band comes to the driver."""
    from pyspark.sql import Window

    each = runs.select(F.explode("__runs.t").alias("t")).select(band(F.col("t.n")).alias("band"), bin_of(F.col("t.p"), battery).alias("bin"))
    counts = cut(each.groupBy("band", "bin").agg(F.count(F.lit(1)).alias("n")))
    up = Window.partitionBy("band").orderBy(F.desc("bin"))
    ranked = counts.select("band", "bin", F.sum("n").over(up).alias("rank"), F.sum("n").over(Window.partitionBy("band")).alias("all"))
    passed = ranked.filter(F.pow(F.lit(10.0), -F.col("bin") / 10) <= battery.fdr * F.col("rank") / F.col("all"))
    return {r[0]: r[1] for r in passed.groupBy("band").agg(F.min("bin")).collect()}


def scan(docs: DataFrame, battery: Battery | None = None, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """docs' columns (or those of keep) with __base and __spans (all, by start and kind): arrays of (start, kind_no, kind, end).

    The texts are read once: spans and tested candidates are written in the shared folder, and the corpus-wide cut-offs are applied to them.
    """
    battery = battery or Battery()
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("__base", "__spans", "__runs") and (keep is None or c in keep)]
    body = text_of(f"`{text}`")
    based = docs.select(*own, F.when(body.rlike(battery.run), body).alias("__body"), base_spans(body).cast(SPAN).alias("__base"))
    none = F.array().cast("array<struct<start: int, end: int, t: struct<n: int, p: double, chance: double>>>")
    runs = F.when(F.col("__body").isNotNull(), candidates(F.col("__body"), F.col("__base"), battery)).otherwise(none)
    one = written(based.select(*own, "__base", runs.alias("__runs")), "secrets")
    limits = cutoffs(one, battery)
    table = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]) if limits else F.create_map().cast("map<int,int>")
    found = lambda t: (bin_of(t["p"], battery) >= F.coalesce(F.try_element_at(table, band(t["n"])), F.lit(battery.bins + 1))) & (t["chance"] >= battery.level)
    random = F.filter("__runs", lambda x: found(x["t"]))
    return one.select(*own, "__base", F.sort_array(F.concat("__base", spans_of(random, "random").cast(SPAN))).alias("__spans"))


def told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with each stretch of overlapping spans replaced by one mark."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        fresh = F.array_append(F.array_append(a["out"], F.substr(text, a["at"] + 1, s["start"] - a["at"])), F.lit(mark))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], fresh).otherwise(a["out"]).alias("out"))

    joined = let(F.aggregate(spans, zero, step), lambda a: F.concat(F.array_join(a["out"], ""), F.substr(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, joined).otherwise(text)
