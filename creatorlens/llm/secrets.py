"""Secret scan: patterns of known secrets, and a randomness test battery for unknown ones.

Everything is built-in expressions. A pattern's places come from the lengths of the matches
and of the text between them, summed up along the array.

The battery looks at long runs of token characters outside the matches, by their letters and
digits. Its question is whether text could look this random, so its nulls are fitted to the
corpus: the neighbours of all distinct runs are counted (at most 62 x 62 pairs of symbols), and
a run's encoding (hexadecimal, base32, base64) says to which alphabet they are restricted.

* chi-squared uniformity: pairs of equal symbols (the statistic is linear in their number)
  against those of text over the encoding's alphabet;
* runs: changes between lower case, upper case and digits against the corpus's rate; left out
  where a run has one class only;
* serial dependence: the mean information of neighbours about each other, which is high where
  symbols follow each other as in the corpus. Runs in which codes correlate as in counters and
  alphabets (0.8 not rejected) are not reported.

The standardised statistics are added up (Stouffer). Their sum's median and lower spread over the
distinct runs of a class of length (powers of two) are its null, so correlation between the tests
and all else that text does is measured, and discoveries, which lie above, hardly move it. Fixed
values with the weight of some hundred runs stand in where a class has few. False discoveries are
controlled by Benjamini and Hochberg's step-up rule within classes of length, over distinct runs.
p-values are rounded up to steps of a hundredth of a decimal power; the counts per class and step
are few.

Limit: what most distinct runs of a class of length look like counts as text. Where more than half
of them are random, random runs are no discovery.

Edge cases: null text is empty and has no spans. Decimal numbers are never reported by the
battery, and neither is a run that overlaps a match. Positions are code points, ends exclusive. Each row is
judged on its own; repeated rows give repeated results. Very long texts are searched whole.
Spans that begin at one place are listed by kind; runs of equal probability are reported or
not together. An empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Patterns of the known kinds, in the order in which equal starts are listed (fixed values).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
ASSIGN_CHARS = 12
KINDS = ("assign", "access", "hex", "random")

#: Runs that the battery tests.
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: Encodings by their letters and digits, and the symbols of each, case folded.
ENCODINGS = (
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("base32", "^[A-Z2-7]+$", "234567abcdefghijklmnopqrstuvwxyz"),
    ("base64", "^[A-Za-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
)
SYMBOLS = 36  # letters and digits, case folded
CODES = 128
#: Stand-in for a corpus of few runs: letters of English text in thousandths, a to z (fixed
#: values); digits share the rest.
LETTERS = (80, 15, 27, 42, 125, 22, 20, 60, 68, 2, 8, 40, 24, 68, 74, 19, 1, 60, 63, 90, 27, 10, 23, 2, 20, 1)
PRIOR_PAIRS = 20000.0  # weight of that text in the counts of neighbours
RARE_PAIR = 5.0  # added to a pair's count and expectation: few counts say little
PRIOR_RUNS = 300.0  # weight of the standard null in a class of length
SWITCHES = 0.15  # chance of a change of character class there
CORRELATION = 0.8  # least correlation of neighbours in an ordered string
RATE = 0.05  # false discovery rate
NOT_ORDERED = 1.645  # normal deviate from that correlation that rejects it
STEPS = 100  # steps per decimal power of p
BLOCK = 256  # matches summed up at a time


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running_sum(numbers: Column) -> Column:
    """Inclusive sums along an array: inside blocks first, then with what lies before each."""

    def in_block(block: Column) -> Column:
        last = lambda acc: F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0).cast("long"))
        return F.aggregate(block, F.array().cast("array<long>"), lambda acc, x: F.concat(acc, F.array(last(acc) + x)))

    def joined(blocks: Column) -> Column:
        ends = F.transform(blocks, lambda b: F.element_at(b, -1))
        before = lambda i: F.aggregate(F.slice(ends, 1, i), F.lit(0).cast("long"), lambda acc, x: acc + x)
        return F.flatten(F.transform(blocks, lambda b, i: _let(before(i), lambda o: F.transform(b, lambda x: x + o))))

    starts = F.sequence(F.lit(1), F.size(numbers), F.lit(BLOCK))
    blocks = F.transform(starts, lambda at: in_block(F.slice(numbers, at, F.lit(BLOCK))))
    return F.when(F.size(numbers) > 0, _let(blocks, joined)).otherwise(F.array().cast("array<long>"))


_SPANS = "array<struct<start:long,end:long,token:string>>"


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with their places."""
    def placed(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("long"))
        sizes = F.transform(found, lambda m: F.length(m).cast("long"))
        # between two ends lie one gap and one match
        steps = F.zip_with(F.slice(gaps, 1, F.greatest(F.size(found), F.lit(0))), sizes, lambda g, s: g + s)
        ends = _let(steps, _running_sum)
        return F.zip_with(found, ends, lambda m, end: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("token")))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.rlike(pattern), _let(found, placed)).otherwise(F.array().cast(_SPANS)).cast(_SPANS)


def _tail(z: Column) -> Column:
    """-log10 of a bound on the upper tail of the normal distribution, 0 for z <= 0
    (Lin's approximation)."""
    return _let(z, lambda x: F.when(x > 0, (0.717 * x + 0.416 * x * x) / math.log(10) + math.log10(2)).otherwise(0.0))


def _body(token: Column) -> Column:
    return F.regexp_replace(token, "[^A-Za-z0-9]", "")


def _testable(token: Column) -> Column:
    return ~token.rlike("^[0-9]+$") & (F.length(_body(token)) > 3)


def _codes(body: Column) -> Column:
    return F.transform(F.filter(F.split(body, ""), lambda c: c != ""), lambda c: F.ascii(c))


def _neighbours(array: Column, pair) -> Column:
    return F.zip_with(F.slice(array, 1, F.size(array) - 1), F.slice(array, 2, F.size(array) - 1), pair)


def _folded(code):
    """0 to 35: digits, letters."""
    if isinstance(code, Column):
        return F.when(code < 58, code - 48).when(code < 97, code - 55).otherwise(code - 87)
    return code - 48 if code < 58 else code - 55 if code < 97 else code - 87


@dataclass
class Nulls:
    """How text-like runs behave. Its size is fixed, whatever the corpus."""

    moments: dict[str, tuple[float, float, float]]  # by encoding: sums of p^2, p^3 and p^4
    switches: float
    information: list[float]  # of a pair of folded symbols, in nats
    mean: float
    spread: float


def fitted(pairs: dict[tuple[int, int], int]) -> Nulls:
    """From counts of neighbours (codes of letters and digits)."""
    digit = (1000 - sum(LETTERS)) / 10
    prior = [max(x, 0.5) for x in [digit] * 10 + list(LETTERS)]
    prior = [x / sum(prior) for x in prior]
    total = sum(pairs.values()) + PRIOR_PAIRS
    joint = [PRIOR_PAIRS * x * y for x in prior for y in prior]
    changes = PRIOR_PAIRS * SWITCHES
    for (a, b), n in pairs.items():
        joint[_folded(a) * SYMBOLS + _folded(b)] += n
        changes += n * ((a < 58, a < 97) != (b < 58, b < 97))
    joint = [x / total for x in joint]
    left = [sum(joint[i * SYMBOLS : (i + 1) * SYMBOLS]) for i in range(SYMBOLS)]
    right = [sum(joint[i::SYMBOLS]) for i in range(SYMBOLS)]
    rare = RARE_PAIR / total
    information = [math.log((p + rare) / (left[i // SYMBOLS] * right[i % SYMBOLS] + rare)) for i, p in enumerate(joint)]
    mean = sum(p * x for p, x in zip(joint, information))
    spread = math.sqrt(sum(p * (x - mean) ** 2 for p, x in zip(joint, information)))
    moments = {}
    for name, _, alphabet in ENCODINGS:
        mine = [left[_folded(ord(c))] for c in alphabet]
        mine = [x / sum(mine) for x in mine]
        moments[name] = tuple(sum(x**k for x in mine) for k in (2, 3, 4))
    return Nulls(moments, changes / total, information, mean, max(spread, 0.5))


def statistics(token: Column, nulls: Nulls) -> Column:
    """(uniform, runs, serial, ordered) of a testable run; each is larger the less text-like it
    is, ordered where its codes correlate like a counter's."""
    information = F.split(F.lit(",".join(f"{x:.9g}" for x in nulls.information)), ",").cast("array<double>")

    def of_encoding(body: Column, k: int) -> Column:
        out = F.lit(None).cast("double")
        for name, pattern, _ in reversed(ENCODINGS):
            out = F.when(body.rlike(pattern), F.lit(nulls.moments[name][k])).otherwise(out)
        return out

    def tests(v: Column) -> Column:
        s, codes, table = v["body"], v["codes"], information
        n = F.length(s).cast("double")
        all_pairs = n * (n - 1) / 2
        pairs = F.aggregate(
            F.array_distinct(F.filter(F.split(s, ""), lambda c: c != "")), F.lit(0.0),
            lambda acc, c: acc + _let(n - F.length(F.replace(s, c, F.lit(""))), lambda m: m * (m - 1) / 2),
        )
        m2, m3 = of_encoding(s, 0), of_encoding(s, 1)
        variance = n * (n - 1) * (n - 2) * (m3 - m2 * m2) + all_pairs * (m2 - m2 * m2)
        uniform = (all_pairs * m2 - pairs) / F.sqrt(variance)

        kind = lambda c: F.when(c < 58, 1).when(c < 97, 2).otherwise(3)
        changes = F.aggregate(_neighbours(codes, lambda x, y: kind(x) != kind(y)), F.lit(0.0), lambda a, d: a + d.cast("double"))
        rate = nulls.switches
        runs = F.when(changes > 0, (changes - (n - 1) * rate) / F.sqrt((n - 1) * rate * (1 - rate))).otherwise(0.0)

        known = F.aggregate(
            _neighbours(codes, lambda x, y: F.get(table, _folded(x) * SYMBOLS + _folded(y))), F.lit(0.0), lambda a, x: a + x
        )
        serial = ((n - 1) * nulls.mean - known) / (F.sqrt(n - 1) * nulls.spread)

        mean = F.aggregate(codes, F.lit(0.0), lambda a, x: a + x) / n
        moments = _let(mean, lambda m: F.array(
            F.aggregate(_neighbours(codes, lambda x, y: (x - m) * (y - m)), F.lit(0.0), lambda a, p: a + p),
            F.aggregate(codes, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)),
        ))
        rho = _let(moments, lambda w: F.when(w[1] > 0, F.greatest(F.least(w[0] / w[1], F.lit(0.999)), F.lit(-0.999))).otherwise(0.999))
        apart = (math.atanh(CORRELATION) - F.abs(F.atanh(rho))) * F.sqrt(n - 3)
        return F.struct(
            uniform.alias("uniform"), runs.alias("runs"), serial.alias("serial"), (apart < NOT_ORDERED).alias("ordered")
        )

    made = _let(_body(token), lambda body: F.struct(body.alias("body"), _codes(body).alias("codes")))
    return _let(made, tests)


def length_class(length: Column) -> Column:
    return F.floor(F.log2(length.cast("double"))).cast("int")


NAMES = ("uniform", "runs", "serial")
#: Quantiles of a null: below the middle, the middle, above it, with their normal deviates.
QUANTILES, LOW, HIGH = (0.16, 0.5, 0.95), 1.0, 1.645


def _scales(values: DataFrame, names: tuple[str, ...], variance: float) -> dict[int, dict[str, tuple[float, float]]]:
    """By length class (a few dozen at most): location and scale of each column."""
    found = values.groupBy("c").agg(F.count("*").alias("n"), *[F.percentile_approx(k, list(QUANTILES), 10000).alias(k) for k in names])
    out: dict[int, dict[str, tuple[float, float]]] = {}
    for r in found.collect():
        weight = r["n"] / (r["n"] + PRIOR_RUNS)
        out[r["c"]] = {}
        for k in names:
            low, middle, high = r[k]
            # discoveries are few and lie above: they may not widen a small class's null
            spread = max((middle - low) / LOW, (high - middle) / HIGH)
            scale = math.sqrt(weight**2 * spread**2 + (1 - weight**2) * variance)
            out[r["c"]][k] = (weight * middle, max(scale, math.sqrt(variance) / 2))
    return out


def _of_class(classes: dict, name: str, k: int, length: Column) -> Column:
    pairs = [F.lit(x) for c, v in sorted(classes.items()) for x in (c, float(v[name][k]))]
    return F.element_at(F.create_map(*pairs), length_class(length))


def _sum(stats: Column, classes: dict, length: Column) -> Column:
    total = F.lit(0.0)
    for name in NAMES:
        total = total + (stats[name] - _of_class(classes, name, 0, length)) / _of_class(classes, name, 1, length)
    return total


def class_nulls(tokens: DataFrame, nulls: Nulls) -> dict[int, dict[str, tuple[float, float]]]:
    """By length class: location and scale of each statistic and of the sum of all."""
    length = F.length("token")
    stats = stored(tokens.select(length.alias("length"), length_class(length).alias("c"), statistics(F.col("token"), nulls).alias("s")), "secret-stats")
    classes = _scales(stats.select("c", "s.*"), NAMES, 1.0)
    if classes:
        # the standard null: variance of three statistics, correlated by a third
        sums = _scales(stats.select("c", _sum(F.col("s"), classes, F.col("length")).alias("sum")), ("sum",), 5.0)
        for c, v in sums.items():
            classes[c].update(v)
    return classes


def evidence(token: Column, nulls: Nulls, classes: dict) -> Column:
    """-log10 p of the hypothesis that the token is text-like; null if it is not tested."""
    if not classes:
        return F.lit(None).cast("double")
    length = F.length(token)

    def p(stats: Column) -> Column:
        z = (_sum(stats, classes, length) - _of_class(classes, "sum", 0, length)) / _of_class(classes, "sum", 1, length)
        return F.when(stats["ordered"], 0.0).otherwise(_tail(z))

    return F.when(_testable(token), _let(statistics(token, nulls), p))


_PLACES = "array<struct<start:long,kind:int,end:long>>"


def _of_kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"))).cast(_PLACES)


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, base and added: arrays of (start, kind, end), kind an index of KINDS."""
    text = F.coalesce(F.col("text"), F.lit(""))
    value = lambda s: F.regexp_extract(s["token"], ASSIGN, 2)
    places = docs.select("doc_id", text.alias("text")).select(
        "doc_id",
        F.array_sort(
            F.concat(
                _of_kind(F.filter(matches(F.col("text"), ASSIGN), lambda s: F.length(value(s)) >= ASSIGN_CHARS), 0),
                _of_kind(matches(F.col("text"), ACCESS), 1),
                _of_kind(matches(F.col("text"), HEX), 2),
            )
        ).alias("base"),
        matches(F.col("text"), RUN).alias("runs"),
    )
    places = stored(places, "secret-places")
    apart = lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"]))
    places = places.withColumn("runs", F.filter("runs", lambda r: apart(r) & _testable(r["token"])))

    # repeated runs count once in what is fitted
    tokens = stored(places.select(F.explode("runs.token").alias("token")).groupBy("token").count(), "secret-runs").select("token")
    pair = F.explode(_let(_codes(_body(F.col("token"))), lambda codes: _neighbours(codes, lambda x, y: x * CODES + y)))
    # one row per pair of letters and digits: 62 x 62 at most
    pairs = tokens.select(pair.alias("pair")).groupBy("pair").count().collect()
    nulls = fitted({(r.pair // CODES, r.pair % CODES): r["count"] for r in pairs})
    classes = class_nulls(tokens, nulls)
    step = lambda token: F.floor(evidence(token, nulls, classes) * STEPS).cast("int")
    limit = _limits(
        tokens.select(F.array(F.struct(length_class(F.length("token")).alias("length_class"), step(F.col("token")).alias("step"))).alias("runs")), rate
    )
    limits = stored(limit, "secret-limits").scalar()

    tested = places.select(
        "doc_id", "base",
        F.transform(
            "runs",
            lambda r: F.struct(
                r["start"].alias("start"), r["end"].alias("end"),
                length_class(r["end"] - r["start"]).alias("length_class"), step(r["token"]).alias("step"),
            ),
        ).alias("runs"),
    )
    tested = tested.withColumn("_limit", limits)
    random = F.filter("runs", lambda r: r["step"] >= F.coalesce(F.element_at(F.col("_limit"), r["length_class"]), F.lit(2**31 - 1)))
    return tested.select("doc_id", "base", _of_kind(random, 3).alias("added"))


def _limits(tested: DataFrame, rate: float) -> DataFrame:
    """One row: the least step that counts as a discovery, by length class. Classes and steps
    are few whatever the input, so the windows run over small groups."""
    from pyspark.sql import Window

    counts = tested.select(F.inline("runs")).groupBy("length_class", "step").agg(F.count("*").alias("n"))
    down = Window.partitionBy("length_class").orderBy(F.desc("step"))
    whole = Window.partitionBy("length_class")
    found = counts.withColumn("at_least", F.sum("n").over(down)).withColumn("m", F.sum("n").over(whole))
    p = F.pow(F.lit(10.0), -F.col("step") / STEPS)
    limits = found.where(p <= rate * F.col("at_least") / F.col("m")).groupBy("length_class").agg(F.min("step").alias("step"))
    return limits.agg(F.map_from_entries(F.collect_list(F.struct("length_class", "step"))).alias("limit"))


def written(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def count_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
