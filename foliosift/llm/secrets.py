"""Secret scans: base patterns, and a battery of randomness tests on the other tokens.

All of it is DataFrame expressions. Positions come from splitting the text at the
matches: the lengths of the pieces and of the matches alternate, in code points.

Battery. Every token of 20 or more characters in one of the encodings below is
tested for being drawn evenly from its alphabet: a chi-squared test of the counts (by
the pairs of equal characters, whose number is near Poisson), a runs test about the
alphabet's middle and a test of the lag-one serial correlation; Fisher's method combines
the three, and tokens that it rejects at ``FIT`` are not random. What it lets pass is
judged against ordinary words: the ratio of a token's likelihood under even draws to
that under a text model, in which kinds of character (digit, lower, upper, sign) change
with probability ``TEXT_CHANGE``, vowels and consonants alternate and letters have their
usual frequencies. One over that ratio is a p-value whatever the token's length (a text
reaches a ratio of r with probability 1 / r at most). P-values are divided by weights in
proportion to the token's bits (mean 1), and Benjamini and Hochberg's step-up over all
tokens of the corpus sets one threshold for the false-discovery rate ``fdr``. The step-up
reads counts in bins of -log10(p), at most ``BINS`` rows, so its size doesn't grow.

The texts are read twice, for the step-up and for the spans; between, the tested tokens' bits and
p-values are written as a table, which goes once the threshold is known. Digits alone are no encoding: numbers,
dates and ids are as even as a drawn token.

Defined results: a null text is an empty one and has no spans; repeated rows each get
their spans; an empty table gives an empty result; the input's columns are kept whatever
their names, but for one named ``spans``, which the result's own replaces.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliosift.llm.common import cut, dropped, table

# Fixed values of the contract's base patterns.
KINDS = ["assign", "access", "hex", "random"]
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Name, the token's whole form, alphabet. The first that fits holds.
ENCODINGS = [
    ("hex", r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", DIGITS + "abcdef"),
    ("hex_upper", r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+=*$", UPPER + "234567"),
    ("base36", r"^(?=.*[0-9])(?=.*[a-z])[0-9a-z]+$", DIGITS + LOWER),
    ("base36_upper", r"^(?=.*[0-9])(?=.*[A-Z])[0-9A-Z]+$", DIGITS + UPPER),
    ("base62", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z]+$", UPPER + LOWER + DIGITS),
    ("base64", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z+/]+=*$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z_-]+=*$", UPPER + LOWER + DIGITS + "-_"),
    ("base26", r"^[a-z]+$", LOWER),
    ("base26_upper", r"^[A-Z]+$", UPPER),
    ("base52", r"^(?=.*[a-z])(?=.*[A-Z])[A-Za-z]+$", UPPER + LOWER),
]
FIT, FDR, BINS, SCALE = 0.001, 0.01, 400, 10
#: Letters of English text per ten thousand, from a to z, and the shares of vowels after a vowel and after a consonant.
LETTERS = [817, 149, 278, 425, 1270, 223, 202, 609, 697, 15, 77, 403, 241, 675, 751, 193, 10, 599, 633, 906, 276, 98, 236, 15, 197, 7]
TEXT_CHANGE, VOWELS, AFTER_VOWEL, AFTER_CONSONANT = 0.25, "aeiou", 0.15, 0.58
SPAN = "array<struct<start:int,rank:int,end:int,match:string,value:string>>"


def _located(text: Column, pattern: str, value_group: int, rank: int) -> Column:
    """All matches with their places: pieces and matches alternate."""
    start = lambda acc, i: acc["at"] + F.length(F.get(F.col("_p"), i))
    found = F.aggregate(
        F.sequence(F.lit(0), F.size("_m") - 1),
        F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")),
        lambda acc, i: F.struct(
            (start(acc, i) + F.length(F.get(F.col("_m"), i))).alias("at"),
            F.array_append(
                acc["out"],
                F.struct(
                    start(acc, i).alias("start"), F.lit(rank).alias("rank"),
                    (start(acc, i) + F.length(F.get(F.col("_m"), i))).alias("end"),
                    F.get(F.col("_m"), i).alias("match"), F.get(F.col("_v"), i).alias("value"),
                ),
            ).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(F.size("_m") > 0, found).otherwise(F.array().cast(SPAN))


def _find(df: DataFrame, name: str, pattern: str, value_group: int, rank: int) -> DataFrame:
    """Adds a column of matches; only texts with a match are taken apart."""
    none = F.array().cast("array<string>")
    hit, text, rx = F.col("_text").rlike(pattern), F.col("_text"), F.lit(pattern)
    return (
        df.withColumn("_m", F.when(hit, F.regexp_extract_all(text, rx, F.lit(0))).otherwise(none))
        .withColumn("_p", F.when(F.size("_m") > 0, F.split(text, pattern, -1)).otherwise(none))
        .withColumn("_v", F.when(F.size("_m") > 0, F.regexp_extract_all(text, rx, F.lit(value_group))).otherwise(none))
        .withColumn(name, _located(text, pattern, value_group, rank))
        .drop("_m", "_p", "_v")
    )


def _tail(z: str) -> str:
    """The upper tail of the normal distribution as SQL, to about 1e-7 of its value."""
    x = f"(least(37D, abs({z})) / sqrt(2D))"
    t = f"(1 / (1 + 0.5D * {x}))"
    series = [1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    inner = "0D"
    for c in reversed(series):
        inner = f"({c}D + {t} * {inner})"
    half = f"(0.5D * {t} * exp(-{x} * {x} - 1.26551223D + {t} * {inner}))"
    return f"if({z} >= 0, {half}, 1 - {half})"


def _text_costs() -> str:
    """SQL map from a letter to -log2 of its share among vowels or consonants."""
    vowels = sum(n for c, n in zip(LOWER, LETTERS) if c in VOWELS)
    return "map(" + ", ".join(f"'{c}', {-math.log2(n / (vowels if c in VOWELS else sum(LETTERS) - vowels))!r}D" for c, n in zip(LOWER, LETTERS)) + ")"


def _tested(token: str) -> str:
    """SQL over a token: struct of its fit to evenness, p-value against text, and bits."""
    alphabet = "CASE " + " ".join(f"WHEN {token} RLIKE r'{rx}' THEN '{letters}'" for _, rx, letters in ENCODINGS) + " END"
    body = f"trim(TRAILING '=' FROM {token})"
    # each step sees the one before as a lambda variable, so nothing is computed twice
    values = "transform(sequence(1, length(t.b)), i -> locate(substr(t.b, i, 1), t.a) - 1)"
    counts = "aggregate(map_values(aggregate(t.v, CAST(map() AS MAP<INT, BIGINT>), (m, x) -> map_concat(map_filter(m, (k, n) -> k <> x), map(x, coalesce(try_element_at(m, x), 0L) + 1L)))), 0D, (s, n) -> s + n * n)"
    kinds = "translate(t.b, '{}', '{}')".format(DIGITS + LOWER + UPPER + "+/-_", "0" * 10 + "a" * 26 + "A" * 26 + "-" * 4)
    classes = "translate(lower(t.b), '{}', '{}')".format(DIGITS + LOWER + "+/-_", "0" * 10 + "".join("v" if c in VOWELS else "c" for c in LOWER) + "-" * 4)
    change, stay = -math.log2(TEXT_CHANGE / 3), -math.log2(1 - TEXT_CHANGE)
    at = lambda of, i: f"substr(t.{of}, {i}, 1)"
    share = lambda p: f"if({at('c', 'i')} = 'v', {-math.log2(p)!r}D, {-math.log2(1 - p)!r}D)"
    first = sum(n for c, n in zip(LOWER, LETTERS) if c in VOWELS) / sum(LETTERS)
    text_bits = (
        "aggregate(sequence(1, t.n), 0D, (s, i) -> s"
        f" + if(i = 1, 2D, if({at('kinds', 'i')} = {at('kinds', 'i - 1')}, {stay!r}D, {change!r}D))"
        f" + CASE {at('c', 'i')} WHEN '0' THEN {math.log2(10)!r}D WHEN '-' THEN 2D ELSE"
        f" CASE if(i = 1, '', {at('c', 'i - 1')}) WHEN 'v' THEN {share(AFTER_VOWEL)} WHEN 'c' THEN {share(AFTER_CONSONANT)} ELSE {share(first)} END"
        f" + {_text_costs()}[lower({at('b', 'i')})] END)"
    )
    high = "size(filter(t.v, x -> x >= t.k / 2))"
    runs = "(1 + aggregate(sequence(1, size(t.v) - 1), 0, (s, i) -> s + if((t.v[i] >= t.k / 2) = (t.v[i - 1] >= t.k / 2), 0, 1)))"
    mean = "aggregate(t.v, 0D, (s, x) -> s + x, s -> s / size(t.v))"
    lag = "aggregate(sequence(1, size(t.v) - 1), 0D, (s, i) -> s + (t.v[i] - t.mean) * (t.v[i - 1] - t.mean))"
    spread = "aggregate(t.v, 0D, (s, x) -> s + pow(x - t.mean, 2))"
    step = lambda source, *fields: f"transform({source}, t -> struct({', '.join(fields)}))"
    out = step(f"filter(array(struct({body} AS b, {alphabet} AS a)), t -> t.a IS NOT NULL AND length(t.b) >= 20)", "t.b AS b", "length(t.a) AS k", f"{values} AS v", f"{kinds} AS kinds", f"{classes} AS c", "length(t.b) AS n")
    out = step(out, "t.k AS k", "t.v AS v", "t.n AS n", f"{counts} AS sq", f"{text_bits} AS text_bits", f"{high} AS hi", f"{runs} AS r", f"{mean} AS mean")
    out = step(
        out, "t.k AS k", "t.n AS n", "t.text_bits AS text_bits", "greatest(1D, t.sq - t.n) AS d", "t.sq = t.n AS unlike", "t.n * (t.n - 1D) / t.k AS mu2",
        "(t.r - (2D * t.hi * (t.n - t.hi) / t.n + 1)) / sqrt(greatest(1e-9D, 2D * t.hi * (t.n - t.hi) * (2D * t.hi * (t.n - t.hi) - t.n) / (pow(t.n, 2) * (t.n - 1)))) AS z_runs",
        f"({lag} / greatest(1e-9D, {spread})) * sqrt(t.n) + 1 / sqrt(t.n) AS z_serial",
    )
    # that a Poisson number with mean mu2 / 2 reaches d / 2 is that a chi-squared one of d degrees stays below mu2
    out = step(
        out, "t.n * log2(t.k) AS bits", "t.text_bits AS text_bits", "t.unlike AS unlike", "(1 - 2 / (9 * t.d) - pow(t.mu2 / t.d, 1 / 3D)) / sqrt(2 / (9 * t.d)) AS z_even",
        "abs(t.z_runs) AS z_runs", "abs(t.z_serial) AS z_serial",
    )
    least = lambda p: f"ln(greatest(1e-300D, {p}))"
    out = step(
        out, "t.bits AS bits", "t.text_bits AS text_bits",
        f"-(if(t.unlike, 0D, {least(_tail('t.z_even'))}) + {least('2 * ' + _tail('t.z_runs'))} + {least('2 * ' + _tail('t.z_serial'))}) AS h",
    )
    out = step(out, "t.bits AS bits", "exp(-t.h) * (1 + t.h + t.h * t.h / 2) AS fit", "least(1D, pow(2D, greatest(-990D, t.bits - t.text_bits))) AS p")
    return f"get({out}, 0)"


def _scanned(df: DataFrame) -> DataFrame:
    """Adds the base spans and the tested tokens outside of them to rows (row, _text)."""
    df = _find(df, "_assign", ASSIGN, 2, 0)
    df = _find(df, "_access", ACCESS, 0, 1)
    df = _find(df, "_hex", HEX, 0, 2)
    df = _find(df, "_token", TOKEN, 0, 3)
    base = F.concat(F.filter("_assign", lambda x: F.length(x["value"]) >= 6), F.col("_access"), F.col("_hex"))
    slim = "transform(_base, x -> struct(x.start AS start, x.rank AS rank, x.end AS end))"
    outside = F.filter("_token", lambda t: ~F.exists("_base", lambda b: (b["start"] <= t["start"]) & (t["end"] <= b["end"])))
    tested = F.expr(f"filter(transform(_tokens, w -> struct(w.start AS start, w.end AS end, {_tested('w.match')} AS t)), x -> x.t.fit >= {FIT})")
    df = df.withColumn("_base", base).withColumn("_tokens", outside).withColumn("_tested", F.when(F.size("_tokens") > 0, tested).otherwise(F.expr("filter(array(struct(0 AS start, 0 AS end, struct(0D AS bits, 0D AS fit, 0D AS p) AS t)), x -> false)")))
    return df.select("row", F.expr(slim).alias("base"), "_tested")


def annotate(docs: DataFrame, *, text_column: str = "text", fdr: float = FDR) -> DataFrame:
    """docs with ``spans``: array of (start, end, kind), sorted."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(text_column), F.lit("")).alias("_text"))
    tokens = _scanned(rows.where(F.col("_text").rlike(TOKEN))).select(F.explode("_tested.t").alias("t")).select("t.bits", "t.p")
    mean, least = _step_up(tokens, fdr)
    random = F.expr(f"transform(filter(_tested, x -> {_bin('x.t.p', 'x.t.bits', mean)} >= {least}), x -> struct(x.start AS start, 3 AS rank, x.end AS end))")
    kinds = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    found = _scanned(rows).withColumn("_all", F.array_sort(F.concat("base", random)))
    spans = F.expr(f"transform(_all, x -> struct(x.start AS start, x.end AS end, {kinds}[x.rank] AS kind))")
    return found.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "spans"], spans.alias("spans"))


def _bin(p: str, bits: str, mean: float) -> str:
    """The bin of -log10 of a weighted p-value."""
    return f"CAST(least({BINS - 1}, greatest(0, floor(-log10(greatest(1e-300D, {p} / ({bits} / {mean!r}D))) * {SCALE}))) AS INT)"


def _step_up(tokens: DataFrame, fdr: float) -> tuple[float, int]:
    """Mean bits, and the least bin of -log10(weighted p) whose tokens are discoveries."""
    tokens = cut(tokens, "tokens")
    mean = tokens.agg(F.avg("bits")).first()[0] or 1.0
    bins = dict(tokens.select(F.expr(_bin("p", "bits", mean)).alias("bin")).groupBy("bin").count().collect())
    dropped(tokens)
    total, above, least = sum(bins.values()), 0, BINS
    for b in range(BINS - 1, -1, -1):
        above += bins.get(b, 0)
        if above and total * 10 ** (-b / SCALE) <= fdr * above:
            least = b
    return mean, least


def redact(docs: DataFrame, *, text_column: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs, their secrets replaced by ``mask``; spans that meet are replaced as one."""
    found = annotate(docs, text_column=text_column)
    merged = (
        "aggregate(spans, CAST(array() AS array<struct<start:int,end:int>>), (acc, x) ->"
        " if(size(acc) > 0 AND get(acc, size(acc) - 1).end >= x.start,"
        " array_append(slice(acc, 1, size(acc) - 1), struct(get(acc, size(acc) - 1).start AS start, greatest(get(acc, size(acc) - 1).end, x.end) AS end)),"
        " array_append(acc, struct(x.start AS start, x.end AS end))))"
    )
    # the text and its merged spans as lambda variables, so that no column of the input can be meant
    kept = (
        f"get(transform(array(struct(`{text_column}` AS text, {merged} AS m)), t -> array_join(transform(sequence(0, size(t.m)), i -> substr(t.text,"
        " if(i = 0, 1, get(t.m, i - 1).end + 1),"
        f" if(i = size(t.m), length(t.text), get(t.m, i).start) - if(i = 0, 0, get(t.m, i - 1).end))), '{mask}')), 0)"
    )
    return found.withColumn(text_column, F.when(F.size("spans") > 0, F.expr(kept)).otherwise(F.col(text_column))).drop("spans")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = annotate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda array: f"array_join(transform({array}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"
    count = lambda kind: F.expr(f"CAST(size(filter(spans, x -> x.kind = '{kind}')) AS BIGINT)").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.expr("sha2({0}, 256)".format(joined("filter(spans, x -> x.kind <> 'random')"))).alias("base_sha256"),
        F.expr(joined("spans")).alias("spans"), count("random"),
    )
