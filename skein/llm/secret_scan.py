"""Secret scanning with patterns and a battery of randomness tests, in DataFrame and SQL functions only.

Three patterns find assignments, access keys and long hexadecimal runs. Beside them every long run of encoding
characters is a candidate: its encoding is inferred (hexadecimal, base 32, 36 or 64, letters of both cases or of one), and three tests ask whether its
symbols could be uniformly random: chi-squared on the alphabet (its symbols, and its digits and cases), runs above and
below the middle, and serial correlation. The p-values are combined by Fisher's method. Dismissing a candidate as not random is a discovery;
within each length class those are made by Benjamini and Hochberg's rule, because short strings have weak tests and
long ones strong tests. Candidates that are not dismissed are reported as `random`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import cut_lineage

#: Fixed by the contract, in the order of kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_VALUE_LENGTH = 12
KINDS = ("assign", "access", "hex", "random")
#: Candidates for the tests (an equals sign is padding at the end, or parts a name from a value), their least length with padding, and the share of dismissals that may be random strings.
#: A run with hyphens or underscores is one candidate if it has letters of both cases and digits, as base 64 has; else each of its parts is one.
_RUN = "[A-Za-z0-9+/_-]"
CANDIDATE = rf"(?<!{_RUN})(?={_RUN}*[a-z])(?={_RUN}*[A-Z])(?={_RUN}*[0-9]){_RUN}{{16,}}={{0,6}}|[A-Za-z0-9+/]{{16,}}={{0,6}}"
CANDIDATE_LENGTH = 20
FALSE_DISCOVERIES = 0.01
#: Letters of one case are taken for a code from this length on: shorter ones are words too often.
ONE_CASE_LENGTH = 28
#: p-values are counted in bins of a hundredth of a decimal power, down to this power.
BINS, LOWEST_POWER = 100, 15
_SPAN = "struct<start:bigint,kind_no:int,end:bigint,kind:string>"


def _tokens(text: str, pattern: str) -> tuple[Column, Column]:
    """All matches and the pieces of text around them."""
    return F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)), F.split(F.col(text), pattern, -1)


_PLACES = "array<struct<start:bigint,end:bigint,token:string>>"
#: Matches are placed in parts of this many, so that no long array grows by one element at a time.
_PART = 1024
_LOCATE = f"""
  CASE WHEN size({{m}}) = 0 THEN CAST(array() AS {_PLACES}) ELSE
  flatten(aggregate(
    transform(sequence(0, (size({{m}}) - 1) div {_PART}), k ->
      aggregate(sequence(CAST(k AS int) * {_PART}, least(size({{m}}), (CAST(k AS int) + 1) * {_PART}) - 1),
        named_struct('at', 0L, 'out', CAST(array() AS {_PLACES})),
        (acc, i) -> named_struct(
          'at', acc.at + length({{g}}[i]) + length({{m}}[i]),
          'out', concat(acc.out, array(named_struct('start', acc.at + length({{g}}[i]), 'end', acc.at + length({{g}}[i]) + length({{m}}[i]), 'token', {{m}}[i])))))),
    named_struct('at', 0L, 'out', CAST(array() AS array<{_PLACES}>)),
    (acc, part) -> named_struct(
      'at', acc.at + part.at,
      'out', concat(acc.out, array(transform(part.out, s -> named_struct('start', acc.at + s.start, 'end', acc.at + s.end, 'token', s.token))))),
    acc -> acc.out)) END
"""


def _upper(z: str) -> str:
    """The upper tail of the normal distribution (Abramowitz and Stegun 26.2.17), for a column expression."""
    t = f"(1 / (1 + 0.2316419D * abs({z})))"
    tail = f"(exp(-{z} * {z} / 2) * 0.3989422804014327D * {t} * (0.319381530D + {t} * (-0.356563782D + {t} * (1.781477937D + {t} * (-1.821255978D + {t} * 1.330274429D)))))"
    return f"(CASE WHEN {z} >= 0 THEN {tail} ELSE 1 - {tail} END)"


_STEPS = [
    # The text of a candidate without padding, and the size of its alphabet; 0 if no encoding fits.
    f"""transform(filter(found, c -> length(c.token) >= {CANDIDATE_LENGTH}), c -> named_struct('start', c.start, 'end', c.end, 't', regexp_replace(c.token, '=+$', '')))""",
    """transform(found, c -> named_struct('start', c.start, 'end', c.end, 't', c.t, 'k',
        CASE WHEN length(c.t) < 16 THEN 0
             WHEN (c.t RLIKE '^[0-9a-f]+$' OR c.t RLIKE '^[0-9A-F]+$') AND c.t RLIKE '[0-9]' AND c.t RLIKE '[a-fA-F]' THEN 16
             WHEN (c.t RLIKE '^[A-Z2-7]+$' OR c.t RLIKE '^[a-z2-7]+$') AND c.t RLIKE '[2-7]' AND c.t RLIKE '[A-Za-z]' THEN 32
             WHEN (c.t RLIKE '^[A-Z0-9]+$' OR c.t RLIKE '^[a-z0-9]+$') AND c.t RLIKE '[0-9]' AND c.t RLIKE '[A-Za-z]' THEN 36
             WHEN c.t RLIKE '^[A-Za-z0-9+/_-]+$' AND c.t RLIKE '[a-z]' AND c.t RLIKE '[A-Z]' AND c.t RLIKE '[0-9]' THEN 64
             WHEN c.t RLIKE '^[A-Za-z]+$' AND c.t RLIKE '[a-z]' AND c.t RLIKE '[A-Z]' THEN 52
             WHEN length(c.t) >= {n} AND (c.t RLIKE '^[a-z]+$' OR c.t RLIKE '^[A-Z]+$') THEN 26
             ELSE 0 END))""".replace("{n}", str(ONE_CASE_LENGTH)),
    # How far digits, cases, letters and vowels are from their shares of the alphabet.
    """transform(filter(found, c -> c.k > 0), c -> named_struct('start', c.start, 'end', c.end, 't', c.t, 'k', c.k,
        'n', CAST(length(c.t) AS double), 'vowels', CAST(length(regexp_replace(c.t, '[^aeiouyAEIOUY]', '')) AS double), 'digits', CAST(length(regexp_replace(c.t, '[^0-9]', '')) AS double),
        'lower', CAST(length(regexp_replace(c.t, '[^a-z]', '')) AS double), 'upper', CAST(length(regexp_replace(c.t, '[^A-Z]', '')) AS double)))""",
    """transform(found, c -> named_struct('start', c.start, 'end', c.end, 't', c.t, 'k', c.k, 'df', CASE c.k WHEN 64 THEN 2D ELSE 1D END,
        'cells', CASE c.k WHEN 16 THEN pow(c.digits - c.n * 10 / 16, 2D) * (1 / (c.n * 10 / 16) + 1 / (c.n * 6 / 16))
                          WHEN 32 THEN pow(c.digits - c.n * 6 / 32, 2D) * (1 / (c.n * 6 / 32) + 1 / (c.n * 26 / 32))
                          WHEN 36 THEN pow(c.digits - c.n * 10 / 36, 2D) * (1 / (c.n * 10 / 36) + 1 / (c.n * 26 / 36))
                          WHEN 52 THEN pow(c.lower - c.n * 26 / 52, 2D) * (1 / (c.n * 26 / 52) + 1 / (c.n * 26 / 52))
                          WHEN 26 THEN pow(c.vowels - c.n * 6 / 26, 2D) * (1 / (c.n * 6 / 26) + 1 / (c.n * 20 / 26))
                          ELSE pow(c.lower - c.n * 26 / 64, 2D) / (c.n * 26 / 64) + pow(c.upper - c.n * 26 / 64, 2D) / (c.n * 26 / 64)
                               + pow(c.n - c.lower - c.upper - c.n * 12 / 64, 2D) / (c.n * 12 / 64) END))""",
    # The symbols as numbers: the text is brought to its alphabet once, split once, and each symbol looked up.
    """transform(found, c -> named_struct('start', c.start, 'end', c.end, 'k', c.k,
        'classes', (pow(c.cells / c.df, 1D / 3) - (1 - 2 / (9 * c.df))) / sqrt(2 / (9 * c.df)),
        'letters', filter(split(CASE c.k WHEN 16 THEN lower(c.t) WHEN 64 THEN translate(c.t, '-_', '+/') WHEN 52 THEN c.t ELSE upper(c.t) END, ''), x -> x <> ''),
        'alphabet', CASE c.k WHEN 16 THEN '0123456789abcdef' WHEN 32 THEN 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'
                             WHEN 36 THEN '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ'
                             WHEN 52 THEN 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz'
                             WHEN 26 THEN 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'
                             ELSE 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/' END))""",
    """transform(found, c -> named_struct('start', c.start, 'end', c.end, 'k', c.k, 'classes', c.classes,
        'x', transform(c.letters, x -> CAST(instr(c.alphabet, x) - 1 AS double))))""",
    """transform(found, c -> named_struct('start', c.start, 'end', c.end, 'k', CAST(c.k AS double), 'classes', c.classes, 'x', c.x,
        'n', CAST(size(c.x) AS double), 'mean', aggregate(c.x, 0D, (a, v) -> a + v) / size(c.x),
        'squares', aggregate(array_distinct(c.x), 0D, (a, v) -> a + pow(size(filter(c.x, y -> y = v)), 2D)),
        'low', CAST(size(filter(c.x, v -> v < c.k / 2)) AS double),
        'runs', 1D + size(filter(sequence(1, size(c.x) - 1), i -> (c.x[i] < c.k / 2) <> (c.x[i - 1] < c.k / 2)))))""",
    """transform(found, c -> named_struct('start', c.start, 'end', c.end, 'n', c.n, 'classes', c.classes,
        'chi', (c.k / c.n * c.squares - c.n - (c.k - 1)) / sqrt(2 * (c.k - 1) * (c.n - 1) / c.n),
        'product', 2 * c.low * (c.n - c.low), 'runs', c.runs,
        'around', aggregate(c.x, 0D, (a, v) -> a + pow(v - c.mean, 2D)),
        'next', aggregate(sequence(1, size(c.x) - 1), 0D, (a, i) -> a + (c.x[i] - c.mean) * (c.x[i - 1] - c.mean))))""",
    """transform(found, c -> named_struct('start', c.start, 'end', c.end, 'n', c.n, 'classes', c.classes, 'chi', c.chi,
        'run', CASE WHEN c.product <= c.n THEN 9D ELSE (c.runs - 1 - c.product / c.n) / sqrt(c.product * (c.product - c.n) / (c.n * c.n * (c.n - 1))) END,
        'serial', CASE WHEN c.around = 0 THEN 9D ELSE (c.next / c.around + 1 / c.n) * sqrt(c.n) END))""",
    f"""transform(found, c -> named_struct('start', c.start, 'end', c.end, 'n', c.n, 'half',
        -ln(greatest(1e-15D, {_upper('c.chi')})) - ln(greatest(1e-15D, {_upper('c.classes')})) - ln(greatest(1e-15D, least(1D, 2 * {_upper('abs(c.run)')}))) - ln(greatest(1e-15D, least(1D, 2 * {_upper('abs(c.serial)')})))))""",
    f"""transform(found, c -> named_struct('start', c.start, 'end', c.end, 'size', CAST(floor(log2(c.n)) AS int),
        'bin', CAST(least({BINS * LOWEST_POWER}D, floor(-{BINS} * log10(greatest(1e-300D, exp(-c.half) * (1 + c.half + c.half * c.half / 2 + c.half * c.half * c.half / 6))))) AS int)))""",
]


def _dismissals(tested: DataFrame, rate: float) -> dict[int, int]:
    """For each length class the first bin of p-values that is dismissed; one row a class reaches the driver."""
    bins = tested.select(F.explode("found").alias("c")).groupBy("c.size", "c.bin").agg(F.count("*").alias("n"))
    # Bins and classes are bounded, so these windows are too. A bin's p-value is its upper border.
    bins = bins.selectExpr("size", "bin", "sum(n) OVER (PARTITION BY size ORDER BY bin DESC) AS upto", "sum(n) OVER (PARTITION BY size) AS m")
    passed = bins.filter(F.pow(F.lit(10.0), -F.col("bin") / F.lit(float(BINS))) <= F.lit(rate) * F.col("upto") / F.col("m"))
    return {r["size"]: r["b"] for r in passed.groupBy("size").agg(F.min("bin").alias("b")).collect()}


def find_secrets(docs: DataFrame, carry: tuple[str, ...] | None = None, text_col: str = "text", rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """(doc, base, spans) for every row of `docs`, `doc` being the row or its columns `carry`.

    `base` has the spans of the three patterns and `spans` those and the `random` ones that overlap no base span;
    each is an array of (start, kind_no, end, kind) by start, then kind, in code points with the end excluded. A match
    of the assignment pattern spans its whole text and counts if its value has 12 characters. Null and empty texts
    have no spans; repeated rows each get theirs. The tests' thresholds depend on all candidates of the table.
    """
    text = docs.select(F.struct(*(carry or ["*"])).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    patterns = {"a": ASSIGN, "k": ACCESS, "h": HEX, "c": CANDIDATE}
    found = text.select("doc", "t", *(_tokens("t", p)[0].alias(f"m_{n}") for n, p in patterns.items()))
    found = found.select("doc", *(f"m_{n}" for n in patterns), *(F.when(F.size(f"m_{n}") > 0, _tokens("t", p)[1]).alias(f"g_{n}") for n, p in patterns.items()))
    found = found.select("doc", *(F.expr(_LOCATE.format(m=f"m_{n}", g=f"g_{n}")).alias(n) for n in patterns))

    def kind(name: str, no: int, keep: Column | None = None) -> Column:
        spans = F.transform(F.col(name), lambda s: F.struct(s["start"].alias("start"), F.lit(no).alias("kind_no"), s["end"].alias("end"), F.lit(KINDS[no]).alias("kind")))
        return spans.cast(f"array<{_SPAN}>")

    long_value = F.filter("a", lambda s: F.length(F.regexp_extract(s["token"], ASSIGN, 2)) >= ASSIGN_VALUE_LENGTH)
    found = found.withColumn("a", long_value)
    tested = found.select("doc", F.array_sort(F.concat(kind("a", 0), kind("k", 1), kind("h", 2))).alias("base"), F.col("c").alias("found"))
    for step in _STEPS:
        tested = tested.withColumn("found", F.expr(step))
    tested = cut_lineage(tested)
    dismissed = _dismissals(tested, rate)
    limit = F.lit(BINS * LOWEST_POWER + 1)
    limits = F.create_map(*(x for size, b in dismissed.items() for x in (F.lit(size), F.lit(b)))) if dismissed else None
    random = F.filter("found", lambda c: c["bin"] < (F.coalesce(limits[c["size"]], limit) if limits is not None else limit))
    random = F.filter(random, lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    more = F.transform(random, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind_no"), c["end"].alias("end"), F.lit(KINDS[3]).alias("kind"))).cast(f"array<{_SPAN}>")
    return tested.select("doc", "base", F.array_sort(F.concat("base", more)).alias("spans"))


def spans_text(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """`docs` with each run of overlapping spans replaced by `mark`; all other columns untouched."""
    found = find_secrets(docs, text_col=text_col).withColumn("t", F.col(f"doc.`{text_col}`"))
    cut = F.expr(
        f"""aggregate(spans, named_struct('at', 0L, 'out', ''),
              (acc, s) -> CASE WHEN s.start >= acc.at
                THEN named_struct('at', s.end, 'out', concat(acc.out, substr(t, acc.at + 1, s.start - acc.at), '{mark}'))
                ELSE named_struct('at', greatest(acc.at, s.end), 'out', acc.out) END,
              acc -> concat(acc.out, substr(t, acc.at + 1)))"""
    )
    return found.withColumn("clean", F.when(F.size("spans") > 0, cut).otherwise(F.col("t"))).select(*[F.col("clean").alias(c) if c == text_col else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
