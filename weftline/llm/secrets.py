"""Secret scans: base patterns, and sliding-window entropy of candidate strings.

Only DataFrame functions run here; no row leaves the JVM and nothing is
shuffled.

*Base kinds*: ``assign`` (a keyword, a colon or equals sign, and a value of 8 or
more characters), ``access`` (an access key id) and ``hex`` (32 or more
lower-case hexadecimal digits), leftmost and non-overlapping per kind.

*Entropy*: a candidate is a maximal run of 20 or more characters of
``[A-Za-z0-9+/_=-]`` that holds a digit.  Parts that the allow-list names (dates,
samples and the like) are cut out of it; what is left between them falls into
pieces, and a piece that is wholly an allowed form (UUID, numbers, a numbered
slug) counts for nothing.  A piece's character class (hex, alnum or base64) sets
the threshold.  A window of 20 characters slides over it; with ``n`` the count of
each character in the window, ``S = sum(n log2 n)`` changes by two terms a step
(the character that leaves, the one that enters), and the window's entropy is
``log2(20) - S / 20``.  The counts are kept incrementally, twelve to a number.
The candidate is a secret when any window of any piece reaches its threshold.
``S`` is kept in whole millionths so every engine decides alike.

Every step takes time in proportion to the text: long pieces are worked through
in stretches that overlap by a window, positions of many matches are summed by
stretches too, and no expression runs deep on a long run of characters.

Positions are code points, end exclusive.  A null text counts as empty; rows
without matches return zero counts, an empty span list and the digest of the
empty string.  Repeated rows are scanned alike, other columns stay untouched
(``out`` replaces a column of that name; names that start with ``__secret_`` are
taken), texts are scanned whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the base patterns.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_MIN = 8

WINDOW = 20
STRETCH = 512  # characters of a long candidate at a time
BATCH = 256  # matches of a text at a time
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}"
#: (class, the characters it allows, bits at which a window is suspicious)
CLASSES = (("hex", "^[0-9A-Fa-f]+$", 3.0), ("alnum", "^[0-9A-Za-z]+$", 3.4), ("base64", "^", 3.6))
#: Parts of a candidate that are no secret.
ALLOW_PARTS = r"(?i)example|sample|dummy|placeholder|lorem|(?<![0-9])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9])"
#: Pieces that are no secret as a whole.
ALLOW = (
    r"^[_=+/-]*[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}[_=+/-]*$",
    r"^[0-9_=+/-]+$",
    r"(?i)^[a-z]++(?:[-_/][a-z]++)*+[-_/]?[0-9]{1,6}$",
)
CODES = 80  # from "+" to "z"
PER_WORD = 12  # counts of five bits


def nlogn(n: int) -> int:
    """``n log2 n`` in whole millionths."""
    return round(n * math.log2(n) * 1_000_000) if n > 1 else 0


def bound(bits: float) -> int:
    """The largest ``S`` of a window whose entropy is at least ``bits``."""
    return math.floor(WINDOW * (math.log2(WINDOW) - bits) * 1_000_000)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _located(text: Column, found: Column, pattern: str) -> Column:
    """Array of (s, e, m): where each of all matches ``found`` lies in ``text``."""
    between = F.transform(F.split(text, pattern, -1), F.length)
    pairs = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("b"), found.alias("m"))
    spans = "array<struct<s:bigint,e:bigint,m:string>>"

    def step(acc: Column, x: Column) -> Column:
        s = (acc["at"] + x["b"]).cast("bigint")
        e = (acc["at"] + x["b"] + F.length(x["m"])).cast("bigint")
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m")))).alias("out"))

    def batch(done: Column, part: Column) -> Column:
        start = F.struct(F.coalesce(F.try_element_at(done, F.lit(-1))["at"], F.lit(0).cast("bigint")).alias("at"), F.array().cast(spans).alias("out"))
        return F.concat(done, F.array(F.aggregate(part, start, step)))

    none = F.array().cast(f"array<struct<at:bigint,out:{spans}>>")
    cut = lambda all_pairs: F.transform(F.sequence(F.lit(0), F.size(found) - 1, F.lit(BATCH)), lambda k: F.slice(all_pairs, k + 1, BATCH))
    located = F.aggregate(_let(pairs, cut), none, batch, lambda done: F.flatten(F.transform(done, lambda x: x["out"])))
    return F.when(F.size(found) > 0, located).otherwise(F.array().cast(spans))


def _stretch_spread(s: Column) -> Column:
    """The smallest ``S`` of any window of a short string."""
    gain = F.array(*[F.lit(nlogn(n + 1) - nlogn(n)).cast("bigint") for n in range(WINDOW + 1)])
    ones = F.array(*[F.lit(1 << 5 * n).cast("bigint") for n in range(PER_WORD)])
    zero = F.lit(0).cast("bigint")

    def code(c: Column) -> Column:
        n = F.ascii(c) - F.lit(43)
        place = n % PER_WORD
        return F.struct(n.alias("n"), F.floor(n / PER_WORD).cast("int").alias("word"), (place * 5).cast("int").alias("shift"), F.element_at(ones, place + 1).alias("one"))

    def held(counts: Column, c: Column) -> Column:
        return F.call_function("shiftright", F.get(counts, c["word"]), c["shift"]).bitwiseAND(F.lit(31)).cast("int")

    def slide(codes: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            enters, leaves = F.get(codes, i), F.get(codes, i - WINDOW)
            less = F.coalesce(F.get(gain, held(acc["counts"], leaves) - 1), zero)
            more = F.get(gain, held(acc["counts"], enters) - F.when(enters["n"] == leaves["n"], 1).otherwise(0))
            counts = F.transform(acc["counts"], lambda v, k: v + F.when(k == enters["word"], enters["one"]).otherwise(zero) - F.when(k == leaves["word"], leaves["one"]).otherwise(zero))
            best = F.when(i >= WINDOW, F.least(acc["best"], acc["now"])).otherwise(acc["best"])
            return F.struct((acc["now"] - less + more).alias("now"), best.alias("best"), counts.alias("counts"))

        start = F.struct(zero.alias("now"), F.lit(2**62).cast("bigint").alias("best"), F.array_repeat(zero, -(-CODES // PER_WORD)).alias("counts"))
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda acc: F.least(acc["best"], acc["now"]))

    return _let(F.transform(F.split(s, ""), code), slide)


def least_spread(s: Column) -> Column:
    """The smallest ``S`` of any window of ``s``, which is its highest entropy."""
    pattern = F.lit(rf"(.{{1,{STRETCH - WINDOW}}})(?=(.{{0,{WINDOW - 1}}}))")
    heads, tails = (F.regexp_extract_all(s, pattern, F.lit(k)) for k in (1, 2))
    whole = F.filter(F.zip_with(heads, tails, lambda a, b: F.concat(a, b)), lambda x: F.length(x) >= WINDOW)
    return F.array_min(F.transform(whole, _stretch_spread))


def _piece_suspicious(s: Column) -> Column:
    limit = F.lit(None).cast("bigint")
    for _, allowed, bits in reversed(CLASSES):
        limit = F.when(s.rlike(allowed), F.lit(bound(bits)).cast("bigint")).otherwise(limit)
    known = F.length(s) < WINDOW
    for pattern in ALLOW:
        known = known | s.rlike(pattern)
    return F.when(known, False).otherwise(least_spread(s) <= limit)


def suspicious(s: Column) -> Column:
    """Whether a candidate has a window of high entropy outside of what is allowed."""
    return F.exists(F.split(s, ALLOW_PARTS, -1), _piece_suspicious)


def _named(spans: Column, order: int, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(order).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind"), x["m"].alias("m")))


def scan_secrets(df: DataFrame, text_col: str = "text", out: str = "secrets") -> DataFrame:
    """``df`` with ``out``: array of (s, k, e, kind, m) by start, then by kind.

    ``k`` orders the kinds: 0 assign, 1 access, 2 hex, 3 entropy.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    kinds = (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("entropy", CANDIDATE))
    step = df.withColumns({f"__secret_{k}": F.regexp_extract_all(t, F.lit(p), F.lit(0)) for k, p in kinds})
    step = step.withColumns({f"__secret_{k}": _located(t, F.col(f"__secret_{k}"), p) for k, p in kinds})
    keep = {
        "assign": lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= ASSIGN_MIN,
        "entropy": lambda x: suspicious(x["m"]),
    }
    parts = []
    for n, (k, _) in enumerate(kinds):
        spans = F.filter(F.col(f"__secret_{k}"), keep[k]) if k in keep else F.col(f"__secret_{k}")
        parts.append(_named(spans, n, k))
    return step.withColumn(out, F.array_sort(F.concat(*parts))).drop(*[f"__secret_{k}" for k, _ in kinds])


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts by base kind, their digest, all spans."""
    from .scratch import table

    docs = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    s = F.col("secrets")
    count = lambda n: F.size(F.filter(s, lambda x: x["k"] == n)).cast("long")
    return docs.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined(F.filter(s, lambda x: x["k"] < 3)), 256).alias("base_sha256"),
        joined(s).alias("spans"),
    )
