"""Answer texts: tags, exact rationals and rewards, as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of the answer format.
TAG = r"(?is)<answer>\s*(.*?)\s*</answer>"
OPEN, CLOSE = r"(?i)<answer>", r"(?i)</answer>"
NUMBER = r"^[-+]?[0-9][0-9]*(\.[0-9]+)?(/[-+]?[0-9][0-9]*)?$"
OUTER_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"
GOLD = r"(?s)####\s*(.*?)\s*$"


def tagged(text: Column) -> Column:
    """All texts between answer tags."""
    return F.regexp_extract_all(text, F.lit(TAG), F.lit(1))


def gold(text: Column) -> Column:
    """What follows the answer marker; NULL without one."""
    return F.when(text.rlike("####"), F.regexp_extract(text, GOLD, 1))


def rational(text: Column) -> Column:
    """Struct ``(num, den, top, below)``, not reduced; NULL where the text is no number.

    ``top`` and ``below`` are the numerator's digits with a minus sign if negative, and the denominator's,
    of any length; ``num`` and ``den`` are the same as decimals, NULL beyond 19 digits a side. Thousands
    commas and dollar signs are dropped, and white space of any kind around it. "1.5/2" and a zero denominator are no numbers. Digits are ASCII.
    """
    t = F.regexp_replace(F.regexp_replace(text, OUTER_SPACE, ""), "[,$]", "")
    parts = F.split(t, "/")
    whole, other = parts[0], F.coalesce(F.get(parts, F.lit(1)), F.lit("1"))
    decimals = F.length(F.regexp_extract(whole, r"\.([0-9]+)$", 1))
    ok = t.rlike(NUMBER) & ~((F.size(parts) > 1) & whole.contains(".")) & other.rlike("[1-9]")
    minus = whole.startswith("-") != other.startswith("-")
    top = _digits(F.regexp_replace(whole, "[-+.]", ""))
    below = F.when(decimals > 0, F.concat(F.lit("1"), F.repeat(F.lit("0"), decimals))).otherwise(_digits(F.regexp_replace(other, "[-+]", "")))
    top = F.concat(F.when(minus & (top != "0"), F.lit("-")).otherwise(F.lit("")), top)
    short = (F.length(top) <= 20) & (F.length(below) <= 20) & (F.length(F.ltrim(top, F.lit("-"))) <= 19)
    as_number = lambda c: F.when(short, c.try_cast("decimal(38,0)"))
    return F.when(ok, F.struct(as_number(top).alias("num"), as_number(below).alias("den"), top.alias("top"), below.alias("below")))


def _digits(text: Column) -> Column:
    """Digits without leading zeros."""
    return F.coalesce(F.nullif(F.ltrim(text, F.lit("0")), F.lit("")), F.lit("0"))


#: Digits of a limb: products of limbs, summed over a number's length, stay within a bigint.
LIMB = 6


def _limbs(digits: Column) -> Column:
    """Limbs of a number, the lowest first."""
    n = F.ceil(F.length(digits) / F.lit(LIMB)).cast("int")
    padded = F.lpad(digits, n * LIMB, "0")
    return F.transform(F.sequence(n, F.lit(1), F.lit(-1)), lambda i: F.substr(padded, (i - 1) * LIMB + 1, F.lit(LIMB)).cast("bigint"))


def _product(a: Column, b: Column) -> Column:
    """Digits of the product of two numbers given by their digits, zeros at the high end included."""
    base = 10**LIMB

    def made(x: Column, y: Column) -> Column:
        def at(k: Column) -> Column:
            low, high = F.greatest(F.lit(0), k - F.size(y) + 1), F.least(k, F.size(x) - 1)
            return F.aggregate(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>")), F.lit(0).cast("bigint"), lambda s, i: s + F.get(x, i) * F.get(y, k - i))

        carried = F.aggregate(
            F.transform(F.sequence(F.lit(0), F.size(x) + F.size(y)), at),
            F.struct(F.lit(0).cast("bigint").alias("c"), F.array().cast("array<bigint>").alias("out")),
            lambda s, v: F.struct(F.call_function("div", s["c"] + v, F.lit(base).cast("bigint")).alias("c"), F.concat(s["out"], F.array((s["c"] + v) % base)).alias("out")),
            lambda s: s["out"],
        )
        return carried

    both = F.array(F.struct(_limbs(a).alias("x"), _limbs(b).alias("y")))  # limbs are made once
    limbs = F.get(F.transform(both, lambda p: made(p["x"], p["y"])), F.lit(0))
    return F.array_join(F.reverse(F.transform(limbs, lambda v: F.lpad(v.cast("string"), LIMB, "0"))), "")


def equal(a: Column, b: Column) -> Column:
    """Exact equality of two rationals by cross-multiplication, digit by digit beyond 19 digits; false if either is NULL."""
    wide = "decimal(38,0)"
    short = (a["num"] * b["den"]).cast(wide) == (b["num"] * a["den"]).cast(wide)
    sign = a["top"].startswith("-") == b["top"].startswith("-")
    bare = lambda c: F.ltrim(c, F.lit("-"))
    long = sign & (_digits(_product(bare(a["top"]), b["below"])) == _digits(_product(bare(b["top"]), a["below"])))
    return F.coalesce(F.when(a["num"].isNotNull() & b["num"].isNotNull(), short).otherwise(long), F.lit(False))


def status(text: Column, strict_tags: bool = False) -> Column:
    """How an answer text parses; ``strict_tags`` also tells malformed tags and names bad numbers otherwise."""
    found = tagged(text)
    bad = F.lit("invalid_numeric_answer" if strict_tags else "invalid_answer_value")
    out = F.when(F.size(found) == 0, F.lit("missing_answer_tag")).when(F.size(found) > 1, F.lit("multiple_answer_tags"))
    if strict_tags:
        one = (F.regexp_count(text, F.lit(OPEN)) == 1) & (F.regexp_count(text, F.lit(CLOSE)) == 1)
        out = out.when(~one, F.lit("malformed_answer_tags"))
    return out.when(rational(F.get(found, F.lit(0))).isNull(), bad).otherwise(F.lit("ok"))


def parsed(text: Column) -> Column:
    """The rational of a text with one good answer, else NULL."""
    found = tagged(text)
    return F.when(F.size(found) == 1, rational(F.get(found, F.lit(0))))


def canonical(value: Column) -> Column:
    """``n`` or ``n/d`` in lowest terms: Euclid's steps, as many as 38-digit numbers can need; NULL beyond 19 digits a side (see ``canonical_answers``)."""
    gcd = F.aggregate(
        F.sequence(F.lit(1), F.lit(184)),
        F.struct(F.abs(value["num"]).cast("decimal(38,0)").alias("a"), value["den"].cast("decimal(38,0)").alias("b")),
        lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] == 0, F.lit(1).cast("decimal(38,0)")).otherwise(s["b"])).cast("decimal(38,0)").alias("b"))),
        lambda s: s["a"],
    )
    n, d = F.floor(value["num"] / gcd).cast("decimal(38,0)").cast("string"), F.floor(value["den"] / gcd).cast("decimal(38,0)").cast("string")
    return F.when(d == "1", n).otherwise(F.concat(n, F.lit("/"), d))


def canonical_answers(df: DataFrame, value: str, name: str) -> DataFrame:
    """The frame with the rational in ``value`` as canonical text, by column functions up to 19 digits a side and exactly for longer ones."""
    from pyspark.sql.types import StringType, StructType

    number = F.col(value)
    df, made = df.withColumn("_row", F.monotonically_increasing_id()), F.col("_row") >= 0  # keeps the conditions below above what makes the value
    short = df.where(made & (number.isNull() | number["num"].isNotNull())).withColumn(name, canonical(number))
    schema = StructType(df.schema.fields).add(name, StringType())

    def run(batches: Iterator) -> Iterator:
        import sys
        from fractions import Fraction

        import pyarrow as pa

        sys.set_int_max_str_digits(0)
        for batch in batches:
            texts = [str(Fraction(int(v["top"]), int(v["below"]))) for v in batch.column(value).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], schema.names)

    return short.unionByName(df.where(made & number["num"].isNull() & number["top"].isNotNull()).mapInArrow(run, schema)).drop("_row")


def correctness_reward(text: Column, truth: Column) -> Column:
    return equal(parsed(text), truth).cast("double")


def format_reward(text: Column) -> Column:
    """1 for one match, one opening and one closing tag and a number, else 0."""
    found = tagged(text)
    good = (F.size(found) == 1) & (F.regexp_count(text, F.lit(OPEN)) == 1) & (F.regexp_count(text, F.lit(CLOSE)) == 1) & rational(F.get(found, F.lit(0))).isNotNull()
    return F.coalesce(good, F.lit(False)).cast("double")
