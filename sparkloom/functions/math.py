"""Mathematical functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.base import Registry, Tables

R = Registry()

#: Steps of Euclid's algorithm that any two 64-bit numbers need at most.
EUCLID_STEPS = 92


def trunc(x: Column, digits: int = 0) -> Column:
    """Towards zero, to so many digits."""
    scale = 10.0**digits
    return F.signum(x) * F.floor(F.abs(x) * scale) / scale


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor, in the JVM: Euclid's algorithm folded over a fixed number of steps."""
    start = F.struct(F.abs(a).cast("bigint").alias("x"), F.abs(b).cast("bigint").alias("y"))
    step = lambda s, _: F.struct(F.when(s.y == 0, s.x).otherwise(s.y).alias("x"), F.when(s.y == 0, s.y).otherwise(F.try_mod(s.x, s.y)).alias("y"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(EUCLID_STEPS)), start, step, lambda s: s.x)


def lcm(a: Column, b: Column) -> Column:
    divisor = gcd(a, b)
    return F.when(divisor == 0, F.lit(0).cast("bigint")).otherwise(F.call_function("div", F.abs(a.cast("bigint") * b.cast("bigint")), divisor))


@R.operator("""
SELECT p_partkey, abs(-p_size) AS ab, CAST(ceil(p_retailprice) AS BIGINT) AS ce, CAST(floor(p_retailprice) AS BIGINT) AS fl, round(p_retailprice, 1) AS ro, trunc(p_retailprice) AS tr,
       round(sqrt(p_size), 8) AS sq, round(cbrt(p_size), 8) AS cb, round(exp(p_size / 50.0), 8) AS ex, round(ln(p_size), 8) AS l, round(log2(p_size), 8) AS l2, round(log10(p_size), 8) AS l10,
       round(power(p_size, 1.5), 6) AS po, CAST(sign(p_size - 25) AS INTEGER) AS sg, p_size % 7 AS mo, greatest(p_size, 25) AS gr, least(p_size, 25) AS lea FROM part""")
def fn_math_pack(t: Tables) -> DataFrame:
    size, price = F.col("p_size"), F.col("p_retailprice")
    r8 = lambda c: F.round(c, 8)
    return t.part.select(
        "p_partkey", F.abs(-size).alias("ab"), F.ceil(price).alias("ce"), F.floor(price).alias("fl"), F.round(price, 1).alias("ro"), trunc(price).alias("tr"), r8(F.sqrt(size)).alias("sq"),
        r8(F.cbrt(size)).alias("cb"), r8(F.exp(size / 50.0)).alias("ex"), r8(F.ln(size)).alias("l"), r8(F.log2(size)).alias("l2"), r8(F.log10(size)).alias("l10"), F.round(F.pow(size, 1.5), 6).alias("po"),
        F.signum(size - 25).cast("int").alias("sg"), (size % 7).alias("mo"), F.greatest(size, F.lit(25)).alias("gr"), F.least(size, F.lit(25)).alias("lea"),
    )


@R.operator("""
SELECT p_partkey, round(sin(p_size), 8) AS s, round(cos(p_size), 8) AS c, round(tan(p_size), 6) AS ta, round(asin(p_size / 50.0), 8) AS a1, round(acos(p_size / 50.0), 8) AS a2, round(atan(p_size), 8) AS a3,
       round(atan2(p_size, 3), 8) AS a4, round(sinh(p_size / 50.0), 8) AS sh, round(cosh(p_size / 50.0), 8) AS chh, round(tanh(p_size / 50.0), 8) AS th, round(degrees(p_size), 6) AS de, round(radians(p_size), 8) AS ra,
       round(cot(p_size), 6) AS ct, round(pi(), 10) AS pii FROM part""")
def fn_trig_pack(t: Tables) -> DataFrame:
    size, part = F.col("p_size"), F.col("p_size") / 50.0
    r8 = lambda c: F.round(c, 8)
    return t.part.select(
        "p_partkey", r8(F.sin(size)).alias("s"), r8(F.cos(size)).alias("c"), F.round(F.tan(size), 6).alias("ta"), r8(F.asin(part)).alias("a1"), r8(F.acos(part)).alias("a2"), r8(F.atan(size)).alias("a3"),
        r8(F.atan2(size, F.lit(3))).alias("a4"), r8(F.sinh(part)).alias("sh"), r8(F.cosh(part)).alias("chh"), r8(F.tanh(part)).alias("th"), F.round(F.degrees(size), 6).alias("de"), r8(F.radians(size)).alias("ra"),
        F.round(F.cot(size), 6).alias("ct"), F.round(F.pi(), 10).alias("pii"),
    )


@R.operator("""
SELECT p_partkey, gcd(p_partkey, CAST(p_size AS BIGINT)) AS g, lcm(p_partkey, CAST(p_size AS BIGINT)) AS l, CAST(factorial(CAST(p_size % 15 AS INTEGER)) AS BIGINT) AS f, isnan(p_retailprice) AS n FROM part""")
def fn_number_theory(t: Tables) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    return t.part.select("p_partkey", gcd(key, size).alias("g"), lcm(key, size).alias("l"), F.factorial(size % 15).alias("f"), F.isnan("p_retailprice").alias("n"))


@R.operator("""
SELECT p_partkey, round(acosh(p_size), 8) AS ac, round(asinh(p_size), 8) AS ah, round(atanh(p_size / 100.0), 8) AS at, p_size = 0 AS iz, round(CAST(p_retailprice AS DOUBLE), -1) AS r1, p_size & 3 AS ba, p_size | 8 AS bo, xor(p_size, 5) AS bx,
       p_size << 2 AS sl, p_size >> 1 AS sr, trunc(p_retailprice * 10) / 10 AS t1, p_size // 7 AS dv FROM part""")
def fn_math_extra(t: Tables) -> DataFrame:
    size, price = F.col("p_size"), F.col("p_retailprice")
    r8 = lambda c: F.round(c, 8)
    return t.part.select(
        "p_partkey", r8(F.acosh(size)).alias("ac"), r8(F.asinh(size)).alias("ah"), r8(F.atanh(size / 100.0)).alias("at"), (size == 0).alias("iz"), F.round(price, -1).alias("r1"), size.bitwiseAND(3).alias("ba"),
        size.bitwiseOR(8).alias("bo"), size.bitwiseXOR(5).alias("bx"), F.shiftleft(size, 2).alias("sl"), F.shiftright(size, 1).alias("sr"), trunc(price, 1).alias("t1"), F.call_function("div", size, F.lit(7)).cast("int").alias("dv"),
    )


@R.operator("SELECT p_partkey, CASE WHEN isnan(CAST('nan' AS DOUBLE)) THEN p_retailprice END AS nv, true AS rnd FROM part")
def fn_nan(t: Tables) -> DataFrame:
    nan = F.lit(float("nan"))
    return t.part.select("p_partkey", F.nanvl(nan, F.col("p_retailprice")).alias("nv"), F.rand(1).between(0, 1).alias("rnd"))
