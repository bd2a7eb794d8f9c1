"""String, regular expression, hash and encoding functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.base import Registry, Tables

R = Registry()


def left(text: Column, n: int) -> Column:
    """The first n characters; a negative n drops as many from the end."""
    return F.substring(text, 1, n) if n >= 0 else F.substr(text, F.lit(1), F.greatest(F.length(text) + n, F.lit(0)))


def concat_skip_nulls(*parts: Column) -> Column:
    """concat() of the dialect: NULL arguments count as empty."""
    return F.concat_ws("", *parts)


def regexp_replace_first(text: Column, pattern: str, with_: str) -> Column:
    """Without the flag g the dialect replaces the first match only."""
    return F.regexp_replace(text, f"(?s)^(.*?)(?:{pattern})(.*)$", f"$1{with_}$2")


@R.operator("""
SELECT c_custkey, upper(c_mktsegment) AS up, lower(c_name) AS low, length(c_name) AS len, trim('  ' || c_name || ' ') AS tr, ltrim('  x') AS lt, rtrim('x  ') AS rt,
       lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS lp, rpad(c_mktsegment, 12, '.') AS rp, left(c_name, 4) AS le, right(c_name, 3) AS ri, substr(c_name, 3, 5) AS su,
       strpos(c_name, '#') AS pos, replace(c_name, 'Customer', 'C') AS rep, reverse(c_mktsegment) AS rev, repeat('ab', 3) AS rpt, split_part(c_name, '#', 2) AS sp
FROM customer""")
def fn_string_pack(t: Tables) -> DataFrame:
    name, seg = F.col("c_name"), F.col("c_mktsegment")
    return t.customer.select(
        "c_custkey", F.upper(seg).alias("up"), F.lower(name).alias("low"), F.length(name).cast("bigint").alias("len"), F.trim(F.concat(F.lit("  "), name, F.lit(" "))).alias("tr"),
        F.ltrim(F.lit("  x")).alias("lt"), F.rtrim(F.lit("x  ")).alias("rt"), F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("lp"), F.rpad(seg, 12, ".").alias("rp"),
        F.left(name, F.lit(4)).alias("le"), F.right(name, F.lit(3)).alias("ri"), F.substring(name, 3, 5).alias("su"), F.instr(name, "#").cast("bigint").alias("pos"),
        F.replace(name, F.lit("Customer"), F.lit("C")).alias("rep"), F.reverse(seg).alias("rev"), F.repeat(F.lit("ab"), 3).alias("rpt"), F.split_part(name, F.lit("#"), F.lit(2)).alias("sp"),
    )


@R.operator("""
SELECT p_partkey, ascii(p_brand) AS a, chr(65) AS ch, concat(p_brand, NULL, '-x') AS c, concat_ws('/', p_brand, NULL, p_type) AS cw, starts_with(p_type, 'S') AS sw, ends_with(p_type, 'L') AS ew,
       contains(p_name, '1') AS co, translate(p_brand, 'Bd', 'bD') AS tl, levenshtein(p_brand, p_type) AS lv, bit_length(p_brand) AS bl, octet_length(encode(p_brand)) AS ol, left(p_type, 4) AS head
FROM part""")
def fn_string_more(t: Tables) -> DataFrame:
    brand, kind = F.col("p_brand"), F.col("p_type")
    return t.part.select(
        "p_partkey", F.ascii(brand).alias("a"), F.chr(F.lit(65)).alias("ch"), concat_skip_nulls(brand, F.lit(None).cast("string"), F.lit("-x")).alias("c"),
        F.concat_ws("/", brand, F.lit(None).cast("string"), kind).alias("cw"), F.startswith(kind, F.lit("S")).alias("sw"), F.endswith(kind, F.lit("L")).alias("ew"),
        F.contains("p_name", F.lit("1")).alias("co"), F.translate(brand, "Bd", "bD").alias("tl"), F.levenshtein(brand, kind).cast("bigint").alias("lv"),
        F.bit_length(brand).cast("bigint").alias("bl"), F.octet_length(brand).cast("bigint").alias("ol"), left(kind, 4).alias("head"),
    )


@R.operator("""
SELECT c_custkey, regexp_replace(c_name, '0+', '-') AS once, regexp_replace(c_name, '0', 'o', 'g') AS every, regexp_matches(c_name, '9') AS has, regexp_extract(c_name, '([0-9]+)', 1) AS num,
       len(regexp_extract_all(c_name, '0')) AS zeros FROM customer""")
def fn_regex_pack(t: Tables) -> DataFrame:
    name = F.col("c_name")
    return t.customer.select(
        "c_custkey", regexp_replace_first(name, "0+", "-").alias("once"), F.regexp_replace(name, "0", "o").alias("every"), name.rlike("9").alias("has"),
        F.regexp_extract(name, "([0-9]+)", 1).alias("num"), F.regexp_count(name, F.lit("0")).cast("bigint").alias("zeros"),
    )


@R.operator("""
SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s, lower(hex(encode(c_mktsegment))) AS h, base64(encode(c_mktsegment)) AS b, decode(unhex(hex(encode(c_name)))) AS back, to_hex(c_custkey) AS th FROM customer""")
def fn_hash_encode(t: Tables) -> DataFrame:
    name, seg = F.col("c_name"), F.col("c_mktsegment")
    return t.customer.select(
        "c_custkey", F.md5(name).alias("m"), F.sha2(name, 256).alias("s"), F.lower(F.hex(seg)).alias("h"), F.base64(F.encode(seg, "UTF-8")).alias("b"),
        F.decode(F.unhex(F.hex(name)), "UTF-8").alias("back"), F.hex("c_custkey").alias("th"),
    )


@R.operator("""
SELECT p_partkey, 'Ab Cd' AS ic, trim(p_brand, 'B#') AS bt, insert_at AS ov, split_part(p_type, ' ', 1) AS si, position('1' IN p_brand) AS p, lpad('x', 1, '.') AS l1, CAST(p_brand || NULL AS VARCHAR) AS nul, instr(p_type, 'E') AS ins,
       regexp_matches(p_brand, '^Brand') AS rl, substring(p_brand FROM 2 FOR 3) AS sub3, length(p_brand) AS cl, sha256(p_brand) AS dg
FROM (SELECT *, left(p_brand, 1) || 'XY' || substr(p_brand, 4) AS insert_at FROM part)""")
def fn_string_extra(t: Tables) -> DataFrame:
    brand, kind = F.col("p_brand"), F.col("p_type")
    return t.part.select(
        "p_partkey", F.initcap(F.lit("ab cd")).alias("ic"), F.btrim(brand, F.lit("B#")).alias("bt"), F.overlay(brand, F.lit("XY"), F.lit(2), F.lit(2)).alias("ov"), F.substring_index(kind, " ", 1).alias("si"),
        F.position(F.lit("1"), brand).cast("bigint").alias("p"), F.lpad(F.lit("x"), 1, ".").alias("l1"), F.concat(brand, F.lit(None).cast("string")).alias("nul"), F.instr(kind, "E").cast("bigint").alias("ins"),
        F.regexp_like(brand, F.lit("^Brand")).alias("rl"), F.substring(brand, 2, 3).alias("sub3"), F.char_length(brand).cast("bigint").alias("cl"), F.sha2(brand, 256).alias("dg"),
    )


@R.operator("""
SELECT n_nationkey, list_position(string_split('A,B,NATION_3', ','), n_name) IS NOT NULL AS fs, regexp_extract_all(n_name, '[0-9]') AS ra, string_split(n_name, '_') AS st FROM nation""")
def fn_string_lists(t: Tables) -> DataFrame:
    name = F.col("n_name")
    return t.nation.select("n_nationkey", (F.find_in_set(name, F.lit("A,B,NATION_3")) > 0).alias("fs"), F.regexp_extract_all(name, F.lit("[0-9]"), F.lit(0)).alias("ra"), F.split(name, "_").alias("st"))
