"""One query a scalar function: name -> (table, key columns, Column, DuckDB expression)."""

from __future__ import annotations

from pyspark.sql import functions as F

from basalt.functions import conditional as C
from basalt.functions import dates as T
from basalt.functions import fulltext as FT
from basalt.functions import numbers as M
from basalt.functions import strings as S

_INITCAP = "(SELECT string_agg(upper(substr(w, 1, 1)) || lower(substr(w, 2)), '' ORDER BY i) FROM (SELECT unnest(regexp_extract_all(replace(c_name, '#', '-') || ' x_y9z', '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+')) AS w, generate_subscripts(regexp_extract_all(replace(c_name, '#', '-') || ' x_y9z', '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+'), 1) AS i))"


_MAYBE = "nullif(c_mktsegment, 'BUILDING')"
_CUSTOMER, _ORDERS, _PART = ("customer", "c_custkey"), ("orders", "o_orderkey"), ("part", "p_partkey")
_LINES, _EVENTS, _DOCUMENTS = ("lineitem", "l_orderkey, l_linenumber"), ("events", "event_id"), ("documents", "doc_id")


def _maybe():
    """A column with nulls."""
    return F.expr(_MAYBE)


#: Columns are made when they are asked for: they need a running session.
FUNCTIONS = {
    "str_upper_lower": (*_CUSTOMER, lambda: S.concat(S.upper("c_mktsegment"), F.lit("/"), S.lower("c_name")), "upper(c_mktsegment) || '/' || lower(c_name)"),
    "str_concat_skips_null": (*_CUSTOMER, lambda: S.concat(F.lit("a"), _maybe(), F.lit("b")), f"concat('a', {_MAYBE}, 'b')"),
    "str_concat_ws": (*_CUSTOMER, lambda: S.concat_ws(F.lit("-"), "c_name", _maybe(), "c_mktsegment"), f"concat_ws('-', c_name, {_MAYBE}, c_mktsegment)"),
    "str_concat_operator": (*_CUSTOMER, lambda: F.expr("'a' || nullif(c_mktsegment, 'BUILDING')"), f"'a' || {_MAYBE}"),
    "str_length": (*_CUSTOMER, lambda: S.length("c_name").cast("bigint"), "length(c_name)"),
    "str_substr": (*_CUSTOMER, lambda: S.concat(S.substr("c_name", F.lit(-2), F.lit(3)), F.lit("|"), S.substr("c_name", 5)), "substr(c_name, 1, 3) || '|' || substr(c_name, 5)"),
    "str_trim": (*_CUSTOMER, lambda: S.concat(S.trim(F.expr("concat('xx', c_name, 'yx')"), "xy"), S.trim(F.expr("concat('  ', c_mktsegment, ' ')"), side="leading"), F.lit("|")), "trim('xx' || c_name || 'yx', 'xy') || ltrim('  ' || c_mktsegment || ' ') || '|'"),
    "str_replace": (*_CUSTOMER, lambda: S.replace("c_mktsegment", "U", "--"), "replace(c_mktsegment, 'U', '--')"),
    "str_pad": (*_CUSTOMER, lambda: S.concat(S.lpad("c_mktsegment", 12, "*"), S.rpad("c_mktsegment", 4, "*")), "lpad(c_mktsegment, 12, '*') || rpad(c_mktsegment, 4, '*')"),
    "str_initcap": (*_CUSTOMER, lambda: S.initcap(F.expr("concat(replace(c_name, '#', '-'), ' x_y9z')")), _INITCAP),
    "str_reverse_repeat": (*_CUSTOMER, lambda: S.concat(S.reverse("c_mktsegment"), S.repeat("c_mktsegment", 2), S.repeat("c_mktsegment", -1)), "reverse(c_mktsegment) || repeat(c_mktsegment, 2)"),
    "str_translate": (*_CUSTOMER, lambda: S.translate("c_mktsegment", "AEIU", "ae"), "replace(replace(translate(c_mktsegment, 'AE', 'ae'), 'I', ''), 'U', '')"),
    "str_split_part": (*_CUSTOMER, lambda: S.concat(S.split_part("c_name", "#", 2), F.lit("|"), S.split_part("c_name", "#", 0), S.split_part("c_name", "#", 9)), "split_part(c_name, '#', 2) || '|'"),
    "str_left_right": (*_CUSTOMER, lambda: S.concat(S.left("c_name", 3), S.right("c_name", 2), S.left("c_name", -1)), "left(c_name, 3) || right(c_name, 2)"),
    "str_chr_ascii": (*_PART, lambda: S.concat(S.chr_(F.expr("65 + p_size % 26")), S.chr_(F.lit(8364)), S.ascii_("p_name")), "chr(CAST(65 + p_size % 26 AS INT)) || chr(8364) || ascii(p_name)"),
    "str_charindex": (*_CUSTOMER, lambda: S.charindex("#", "c_name").cast("bigint"), "strpos(c_name, '#')"),
    "str_instr_start": (*_CUSTOMER, lambda: S.instr("c_mktsegment", "I", 3).cast("bigint"), "CASE WHEN strpos(substr(c_mktsegment, 3), 'I') = 0 THEN 0 ELSE strpos(substr(c_mktsegment, 3), 'I') + 2 END"),
    "str_regexp_like": (*_CUSTOMER, lambda: S.regexp_like("c_mktsegment", "^(auto|mach)", "i"), "regexp_matches(c_mktsegment, '(?i)^(auto|mach)')"),
    "str_regexp_replace": (*_CUSTOMER, lambda: S.regexp_replace("c_name", "0+", "<z>"), "regexp_replace(c_name, '0+', '<z>')"),
    "str_regexp_replace_all": (*_CUSTOMER, lambda: S.regexp_replace("c_name", "[0-9]", "d", "g"), "regexp_replace(c_name, '[0-9]', 'd', 'g')"),
    "str_regexp_substr": (*_CUSTOMER, lambda: S.regexp_substr("c_name", "[1-9][0-9]*"), "nullif(regexp_extract(c_name, '[1-9][0-9]*'), '')"),
    "str_to_char": (*_ORDERS, lambda: S.to_char("o_orderdate", "YYYY/MM/DD HH24:MI:SS"), "strftime(o_orderdate, '%Y/%m/%d %H:%M:%S')"),
    "str_newid": (*_CUSTOMER, lambda: S.length(S.newid()).cast("bigint"), "CAST(36 AS BIGINT)"),
    "date_extract": (*_ORDERS, lambda: S.concat_ws(F.lit("-"), *[T.extract(f, "o_orderdate") for f in ("YEAR", "MONTH", "DAY", "HOUR", "DOW", "DOY")]), "concat_ws('-', year(o_orderdate), month(o_orderdate), day(o_orderdate), hour(o_orderdate), dayofweek(o_orderdate), dayofyear(o_orderdate))"),
    "date_extract_epoch": (*_EVENTS, lambda: T.extract("EPOCH", "ts").cast("bigint"), "CAST(floor(epoch(ts)) AS BIGINT)"),
    "date_extract_second": (*_EVENTS, lambda: T.extract("SECOND", "ts").cast("bigint"), "CAST(second(ts) AS BIGINT)"),
    "date_trunc": (*_EVENTS, lambda: F.concat_ws(" ", *[S.to_char(T.date_trunc(u, "ts"), "YYYY-MM-DD HH24:MI:SS") for u in ("YEAR", "MONTH", "DAY", "HOUR", "MINUTE")]), "concat_ws(' ', " + ", ".join(f"strftime(date_trunc('{u}', ts), '%Y-%m-%d %H:%M:%S')" for u in ("year", "month", "day", "hour", "minute")) + ")"),
    "date_add_months": (*_ORDERS, lambda: T.date_add(F.expr("CAST(o_orderdate AS DATE)"), months=1, days=3).cast("string"), "CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH + INTERVAL 3 DAY AS DATE) AS VARCHAR)"),
    "date_sub_days": (*_ORDERS, lambda: T.date_sub(F.expr("CAST(o_orderdate AS DATE)"), days=40).cast("string"), "CAST(CAST(o_orderdate AS DATE) - 40 AS VARCHAR)"),
    "date_diff": (*_ORDERS, lambda: T.datediff("DAY", F.expr("CAST(o_orderdate AS DATE)"), F.expr("DATE '1995-01-01'")).cast("bigint"), "date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE))"),
    "date_diff_hours": (*_EVENTS, lambda: T.datediff("HOUR", F.expr("CAST(ts AS TIMESTAMP)"), F.expr("TIMESTAMP '2020-01-01 00:00:00'")).cast("bigint"), "date_sub('hour', TIMESTAMP '2020-01-01 00:00:00', ts)"),
    "date_age": (*_ORDERS, lambda: T.datediff("DAY", F.expr("CAST(o_orderdate + (o_orderdate - TIMESTAMP_NTZ '1995-01-01 00:00:00') AS DATE)"), F.expr("CAST(o_orderdate AS DATE)")).cast("bigint"), "date_diff('day', o_orderdate, o_orderdate + (o_orderdate - TIMESTAMP '1995-01-01 00:00:00'))"),
    "date_to_date": (*_ORDERS, lambda: T.to_date(S.to_char("o_orderdate", "DD.MM.YYYY"), "DD.MM.YYYY").cast("string"), "CAST(CAST(strptime(strftime(o_orderdate, '%d.%m.%Y'), '%d.%m.%Y') AS DATE) AS VARCHAR)"),
    "date_unixtime": (*_EVENTS, lambda: S.to_char(T.from_unixtime(T.unix_timestamp("ts")), "YYYY-MM-DD HH24:MI:SS"), "strftime(ts, '%Y-%m-%d %H:%M:%S')"),
    "math_abs_sign": (*_CUSTOMER, lambda: F.abs("c_acctbal") * M.sign("c_acctbal"), "abs(c_acctbal) * sign(c_acctbal)"),
    "math_ceil_floor": (*_CUSTOMER, lambda: M.ceil("c_acctbal") * 1000000 + M.floor("c_acctbal"), "ceil(c_acctbal) * 1000000 + floor(c_acctbal)"),
    "math_round_even": (*_LINES, lambda: M.round_(F.expr("CAST(l_extendedprice AS DECIMAL(18,2)) / 10"), 2), "CAST(round_even(CAST(l_extendedprice AS DECIMAL(18,2))::DECIMAL(18,3) * 0.1::DECIMAL(2,1), 2) AS DOUBLE)"),
    "math_round_integer": (*_CUSTOMER, lambda: M.round_("c_acctbal"), "CAST(round_even(CAST(c_acctbal AS DECIMAL(18,2)), 0) AS BIGINT)"),
    "math_trunc": (*_CUSTOMER, lambda: M.trunc("c_acctbal", 1), "CAST(trunc(CAST(c_acctbal AS DECIMAL(18,2)) * 10) AS DOUBLE) / 10"),
    "math_mod": (*_PART, lambda: M.mod(F.expr("p_size - 25"), 7).cast("bigint"), "CAST((p_size - 25) % 7 AS BIGINT)"),
    "math_trig": (*_PART, lambda: F.round(M.sin("p_size") + M.cos("p_size") + M.tan("p_size") + M.atan("p_size") + M.atan2("p_size", F.lit(3)), 6), "round(sin(p_size) + cos(p_size) + tan(p_size) + atan(p_size) + atan2(p_size, 3), 6)"),
    "math_arc": (*_PART, lambda: F.round(M.asin(F.expr("p_size / 100.0")) + M.acos(F.expr("p_size / 100.0")), 6), "round(asin(p_size / 100.0) + acos(p_size / 100.0), 6)"),
    "math_degrees": (*_PART, lambda: F.round(M.degrees("p_size") + M.radians("p_size") + M.pi(), 6), "round(degrees(p_size) + radians(p_size) + pi(), 6)"),
    "math_exp_log": (*_PART, lambda: F.round(M.exp(F.expr("p_size / 10.0")) + M.log("p_size") + M.log(2, "p_size") + M.log10("p_size"), 6), "round(exp(p_size / 10.0) + ln(p_size) + log2(p_size) + log10(p_size), 6)"),
    "math_power": (*_PART, lambda: F.round(M.sqrt("p_size") + M.power("p_size", F.lit(3)) + M.square("p_size"), 6), "round(sqrt(p_size) + pow(p_size, 3) + p_size * p_size, 6)"),
    "math_random": (*_PART, lambda: (M.random(7) >= 0) & (M.random(7) < 1), "true"),
    "math_to_number": (*_CUSTOMER, lambda: M.to_number(S.split_part("c_name", "#", 2)).cast("bigint"), "CAST(split_part(c_name, '#', 2) AS BIGINT)"),
    "cond_coalesce": (*_CUSTOMER, lambda: C.nvl(_maybe(), F.lit("none")), f"coalesce({_MAYBE}, 'none')"),
    "cond_nvl2": (*_CUSTOMER, lambda: C.nvl2(_maybe(), F.lit("some"), F.lit("none")), f"CASE WHEN {_MAYBE} IS NOT NULL THEN 'some' ELSE 'none' END"),
    "cond_if": (*_CUSTOMER, lambda: C.if_(F.col("c_nationkey"), F.lit("yes"), F.lit("no")), "CASE WHEN c_nationkey <> 0 THEN 'yes' ELSE 'no' END"),
    "cond_decode": (*_CUSTOMER, lambda: C.decode(_maybe(), "MACHINERY", "m", None, "null", "other"), f"CASE WHEN {_MAYBE} = 'MACHINERY' THEN 'm' WHEN {_MAYBE} IS NULL THEN 'null' ELSE 'other' END"),
    "cond_null_safe": (*_CUSTOMER, lambda: C.equal_or_both_null(_maybe(), F.expr("nullif(c_mktsegment, 'MACHINERY')")), f"{_MAYBE} IS NOT DISTINCT FROM nullif(c_mktsegment, 'MACHINERY')"),
    "json_extract": (*_EVENTS, lambda: C.json_extract("props", "$.k", "bigint"), "TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)"),
    "json_arrow": (*_EVENTS, lambda: C.json_get(F.expr("""concat('{"a":{"b":[10,', event_id, ']}}')"""), "a"), """'{"b":[10,' || event_id || ']}'"""),
    "json_arrow_text": (*_EVENTS, lambda: C.json_text("props", "k"), "json_extract_string(props, '$.k')"),
    "json_path": (*_EVENTS, lambda: C.json_extract(F.expr("""concat('{"a":{"b":[10,', event_id, ']}}')"""), "$.a.b[1]", "bigint"), "event_id"),
    "json_invalid": (*_EVENTS, lambda: C.json_extract(F.expr("concat('{', props)"), "$.k", "bigint"), "CAST(NULL AS BIGINT)"),
    "fts_ngram": (*_DOCUMENTS, lambda: FT.ft_search("text", "the"), "contains(lower(regexp_replace(text, '[\\s[:punct:]]', '', 'g')), 'th') AND contains(lower(regexp_replace(text, '[\\s[:punct:]]', '', 'g')), 'he')"),
    "fts_morph": (*_DOCUMENTS, lambda: FT.ft_search_words("text", "the of"), "list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), 'the') AND list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), 'of')"),
}
