"""Scalar and aggregate functions of the query language, by name.

Each entry builds a Spark expression from the argument columns; ``kinds`` are
the arguments' data types (None where unknown, inside lambdas).  A wrong value
gives NULL, never an error, whatever spark.sql.ansi.enabled says.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Build = Callable[[list[Column], list], Column]
SCALARS: dict[str, tuple[Build, int, int]] = {}
#: Functions whose expression depends on the types of their arguments; only for these are types resolved.
TYPED: set[str] = set()
ALIASES: dict[str, str] = {}
USER: dict[str, Callable] = {}


def fn(names: str, least: int, most: int | None = None) -> Callable[[Build], Build]:
    def put(f: Build) -> Build:
        for n in names.split():
            SCALARS[n] = (f, least, least if most is None else most)
            TYPED.add(n)
        return f

    return put


def simple(names: str, f: Callable[..., Column], n: int, most: int | None = None) -> None:
    fn(names, n, most)(lambda a, k: f(*a))
    TYPED.difference_update(names.split())


def is_list(kind) -> bool:
    return isinstance(kind, T.ArrayType)


D = lambda c: c.try_cast("double")
I = lambda c: c.try_cast("int")  # noqa: E731, E741
S = lambda c: c.cast("string")
BLANK = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"

# -- strings
simple("UPPER TO_UPPER", lambda s: F.upper(S(s)), 1)
simple("LOWER TO_LOWER", lambda s: F.lower(S(s)), 1)
simple("INITCAP", lambda s: F.initcap(S(s)), 1)
simple("TO_STRING STR", S, 1)
fn("REVERSE", 1)(lambda a, k: F.reverse(a[0] if is_list(k[0]) else S(a[0])))
fn("LENGTH SIZE STR_LEN ARRAY_SIZE LIST_SIZE", 1)(lambda a, k: F.size(a[0]).cast("long") if is_list(k[0]) or isinstance(k[0], T.MapType) else F.octet_length(S(a[0])).cast("long"))
fn("OCTET_LENGTH", 1)(lambda a, k: F.octet_length(S(a[0])).cast("long"))
fn("CONCAT", 1, 99)(lambda a, k: F.concat(*a) if all(map(is_list, k)) else F.concat_ws("", *[S(x) for x in a]))
fn("SUBSTRING SUBSTR", 2, 3)(lambda a, k: F.substring(S(a[0]), F.greatest(I(a[1]), F.lit(0)) + 1, F.greatest(I(a[2]), F.lit(0)) if len(a) > 2 else F.lit(2**31 - 1)))
simple("REPLACE", lambda s, a, b: F.replace(S(s), S(a), S(b)), 3)
simple("TRIM", lambda s: F.regexp_replace(S(s), f"^{BLANK}|{BLANK}$", ""), 1)
simple("LTRIM", lambda s: F.regexp_replace(S(s), f"^{BLANK}", ""), 1)
simple("RTRIM", lambda s: F.regexp_replace(S(s), f"{BLANK}$", ""), 1)
simple("CONTAINS", lambda s, x: F.contains(S(s), S(x)), 2)
simple("STARTS_WITH", lambda s, x: F.startswith(S(s), S(x)), 2)
simple("ENDS_WITH", lambda s, x: F.endswith(S(s), S(x)), 2)
simple("LEFT", lambda s, n: F.substring(S(s), F.lit(1), F.greatest(I(n), F.lit(0))), 2)
simple("RIGHT", lambda s, n: F.when(I(n) <= 0, F.lit("")).otherwise(F.right(S(s), I(n))), 2)
simple("REPEAT", lambda s, n: F.repeat(S(s), I(n)), 2)
simple("SPLIT", lambda s, d: F.split(S(s), F.concat(F.lit("\\Q"), S(d), F.lit("\\E"))), 2)
simple("SPLIT_PART", lambda s, d, p: F.when(I(p) >= 1, F.get(F.split(S(s), F.concat(F.lit("\\Q"), S(d), F.lit("\\E"))), I(p) - 1)), 3)
simple("LPAD", lambda s, n, f=None: F.lpad(S(s), I(n), S(f) if f is not None else F.lit(" ")), 2, 3)
simple("RPAD", lambda s, n, f=None: F.rpad(S(s), I(n), S(f) if f is not None else F.lit(" ")), 2, 3)
simple("LEVENSHTEIN", lambda a, b: F.levenshtein(S(a), S(b)).cast("long"), 2)
simple("REGEXP_MATCH", lambda s, p: F.regexp_like(S(s), S(p)), 2)
simple("REGEXP_COUNT", lambda s, p: F.regexp_count(S(s), S(p)).cast("long"), 2)
simple("REGEXP_EXTRACT", lambda s, p: F.coalesce(F.regexp_substr(S(s), S(p)), F.when(s.isNotNull() & p.isNotNull(), F.lit(""))), 2)
simple("REGEXP_REPLACE", lambda s, p, r: F.regexp_replace(S(s), S(p), S(r)), 3)
simple("MD5", lambda s: F.md5(S(s)), 1)
simple("SHA256", lambda s: F.sha2(S(s), 256), 1)
simple("TO_HEX", lambda x: F.lower(F.hex(x.try_cast("long"))), 1)
simple("FROM_HEX", lambda x: F.when(S(x).rlike("^-?[0-9a-fA-F]+$"), F.conv(S(x), 16, 10).try_cast("long")), 1)
simple("HASH", lambda x: F.xxhash64(x), 1)
simple("GEN_RANDOM_UUID", lambda: F.expr("uuid()"), 0)


def _concat_ws(a: list[Column]) -> Column:
    return F.call_function("concat_ws", *[S(x) for x in a])


fn("CONCAT_WS", 2, 99)(lambda a, k: _concat_ws(a))


def jaro_winkler(a: str, b: str) -> float:
    """Similarity of 0 to 1; a shared prefix of up to 4 counts extra, by 0.1 of what is missing."""
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, mine = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                mine.append(c)
                break
    m = len(mine)
    if not m:
        return 0.0
    theirs = [c for j, c in enumerate(b) if used[j]]
    swaps = sum(x != y for x, y in zip(mine, theirs, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    same = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return jaro + same * 0.1 * (1 - jaro)


def _jaro(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


simple("JARO_WINKLER", lambda a, b: F.pandas_udf(_jaro, "double")(S(a), S(b)), 2)

# -- numbers
simple("ABS", lambda x: F.abs(x), 1)
simple("CEIL", lambda x: F.ceil(D(x)).cast("double"), 1)
simple("FLOOR", lambda x: F.floor(D(x)).cast("double"), 1)
simple("ROUND", lambda x: F.round(D(x)), 1)
for _n in "SQRT EXP SIN COS TAN ASIN ACOS ATAN COT SINH COSH TANH".split():
    simple(_n, lambda x, f=getattr(F, _n.lower()): f(D(x)), 1)
#: Out of their domain logarithms are NaN or -infinity, as on floats.
_log = lambda f: lambda x: F.when(D(x) > 0, f(D(x))).when(D(x) == 0, F.lit(float("-inf"))).when(D(x) < 0, F.lit(float("nan")))
simple("LN", _log(F.ln), 1)
simple("LOG LOG10", _log(F.log10), 1)
simple("LOG2", _log(F.log2), 1)
simple("SIGN", lambda x: F.when(D(x) == 0, F.lit(1.0)).otherwise(F.signum(D(x))), 1)  # zero counts as positive
simple("POW POWER", lambda x, y: F.pow(D(x), D(y)), 2)
simple("MOD", lambda x, y: F.try_mod(D(x), D(y)), 2)
simple("ATAN2", lambda y, x: F.atan2(D(y), D(x)), 2)
simple("RADIANS", lambda x: F.radians(D(x)), 1)
simple("DEGREES", lambda x: F.degrees(D(x)), 1)
simple("RAND", lambda: F.rand(), 0)
simple("IS_NAN", lambda x: F.when(x.isNotNull(), F.isnan(D(x))), 1)
simple("IS_INF", lambda x: F.abs(D(x)) == float("inf"), 1)
simple("PI", lambda: F.pi(), 0)
simple("E", lambda: F.e(), 0)
simple("PHI", lambda: F.lit((1 + 5**0.5) / 2), 0)
simple("INFINITY", lambda: F.lit(float("inf")), 0)
_l = lambda c: c.try_cast("long")
simple("BIT_AND", lambda a, b: _l(a).bitwiseAND(_l(b)), 2)
simple("BIT_OR", lambda a, b: _l(a).bitwiseOR(_l(b)), 2)
simple("BIT_XOR", lambda a, b: _l(a).bitwiseXOR(_l(b)), 2)
simple("BIT_NOT", lambda a: F.bitwise_not(_l(a)), 1)
simple("BIT_COUNT", lambda a: F.bit_count(_l(a)).cast("long"), 1)
simple("BIT_SHIFT_LEFT", lambda a, n: F.call_function("shiftleft", _l(a), I(n)), 2)
simple("BIT_SHIFT_RIGHT", lambda a, n: F.call_function("shiftright", _l(a), I(n)), 2)

# -- conditions and conversions
CASTS = {"INT64": "long", "BIGINT": "long", "INT32": "int", "INTEGER": "int", "DOUBLE": "double", "FLOAT": "double", "STRING": "string", "TEXT": "string", "BOOL": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz"}
simple("COALESCE", lambda *a: F.coalesce(*a), 1, 99)
simple("IFNULL ISNULL", lambda a, b: F.coalesce(a, b), 2)
simple("NULLIF", lambda a, b: F.nullif(a, b), 2)
simple("IF IIF", lambda c, a, b: F.when(c.cast("boolean"), a).otherwise(b), 3)
simple("IS_NULL", lambda x: x.isNull(), 1)
simple("IS_NOT_NULL", lambda x: x.isNotNull(), 1)
fn("TO_INT INTEGER", 1)(lambda a, k: a[0].try_cast("long") if not isinstance(k[0], T.StringType) else F.coalesce(a[0].try_cast("long"), F.lit(None).cast("long")))
simple("TO_FLOAT FLOAT", D, 1)
simple("TO_BOOL BOOL", lambda x: x.try_cast("boolean"), 1)
simple("TO_DATE", lambda x: x.try_cast("date"), 1)
simple("TO_TIMESTAMP", lambda x: x.try_cast("timestamp_ntz"), 1)
simple("VERSION", lambda: F.lit("graphloom 1"), 0)
simple("CURRENT_USER", lambda: F.current_user(), 0)

# -- dates
fn("DATE", 0, 1)(lambda a, k: F.current_date() if not a else a[0].try_cast("date") if not isinstance(k[0], T.StringType) else F.when(a[0].rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), a[0].try_cast("date")))
fn("TIMESTAMP DATETIME", 0, 1)(lambda a, k: F.localtimestamp() if not a else a[0].try_cast("timestamp_ntz"))
simple("CURRENT_DATE", lambda: F.current_date(), 0)
simple("CURRENT_TIMESTAMP NOW", lambda: F.localtimestamp(), 0)
for _n in "YEAR MONTH DAY HOUR MINUTE SECOND".split():
    simple(_n, lambda x, f=getattr(F, _n.lower()): f(x.try_cast("timestamp_ntz")).cast("long"), 1)


def _shift(sign: int) -> Build:
    def f(a: list[Column], k: list) -> Column:
        d, n = a[0].try_cast("date"), I(a[1]) * sign
        unit = F.upper(a[2]) if len(a) > 2 else F.lit("DAY")
        return F.when(unit.isin("DAY", "DAYS"), F.date_add(d, n)).when(unit.isin("WEEK", "WEEKS"), F.date_add(d, n * 7)).when(unit.isin("MONTH", "MONTHS"), F.add_months(d, n))

    return f


fn("DATE_ADD", 2, 3)(_shift(1))
fn("DATE_SUB", 2, 3)(_shift(-1))
simple("DATE_TRUNC", lambda u, d: F.when(F.lower(u).isin("year", "month"), F.call_function("trunc", d.try_cast("date"), u)).when(F.lower(u) == "day", d.try_cast("date")), 2)


def _part(a: list[Column], k: list) -> Column:
    t, u = a[1].try_cast("timestamp_ntz"), F.lower(a[0])
    out = F.when(u == "year", F.year(t)).when(u == "month", F.month(t)).when(u == "day", F.dayofmonth(t)).when(u == "hour", F.hour(t)).when(u == "minute", F.minute(t)).when(u == "second", F.second(t))
    return out.when(u == "quarter", F.quarter(t)).when(u == "week", F.weekofyear(t)).when(u == "dow", F.dayofweek(t) - 1).when(u == "doy", F.dayofyear(t)).cast("long")


fn("DATE_PART", 2)(_part)


def _diff(a: list[Column], k: list) -> Column:
    u, x, y = F.lower(a[0]), a[1].try_cast("date"), a[2].try_cast("date")
    days, months = F.datediff(y, x).cast("long"), F.floor(F.months_between(y, x)).cast("long")
    out = F.when(u.isin("day", "days"), days).when(u.isin("week", "weeks"), F.floor(days / 7)).when(u.isin("hour", "hours"), days * 24).when(u.isin("minute", "minutes"), days * 1440).when(u.isin("second", "seconds"), days * 86400)
    return out.when(u.isin("month", "months"), months).when(u.isin("year", "years"), F.floor(months / 12)).cast("long")


fn("DATE_DIFF TIMESTAMP_DIFF", 3)(_diff)
simple("AGE", lambda d: F.floor(F.datediff(F.current_date(), d.try_cast("date")) / 365).cast("long"), 1)
simple("EPOCH", lambda t: F.unix_seconds(t.try_cast("timestamp_ntz").cast("timestamp")), 1)
simple("MONTHNAME", lambda d: F.date_format(d.try_cast("timestamp_ntz"), "MMMM"), 1)
simple("DAYNAME", lambda d: F.date_format(d.try_cast("timestamp_ntz"), "EEEE"), 1)
_year = lambda d: F.year(d.try_cast("date"))
simple("LEAP_YEAR", lambda d: ((_year(d) % 4 == 0) & (_year(d) % 100 != 0)) | (_year(d) % 400 == 0), 1)

# -- lists
simple("LIST_CONTAINS", lambda x, e: F.array_contains(x, e), 2)
fn("RANGE", 2, 3)(lambda a, k: _range(*[x.try_cast("long") for x in a]))


#: Elements of a range at most.
LONGEST = 10_000_000


def _range(a: Column, b: Column, step: Column | None = None) -> Column:
    step = F.lit(1).cast("long") if step is None else step
    fits = ((step > 0) & (a <= b)) | ((step < 0) & (a >= b))
    if_ok = F.sequence(a, F.when(fits, b).otherwise(a), F.when(fits, step).otherwise(F.lit(1).cast("long")))
    return F.when(a.isNull() | b.isNull() | step.isNull(), F.lit(None)).when(step == 0, F.raise_error(F.lit("the step of RANGE is 0"))).when(fits & (F.abs(F.try_divide(b - a, step)) >= LONGEST), F.raise_error(F.lit("RANGE holds too many elements"))).when(fits, if_ok).otherwise(F.array().cast("array<bigint>"))


simple("LIST_APPEND", lambda x, e: F.array_append(x, e), 2)
simple("LIST_PREPEND", lambda x, e: F.array_prepend(x, e), 2)
simple("LIST_CONCAT", lambda x, y: F.concat(x, y), 2)
simple("LIST_EXTRACT", lambda x, i: F.get(x, F.when(I(i) < 0, F.size(x) + I(i)).otherwise(I(i))), 2)


def list_slice(x: Column, a: Column, b: Column | None = None) -> Column:
    lo = F.greatest(I(a), F.lit(1))
    hi = F.size(x) if b is None else F.least(I(b), F.size(x))
    return F.slice(x, lo, F.greatest(F.lit(0), hi - lo + 1))


simple("LIST_SLICE", list_slice, 2, 3)
simple("LIST_DISTINCT", lambda x: F.array_distinct(x), 1)
simple("LIST_SORT", lambda x: F.array_sort(x), 1)
simple("LIST_REVERSE", lambda x: F.reverse(x), 1)
simple("LIST_POSITION", lambda x, e: F.nullif(F.array_position(x, e), F.lit(0).cast("long")), 2)
simple("LIST_INSERT", lambda x, i, e: F.when(I(i).between(F.lit(1), F.size(x) + 1), F.array_insert(x, F.when(I(i).between(F.lit(1), F.size(x) + 1), I(i)).otherwise(1), e)), 3)
simple("LIST_REPLACE", lambda x, a, b: F.transform(x, lambda e: F.when(e == a, b).otherwise(e)), 3)
simple("LIST_REMOVE", lambda x, e: F.array_remove(x, e), 2)
_nums = lambda x: F.filter(F.transform(x, lambda e: e.try_cast("double")), lambda e: e.isNotNull())
_sum = lambda x: F.aggregate(_nums(x), F.lit(0.0), lambda s, e: s + e)
simple("LIST_SUM", lambda x: F.when(F.size(_nums(x)) > 0, _sum(x)), 1)
simple("LIST_AVG", lambda x: F.when(F.size(_nums(x)) > 0, F.try_divide(_sum(x), F.size(_nums(x)))), 1)
simple("LIST_MIN", lambda x: F.array_min(_nums(x)), 1)
simple("LIST_MAX", lambda x: F.array_max(_nums(x)), 1)

# -- maps, structs, JSON
simple("MAP_CREATE MAP_KV_LIST MAP", lambda k, v: F.map_from_arrays(k, v), 2)
simple("MAP_KEYS", lambda m: F.map_keys(m), 1)
simple("MAP_VALUES", lambda m: F.map_values(m), 1)
simple("MAP_EXTRACT", lambda m, k: F.try_element_at(m, k), 2)
simple("MAP_REMOVE", lambda m, k: F.map_filter(m, lambda a, _: a != k), 2)
simple("MAP_CONTAINS_KEY", lambda m, k: F.map_contains_key(m, k), 2)
simple("MAP_CONTAINS_VALUE", lambda m, v: F.array_contains(F.map_values(m), v), 2)
simple("STRUCT_PACK", lambda k, v: F.map_from_arrays(k, v), 2)  # with literal keys the compiler builds a struct
fn("STRUCT_EXTRACT", 2)(lambda a, k: F.try_element_at(a[0], a[1]) if isinstance(k[0], T.MapType) else F.lit(None))  # of a struct in the compiler
simple("JSON_PARSE", lambda s: F.try_parse_json(S(s)), 1)
fn("JSON_SERIALIZE", 1)(lambda a, k: F.to_json(a[0]) if isinstance(k[0], T.StructType | T.ArrayType | T.MapType | T.VariantType) else F.when(a[0].isNotNull(), F.regexp_replace(F.to_json(F.struct(a[0].alias("x"))), r"^\{\"x\":|\}$", "")))
simple("NODES", lambda p: F.filter(p, lambda x, i: i >= 0), 1)
simple("OFFSET", lambda x: F.monotonically_increasing_id(), 1)


def scalar(name: str, args: list[Column], kinds: list) -> Column:
    if name in USER:
        return USER[name](*args)
    if name not in SCALARS:
        raise ValueError(f"unknown function {name}")
    f, least, most = SCALARS[name]
    if not least <= len(args) <= most:
        raise ValueError(f"{name} takes {least} to {most} arguments, not {len(args)}")
    return f(args, kinds)


def register(name: str, f: Callable, returns: str = "double") -> None:
    """A user function over pandas Series, called in queries as NAME(...)."""
    USER[name.upper()] = F.pandas_udf(f, returns)


#: User aggregates: a function of the list of a group's values.
USER_AGGREGATES: dict[str, Callable] = {}


def register_aggregate(name: str, f: Callable, returns: str = "double") -> None:
    """A user aggregate over one group's values as a pandas Series, called as NAME(x); groups must fit a task."""
    import pandas as pd

    def whole(v: pd.Series) -> float:
        return f(v)

    whole.__annotations__ = {"v": pd.Series, "return": float if returns == "double" else int if returns in ("long", "int") else str}
    USER_AGGREGATES[name.upper()] = F.pandas_udf(whole, returns)
    AGGREGATES.add(name.upper())


# -- aggregates
AGGREGATES = set("COUNT COUNT_DISTINCT SUM AVG MIN MAX COLLECT COLLECT_DISTINCT STDDEV STDDEV_POP STDDEV_SAMP VAR VARIANCE VAR_POP VAR_SAMP GROUP_CONCAT MEDIAN".split())


def aggregate(name: str, arg: Column | None, distinct: bool, kind=None) -> Column:
    if name in USER_AGGREGATES:
        return USER_AGGREGATES[name](arg)
    if name == "COUNT" and arg is None:
        return F.count(F.lit(1))
    if name == "COUNT_DISTINCT" or (name == "COUNT" and distinct):
        return F.count_distinct(arg)
    if name == "COUNT":
        return F.count(arg)
    if name == "COLLECT_DISTINCT" or (name == "COLLECT" and distinct):
        return F.array_sort(F.collect_set(arg))
    if name == "COLLECT":
        return F.array_sort(F.collect_list(arg))
    if name == "GROUP_CONCAT":
        values = F.array_distinct(F.collect_list(S(arg))) if distinct else F.collect_list(S(arg))
        return F.when(F.count(arg) > 0, F.array_join(F.array_sort(values), ", "))
    if name == "SUM":
        return F.sum_distinct(arg) if distinct else F.sum(arg)
    if name == "AVG":
        return F.expr("NULL") if arg is None else (F.try_divide(F.sum_distinct(D(arg)), F.count_distinct(arg)) if distinct else F.avg(D(arg)))
    if name in ("MIN", "MAX"):
        return (F.min if name == "MIN" else F.max)(arg)
    if name == "MEDIAN":
        return F.median(D(arg))
    f = {"STDDEV": F.stddev_pop, "STDDEV_POP": F.stddev_pop, "STDDEV_SAMP": F.stddev_samp, "VAR": F.var_pop, "VARIANCE": F.var_pop, "VAR_POP": F.var_pop, "VAR_SAMP": F.var_samp}[name]
    return F.when(F.count(arg) >= 2, f(D(arg)))
