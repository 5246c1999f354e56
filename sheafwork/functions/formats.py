"""Number formats of spreadsheets: a code is compiled once to what it asks for, and then applied to its column."""

from __future__ import annotations

import functools
import math
import re
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Formats by number, and the numbers that stand for dates and times.
BUILT_IN = {
    1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%",
    37: "#,##0;-#,##0", 38: "#,##0;-#,##0", 39: "#,##0.00;-#,##0.00", 40: "#,##0.00;-#,##0.00", 44: '"$"#,##0.00',
}
DATES = (*range(14, 23), 45, 46, 47)

#: A quoted literal, a bracket, an escaped or a reserved character, a run of digit places, anything else.
TOKEN = re.compile(r'"([^"]*)"?|\[([^\]]*)\]?|\\(.?)|_.?|([#0.,]+)|(.)', re.S)


def built_in(number: Column) -> Column:
    codes = F.create_map(*(F.lit(x) for pair in BUILT_IN.items() for x in pair))
    return F.coalesce(F.try_element_at(codes, number.cast("int")), F.lit(""))


def is_date(code: Column) -> Column:
    """Whether a code shows a date or a time; literals and conditions don't count."""
    bare = F.regexp_replace(code, r'"[^"]*"|\[[^\]]*\]|\\.', "")
    return bare.rlike("(?i)[ymdhs]")


@dataclass(frozen=True)
class Section:
    """What stands before and after the digits; what the number is multiplied and divided by; its decimals, least digits, groups, and
    whether zeros at the end are shown."""

    before: str
    after: str
    factor: float
    divisor: float
    decimals: int
    least: int
    grouped: bool
    full: bool


@functools.lru_cache(maxsize=4096)
def sections(code: str) -> tuple[str, ...]:
    """At semicolons outside literals and brackets."""
    out = []
    for text, end in re.findall(r'((?:"[^"]*"?|\[[^\]]*\]?|[^;"\[])*)(;|$)', code):
        out.append(text)
        if not end:
            break
    return tuple(out)


@functools.lru_cache(maxsize=4096)
def compiled(section: str) -> Section | None:
    """None for what isn't shown by these rules: fractions, exponents, text, general."""
    if not section or section.lower() == "general" or re.search(r"[?eE@]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", section)):
        return None
    sides, places, percents = ["", ""], "", 0
    for literal, bracket, escaped, digits, other in TOKEN.findall(section):
        if digits:
            places += digits
            continue
        percents += other == "%"
        money = bracket[1:].split("-")[0] if bracket.startswith("$") else ""
        sides[bool(places)] += literal or money or escaped or other
    if not places:
        return None
    thousands = re.search(r",+(?=\.|$)", places)  # each at the end scales
    whole, _, rest = re.sub(r",+(?=\.|$)", "", places, count=1).partition(".")
    rest = rest.split(".")[0]
    divisor = 1000.0 ** (len(thousands[0]) if thousands else 0)
    return Section(*sides, 100.0**percents, divisor, len(re.findall("[0#]", rest)), whole.count("0"), "," in whole, "0" in rest)


def rounded(x: float, decimals: int, even: bool = False) -> str:
    """Fixed decimals of a number that isn't negative; halves, where a double can hold one, go up or, if asked, to the even digit."""
    twice = x * 2 * 10**decimals
    if not even and twice < 2**53 and twice % 2 == 1:
        return str(Decimal(x).quantize(Decimal(1).scaleb(-decimals), ROUND_HALF_UP))
    return f"{x:.{decimals}f}"


def shown(value: float | None, code: str | None, printf: bool = False) -> str | None:
    """The value under the code; None if the code isn't one of these. Spreadsheets round halves up, have no negative zero and show only
    finite numbers; with `printf`, halves go to the even digit, every sign is kept, and infinity and NaN are shown by name, as SQL does."""
    parts = sections(code or "")
    if value is None or not (printf or math.isfinite(value)) or not parts:
        return None
    s = compiled(parts[1] if value < 0 and len(parts) > 1 else parts[2] if value == 0 and len(parts) > 2 else parts[0])
    if s is None:
        return None
    whole, _, fraction = rounded(abs(value * s.factor / s.divisor), s.decimals, printf).partition(".")
    if whole.isdecimal():
        whole = "" if not s.least and whole == "0" and s.decimals else whole.rjust(s.least, "0")
    if s.grouped:
        whole = re.sub(r"\B(?=(\d{3})+$)", ",", whole)
    fraction = fraction if s.full else fraction.rstrip("0")
    negative = math.copysign(1, value) < 0 if printf else value < 0
    sign = "-" if negative and len(parts) == 1 else ""
    return f"{sign}{s.before}{whole}{'.' + fraction if fraction else ''}{s.after}"


def formatted(value: Column, code: Column, printf: bool = False) -> Column:
    """`shown` over columns; a null is null, and NaN, which pandas would take for one, isn't."""

    @F.arrow_udf(StringType())
    def made(values: pa.Array, codes: pa.Array) -> pa.Array:
        rows = zip(*(x.to_numpy(zero_copy_only=False).tolist() for x in (values, values.is_null(), codes)))
        return pa.array([shown(None if null else float(v), c, printf) for v, null, c in rows], pa.string())

    return made(value, code)
