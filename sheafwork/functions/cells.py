"""Numbers, dates and cell values as they stand in text. All columns, no Python on the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, places: int = 0) -> Column:
    """Halves up, towards plus infinity."""
    return F.floor(x * 10**places + 0.5) / 10**places


# Marks of currency, digits that a double holds, digits of a bare run that is an identifier.
CURRENCY = "$€£¥₹₩₪₫₽₴₺₦₱฿"
DIGITS, BARE = 15, 12

def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once: as the variable of a lambda it can't be copied to each place."""
    return F.transform(F.array(value), use)[0]


#: Digits grouped by spaces; by commas, with a decimal dot; by dots, with a decimal comma or without any; not at all.
SPACED = r"^\d{1,3}( \d{3})+([.,]\d+)?$"
COMMAS = r"^\d{1,3}(,\d{3})+(\.\d+)?$"
DOTS = r"^\d{1,3}(\.\d{3})+,\d+$|^\d{1,3}(\.\d{3}){2,}$"
PLAIN = r"^\d+(\.\d+)?$"


def number(body: Column) -> Column:
    """value, decimals and grouped of digits as they are written, null for what isn't a number: a single comma groups
    (1,234) or isn't one (12,5), leading zeros and long bare runs of digits are identifiers, and more digits than a
    double holds aren't read at all."""

    def spaced(b: Column) -> Column:
        grouped = b.rlike(SPACED)
        return bound(F.struct(F.when(grouped, F.replace(b, F.lit(" "), F.lit(""))).otherwise(b).alias("t"), grouped.alias("s")), shaped)

    def shaped(x: Column) -> Column:
        t = x["t"]
        shape = F.when(t.rlike(PLAIN), "plain").when(t.rlike(COMMAS), "commas").when(t.rlike(DOTS), "dots")
        return bound(F.struct(t.alias("t"), x["s"].alias("s"), shape.alias("k")), parted)

    def parted(x: Column) -> Column:
        t = F.when(x["k"] == "dots", F.replace(F.replace(x["t"], F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(x["k"] == "commas", F.replace(x["t"], F.lit(","), F.lit(""))).when(x["k"] == "plain", x["t"])
        return bound(F.struct(t.alias("t"), x["s"].alias("s"), (x["k"] != "plain").alias("g"), F.substring_index(t, ".", 1).alias("whole"), F.when(t.contains("."), F.substring_index(t, ".", -1)).otherwise("").alias("rest")), read)

    def read(x: Column) -> Column:
        significant = F.length(F.ltrim(x["whole"], F.lit("0"))) + F.length(x["rest"])
        bare = ~x["g"] & (x["rest"] == "") & (F.length(x["whole"]) >= BARE)
        zeros = x["whole"].startswith("0") & (F.length(x["whole"]) > 1)
        good = x["t"].isNotNull() & ~zeros & (significant <= DIGITS) & ~bare
        return F.when(good, F.struct(x["t"].try_cast("double").alias("value"), F.length(x["rest"]).cast("long").alias("decimals"), (x["s"] | x["g"]).alias("grouped")))

    return bound(body, spaced)


#: What stands before a number, at most twice: a sign or a currency.
FRONT = f"^(?:(?:[-+\u2212]|[A-Za-z]{{0,3}}[{CURRENCY}])\\s*){{0,2}}"


def cell(raw: Column) -> Column:
    """kind (empty, date, ambiguous-date, number, percent, text), value (of dates the day number) and format (date,
    decimal, thousands, percent, general) of a cell. Dates with slashes could be read two ways and stay text."""

    def opened(t: Column) -> Column:
        bracket = t.rlike(r"^\(.+\)$")
        core = F.when(bracket, F.trim(F.substring(t, F.lit(2), F.length(t) - 2))).otherwise(t)
        return bound(F.struct(t.alias("text"), bracket.alias("bracket"), core.alias("core")), fronted)

    def fronted(x: Column) -> Column:
        return bound(F.struct(x["text"], x["bracket"], x["core"], F.regexp_extract(x["core"], FRONT, 0).alias("front")), bodied)

    def bodied(x: Column) -> Column:
        minus = F.length(x["front"]) - F.length(F.translate(x["front"], "-\u2212", "")) + x["bracket"].cast("int")
        body = F.substring(x["core"], F.length(x["front"]) + 1, F.length(x["core"]))
        return bound(F.struct(x["text"], (minus % 2 == 1).alias("minus"), body.alias("body")), parsed)

    def parsed(x: Column) -> Column:
        percent = x["body"].endswith("%")
        body = F.trim(F.regexp_replace(F.trim(F.regexp_replace(x["body"], "%$", "")), rf"\s*[{CURRENCY}]$", ""))
        iso = F.when(x["text"].rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(x["text"], "yyyy-MM-dd"))
        slashed = x["text"].rlike(r"^\d{1,2}[/.]\d{1,2}[/.]\d{2,4}$")
        return bound(F.struct(x["text"], x["minus"], percent.alias("percent"), iso.alias("iso"), slashed.alias("slashed"), number(body).alias("n")), signed)

    def signed(x: Column) -> Column:
        value = F.when(x["minus"], -x["n"]["value"]).otherwise(x["n"]["value"])
        kind = F.when(x["text"] == "", "empty").when(x["iso"].isNotNull(), "date").when(x["slashed"], "ambiguous-date").when(x["n"].isNull(), "text").when(x["percent"], "percent").otherwise("number")
        return bound(F.struct(kind.alias("kind"), value.alias("value"), x["iso"], x["n"]), typed)

    def typed(x: Column) -> Column:
        value = F.when(x["kind"] == "date", serial(x["iso"]).cast("double")).when(x["kind"] == "percent", x["value"] / 100).when(x["kind"] == "number", x["value"])
        shown = F.when(x["n"]["decimals"] == 2, "decimal").when((x["n"]["decimals"] == 0) & x["n"]["grouped"], "thousands").otherwise("general")
        whole = F.when(x["value"] == F.floor(x["value"]), "percent").otherwise("general")
        form = F.when(x["kind"] == "date", "date").when(x["kind"] == "percent", whole).when(x["kind"] == "number", shown)
        return F.struct(x["kind"], value.alias("value"), form.alias("format"))

    return bound(F.trim(F.regexp_replace(raw, r"[\s\u00a0\u2007\u202f]+", " ")), opened)


# Fixed value: headings of columns that hold identifiers.
IDENTIFIERS = r"(?i)(^|[\s(-])(no\.?|num(ber)?|nr\.?|#|id|ref(\.|erence)?|code|acc(t|ount)?|phone|tel|fax|zip|postcode|isbn|sku|serial|barcode|imei|vin)\)?$"


def names_identifiers(heading: Column) -> Column:
    return heading.rlike(IDENTIFIERS)


def looks_numeric(text: Column) -> Column:
    """Whether a field of delimited text is set to the right: a number with currency, percent, commas or brackets."""
    text = F.trim(text)
    bare = F.regexp_replace(F.regexp_replace(text, r"^\((.*)\)$", "-$1"), r"[$€£¥₹\s]", "")
    bare = F.replace(F.regexp_replace(bare, "%$", ""), F.lit(","), F.lit(""))
    return (text != "") & (F.length(text) <= 32) & bare.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$")


def serial(day: Column) -> Column:
    """Day number of a spreadsheet, from 1899-12-30."""
    return F.datediff(day, F.lit("1899-12-30").cast("date")).cast("long")


def from_serial(number: Column) -> Column:
    return F.date_add(F.lit("1899-12-30").cast("date"), F.floor(number).cast("int"))


def letters(column: Column) -> Column:
    """Spreadsheet letters of a column from 0, up to three."""
    letter = lambda x: F.chr((F.lit(65) + x).cast("int"))
    a, b, c = column % 26, F.floor(column / 26 - 1) % 26, F.floor((column / 26 - 1) / 26 - 1)
    one, two = letter(a), F.concat(letter(b), letter(a))
    return F.when(column < 26, one).when(column < 702, two).otherwise(F.concat(letter(c), letter(F.floor(column / 26 - 1) % 26), letter(a)))


def pdf_date(stamp: Column) -> Column:
    return F.concat(F.lit("D:"), F.date_format(stamp, "yyyyMMddHHmmss"), F.lit("Z"))


def human_bytes(n: Column) -> Column:
    """12 MB, 3.4 MB, 56 KB, 7 bytes."""
    mb = n / (1024 * 1024)
    tenth = rounded(mb, 1)
    small = F.when(tenth == F.floor(tenth), F.floor(tenth).cast("long").cast("string")).otherwise(tenth.cast("decimal(20,1)").cast("string"))
    large = F.concat(F.when(mb >= 10, F.floor(mb + 0.5).cast("long").cast("string")).otherwise(small), F.lit(" MB"))
    return F.when(n >= 1024 * 1024, large).when(n >= 1024, F.concat(F.floor(n / 1024 + 0.5).cast("long").cast("string"), F.lit(" KB"))).otherwise(F.concat(n.cast("string"), F.lit(" bytes")))


def serial_text(number_: Column, from_1904: Column | bool = False) -> Column:
    """A spreadsheet's day number as a date, with the time if it has a fraction."""
    days = number_ + F.when(F.lit(from_1904) if isinstance(from_1904, bool) else from_1904, 1462).otherwise(0)
    stamp = F.timestamp_millis(F.floor((days - 25569) * 86_400_000 + 0.5).cast("long"))
    return F.when(number_ == F.floor(number_), F.date_format(stamp, "yyyy-MM-dd")).otherwise(F.date_format(stamp, "yyyy-MM-dd HH:mm"))


def reference(ref: Column) -> Column:
    """col and row, from 0, of a reference such as $BC$12; what isn't one is the first cell."""
    p = r"^\$?([A-Z]+)\$?(\d+)$"
    letters_ = F.split(F.regexp_extract(ref, p, 1), "")
    col = F.aggregate(F.filter(letters_, lambda c: c != ""), F.lit(0).cast("long"), lambda n, c: n * 26 + F.ascii(c) - 64)
    found = ref.rlike(p)
    return F.struct(F.when(found, col - 1).otherwise(0).alias("col"), F.when(found, F.regexp_extract(ref, p, 2).try_cast("long") - 1).otherwise(0).alias("row"))


def width_in_points(width: Column) -> Column:
    return F.floor((width * 7 + 5) * 0.75 + 0.5).cast("long")


def trimmed_noise(x: Column) -> Column:
    """Without the last digits that come of binary fractions."""
    return F.floor(x * 1e10 + 0.5) / 1e10


# Units of office files in a point.
TWIPS, HALF_POINTS, EMU = 20, 2, 12700


def in_units(points: Column, unit: int) -> Column:
    return F.floor(points * unit + 0.5).cast("long")


def size_in_bytes(text: Column) -> Column:
    """3.5 MB as bytes; null if no size is named."""
    p = r"(?i)([\d.]+)\s*(KB|MB|GB|B)"
    power = F.array_position(F.array(*map(F.lit, ("B", "KB", "MB", "GB"))), F.upper(F.regexp_extract(text, p, 2))) - 1
    return F.regexp_extract(text, p, 1).try_cast("double") * F.pow(F.lit(1024.0), power.cast("double"))


def counted(n: Column, one: str, many: str | None = None) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {one}").otherwise(f" {many or one + 's'}"))


def listed(items: Column) -> Column:
    """4, 9 and 12."""
    text = F.transform(items, lambda x: x.cast("string"))
    head = F.array_join(F.slice(text, 1, F.greatest(F.size(text) - 1, F.lit(1))), ", ")
    return F.when(F.size(text) > 1, F.concat(head, F.lit(" and "), F.element_at(text, -1))).otherwise(head)
