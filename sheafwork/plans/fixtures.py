"""Queries over small literal tables, one row for each branch of a rule, beside what the rule says of them."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells, dates, formats, media, names, secure, xmp
from ..functions import geometry as G
from ..functions import markdown as M
from ..functions import text as T
from ..operators import compare, delimited, grids, outline, paging, records, structure
from ..sources import office
from ..streaming import state
from . import dispatch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def literal(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, int):
        return f"{v}::bigint"
    if isinstance(v, float):
        return f"{v!r}::double"
    if isinstance(v, (list, tuple)):
        return f"[{', '.join(map(literal, v))}]"
    return "'" + str(v).replace("'", "''") + "'"


def kind(values: list) -> str:
    v = next((x for x in values if x is not None), "")
    if isinstance(v, (list, tuple)):
        return kind([y for x in values if x for y in x]) + "[]"
    return "boolean" if isinstance(v, bool) else "bigint" if isinstance(v, int) else "double" if isinstance(v, float) else "varchar"


def expect(name: str, columns: str, rows: list[tuple], query: Query) -> None:
    """A query and the rows it must give, as SQL."""
    titles = columns.split()
    kinds = [kind([r[i] for r in rows]) for i in range(len(titles))]
    values = ", ".join("(" + ", ".join(literal(v) for v in r) + ")" for r in rows)
    chosen = ", ".join(f'"{c}"::{k} as "{c}"' for c, k in zip(titles, kinds))
    quoted = ", ".join(f'"{c}"' for c in titles)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir)
        whole = lambda t: t.replace("int", "bigint") if "int" in t and "bigint" not in t else t
        return df.select(*(F.col(f.name).cast(whole(f.dataType.simpleString())).alias(f.name) for f in df.schema if f.name in titles))

    QUERIES[name] = run
    ORACLES[name] = f"select {chosen} from (values {values}) t({quoted})"


def made(spark: SparkSession, ddl: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, ddl)


def scalar(name: str, ddl: str, out: str, rows: list[tuple], f: Callable[..., Column | list[Column]]) -> None:
    """f over the input columns of rows (inputs, then outputs); the first input is the number of the row."""
    n, titles = len(ddl.split(",")), out.split()

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = made(spark, f"id long, {ddl}", [(i, *r[:n]) for i, r in enumerate(rows)])
        made_ = f(*(F.col(c) for c in df.columns[1:]))
        found = made_ if isinstance(made_, (list, tuple)) else [made_]
        return df.select("id", *(c.alias(t) for c, t in zip(found, titles)))

    expect(name, "id " + out, [(i, *r[n:]) for i, r in enumerate(rows)], run)


def parts(c: Column, titles: str) -> list[Column]:
    return [c[t] for t in titles.split()]


def rounded(values) -> list[Column]:
    return [F.round(v, 6) for v in values]


# text ------------------------------------------------------------------------------------------------------------

scalar("heading_rule", "t string, ratio double, bold boolean", "level", [
    ("Big title", 1.6, False, 1), ("Large", 1.4, False, 2), ("Larger", 1.2, False, 3), ("A little larger", 1.1, False, 3),
    ("one two three four five six seven eight nine", 1.1, False, 0), ("Bold label", 1.03, True, 4), ("Bold label", 1.01, True, 0),
    ("SECTION ONE", 1.0, False, 4), ("AB", 1.0, False, 0), ("Mixed CASE", 1.0, False, 0), ("a b c d e f g h i j k l m n o", 2.0, True, 0), ("plain words", 1.0, False, 0),
], T.heading_level)
scalar("list_marks", "t string", "marker rest ordered", [
    ("• first", "•", "first", False), ("1. one", "1", "one", True), ("  iv) four", "iv", "four", True), ("B. bee", "B", "bee", True), ("1234. no", None, None, None), ("plain", None, None, None), ("– not known", None, None, None),
], lambda t: parts(T.list_marker(t, F.array(F.lit("•"))), "marker rest ordered"))
scalar("signature_rule", "t string, baseline double, bottom double", "sig", [
    ("Page 12 of 90", 30.0, 32.0, "top:page # of #"), ("  The   Report ", 780.0, 790.0, "bottom:the report"), ("Body", 400.0, 402.0, ""), (" ", 30.0, 32.0, ""),
], lambda t, a, b: T.running_signature(t, a, b, F.lit(800.0)))
scalar("tab_stops", "t string", "expanded", [("a\tb", "a   b"), ("abcd\te", "abcd    e"), ("\t\tx", "        x"), ("none", "none"), ("ab\tcde\tf", "ab  cde f")], lambda t: T.tabs_expanded(t, 4))
scalar("slug_rule", "t string", "slug", [
    ("Chapter 1: Über Straße", "Chapter-1-Über-Straße"), ("  a   b\tc ", "a-b-c"), ("..hidden--name..", "hidden-name"), ("CON", ""), ("///", ""),
    ("A rather long title that goes on well beyond the sixty characters allowed", "A-rather-long-title-that-goes-on-well-beyond-the-sixty"),
    ("x" * 70, "x" * 60), ("short-" + "y" * 70, "short-" + "y" * 54),
], T.slug)
scalar("unescape_rule", "t string", "plain", [
    ("&lt;b&gt; &quot;x&quot; &apos;y&apos;", "<b> \"x\" 'y'"), ("&amp;lt;", "&lt;"), ("caf&#233; &#x20AC;", "café €"), ("&nbsp; & done", "&nbsp; & done"), ("&#128512;", "😀"), ("", ""),
], T.unescaped)
scalar("escape_rule", "t string", "body attribute", [
    ("a < b & c > d", "a &lt; b &amp; c &gt; d", "a &lt; b &amp; c &gt; d"), ('say "x"', 'say "x"', "say &quot;x&quot;"), ("a\r\nb\tc\x01", "a\nb\tc", "a&#10;b&#9;c"),
], lambda t: [T.escaped(t), T.escaped_attribute(t)])
scalar("noise_rule", "t string", "n garbled fragments noisy", [
    (" ".join(["ab"] * 10 + ["w0rd"] * 10 + ["plain"] * 60), 80, 10, 10, True), (" ".join(["ab"] * 2 + ["w0rd"] * 20 + ["plain"] * 60), 82, 20, 2, False),
    (" ".join(["it's", "e-mail", "a.b.c"] * 20), 60, 20, 0, False), ("ab c0d", 2, 1, 1, False),
], lambda t: parts(T.noise(t), "n garbled fragments noisy"))
scalar("soft_hyphens", "a string, b string", "joined", [("exam-", "ple", "example"), ("exam-", "Ple", "exam- Ple"), ("1-", "a", "1- a"), ("no", "hyphen", "no hyphen"), ("é-", "é", "éé")], T.dehyphenated)
scalar("strength_rule", "t string", "bits strength", [("", 0, "Weak"), ("aaaaaaaa", 14, "Weak"), ("abcdefgh", 38, "Weak"), ("Abcdefg1", 48, "Fair"), ("Abcdefgh1234", 71, "Strong"), ("Abcdefgh1234!?", 92, "Very strong")], lambda t: [T.entropy_bits(t), T.strength(T.entropy_bits(t))])

# names -----------------------------------------------------------------------------------------------------------

scalar("extensions", "t string", "ext stem", [("a.PDF", "pdf", "a"), ("a.tar.gz", "gz", "a.tar"), ("noext", "", "noext"), ("x.toolongext", "", "x.toolongext"), ("y.", "", "y.")], lambda t: [names.extension(t), names.stem(t)])
scalar("safe_names", "t string, e string", "name", [
    ("report", "pdf", "report.pdf"), ("report.pdf", "pdf", "report.pdf"), ("report.exe", "pdf", "report.exe.pdf"), (".pdf", "pdf", "document.pdf"), ("..a  b. ", "pdf", "a b.pdf"),
    ("CON", "pdf", "CON-file.pdf"), ("lpt1.x", "", "lpt1.x-file"), ("a<b>:c", "txt", "abc.txt"), ("é", "md", "é.md"), ("‮gpj", "pdf", "gpj.pdf"), ("x" * 300, "pdf", "x" * 176 + ".pdf"), ("é" * 100, "pdf", "é" * 88 + ".pdf"),
], names.safe_filename)
scalar("series_names", "t string, o array<string>", "found", [
    ("report", ["a.pdf", "b.pdf"], ["report-1.pdf", "report-2.pdf"]), ("report", ["a.pdf", "a.txt"], ["report.pdf", "report.txt"]), ("", ["scan.pdf"], ["scan.pdf"]),
], names.name_series)
scalar("batch_of_names", "o array<string>", "found", [(["same.pdf", "SAME.pdf", "x.pdf", "../unsafe.txt", "same.pdf"], ["same.pdf", "2 - SAME.pdf", "x.pdf", "unsafe.txt", "3 - same.pdf"])], names.batch_names)
scalar("sheet_name_repair", "o array<string>", "found", [
    (["Totals", "totals", "a:b/c", "'quoted'", "", "x" * 40, "x" * 31], ["Totals", "totals (2)", "a b c", "quoted", "Sheet", "x" * 31, "x" * 27 + " (2)"]),
], names.sheet_names)
scalar("response_names", "t string", "name", [("My page: a/b?", "My page ab.pdf"), ("", "page.pdf"), ("???", "page.pdf"), ("y" * 80, "y" * 60 + ".pdf")], names.response_name)

# security --------------------------------------------------------------------------------------------------------

scalar("url_refusals", "t string", "why", [
    ("https://example.com/a", None), ("ftp://example.com", "scheme"), ("file:///etc/passwd", "scheme"), ("example.com", "scheme"), ("http://", "host"), ("http://127.0.0.1/", "private"), ("http://10.1.2.3", "private"),
    ("http://169.254.169.254/latest", "private"), ("http://[::1]/", "private"), ("http://0.0.0.0", "private"), ("http://100.64.0.1", "private"), ("http://[::ffff:10.0.0.1]", "private"), ("http://8.8.8.8", None), ("http://user@192.168.0.1/", "private"), ("http://localhost:80", "private"), ("http://224.0.0.1", "private"),
], secure.url_refusal)
scalar("database_urls", "t string", "url pooled", [
    ("postgres://u:p@host/db", "postgresql+asyncpg://u:p@host/db", False), ("postgresql://u:p@ep-x-pooler.eu/db?sslmode=require&channel_binding=require", "postgresql+asyncpg://u:p@ep-x-pooler.eu/db", True),
    ("postgresql://h/db?sslmode=require&a=1", "postgresql+asyncpg://h/db?a=1", False), ("sqlite:///x.db", "sqlite:///x.db", False), ("postgres://h/db?options=x&b", "postgresql+asyncpg://h/db?b=", False),
], lambda t: parts(secure.database_url(t), "url pooled"))
scalar("lifted_rights", "p long", "found", [
    (-1, []), (-4, []), (-8, ["printing"]), (-2052, ["printing at full resolution"]), (0, ["printing", "editing", "copying text", "commenting", "filling in forms", "reordering pages"]), (-3904 | 1280, ["printing", "editing", "copying text", "commenting"]), (-44, ["editing", "commenting"]),
], secure.lifted)
scalar("rewrite_verdicts", "a string, b string", "why", [
    ("x" * 50, "", "empty"), ("short", "%PDF longer %%EOF", "not smaller"), ("x" * 50, "junk %%EOF", "not a document"), ("x" * 50, "%PDF cut", "truncated"), ("x" * 50, "%PDF %%EOF %%EOF\n", "revisions"), ("x" * 50, "%PDF body %%EOF\n ", None),
], lambda a, b: secure.verdict(a.cast("binary"), b.cast("binary")))
scalar("strip_verdicts", "t string", "why", [("a %%EOF", None), ("a", "revisions"), ("%%EOF <?xpacket", "packet"), ("<x:xmpmeta> %%EOF", "packet"), ("about xmpmeta %%EOF", None)], lambda t: secure.stripped(t.cast("binary")))

# dates -----------------------------------------------------------------------------------------------------------

DATE = "year month day hour minute second offset"
scalar("stored_dates", "t string", DATE + " iso shown", [
    ("D:20260102030405+02'00'", 2026, 1, 2, 3, 4, 5, 120, "2026-01-02T03:04:05+02:00", "2 January 2026, 03:04:05 UTC+02:00"), ("D:2026", 2026, 1, 1, 0, 0, 0, None, "2026-01-01T00:00:00", "1 January 2026, 00:00:00 (no time zone recorded)"),
    ("20260403090000Z", 2026, 4, 3, 9, 0, 0, 0, "2026-04-03T09:00:00Z", "3 April 2026, 09:00:00 UTC"), ("D:20260231", 2026, 2, 31, 0, 0, 0, None, "2026-02-31T00:00:00", "31 February 2026, 00:00:00 (no time zone recorded)"), ("D:20261301", *[None] * 9), ("D:20260101240000", *[None] * 9),
    ("D:20260101000060-0330", 2026, 1, 1, 0, 0, 60, -210, "2026-01-01T00:00:60-03:30", "1 January 2026, 00:00:60 UTC-03:30"), ("junk", *[None] * 9), ("D:202601020304 junk", 2026, 1, 2, 3, 4, 0, None, "2026-01-02T03:04:00", "2 January 2026, 03:04:00 (no time zone recorded)"), ("D:20260102030405+", 2026, 1, 2, 3, 4, 5, 0, "2026-01-02T03:04:05Z", "2 January 2026, 03:04:05 UTC"), ("D:0000", *[None] * 9),
], lambda t: [*parts(dates.stored(t), DATE), dates.to_iso(dates.stored(t)), dates.to_read(dates.stored(t))])
scalar("typed_dates", "t string", DATE + " stored", [
    ("2026-04-03", 2026, 4, 3, 0, 0, 0, None, "D:20260403000000"), ("2026-04-03T09:30", 2026, 4, 3, 9, 30, 0, None, "D:20260403093000"), ("2026-04-03 09:30:15Z", 2026, 4, 3, 9, 30, 15, 0, "D:20260403093015Z"), ("2026-04-03T09:30:15-0530", 2026, 4, 3, 9, 30, 15, -330, "D:20260403093015-05'30'"),
    ("2026-13-03", *[None] * 8), ("3 April", *[None] * 8), ("", *[None] * 8), ("D:20260102", 2026, 1, 2, 0, 0, 0, None, "D:20260102000000"),
], lambda t: [*parts(dates.typed(t), DATE), dates.to_store(dates.typed(t))])

# cells and sheets ------------------------------------------------------------------------------------------------

scalar("cell_rules", "t string", "kind value format", [
    ("", "empty", None, None), ("   ", "empty", None, None), ("1900-01-01", "date", 2.0, "date"), ("2026-02-31", "text", None, None), ("03/04/2026", "ambiguous-date", None, None), ("3.4.26", "ambiguous-date", None, None), ("1,234.50", "number", 1234.5, "decimal"), ("1,234", "number", 1234.0, "thousands"), ("12,5", "text", None, None),
    ("1.234,56", "number", 1234.56, "decimal"), ("1.234.567", "number", 1234567.0, "thousands"), ("1 234 567", "number", 1234567.0, "thousands"), ("1 555 123 4567", "text", None, None), ("1.5", "number", 1.5, "general"), ("007", "text", None, None), ("0", "number", 0.0, "general"), ("0.25", "number", 0.25, "decimal"), ("123456789012", "text", None, None), ("12345678901", "number", 12345678901.0, "general"), ("1,234,567,890,123,456", "text", None, None),
    ("(1,234)", "number", -1234.0, "thousands"), ("($5.00)", "number", -5.0, "decimal"), ("-$5", "number", -5.0, "general"), ("$-5", "number", -5.0, "general"), ("(-5)", "number", 5.0, "general"), ("−7", "number", -7.0, "general"), ("+8", "number", 8.0, "general"), ("US$ 9", "number", 9.0, "general"), ("12 €", "number", 12.0, "general"), ("12 EUR", "text", None, None), ("12.5%", "percent", 0.125, "general"), ("50 %", "percent", 0.5, "percent"), ("-3%", "percent", -0.03, "percent"), ("12-5", "text", None, None), ("1,23,456", "text", None, None), ("abc", "text", None, None), ("1,234,567", "number", 1234567.0, "thousands"), ("1 234,5", "text", None, None),
], lambda t: parts(cells.cell(t), "kind value format"))
scalar("identifier_headings", "t string", "found", [("Invoice No.", True), ("Number of units", False), ("Ticket number", True), ("id", True), ("paid", False), ("SKU", True), ("Account", True), ("Phone (tel)", True)], cells.names_identifiers)
scalar("numeric_fields", "t string", "found", [("$1,234.5", True), ("(12)", True), ("12%", True), ("-", False), ("", False), ("1e5", True), ("12 kg", False), (" 7 ", True), ("1" * 33, False), ("(a)", False)], cells.looks_numeric)
scalar("format_codes", "v double, c string", "shown", [
    (1234.5, "#,##0.00", "1,234.50"), (-1234.5, "#,##0.00", "-1,234.50"), (-1234.5, "#,##0;(#,##0)", "(1,235)"), (0.256, "0%", "26%"), (0.256, "0.00%", "25.60%"), (5.0, "000", "005"), (1234567.0, "#,##0,", "1,235"), (1234567.0, '0.0,,"M"', "1.2M"), (12.0, "[$€-407] 0.00", "€ 12.00"), (0.5, "#.##", ".5"), (2.0, "#.##", "2"),
    (0.0, '0.00;(0.00);"zero"', None), (0.0, '0.00;(0.00);"nil "0', "nil 0"), (3.0, "0\\x", "3x"), (3.0, "_(0_)", "3"), (3.0, "General", None), (3.0, "0.0E+0", None), (3.0, "# ?/?", None), (3.0, "@", None), (44.5, '"$"#,##0.00', "$44.50"), (-3.0, "0", "-3"), (3.0, "[Red]0", "3"), (3.0, "", None), (1234.5, "#,##0", "1,235"), (0.4, "#", "0"),
], formats.formatted)
scalar("built_in_formats", "n long", "code", [(1, "0"), (4, "#,##0.00"), (10, "0.00%"), (44, '"$"#,##0.00'), (14, ""), (99, "")], formats.built_in)
scalar("date_codes", "t string", "found", [("yyyy-mm-dd", True), ("0.00", False), ('"day" 0', False), ("[Red]0", False), ("h:mm", True), ("\\d0", False)], formats.is_date)
scalar("serial_dates", "v double, b boolean", "shown", [(1.0, False, "1899-12-31"), (45000.0, False, "2023-03-15"), (45000.5, False, "2023-03-15 12:00"), (0.0, True, "1904-01-01"), (45000.25, True, "2027-03-16 06:00")], lambda v, b: cells.serial_text(v, b))
scalar("cell_references", "t string", "col row", [("A1", 0, 0), ("BC12", 54, 11), ("$Z$9", 25, 8), ("AAA100", 702, 99), ("a1", 0, 0), ("12", 0, 0)], lambda t: parts(cells.reference(t), "col row"))
scalar("column_letters", "n long", "name", [(0, "A"), (25, "Z"), (26, "AA"), (701, "ZZ"), (702, "AAA"), (54, "BC"), (16383, "XFD")], cells.letters)
scalar("office_units", "v double", "width twips half emu trimmed", [(8.43, 48, 169, 17, 107061, 8.43), (0.1 + 0.2, 5, 6, 1, 3810, 0.3), (10.0, 56, 200, 20, 127000, 10.0)], lambda v: [cells.width_in_points(v), *(cells.in_units(v, u) for u in (cells.TWIPS, cells.HALF_POINTS, cells.EMU)), cells.trimmed_noise(v)])
scalar("parse_bytes", "t string", "n", [("3.5 MB", 3670016.0), ("12kb", 12288.0), ("7 B", 7.0), ("1 GB free", 1073741824.0), ("none", None), ("2.5.1 MB", None)], cells.size_in_bytes)
scalar("counted_and_listed", "n long, o array<long>", "plural listed", [(1, [4], "1 page", "4"), (2, [4, 9], "2 pages", "4 and 9"), (0, [4, 9, 12], "0 pages", "4, 9 and 12")], lambda n, o: [cells.counted(n, "page"), cells.listed(o)])
scalar("delimiter_sniff", "t string", "found", [
    ("a;b;c\n1;2;3\n", ";"), ("a,b\n1,2\n", ","), ("a\tb\tc\n1\t2\t3", "\t"), ("one\ntwo", ","), ('"x;y",b\n"1;2",3\n', ","), ("a,b;c\n1,2;3\n", ","), ("\n\n a;b \n", ";"),
], delimited.sniffed)

# bytes -----------------------------------------------------------------------------------------------------------

raw = lambda c: F.unhex(c)
scalar("accepted_files", "t string", "kind text_kind", [("a.JPG", "image", None), ("a.docx", "office", None), ("a.mkdn", "text", "markdown"), ("a.TSV", "text", "csv"), ("a.log", "text", "text"), ("a.pdf", "pdf", None), ("a.exe", None, None)], lambda t: [media.accepted(t), media.text_kind(t)])
scalar("magic_bytes", "h string", "kind", [("FFD8FFE000", "jpeg"), ("89504E470D0A1A0A00", "png"), ("52494646000000005745425056", "webp"), ("5249464600000000574156", None), ("", None), ("25504446", None)], lambda h: media.image_kind(raw(h)))
scalar("content_hashes", "t string", "hash", [("", "0:811c9dc5"), ("a", "1:e40c292c"), ("foobar", "6:bf9cf968")], lambda t: media.fingerprint(t.cast("binary")))
scalar("decode_bytes", "h string", "text encoding", [
    ("EFBBBF6869", "hi", "UTF-8 mark"), ("FFFE68006900", "hi", "UTF-16LE mark"), ("FEFF00680069", "hi", "UTF-16BE mark"), ("6100620063006400", "abcd", "UTF-16LE"), ("0061006200630064", "abcd", "UTF-16BE"), ("63C3A9", "cé", "UTF-8"), ("63E980", "cé€", "Windows-1252"), ("", "", "UTF-8"),
], lambda h: parts(media.decode_text(raw(h)), "text encoding"))
scalar("newline_rule", "t string", "text", [("\ufeffa\r\nb\rc\n\ufeffd", "a\nb\nc\nd"), ("x", "x")], media.one_newline)
EXIF = "FFD8FFE1001E457869660000{order}{magic}{offset}{count}{tag}{kind}{n}{value}0000"
_little = dict(order="4949", magic="2A00", offset="08000000", count="0100", tag="1201", kind="0300", n="01000000")
_big = dict(order="4D4D", magic="002A", offset="00000008", count="0001", tag="0112", kind="0003", n="00000001")
scalar("photo_turns", "h string", "turn", [(EXIF.format(**_little, value="0600"), 90), (EXIF.format(**_big, value="0008"), 270), (EXIF.format(**_big, value="0003"), 180), (EXIF.format(**_little, value="0900"), 0), ("FFD8FFDA0000", 0), ("FFD8", 0), (EXIF.format(**_little, value="0200"), 0)], lambda h: media.photo_turn(raw(h)))
scalar("character_maps", "t string", "codes found", [
    ("2 beginbfchar\n<01> <0041>\n<02> <00420043>\nendbfchar", [1, 2], ["0041", "00420043"]), ("1 beginbfrange <10> <12> <D83D0061> endbfrange", [16, 17, 18], ["D83D0061", "D83D0062", "D83D0063"]), ("1 beginbfrange <20> <21> [<0031> <0032>] endbfrange", [32, 33], ["0031", "0032"]), ("none", [], []),
], lambda t: [F.array_sort(F.map_keys(media.parse_cmap(t))), F.transform(F.array_sort(F.map_entries(media.parse_cmap(t))), lambda e: e["value"])])
scalar("write_cmap", "k array<long>, v array<string>", "text", [([2, 1], ["0042", "0041"], "2 beginbfchar\n<0001> <0041>\n<0002> <0042>\nendbfchar"), ([5], [""], "")], lambda k, v: media.cmap_blocks(F.map_from_arrays(k, v)))
scalar("cmap_block_sizes", "n long", "sizes", [(250, ["100", "100", "50"]), (100, ["100"])], lambda n: F.regexp_extract_all(media.cmap_blocks(F.map_from_entries(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.struct(i, F.lit("0041"))))), F.lit("([0-9]+) beginbfchar"), F.lit(1)))
scalar("content_tokens", "t string", "kinds found", [
    ("BT /F1 12 Tf (a(b)\\)c) Tj <48 65> Tj % note\n[1 -2.5]TJ", ["operator", "name", "other", "operator", "literal", "operator", "hex", "operator", "other", "other", "other", "other", "operator"], ["BT", "/F1", "12", "Tf", "a(b)\\)c", "Tj", "48 65", "Tj", "[", "1", "-2.5", "]", "TJ"]), ("% only", [], []),
], lambda t: [F.transform(media.tokenise(t), lambda x: x["kind"]), F.transform(media.tokenise(t), lambda x: x["value"])])
scalar("font_names", "t string", "name bold italic", [("ABCDEF+Arial-BoldMT", "Arial-BoldMT", True, False), ("Times-Italic", "Times-Italic", False, True), ("Blackadder", "Blackadder", False, False), ("FooSemibold", "FooSemibold", True, False), ("UltraLight", "UltraLight", False, False)], lambda t: parts(media.font_facts(t), "name bold italic"))
scalar("dpi_ceilings", "w double, h double", "dpi", [(612.0, 792.0, 358), (0.0, 0.0, 249415), (10000.0, 10000.0, 24)], media.dpi_ceiling)
scalar("grey_of_colours", "r double, g double, b double", "grey inks", [(1.0, 1.0, 1.0, 1.0, 0.0), (0.0, 0.0, 0.0, 0.0, 0.7), (0.5, 0.5, 0.5, 0.5, 0.2), (2.0, -1.0, 0.0, 0.49844, 0.628432)], lambda r, g, b: rounded([media.luminance(r, g, b), media.luminance_of_inks(r, g, b, F.lit(0.3))]))
scalar("colours", "t string", "r g b", [("#f80", 1.0, 0.533333, 0.0), ("336699", 0.2, 0.4, 0.6), (" #FFFFFF ", 1.0, 1.0, 1.0), ("red", 0.2, 0.2, 0.2), ("#12345", 0.2, 0.2, 0.2)], lambda t: rounded(parts(media.colour(t), "r g b")))
scalar("package_relations", "t string", "ids paths", [
    ('<Relationships><Relationship Id="r1" Target="media/a.png"/><Relationship Target="../theme/t.xml" Id="r2"/><Relationship Id="r3" Target="http://x"/><Relationship Id="r4" Target="/root.xml"/><Relationship Id="r5" Target="./b/../c.xml"/></Relationships>', ["r1", "r2", "r4", "r5"], ["word/media/a.png", "theme/t.xml", "root.xml", "word/c.xml"]), ("<x/>", [], []),
], lambda t: [F.map_keys(media.relationships(t, F.lit("word"))), F.map_values(media.relationships(t, F.lit("word")))])

# markdown --------------------------------------------------------------------------------------------------------

scalar("markdown_lines", "t string", "class", [
    ("", "blank"), ("   ", "blank"), ("```py", "fence"), ("   ~~~", "fence"), ("    ```", "text"), ("> q", "quote"), ("- - -", "rule"), ("***", "rule"), ("**", "text"), ("## Two ##", "heading"), ("   # In", "heading"), ("#no", "text"), ("- item", "item"), ("12) item", "item"), ("1234567890. no", "text"), ("|---|:-:|", "delimiter"), ("a | b", "text"), ("plain", "text"), ("  * deep", "item"),
], M.line_class)
scalar("markdown_cells", "t string", "found", [("| a | b\\|c |", ["a", "b|c"]), ("a|b", ["a", "b"]), ("x", ["x"]), ("| a || c |", ["a", "", "c"])], M.table_cells)
scalar("markdown_inline", "t string", "texts styles links", [
    ("a **b** *c* `d *e*` ~~f~~", ["a ", "b", " ", "c", " ", "d *e*", " ", "f"], ["", "b", "", "i", "", "m", "", "s"], ["", "", "", "", "", "", "", ""]), ("[g *h*](http://x(y) \"t\")!", ["g ", "h", "!"], ["", "i", ""], ["http://x(y)", "http://x(y)", ""]),
    ("<https://z> ![pic](u) \\*no\\*", ["https://z", " ", "[pic]", " *no*"], ["", "", "i", ""], ["https://z", "", "", ""]), ("snake_case_x _y_ ***z***", ["snake_case_x ", "y", " ", "z"], ["", "i", "", "bi"], ["", "", "", ""]), ("open `x **y [z](", ["open `x **y [z]("], [""], [""]), ("", [], [], []),
], lambda t: [F.transform(M.inline_runs(t), lambda r: r["text"]), F.transform(M.inline_runs(t), lambda r: F.concat(F.when(r["bold"], "b").otherwise(""), F.when(r["italic"], "i").otherwise(""), F.when(r["mono"], "m").otherwise(""), F.when(r["strike"], "s").otherwise(""))), F.transform(M.inline_runs(t), lambda r: F.coalesce(r["link"], F.lit("")))])
_NOTE = "# T\n\n- private\n- fast\n  more\n1. one\n> q\nlazy\n\nSet\n===\n\n| a | b |\n|---|:-:|\n| 1 | *2* |\n\n```py\ncode **x**\n```\n***\nline\nnext\n    \t- deep"
scalar("markdown_blocks", "t string", "kinds levels quotes texts", [
    (_NOTE, ["heading", "item", "item", "numbered", "para", "heading", "table", "code", "rule", "para", "item"], [1, 0, 0, 0, 0, 1, 2, 0, 0, 0, 4], [0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0], ["T", "private", "fast more", "one", "q lazy", "Set", "a\tb\n1\t2", "code **x**", "", "line next", "deep"]), ("", [], [], [], []), ("> > deep\n\n~~~\nopen", ["para", "code"], [0, 0], [2, 0], ["deep", "open"]),
], lambda t: [M.block_rows(t)["kind"], M.block_rows(t)["level"].cast("array<long>"), M.block_rows(t)["quote"].cast("array<long>"), M.block_rows(t)["text"]])
scalar("markdown_written", "t string", "text", [(_NOTE.split("\n\n|")[0], "# T\n\n- private\n\n- fast more\n\n1. one\n\nq lazy\n\n# Set")], lambda t: F.array_join(F.transform(M.block_rows(t), lambda b: M.written(b["kind"], b["level"], b["text"])), "\n\n"))

# geometry --------------------------------------------------------------------------------------------------------

BOX = "x double, y double, width double, height double"
box = lambda *c: tuple(c)
scalar("clamped_boxes", BOX, "a b c d", [(0.1, 0.2, 0.3, 0.4, 0.1, 0.2, 0.3, 0.4), (-1.0, 2.0, 5.0, 5.0, 0.0, 0.99, 1.0, 0.01), (0.5, 0.5, 0.0, float("nan"), 0.5, 0.5, 0.01, 0.01), (float("inf"), 0.0, 0.5, 0.5, 0.0, 0.0, 0.5, 0.5)], lambda *r: rounded(G.clamp(r)))
scalar("clamped_turned_boxes", BOX + ", turn double", "a b c d", [(0.0, 0.0, 0.4, 0.2, 0.0, 0.0, 0.0, 0.4, 0.2), (0.0, 0.0, 0.2, 0.4, 90.0, 0.1, 0.0, 0.2, 0.4), (0.9, 0.9, 0.1, 0.1, 45.0, 0.879289, 0.879289, 0.1, 0.1)], lambda x, y, w, h, t: rounded(G.clamp_turned((x, y, w, h), t)))
scalar("moved_boxes", BOX + ", dx double, dy double", "a b c d cx cy", [(0.1, 0.1, 0.2, 0.2, 0.5, -0.5, 0.6, 0.0, 0.2, 0.2, 0.2, 0.2), (0.5, 0.5, 0.4, 0.4, 0.5, 0.5, 0.6, 0.6, 0.4, 0.4, 0.7, 0.7)], lambda x, y, w, h, dx, dy: rounded([*G.moved((x, y, w, h), dx, dy), *G.centre((x, y, w, h))]))
scalar("spanned_boxes", "x double, y double, u double, v double", "a b c d", [(0.8, 0.2, 0.3, 0.6, 0.3, 0.2, 0.5, 0.4), (0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 0.01, 0.01)], lambda x, y, u, v: rounded(G.between((x, y), (u, v))))
scalar("resized_boxes", BOX + ", u double, v double", "ax ay aw ah bx by bw bh", [(0.2, 0.2, 0.4, 0.4, 0.3, 0.9, 0.2, 0.2, 0.1, 0.7, 0.3, 0.58, 0.3, 0.02), (0.2, 0.2, 0.4, 0.4, 0.9, 0.1, 0.2, 0.2, 0.7, 0.02, 0.58, 0.1, 0.02, 0.5)], lambda x, y, w, h, u, v: rounded([*G.resized((x, y, w, h), "se", (u, v)), *G.resized((x, y, w, h), "nw", (u, v))]))
scalar("scaled_boxes", BOX + ", sx double, sy double", "a b c d", [(0.4, 0.4, 0.2, 0.2, 2.0, 0.5, 0.3, 0.45, 0.4, 0.1), (0.4, 0.4, 0.2, 0.2, 0.0, 10.0, 0.49, 0.0, 0.02, 1.0)], lambda x, y, w, h, sx, sy: rounded(G.scaled((x, y, w, h), sx, sy)))
scalar("snapped_values", "v double", "guide", [(0.51, 0.5), (0.25, 0.25), (0.4, None), (0.018, 0.0), (0.99, 1.0)], lambda v: G.snapped(v, F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0)))))
scalar("turned_points", "x double, y double, degrees double", "u v far unit", [(1.0, 0.0, 90.0, 0.0, 1.0, 1.0, 1.0), (2.0, 3.0, 180.0, -2.0, -3.0, 3.605551, 1.0), (0.5, 0.0, 0.0, 0.5, 0.0, 0.5, 0.5)], lambda x, y, d: rounded([F.round(c, 9) + 0.0 for c in G.turned_point((x, y), (F.lit(0.0), F.lit(0.0)), F.radians(d))] + [G.distance((x, y), (F.lit(0.0), F.lit(0.0))), G.unit(x)]))
scalar("box_handles", BOX, "names xs", [(0.0, 0.0, 1.0, 2.0, ["e", "n", "ne", "nw", "s", "se", "sw", "w"], [1.0, 0.5, 1.0, 0.0, 0.5, 1.0, 0.0, 0.0])], lambda *r: [F.array(*(F.lit(k) for k in sorted(G.handles(r)))), F.array(*(G.handles(r)[k][0] for k in sorted(G.handles(r))))])
scalar("matrix_products", "a double, b double", "m", [(2.0, 3.0, [2.0, 0.0, 0.0, 3.0, 10.0, 21.0]), (1.0, 1.0, [1.0, 0.0, 0.0, 1.0, 5.0, 7.0])], lambda a, b: F.array(*G.product([a, F.lit(0.0), F.lit(0.0), b, F.lit(0.0), F.lit(0.0)], list(map(F.lit, (1.0, 0.0, 0.0, 1.0, 5.0, 7.0))))))
scalar("visible_boxes", BOX, "a b c d", [(10.0, 10.0, 50.0, 50.0, 10.0, 10.0, 50.0, 50.0), (-5.0, 90.0, 50.0, 50.0, 0.0, 90.0, 45.0, 10.0), (200.0, 0.0, 5.0, 5.0, 0.0, 0.0, 100.0, 100.0), (0.0, 0.0, 0.0, 9.0, 0.0, 0.0, 100.0, 100.0)], lambda *r: list(G.visible(tuple(map(F.lit, (0.0, 0.0, 100.0, 100.0))), r)))
scalar("points_on_pages", "turn long, u double, v double", "x y fx fy vx vy", [(0, 0.0, 0.0, 10.0, 220.0, 10.0, 20.0, 1.0, 2.0), (90, 0.0, 0.0, 10.0, 20.0, 110.0, 20.0, -2.0, 1.0), (180, 0.25, 0.5, 85.0, 120.0, 110.0, 220.0, -1.0, -2.0), (270, 0.25, 0.5, 60.0, 170.0, 10.0, 220.0, 2.0, -1.0)], lambda t, u, v: [*G.on_page(tuple(map(F.lit, (10.0, 20.0, 100.0, 200.0))), t, u, v), *G.shown_frame(tuple(map(F.lit, (10.0, 20.0, 100.0, 200.0))), t)[4:], *G.turned_vector(t, F.lit(1.0), F.lit(2.0))])
scalar("fitted_stamps", "fit string, anchor string", "x y w h", [("contain", "centre", 0.0, 50.0, 100.0, 100.0), ("cover", "top-left", 0.0, 0.0, 200.0, 200.0), ("stretch", "right", 0.0, 0.0, 100.0, 200.0), ("actual", "bottom-right", 50.0, 0.0, 50.0, 50.0), ("actual", "top", 25.0, 150.0, 50.0, 50.0), ("actual", "left", 0.0, 75.0, 50.0, 50.0)], lambda f, a: list(G.fitted(f, a, (F.lit(50.0), F.lit(50.0)), (F.lit(100.0), F.lit(200.0)))))
scalar("block_alignment", "a double, b double, flush boolean, n long", "align", [(100.0, 300.0, False, 2, "center"), (250.0, 399.0, False, 1, "right"), (0.0, 398.0, True, 3, "justify"), (0.0, 398.0, True, 1, "left"), (0.0, 200.0, False, 4, "left")], lambda a, b, f, n: G.alignment((a, b), (F.lit(0.0), F.lit(400.0)), F.lit(12.0), f, n))
scalar("kept_edges", "e array<double>", "kept", [([5.0, 1.0, 2.0, 2.6, 9.0], [1.0, 2.6, 5.0, 9.0]), ([], []), ([1.0, 2.5, 2.6], [1.0, 2.6])], structure.kept_edges)
scalar("table_confidence", "rows long, fill double, straight double, shape double, across long, drawn_ long, edges long, ruled boolean", "sure passes", [
    (7, 1.0, 1.0, 1.0, 0, 0, 3, False, 0.85, True), (3, 0.9, 0.5, 0.4, 0, 0, 2, False, 0.526, False), (7, 1.0, 0.2, 1.0, 2, 3, 3, True, 1.0, True), (4, 0.8, 0.7, 1.0, 1, 0, 2, False, 0.7825, True), (3, 0.5, 0.5, 0.5, 0, 0, 0, False, 0.43, False),
], lambda r, f, s, p, a, d, e, u: [F.round(structure.table_confidence(r, f, s, p, a, d, e, u), 6), structure.table_confidence(r, f, s, p, a, d, e, u) >= structure.FLOOR])
scalar("strict_ranges", "n long", "pages bad", [(5, [1, 2, 3, 5], None), (4, None, None)], lambda n: [records.strict_ranges("1-3, 5 2", n), records.strict_ranges("3-1", n)])
scalar("beyond_range", "n long", "found", [(5, [9, 7]), (20, []), (8, [9])], lambda n: records.out_of_range("9-12, 7, 5-, odd, x, 12-2", n))


# tables ----------------------------------------------------------------------------------------------------------

def rows_of(name: str, columns: str, rows: list[tuple]):
    def put(f: Query) -> Query:
        expect(name, columns, rows, f)
        return f

    return put


@rows_of("assembled_lines", "doc page line text size bold", [(1, 1, 0, "Head line", 14.0, True), (1, 1, 1, "one two", 10.0, False), (1, 1, 2, "• item", 10.0, False), (1, 2, 0, "next", 10.0, False)])
def _(spark, sf_dir):
    ddl = "doc long, page long, run long, text string, x double, right double, top double, bottom double, baseline double, size double, bold boolean, italic boolean, spacer boolean"
    r = lambda page, run, text, x, right, base, size=10.0, bold=False, spacer=False: (1, page, run, text, x, right, base - size, base, base, size, bold, False, spacer)
    rows = [r(1, 2, "line", 60.0, 90.0, 20.0, 14.0, True), r(1, 1, "Head", 10.0, 50.0, 20.5, 14.0, True), r(1, 3, "one", 10.0, 30.0, 50.0), r(1, 4, " ", 30.0, 34.0, 50.0, spacer=True), r(1, 5, "tw", 34.0, 44.0, 50.0), r(1, 6, "o", 44.5, 49.0, 50.0), r(1, 7, "•", 10.0, 10.2, 80.0), r(1, 8, "item", 10.3, 40.0, 80.0), r(2, 1, "next", 10.0, 30.0, 20.0), r(2, 2, " ", 10.0, 30.0, 90.0)]
    return structure.lines(made(spark, ddl, rows))


@rows_of("running_lines", "doc page text running", [(1, p, t, k) for p in range(1, 6) for t, k in ((f"Page {p}", True), ("Body", False))] + [(1, 1, "Draft", False), (1, 2, "Draft", False)])
def _(spark, sf_dir):
    lines = [(1, p, t, b, b + 2) for p in range(1, 6) for t, b in ((f"Page {p}", 20.0), ("Body", 400.0))] + [(1, 1, "Draft", 790.0, 795.0), (1, 2, "Draft", 790.0, 795.0)]
    return structure.flagged(made(spark, "doc long, page long, text string, baseline double, bottom double", lines), made(spark, "doc long, page long, height double", [(1, p, 800.0) for p in range(1, 6)]))


@rows_of("paragraph_breaks", "doc line para", [(1, 1, 0), (1, 2, 0), (1, 3, 1), (1, 4, 2), (1, 5, 2), (1, 6, 3), (1, 7, 4), (1, 8, 5), (1, 9, 6), (2, 1, 0), (2, 2, 0), (2, 3, 0), (2, 4, 1), (2, 5, 1)])
def _(spark, sf_dir):
    row = lambda doc, n, text, x, right, base, size=10.0, bold=False: (doc, 0, n, text, x, right, base, size, bold)
    rows = [
        row(1, 1, "first line of text", 0.0, 390.0, 12.0), row(1, 2, "and its second one.", 0.0, 200.0, 24.0), row(1, 3, "A new one after a short line", 0.0, 380.0, 36.0), row(1, 4, "after a gap", 0.0, 200.0, 60.0), row(1, 5, "goes on in small letters", 0.0, 300.0, 72.0),
        row(1, 6, "1. item", 0.0, 300.0, 84.0), row(1, 7, "Heading", 0.0, 300.0, 96.0, 12.0), row(1, 8, "Bold", 0.0, 400.0, 108.0, 12.0, True), row(1, 9, "indented", 10.0, 400.0, 120.0, 12.0, True),
        *(row(2, n, f"line {n}", 0.0, r, 12.0 * n) for n, r in ((1, 400.0), (2, 400.0), (3, 300.0), (4, 400.0), (5, 400.0))),
    ]
    return structure.paragraphs(made(spark, "doc long, column long, line long, text string, x double, right double, baseline double, size double, bold boolean", rows), 10.0)


@rows_of("space_before", "doc block space", [(1, 1, 0.0), (1, 2, 8.0), (1, 3, 0.0)])
def _(spark, sf_dir):
    return structure.space_before(made(spark, "doc long, band long, column long, block long, top double, bottom double", [(1, 0, 0, 1, 0.0, 10.0), (1, 0, 0, 2, 18.0, 30.0), (1, 0, 0, 3, 29.0, 40.0)]))


@rows_of("rule_boundary_semi", "doc boundary", [(1, 100.0), (1, 250.0), (2, 9.9)])
def _(spark, sf_dir):
    return structure.ruled_boundaries(made(spark, "doc long, boundary double", [(1, 100.0), (1, 180.0), (1, 250.0), (2, 9.9), (2, 100.0)]), made(spark, "doc long, x double", [(1, 109.0), (1, 241.0), (1, 260.0), (2, 0.0), (1, 170.0)]), 10.0)


@rows_of("table_continuation", "doc table group", [(1, 1, 1), (1, 2, 1), (1, 3, 2), (1, 4, 3), (2, 1, 1), (2, 2, 2), (2, 3, 3)])
def _(spark, sf_dir):
    t = lambda doc, table, page, top, bottom, edges, first: (doc, table, page, 800.0, top, bottom, edges, first)
    rows = [t(1, 1, 1, 100.0, 700.0, [10.0, 200.0], ["h", "a"]), t(1, 2, 2, 50.0, 700.0, [12.0, 203.0], ["h", "b"]), t(1, 3, 3, 50.0, 700.0, [10.0, 300.0], ["h", "c"]), t(1, 4, 4, 500.0, 700.0, [10.0, 300.0], ["h", "d"]),
            t(2, 1, 1, 100.0, 700.0, [1.0], ["h", "a"]), t(2, 2, 2, 50.0, 700.0, [1.0], ["h", "a"]), t(2, 3, 4, 50.0, 700.0, [1.0], ["h", "z"])]
    return structure.continued(made(spark, "doc long, table long, page long, height double, top double, bottom double, edges array<double>, first_rows array<string>", rows), 10.0)


@rows_of("repeated_heads", "doc table row text", [(1, 1, 0, "h"), (1, 1, 1, "a"), (1, 2, 1, "b"), (1, 3, 0, "x"), (1, 3, 1, "h")])
def _(spark, sf_dir):
    return structure.without_repeated_heads(made(spark, "doc long, group long, table long, row long, text string", [(1, 1, 1, 0, "h"), (1, 1, 1, 1, "a"), (1, 1, 2, 0, "h"), (1, 1, 2, 1, "b"), (1, 1, 3, 0, "x"), (1, 1, 3, 1, "h")]))


@rows_of("sheet_titles", "doc table sheet", [(1, 1, "Page 1 table 1"), (1, 2, "Page 1 table 2"), (1, 3, "Page 2")])
def _(spark, sf_dir):
    return structure.sheet_titles(made(spark, "doc long, page long, table long", [(1, 1, 1), (1, 1, 2), (1, 2, 3)]))


@rows_of("header_detect", "doc header", [(1, True), (2, False), (3, True), (4, False), (5, False)])
def _(spark, sf_dir):
    cell = lambda doc, row, col, text, numeric=False, bold=False: (doc, row, col, text, numeric, bold)
    rows = []
    for doc, head, body in ((1, ["Item", "Total"], ["a", "5"]), (2, ["1", "2"], ["a", "5"]), (4, ["Item", ""], ["a", "5"]), (5, ["Item", "Kind"], ["a", "b"])):
        rows += [cell(doc, 0, c, t, t.isdigit()) for c, t in enumerate(head)] + [cell(doc, r, c, t, t.isdigit()) for r in (1, 2) for c, t in enumerate(body)]
    rows += [cell(3, 0, c, t, False, True) for c, t in enumerate(["Item", "Kind"])] + [cell(3, r, c, "x") for r in (1, 2) for c in (0, 1)]
    return structure.has_header(made(spark, "doc long, row long, col long, text string, numeric boolean, bold boolean", rows))


@rows_of("font_majority", "doc size font bold italic office", [(1, 10.0, "A", True, False, "Arial"), (2, 9.0, "M", False, True, "Courier New"), (3, 8.0, "S", False, False, "Times New Roman")])
def _(spark, sf_dir):
    rows = [(1, 1, "abcdef", 10.0, "A", True, False, False, False), (1, 2, "xyz", 12.0, "B", False, False, True, False), (2, 1, "code here", 9.0, "M", False, True, False, True), (3, 1, "serif text", 8.0, "S", False, False, True, False)]
    runs = made(spark, "doc long, run long, text string, size double, font string, bold boolean, italic boolean, serif boolean, mono boolean", rows)
    return structure.majority(runs, ["doc"]).join(structure.document_font(runs).withColumnRenamed("font", "office"), "doc")


@rows_of("fitted_widths", "doc col width", [(1, 0, 62.0), (1, 1, 110.0), (2, 0, 42.0), (2, 1, 110.0), (2, 2, 48.0), (3, 0, 24.0), (4, 0, 88.0), (4, 1, 88.0), (4, 2, 24.0)])
def _(spark, sf_dir):
    rows = [(1, 0, 50.0), (1, 0, 20.0), (1, 1, 100.0), (2, 0, 30.0), (2, 1, 500.0), (2, 2, 36.0), (3, 0, 1.0), (4, 0, 150.0), (4, 1, 150.0), (4, 2, 10.0)]
    return structure.fitted_widths(made(spark, "doc long, col long, width double", rows), 200.0)


@rows_of("ink_boxes", "doc top bottom left right", [(1, 2, 5, 3, 8)])
def _(spark, sf_dir):
    return structure.ink_box(made(spark, "doc long, x long, y long, dark boolean, width long, height long", [(1, x, y, 3 <= x <= 8 and 2 <= y <= 5 or (x, y) == (0, 9), 10, 10) for x in range(10) for y in range(10)]))


@rows_of("page_align", "pair nth before after added removed", [(1, 1, 1, 1, 0, 0), (1, 2, None, 2, 4, 0), (1, 3, 2, 3, 1, 1), (1, 4, 3, None, 0, 3), (2, 1, 1, 1, 0, 0), (3, 1, 1, None, 0, 2), (3, 2, None, 1, 2, 0)])
def _(spark, sf_dir):
    return compare.page_pairs(compared_pages(spark))


def compared_pages(spark):
    sides = {1: (["a b c d", "one two three four five", "gone for good"], ["a b c d", "new page just here", "one two 3 four five"]), 2: ([""], [""]), 3: (["x y"], ["p q"])}
    return made(spark, "pair long, side long, page long, text string", [(k, s, p, t) for k, both in sides.items() for s, texts in enumerate(both) for p, t in enumerate(texts, 1)])


@rows_of("diff_totals", "pair added removed changed inserted deleted n_pages", [(1, 5, 4, 3, 1, 1, 4), (2, 0, 0, 0, 0, 0, 1), (3, 2, 2, 2, 1, 1, 2)])
def _(spark, sf_dir):
    return compare.totals(compare.page_pairs(compared_pages(spark)))


@rows_of("diff_report", "pair text", [(2, "# What changed\n\n- 0 words added\n- 0 words removed\n- 0 of 1 pages differ\n\n"), (3, "# What changed\n\n- 2 words added\n- 2 words removed\n- 2 of 2 pages differ\n\n## Page 1 — removed\n\n**−** ~~x y~~\n\n## Page 1 — added\n\n**+** p q")])
def _(spark, sf_dir):
    return compare.report(compare.page_pairs(compared_pages(spark)).where("pair > 1"))


TREE = [(1, None, 1), (2, 1, 1), (3, 2, 1), (4, 1, 2), (5, None, 2), (6, 7, 1), (7, 6, 1)]


@rows_of("outline_depth", "node depth", [(1, 0), (2, 1), (3, 2), (4, 1), (5, 0)])
def _(spark, sf_dir):
    return outline.depths(made(spark, "node long, parent long, ord long", TREE).drop("ord"))


@rows_of("composite_closure", "node", [(1,), (2,), (3,), (4,), (9,)])
def _(spark, sf_dir):
    return outline.closure(made(spark, "node long, part long", [(1, 2), (2, 3), (3, 1), (1, 4), (5, 6)]), made(spark, "node long", [(1,), (9,)]))


@rows_of("outline_remap", "node page", [(1, 5), (2, 5), (3, 5), (4, 2), (5, 1), (10, 7), (11, 7)])
def _(spark, sf_dir):
    nodes = [(1, None, 1, 9, 1), (2, 1, 1, 9, 1), (3, 2, 1, 3, 1), (4, 1, 1, 2, 2), (5, None, 1, 1, 2), (8, None, 1, 9, 3), (9, 8, 1, None, 1), (10, None, 2, None, 1), (11, 10, 2, 1, 1)]
    plan = [(1, 1, 1), (2, 1, 2), (3, 1, 2), (5, 1, 3), (7, 2, 1)]
    return outline.remapped(made(spark, "node long, parent long, file long, page long, ord long", nodes), made(spark, "pos long, file long, page long", plan))


@rows_of("split_bookmarks", "file page part name", [(1, 1, 1, "1-Front-matter"), (1, 2, 2, "2-Intro"), (1, 3, 2, "2-Intro"), (1, 4, 3, "3-A-B"), (2, 1, 1, "1-untitled-section"), (2, 2, 1, "1-untitled-section")])
def _(spark, sf_dir):
    marks = made(spark, "file long, page long, ord long, title string", [(1, 2, 1, "Intro"), (1, 4, 3, "Later"), (1, 4, 2, "A/B"), (2, 1, 1, "???")])
    return outline.split_at_bookmarks(made(spark, "file long, page long", [(1, p) for p in range(1, 5)] + [(2, 1), (2, 2)]), marks)


@rows_of("filled_forms", "form name value state", [(1, "a", "new", "filled"), (1, "b", "old", "kept"), (1, "c", None, "filled"), (1, "zz", "x", "skipped")])
def _(spark, sf_dir):
    return records.filled(made(spark, "form long, name string, value string", [(1, "a", "was"), (1, "b", "old"), (1, "c", "was")]), made(spark, "form long, name string, given string", [(1, "a", "new"), (1, "zz", "x"), (1, "c", None)]))


@rows_of("sheet_cells", "sheet row col text", [(1, 0, 0, "alpha"), (1, 0, 3, ""), (1, 2, 0, "beta")])
def _(spark, sf_dir):
    cells_ = made(spark, "sheet long, row long, col long, index long", [(1, 0, 0, 0), (1, 0, 1, 1), (1, 1, 1, 1), (1, 0, 3, 9), (1, 2, 0, 1)])
    merges = made(spark, "sheet long, r0 long, c0 long, r1 long, c1 long", [(1, 0, 0, 1, 2)])
    return records.shared_strings(records.without_covered(cells_, merges), made(spark, "sheet long, index long, text string", [(1, 0, "alpha"), (1, 1, "beta")]))


@rows_of("network_audit", "source text problem", [("a.ts", "fetch(x)", "undocumented"), ("b.ts", "old", "unused")])
def _(spark, sf_dir):
    ddl = "source string, text string"
    return records.unmatched(made(spark, ddl, [("a.ts", "fetch(x)"), ("a.ts", "fetch(y)")]), made(spark, ddl, [("a.ts", "fetch(y)"), ("b.ts", "old")]))


@rows_of("snapshot_losses", "file object", [(1, 2), (1, 3)])
def _(spark, sf_dir):
    ddl = "file long, object long, digest string"
    return records.lost_objects(made(spark, ddl, [(1, 1, "a"), (1, 2, "b"), (1, 3, "c")]), made(spark, ddl, [(1, 1, "a"), (1, 2, "x"), (1, 4, "n")]))


@rows_of("named_destinations", "file link page", [(1, 1, 7), (1, 2, None)])
def _(spark, sf_dir):
    return records.named_pages(made(spark, "file long, link long, name string", [(1, 1, "intro"), (1, 2, "none")]), made(spark, "file long, name string, page long", [(1, "intro", 7), (2, "none", 1)]))


@rows_of("composition", "file n_images image_bytes share is_scan message", [(1, 1, 700, 0.7, True, "a single scanned image"), (2, 41, 4100, 0.82, False, "scanned images"), (3, 1, 300, 0.3, False, "partly images"), (4, 0, 0, 0.0, False, "")])
def _(spark, sf_dir):
    rows = [(1, "image", 700), (1, "font", 300), *[(2, "image", 100)] * 41, (2, "font", 900), (3, "image", 300), (3, "text", 700), (4, "text", 0)]
    return records.composition(made(spark, "file long, kind string, bytes long", rows))


@rows_of("receipts", "job bytes_in bytes_out ratio saved", [(1, 300, 150, 0.5, 150), (2, 100, 120, 1.2, 0)])
def _(spark, sf_dir):
    return records.receipts(made(spark, "job long, bytes_in long, bytes_out long", [(1, 100, 50), (1, 200, 100), (2, 100, 120)]))


@rows_of("crop_groups", "file w h x0 y0 x1 y1", [(1, 600, 800, 0.1, 0.1, 0.9, 0.95), (1, 800, 600, 0.2, 0.2, 0.8, 0.8)])
def _(spark, sf_dir):
    rows = [(1, 1, 600.0, 800.0, 0, 0.1, 0.2, 0.8, 0.9), (1, 2, 800.2, 600.1, 90, 0.2, 0.1, 0.9, 0.95), (1, 3, 800.0, 600.0, 0, 0.2, 0.2, 0.8, 0.8)]
    return records.crop_boxes(made(spark, "file long, page long, width double, height double, turn long, x0 double, y0 double, x1 double, y1 double", rows))


@rows_of("blank_pages", "file page blank", [(1, 1, True), (1, 2, False), (1, 3, True)])
def _(spark, sf_dir):
    rows = [(1, p, 200 if p == 2 and k < 10 or p == 3 else 250, 5 if p == 3 else 255) for p in (1, 2, 3) for k in range(100)]
    return records.ink_share(made(spark, "file long, page long, luma long, alpha long", rows)).select("file", "page", records.blank(F.col("ink"), 0.005).alias("blank"))


@rows_of("claims", "key id", [("a", 3), ("b", 5)])
def _(spark, sf_dir):
    t = lambda h, m: datetime(2026, 1, 1, h, m)
    return state.claimed(made(spark, "key string, id long, at timestamp_ntz", [("a", 1, t(11, 10)), ("a", 2, t(11, 30)), ("a", 3, t(11, 30)), ("b", 4, t(10, 59)), ("b", 5, t(11, 0)), ("c", 6, t(10, 0)), ("d", 7, t(12, 1))]), "2026-01-01 12:00:00")


@rows_of("live_preferences", "key value", [("a", "x")])
def _(spark, sf_dir):
    rows = [("a", datetime(2025, 6, 1), 2, "x"), ("b", datetime(2024, 12, 31), 2, "y"), ("c", datetime(2025, 6, 1), 1, "z")]
    return state.live(made(spark, "key string, saved timestamp_ntz, version long, value string", rows), "2026-01-01 00:00:00", 2)


@rows_of("keyword_union", "id keywords", [(1, ["a", "b", "c"]), (2, [])])
def _(spark, sf_dir):
    return records.keywords(made(spark, "id long, own array<string>, more array<string>", [(1, ["a", "b"], ["b", "c", "a"]), (2, [], [])]), ["own", "more"])


@rows_of("outliving_fields", "file field value", [(1, "dc:creator", "Ann, Bob")])
def _(spark, sf_dir):
    found = [(1, "dc:creator", 1, "Ann"), (1, "dc:creator", 2, "Bob"), (1, "dc:creator", 3, "An"), (1, "dc:title", 1, "T"), (1, "x:other", 1, "o")]
    return records.outliving(records.merged_fields(made(spark, "file long, field string, ord long, value string", found)), made(spark, "file long, entry string", [(1, "title")]))


@rows_of("atom_feed", "xml", [('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>New &amp; good</title><link href="u2"/><updated>2026-02-01T00:00:00Z</updated></entry><entry><title>Old</title><link href="u1"/><updated>2026-01-01T00:00:00Z</updated></entry></feed>',)])
def _(spark, sf_dir):
    return records.feed(made(spark, "title string, url string, updated timestamp_ntz", [("Old", "u1", datetime(2026, 1, 1)), ("New & good", "u2", datetime(2026, 2, 1))]))


@rows_of("reorder_permutation", "file pos page", [(1, 1, 3), (1, 2, 1), (1, 3, 2)])
def _(spark, sf_dir):
    return records.reordered(made(spark, "file long, page long", [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2)]), [3, 1, 2])


@rows_of("keyword_starts", "id any_case exact", [(1, True, False), (2, False, False), (3, True, True), (4, False, False)])
def _(spark, sf_dir):
    rows = made(spark, "id long, text string", [(1, "INVOICE 7"), (2, "x" * 900 + "invoice"), (3, "an invoice (a.b)"), (4, "axb")])
    return rows.select("id", records.starts_with_any(F.col("text"), " invoice, a.b,, ").alias("any_case"), records.starts_with_any(F.col("text"), "invoice", True).alias("exact"))


@rows_of("page_content_groups", "hash pages copies", [("1:e40c292c", [1, 3], 3), ("1:e70c2de5", [2], 1)])
def _(spark, sf_dir):
    return records.with_pages(made(spark, "page long, t string", [(3, "a"), (1, "a"), (1, "a"), (2, "b")]).select("page", media.fingerprint(F.col("t").cast("binary")).alias("hash")), "hash", "page")



#: Small packages as other programs write them.
_REL = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
SHEET = office.zipped({
    "xl/workbook.xml": f'<workbook {_REL}><workbookPr date1904="1"/><sheets><sheet name="S" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>',
    "xl/sharedStrings.xml": "<sst><si><r><t>sha</t></r><r><t>red</t></r></si></sst>", "xl/styles.xml": '<styleSheet><numFmts><numFmt numFmtId="200" formatCode="0&quot; kg&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="200"/></cellXfs></styleSheet>',
    "xl/worksheets/s.xml": '<worksheet><cols><col min="5" max="5" hidden="1"/></cols><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>0</v></c><c r="C1" t="b"><v>1</v></c><c r="D1" t="e"><v>#DIV/0!</v></c><c r="E1"><v>5</v></c><c r="F1" t="s"><v>9</v></c></row><row r="2"><c r="A2" t="inlineStr"><is><t>inline</t></is></c><c r="B2" s="0"><f>0.1+0.2</f><v>0.30000000000000004</v></c><c r="C2" s="1"><v>1</v></c><c r="D2" s="2"><v>7</v></c></row><row r="3" hidden="1"><c r="A3"><v>1</v></c></row></sheetData><mergeCells><mergeCell ref="A1:B1"/></mergeCells></worksheet>',
})
_SLIDE = '<p:sld xmlns:p="p" xmlns:a="a">{0}</p:sld>'
SLIDES = office.zipped({
    "ppt/presentation.xml": f'<p:presentation xmlns:p="p" {_REL}><p:sldIdLst><p:sldId r:id="r2"/><p:sldId r:id="r1"/></p:sldIdLst></p:presentation>', "ppt/_rels/presentation.xml.rels": '<Relationships><Relationship Id="r1" Target="slides/b.xml"/><Relationship Id="r2" Target="/ppt/slides/a.xml"/></Relationships>',
    "ppt/slides/a.xml": _SLIDE.format("<a:p><a:r><a:t>Ti</a:t></a:r><a:r><a:t>tle</a:t></a:r></a:p><a:tc><a:p><a:r><a:t>in a table</a:t></a:r></a:p></a:tc>"), "ppt/slides/b.xml": _SLIDE.format("<a:p><a:r><a:t>Second</a:t></a:r></a:p>"),
})

# more of text, geometry and office files ------------------------------------------------------------------------

scalar("folded_text", "t string", "plain fallback segments", [
    ("ﬁt – a→b", "fit – a->b", False, ["fit – a->b"]), ("x\ty\x07", "x    y", False, ["x    y"]), ("a​b", "ab", False, ["ab"]), ("日本 ok 語", "日本 ok 語", True, ["日本", " ok ", "語"]), ("● ‑ ″", '• - "', False, ['• - "']), ("", "", False, []),
], lambda t: [T.folded(t), T.needs_fallback(t), F.transform(T.segments(t), lambda s: s["text"])])
scalar("wrapped_lines", "t string", "lines", [
    ("one two three", ["one two ", "three"]), ("abcdefghijklmno", ["abcdefgh", "ijklmno"]), ("short", ["short"]), ("a\nb", ["a", "b"]), ("", [""]), ("exactly8 x", ["exactly8", " x"]), ("ab cdefghijkl", ["ab ", "cdefghij", "kl"]),
], lambda t: T.wrapped(t, 8))
scalar("xmp_fields", "t string", "fields found", [
    ('<x:xmpmeta><rdf:Description xmp:CreatorTool="Word" pdf:Producer=\'P &amp; Q\'><dc:title><rdf:Alt><rdf:li xml:lang="x">My  title</rdf:li></rdf:Alt></dc:title><dc:creator><rdf:Seq><rdf:li>Ann</rdf:li><rdf:li>Bob</rdf:li><rdf:li>An</rdf:li></rdf:Seq></dc:creator><xmp:Note>n</xmp:Note></rdf:Description></x:xmpmeta>', ["dc:title", "dc:creator", "xmp:Note", "xmp:CreatorTool", "pdf:Producer"], ["My title", "Ann, Bob", "n", "Word", "P & Q"]), ("none", [], []),
], lambda t: [F.transform(xmp.packet_fields(t), lambda f: f["field"]), F.transform(xmp.packet_fields(t), lambda f: f["value"])])
_CLOUD = "x array<double>, y array<double>"
_points = lambda x, y: F.transform(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
scalar("page_quads", _CLOUD, "xs area problem plausible width height", [
    ([0.0, 100.0, 100.0, 0.0, 50.0, 3.0], [0.0, 0.0, 200.0, 200.0, 100.0, 9.0], [0.0, 100.0, 100.0, 0.0], 20000.0, None, True, 100, 200), ([0.0, 1.0, 2.0], [0.0, 5.0, 1.0], None, None, "count", False, None, None), ([0.0, 6.0, 6.0, 0.0], [0.0, 0.0, 5.0, 5.0], [0.0, 6.0, 6.0, 0.0], 30.0, "small", False, 6, 5),
    ([0.0, 4400.0, 4400.0, 0.0], [0.0, 0.0, 2200.0, 2200.0], [0.0, 4400.0, 4400.0, 0.0], 9680000.0, None, True, 2200, 1100), ([0.0, 1000.0, 1000.0, 0.0], [0.0, 0.0, 100.0, 100.0], [0.0, 1000.0, 1000.0, 0.0], 100000.0, None, False, 1000, 100),
], lambda x, y: (lambda q: [F.transform(q["corners"], lambda c: c["x"]), *parts(q, "area problem plausible width height")])(G.page_quad(_points(x, y))))
scalar("quad_maps", _CLOUD, "m", [([0.0, 1.0, 1.0, 0.0], [0.0, 0.0, 1.0, 1.0], [2.0, 0.0, 5.0, 0.0, 3.0, 7.0, 0.0, 0.0]), ([0.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 0.0], None)], lambda x, y: F.transform(G.quad_map(_points(x, y), F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in ((5.0, 7.0), (7.0, 7.0), (7.0, 10.0), (5.0, 10.0))))), lambda v: F.round(v, 6) + 0.0))
scalar("blank_rows", "f array<string>", "blank", [(["", "  "], True), (["", "x"], False), ([], True)], records.blank_row)
scalar("message_guard", "n double, f array<string>", "ok", [(1.0, ["a"], True), (1.5, ["a"], False), (None, ["a"], False), (2.0, None, False)], records.valid_message)


@rows_of("line_cells", "doc line cell x text", [(1, 1, 0, 10.0, "Item name"), (1, 1, 1, 100.0, "Total"), (1, 2, 0, 10.0, "only one"), (1, 3, 0, 10.0, "a"), (1, 3, 1, 40.0, "b")])
def _(spark, sf_dir):
    rows = [(1, 1, 1, "Item", 10.0, 30.0, False), (1, 1, 2, "name", 33.0, 60.0, False), (1, 1, 3, "Total", 100.0, 130.0, False), (1, 2, 4, "only", 10.0, 30.0, False), (1, 2, 5, "one", 32.0, 50.0, False), (1, 3, 6, "a", 10.0, 15.0, False), (1, 3, 7, " ", 15.0, 40.0, True), (1, 3, 8, "b", 40.0, 45.0, False)]
    return grids.cells(made(spark, "doc long, line long, run long, text string, x double, right double, spacer boolean", rows).withColumn("size", F.lit(10.0)))


@rows_of("table_rows", "doc table row cell text", [(1, 0, 0, 0, "Item"), (1, 0, 0, 1, "Total"), (1, 0, 1, 0, "a wrapped"), (1, 0, 1, 1, "1"), (1, 0, 2, 0, "b"), (1, 0, 2, 1, "2"), (2, 0, 0, 0, "p"), (2, 0, 0, 1, "q"), (2, 0, 1, 0, "p"), (2, 0, 1, 1, "q"), (2, 0, 2, 0, "p"), (2, 0, 2, 1, "q")])
def _(spark, sf_dir):
    lines, cells_ = [], []

    def line(doc, n, top, *own):
        lines.append((doc, n, top, top + 10.0))
        cells_.extend((doc, n, c, x, t) for c, (x, t) in enumerate(own))

    for n, own in enumerate([[(10.0, "Item"), (100.0, "Total")], [(10.0, "a"), (100.0, "1")], [(10.5, "wrapped")], [(10.0, "b"), (100.0, "2")], [(50.0, "prose")], [(10.0, "c"), (100.0, "3")]]):
        line(1, n, 14.0 * n, *own)
    for n, top in enumerate([0.0, 14.0, 28.0, 80.0, 94.0]):
        line(2, n, top, (10.0, "p"), (100.0, "q"))
    return grids.tables(made(spark, "doc long, line long, top double, bottom double", lines), made(spark, "doc long, line long, cell long, x double, text string", cells_), 10.0)


@rows_of("column_cut", "page run column", [(1, n, n % 2) for n in range(24)] + [(2, n, 0) for n in range(12)])
def _(spark, sf_dir):
    run = lambda page, n, x, right, base: (1, page, n, x, right, base - 10, base, base, 10.0, False)
    rows = [run(1, n, 50.0 + n % 2 * 250, 270.0 + n % 2 * 250, 20.0 + n // 2 * 14) for n in range(24)] + [run(2, n, 50.0, 500.0, 20.0 + n * 14) for n in range(12)]
    return grids.columns(made(spark, "doc long, page long, run long, x double, right double, top double, bottom double, baseline double, size double, spacer boolean", rows), 10.0, 600.0)


@rows_of("page_margins", "doc width height left right top bottom varies", [(1, 600.0, 800.0, 72, 50, 108, 18, True)])
def _(spark, sf_dir):
    pages_ = made(spark, "doc long, page long, width double, height double", [(1, 1, 600.0, 800.0), (1, 2, 600.2, 800.0), (1, 3, 300.0, 300.0)])
    blocks = made(spark, "doc long, page long, x double, right double, top double, bottom double, running boolean", [(1, 1, 70.0, 550.0, 120.0, 790.0, False), (1, 1, 5.0, 550.0, 2.0, 10.0, True), (1, 2, 74.0, 550.2, 300.0, 790.0, False), (1, 3, 1.0, 299.0, 1.0, 299.0, False)])
    return grids.margins(pages_, blocks)


@rows_of("histogram_quantile", "k quantile", [(1, 50.09765625), (2, 0.0)])
def _(spark, sf_dir):
    rows = [(1, float(v)) for v in range(101)] + [(2, 0.0)]
    return grids.quantile(made(spark, "k long, v double", rows), "k", "v", 0.5)


@rows_of("office_documents", "file ord kind level text error", [("a.docx", 0, "heading", 1, "T", None), ("a.docx", 1, "para", 0, "x\ny & z", None), ("a.docx", 2, "item", 0, "i", None), ("a.docx", 3, "cell", 0, "a", None), ("a.docx", 4, "cell", 0, "b", None), ("bad.docx", 0, None, None, None, "BadZipFile")])
def _(spark, sf_dir):
    blocks = made(spark, "file string, ord long, kind string, level long, text string", [("a.docx", 2, "item", 0, "i"), ("a.docx", 0, "heading", 1, "T"), ("a.docx", 1, "para", 0, "x\ny & z"), ("a.docx", 3, "table", 1, "a\tb")])
    bad = made(spark, "file string, content string", [("bad.docx", "junk")]).select("file", F.col("content").cast("binary").alias("content"))
    return office.read(office.write_documents(blocks).union(bad), "docx")


@rows_of("office_sheets", "file sheet name row col text numeric", [("a.xlsx", 0, "One", 0, 0, "Item", False), ("a.xlsx", 0, "One", 0, 1, "Total", False), ("a.xlsx", 0, "One", 1, 0, "a<b", False), ("a.xlsx", 0, "One", 1, 1, "1,234.50", True), ("a.xlsx", 0, "One", 2, 1, "2023-03-15", False), ("a.xlsx", 0, "One", 3, 1, "25%", True), ("a.xlsx", 1, "Two", 5, 27, "x", False)])
def _(spark, sf_dir):
    rows = [("One", 0, 0, 0, "Item", None, "text"), ("One", 0, 0, 1, "Total", None, "text"), ("One", 0, 1, 0, "a<b", None, "general"), ("One", 0, 1, 1, None, 1234.5, "decimal"), ("One", 0, 2, 1, None, 45000.0, "date"), ("One", 0, 3, 1, None, 0.25, "percent"), ("Two", 1, 5, 27, "x", None, "general")]
    cells_ = made(spark, "name string, sheet long, row long, col long, text string, number double, format string", rows).withColumn("file", F.lit("a.xlsx"))
    return office.read(office.write_workbooks(cells_), "xlsx")


@rows_of("sheet_features", "row col text numeric", [(0, 0, "shared", False), (0, 2, "TRUE", False), (0, 3, "#DIV/0!", False), (1, 0, "inline", False), (1, 1, "0.3", True), (1, 2, "1904-01-02", False), (1, 3, "7 kg", True)])
def _(spark, sf_dir):
    return office.read(made(spark, "file string, content binary", [("f.xlsx", bytearray(SHEET))]), "xlsx")


@rows_of("office_slides", "slide nth kind text", [(1, 1, "para", "Title"), (1, 2, "cell", "in a table"), (2, 1, "para", "Second")])
def _(spark, sf_dir):
    return office.read(made(spark, "file string, content binary", [("f.pptx", bytearray(SLIDES))]), "pptx")


@rows_of("result_archives", "job names sizes", [(1, ["a.txt", "2 - A.txt"], [3, 2])])
def _(spark, sf_dir):
    files = made(spark, "job long, ord long, name string, content string", [(1, 2, "A.txt", "xy"), (1, 1, "a.txt", "abc")]).withColumn("content", F.col("content").cast("binary"))

    def entries(batches):
        for b in batches:
            for job, content in zip(b.job, b.content):
                found = zipfile.ZipFile(io.BytesIO(bytes(content))).infolist()
                yield pd.DataFrame({"job": [job], "names": [[x.filename for x in found]], "sizes": [[x.compress_size for x in found]]})

    return office.archives(files).mapInPandas(entries, "job long, names array<string>, sizes array<long>")


@rows_of("image_filter", "id plain masked", [(1, True, True), (2, False, False), (3, False, True)])
def _(spark, sf_dir):
    images = made(spark, "id long, width long, height long, mask boolean", [(1, 32, 100, False), (2, 31, 100, False), (3, 64, 64, True)])
    kept = lambda masks, c: records.worth_keeping(images, masks=masks).select("id", F.lit(True).alias(c))
    return images.join(kept(False, "plain"), "id", "left").join(kept(True, "masked"), "id", "left").select("id", F.coalesce("plain", F.lit(False)).alias("plain"), F.coalesce("masked", F.lit(False)).alias("masked"))


@rows_of("confidence_gate", "id accepted", [(1, True), (2, False), (3, True)])
def _(spark, sf_dir):
    return records.sure(made(spark, "id long, confidence double", [(1, 0.7), (2, 0.699), (3, 0.95)]))


@rows_of("category_search", "ord search", [(2, "Merge files"), (4, "merge again")])
def _(spark, sf_dir):
    return records.searched(made(spark, "ord long, category string, search string", [(4, "a", "merge again"), (2, "a", "Merge files"), (1, "b", "merge other"), (3, "a", "split")]), " MERGE ", "a")


@rows_of("recognition_confidence", "file confidence", [(1, 85.0), (2, None)])
def _(spark, sf_dir):
    return records.mean_confidence(made(spark, "file long, confidence double", [(1, 80.0), (1, 90.0), (1, None), (2, None), (1, float("nan"))]))


@rows_of("glyph_usage", "font codes", [("A", [1, 2, 3]), ("B", [1])])
def _(spark, sf_dir):
    return records.glyphs(made(spark, "page long, name string, code long", [(1, "F1", 2), (1, "F1", 1), (2, "F9", 3), (2, "F1", 1), (3, "F1", 7)]), made(spark, "page long, name string, font string", [(1, "F1", "A"), (2, "F9", "A"), (2, "F1", "B")]))


@rows_of("missing_fonts", "file fonts", [(1, ["Arial", "Times"])])
def _(spark, sf_dir):
    return records.missing_fonts(made(spark, "file long, name string, embedded boolean", [(1, "ABCDEF+Arial", False), (1, "Arial", False), (1, "Times", False), (1, "Inter", True), (2, "X", True)]))


@rows_of("geometry_probe", "file n_pages max_dpi", [(1, 2, 249), (2, 1, 358)])
def _(spark, sf_dir):
    return records.probe(made(spark, "file long, width double, height double", [(1, 612.0, 792.0), (1, 1000.0, 1000.0), (2, 612.0, 792.0)]))


@rows_of("job_progress", "job done total label", [(2, 3, 9, "late")])
def _(spark, sf_dir):
    return state.progress(made(spark, "job long, seq long, done long, total long, label string", [(1, 9, 9, 9, "stale"), (2, 1, 1, 9, "early"), (2, 2, 3, 9, "late")]), 2)


@rows_of("open_documents", "session file", [(1, "b"), (2, "c")])
def _(spark, sf_dir):
    return state.open_documents(made(spark, "session long, seq long, kind string, file string", [(1, 1, "open", "a"), (1, 2, "open", "b"), (1, 3, "close", "a"), (2, 1, "open", "x"), (2, 2, "end", None), (2, 3, "open", "c")]))



scalar("xml_elements", "t string, n string", "inners ids", [
    ('<a><w:b id="1">x<b>y</b></w:b><b id="2"/><c><b k=">" id="3">z</b></c><!-- <b>no</b> --></a>', "b", ["x<b>y</b>", "", "z"], ["1", "2", "3"]), ("<a/>", "b", [], []), ('<b z="1">q</b>', "b", ["q"], [None]),
], lambda t, n: [F.transform(media.elements(t, n), lambda e: e["inner"]), F.transform(media.elements(t, n), lambda e: media.attribute(e["attributes"], "id"))])


@rows_of("read_documents", "doc page line text ratio running level", [(1, p, 0, "Report 1" if p == 1 else f"Report {p}", 1.0, True, 0) for p in (1, 2, 3)] + [(1, 1, 1, "Big title", 1.6, False, 1), (1, 1, 2, "body text of many words here", 1.0, False, 0), (1, 2, 1, "more body text of many words", 1.0, False, 0), (1, 3, 1, "LABEL", 1.0, False, 4)])
def _(spark, sf_dir):
    run = lambda page, n, text, base, size=10.0: (1, page, n, text, 50.0, 300.0, base - size, base, base, size, False, False, False)
    rows = [run(p, 1, f"Report {p}", 30.0) for p in (1, 2, 3)] + [run(1, 2, "Big title", 120.0, 16.0), run(1, 3, "body text of many words here", 200.0), run(2, 2, "more body text of many words", 200.0), run(3, 2, "LABEL", 200.0)]
    ddl = "doc long, page long, run long, text string, x double, right double, top double, bottom double, baseline double, size double, bold boolean, italic boolean, spacer boolean"
    return structure.document(made(spark, ddl, rows), made(spark, "doc long, page long, height double", [(1, p, 800.0) for p in (1, 2, 3)]))


@rows_of("markdown_pages", "doc text", [(1, "# T\n\n- i\n\n---\n\npara\n\n```\nx\n```"), (2, "1. n")])
def _(spark, sf_dir):
    rows = [(1, 1, 2, "item", 0, "i"), (1, 1, 1, "heading", 1, "T"), (1, 2, 1, "para", 0, "para"), (1, 2, 2, "code", 0, "x"), (2, 1, 1, "numbered", 0, "n")]
    return structure.written_pages(made(spark, "doc long, page long, block long, kind string, level int, text string", rows))


@rows_of("picture_plan", "file page name dpi", [(1, 2, "scan-02.png", 300), (1, 4, "scan-04.png", 249), (1, 10, "scan-10.png", 300)])
def _(spark, sf_dir):
    rows = [(1, "scan", p, 10, 1000.0 if p == 4 else 612.0, 1000.0 if p == 4 else 792.0) for p in (1, 2, 4, 10)]
    pages_ = made(spark, "file long, stem string, page long, n_pages long, width double, height double", rows)
    return structure.picture_plan(pages_, F.col("page") % 2 == 0, 300)



@rows_of("deleted_pages", "file page error", [(1, 1, None), (1, 4, None), (2, None, "nothing left")])
def _(spark, sf_dir):
    return dispatch.run("delete", made(spark, "file long, page long", [(1, p) for p in range(1, 5)] + [(2, 1)]), spec="2-3")


@rows_of("missing_sources", "pos file page", [(2, 1, 9), (3, 7, 1)])
def _(spark, sf_dir):
    return paging.missing(made(spark, "pos long, file long, page long", [(1, 1, 1), (2, 1, 9), (3, 7, 1)]), made(spark, "file long, page long", [(1, 1), (1, 2)]))


@rows_of("operations_by_name", "op n", [("extract", 4), ("merge", 6), ("reorder", 3), ("rotate", 2), ("split", 4)])
def _(spark, sf_dir):
    rows = made(spark, "file long, page long, text string, n long", [(f, p, "t", 1) for f, k in ((1, 3), (2, 2), (3, 1)) for p in range(1, k + 1)])
    counts = {
        "merge": dispatch.run("merge", rows).agg(F.max("sequence").alias("n")), "split": dispatch.run("split", rows, every=2).select("file", "part").distinct().agg(F.count("*").alias("n")),
        "rotate": dispatch.run("rotate", rows, turn=90, spec="even").where("rotate = 90").agg(F.count("*").alias("n")), "reorder": dispatch.run("reorder", rows, order=[2, 3, 1]).agg(F.count("*").alias("n")), "extract": dispatch.run("extract", rows, wanted=[3, 1]).agg(F.count("*").alias("n")),
    }
    out = None
    for op, df in counts.items():
        own = df.select(F.lit(op).alias("op"), F.col("n").cast("long").alias("n"))
        out = own if out is None else out.union(own)
    return out


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
