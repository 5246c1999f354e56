"""Names of files and sheets."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Characters that no file system takes or that turn the order of others, names of devices, bytes of a name.
FORBIDDEN = re.compile("[\u0000-\u001f\u007f<>:\"/\\\\|?*‪-‮⁦-⁩]")
DEVICE = re.compile(r"(con|prn|aux|nul|com[1-9]|lpt[1-9])(\.|$)", re.I)
MOST_BYTES = 180
EXTENSION = r"\.([A-Za-z0-9]{1,8})$"


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, EXTENSION, 1))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, EXTENSION, "")


def made_safe(typed: str, ext: str, fallback: str = "document") -> str:
    """A typed stem as a file name with the extension that the bytes have."""
    name = FORBIDDEN.sub("", unicodedata.normalize("NFC", typed)).rstrip()
    if ext and name.lower().endswith("." + ext):
        name = name[: -len(ext) - 1]
    name = " ".join(name.strip(". \t\n\r").split())
    name = f"{name}-file" if DEVICE.match(name) else name or fallback
    room = max(MOST_BYTES - len(ext.encode()) - bool(ext), 1)
    # a character that is cut in the middle goes
    name = name.encode()[:room].decode(errors="ignore").rstrip(". \t\n\r") or fallback
    return name + ("." + ext if ext else "")


@F.pandas_udf(StringType())
def safe_filename(typed: pd.Series, ext: pd.Series) -> pd.Series:
    return pd.Series([made_safe(t or "", e or "") for t, e in zip(typed, ext)])


@F.pandas_udf(ArrayType(StringType()))
def name_series(typed: pd.Series, originals: pd.Series) -> pd.Series:
    """Names of a set of files from one stem: numbered where their extensions don't tell them apart."""

    def named(stem_: str, names: list[str]) -> list[str]:
        found = [re.search(EXTENSION, n) for n in names]
        ends = [m[1].lower() if m else "" for m in found]
        numbered = len(names) > 1 and len(set(ends)) == 1
        return [made_safe(f"{stem_}-{i}" if numbered else stem_, e, n[: m.start()] if m else n or "document") for i, (n, m, e) in enumerate(zip(names, found, ends), 1)]

    return pd.Series([named(t, list(o)) for t, o in zip(typed, originals)])


def distinct(names: list[str], clean, again) -> list[str]:
    """Clean names, no two alike but for case: again(name, n) makes the nth try."""
    used: set[str] = set()
    out = []
    for name in map(clean, names):
        candidate, n = name, 2
        while candidate.lower() in used:
            candidate, n = again(name, n), n + 1
        used.add(candidate.lower())
        out.append(candidate)
    return out


@F.pandas_udf(ArrayType(StringType()))
def batch_names(names: pd.Series) -> pd.Series:
    """Names of a batch's files in order; repeated ones as `2 - name`."""
    end = lambda n: (re.search(EXTENSION, n) or [None, ""])[1].lower()
    clean = lambda n: made_safe(n, end(n))
    return pd.Series([distinct(list(x), clean, lambda n, k: made_safe(f"{k} - {re.sub(EXTENSION, '', n)}", end(n))) for x in names])


@F.pandas_udf(ArrayType(StringType()))
def sheet_names(names: pd.Series) -> pd.Series:
    """Names of a workbook's sheets in order: 31 characters, none that a sheet may not have; repeated ones as `name (2)`."""

    def clean(name: str) -> str:
        name = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", name)
        return " ".join(re.sub(r"[:\\/?*\[\]]", " ", name).split()).strip("'")[:31].strip() or "Sheet"

    return pd.Series([distinct(list(x), clean, lambda n, k: f"{n[: 31 - len(f' ({k})')]} ({k})") for x in names])


def response_name(title: Column) -> Column:
    """A page's title as a file name: letters, digits, spaces, dashes and underscores, 60 of them."""
    clean = F.trim(F.substring(F.regexp_replace(title, r"[^\p{L}\p{N} _-]", ""), 1, 60))
    return F.concat(F.when(clean == "", "page").otherwise(clean), F.lit(".pdf"))
