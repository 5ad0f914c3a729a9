"""Text, amounts and dates as vouchers print them."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space in printed text: ASCII controls, the Unicode spaces and the byte order mark.
BLANK = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: The same characters one by one.
BLANKS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def spaced(pattern: str) -> str:
    r"""A pattern whose \s and \S mean all printed white space; Java's mean ASCII only."""
    return pattern.replace(r"\S", f"[^{BLANK[1:-1]}]").replace(r"\s", BLANK)


# fixed values: the printed forms
AMOUNT = spaced(r"^-?\$?\s*\d{1,3}(\.\d{3})*(,\d+)?$|^-?\$?\s*\d+(,\d+)?$")
DATE = r"^(\d{2})/(\d{2})/(\d{4})$"
PERIOD = r"(\d{2})/(\d{4})"
BARCODE = spaced(r"^[A-Za-z0-9]{6,}(\s*-\s*[A-Za-z0-9]{2,})+$")
MONEY = "decimal(20,6)"


@lru_cache(1)
def _folds() -> tuple[str, str]:
    """Characters whose canonical decomposition is one ASCII letter or digit with marks, and
    those letters; then the marks themselves, which translate() drops."""
    marks = "".join(map(chr, range(0x300, 0x370)))
    source, target = [], []
    for code in range(0x80, min(sys.maxunicode, 0x2FFF)):
        bare = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if c not in marks)
        if len(bare) == 1 and bare.isascii() and bare.isalnum():
            source.append(chr(code))
            target.append(bare)
    return "".join(source) + marks, "".join(target)


def norm(s: Column) -> Column:
    """Without accents, lower case, everything but letters and digits as one space; null as ''."""
    source, target = _folds()
    # capitals go with the accents: of the rest, lower() makes no letter from a to z; plain ASCII needs no look at each letter
    bare = F.when(F.octet_length(s) == F.length(s), F.lower(s)).otherwise(F.translate(F.coalesce(s, F.lit("")), ascii_uppercase + source, ascii_lowercase + target.lower()))
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


def trimmed(s: Column) -> Column:
    inked = F.substring(s, 1, 1).between("!", "~") & F.substring(s, -1, 1).between("!", "~")  # most texts
    return F.when(inked, s).otherwise(F.btrim(F.coalesce(s, F.lit("")), F.lit(BLANKS)))


def squish(s: Column) -> Column:
    """Runs of white space as one space, none at the ends; null as ''."""
    plain = ~s.rlike("[^ -~]|  |^ | $")  # most texts
    return F.when(plain, s).otherwise(F.trim(F.regexp_replace(F.coalesce(s, F.lit("")), f"[[^!-~]&&{BLANK}]+", " ")))  # most characters are told by one comparison


def is_numeric(s: Column) -> Column:
    return trimmed(s).rlike(AMOUNT)


def to_number(s: Column) -> Column:
    """A printed amount (points between thousands, comma before decimals) as a decimal; null
    for anything else, so that no data is not zero."""
    plain = F.translate(trimmed(s), ",$." + BLANKS, ".")
    return F.when(is_numeric(s), plain.try_cast(MONEY))


def printed(n: Column, decimals: int = 0) -> Column:
    """A number as printed: points between thousands, comma before decimals."""
    return F.translate(F.format_number(n, decimals), ",.", ".,")


def date_key(s: Column) -> Column:
    """dd/mm/yyyy as the integer yyyymmdd, without a look at the calendar; else null."""
    part = lambda t, at, n: F.substring(t, at, n).cast("int")
    key = lambda t: part(t, 7, 4) * 10000 + part(t, 4, 2) * 100 + part(t, 1, 2)
    return F.when(s.rlike(DATE), key(s)).when(trimmed(s).rlike(DATE), key(trimmed(s)))


def period(s: Column) -> Column:
    """struct<month, year, text, code> of the first mm/yyyy, or null; code has no leading zero."""
    part = lambda k: F.regexp_extract(s, PERIOD, k)
    month, year = part(1).cast("int"), part(2).cast("int")
    whole = F.struct(month.alias("month"), year.alias("year"), F.concat_ws("/", part(1), part(2)).alias("text"), F.concat(month.cast("string"), year.cast("string")).alias("code"))
    return F.when(s.rlike(PERIOD), whole)


def first_match(s: Column, pattern: str, group: int = 0) -> Column:
    """The group of the first match, or null without one."""
    return F.when(s.rlike(pattern), F.regexp_extract(s, pattern, group))


def is_value(s: Column) -> Column:
    """Whether a header cell holds a value, not a heading: a tax id, an amount, a form's label or a barcode."""
    from .taxid import looks_like_tax_id

    t = trimmed(s)
    return looks_like_tax_id(s) | is_numeric(s) | t.endswith(":") | t.rlike(BARCODE)


def short_digest(data: Column) -> Column:
    return F.substring(F.sha2(data, 256), 1, 16)


def progress(document: Column, documents: Column, page: Column, pages: Column) -> Column:
    """Percent done while the given page of the given document is read, 99 at most."""
    done = (document - 1 + page / F.greatest(pages, F.lit(1))) / documents * 100
    return F.least(F.lit(99), F.round(done)).cast("int")
