"""Column expressions on text: folding, keys, classification, parsing."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F



def _plain_letters() -> tuple[str, str]:
    """Letters of the Latin blocks that decompose to one ASCII letter and marks, with that letter; then the marks, which have none."""
    letters = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii() and base.isalpha():
            letters[chr(code)] = base
    return "".join(letters) + "".join(map(chr, range(0x300, 0x370))), "".join(letters.values())


ACCENTED, PLAIN = _plain_letters()


def strip_accents(c: Column) -> Column:
    """Latin letters without their diacritics; marks of their own are removed."""
    return F.translate(c, ACCENTED, PLAIN)


def fold(c: Column, accents: bool = True) -> Column:
    """Upper case without accents and with single spaces; blank becomes null."""
    text = F.regexp_replace(F.trim(c.cast("string")), "\\s+", " ")
    return F.nullif(F.upper(strip_accents(text) if accents else text), F.lit(""))


def alnum_key(c: Column) -> Column:
    """Lower-case ASCII letters and digits only."""
    return F.regexp_replace(F.lower(strip_accents(c)), "[^a-z0-9]", "")


def first_number(c: Column) -> Column:
    """The first number in a text as a double; a comma may be the decimal sign."""
    return F.replace(F.regexp_extract(c, "(\\d+(?:[.,]\\d+)?)", 1), F.lit(","), F.lit(".")).try_cast("double")


def kilometre(c: Column) -> Column:
    """A kilometre from text, with a decimal comma or point; null unless the whole text is a number."""
    text = F.replace(F.trim(c.cast("string")), F.lit(","), F.lit("."))
    return F.when(text.rlike("^-?[0-9]+([.][0-9]+)?$"), text.try_cast("double"))


def hour_of(c: Column) -> Column:
    """The hour at the beginning of a time of day; null if it is beyond 23 or missing."""
    hour = F.regexp_extract(c, "(\\d{1,2})", 1).try_cast("int")
    return F.when(hour <= 23, hour)


def classify(c: Column, patterns: dict[str, str], default: str) -> Column:
    """The label of the first pattern (in order) found in the text, whatever its case."""
    out = None
    for label, pattern in patterns.items():
        hit = c.rlike(f"(?i){pattern}")
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


def corridor(c: Column) -> Column:
    """A route without its direction suffix."""
    return F.regexp_replace(F.trim(c), "([NSEW])$", "")


def place_tokens(c: Column) -> Column:
    """Names in a stretch's title: split at dashes, colons, brackets and the conjunctions y and e; sector numbers are dropped."""
    parts = F.split(F.regexp_replace(c, "\\s+[yYeE]\\s+|[-–—:()]", "|"), "\\|")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike("(?i)^sector\\s*\\d+$"))


def clip_text(c: Column, most: int = 500) -> Column:
    return F.substring(F.trim(F.regexp_replace(c, "\\s+", " ")), 1, most)


def escape_html(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def links(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit('href="([^"]+)"'), F.lit(1))


def lenient_double(c: Column, noise: str = "[°º, ]") -> Column:
    """A number after removal of noise characters; null where it is none."""
    return F.regexp_replace(c.cast("string"), noise, "").try_cast("double")


#: Forms that are tried last, the day before the month.
DAY_FIRST = ["d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "d/M/yy"]


def parse_date(c: Column, formats: list[str], day_first: bool = False) -> Column:
    """The first format that fits, in order; with day_first, the usual forms with the day in front as a last resort."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)).cast("date") for f in [*formats, *(DAY_FIRST if day_first else [])]])


def lat_lon(c: Column) -> Column:
    """A struct (lat, lon) from "lat,lon"; null for other text."""
    ok = c.rlike("^\\s*-?\\d+(\\.\\d+)?\\s*,\\s*-?\\d+(\\.\\d+)?\\s*$")
    part = F.split(c, ",")
    return F.when(ok, F.struct(F.trim(part[0]).try_cast("double").alias("lat"), F.trim(part[1]).try_cast("double").alias("lon")))


def record_id(*columns: Column) -> Column:
    """A repeatable id of a record."""
    return F.sha2(F.concat_ws(":", *[c.cast("string") for c in columns]), 256)


def departure(c: Column) -> Column:
    """A departure time in one of the three accepted forms; null otherwise."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in ("yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm", "dd/MM/yyyy HH:mm")])


def redate(c: Column, source: str = "yyyyMMdd", target: str = "dd/MM/yyyy") -> Column:
    return F.date_format(F.try_to_timestamp(c, F.lit(source)), target)


def ramp(v: Column, low: tuple[int, int, int], high: tuple[int, int, int]) -> Column:
    """A colour #rrggbb between two, at v from 0 to 1."""
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    return F.lower(F.format_string("#%02x%02x%02x", *[F.round(F.lit(a) + t * (b - a)).cast("int") for a, b in zip(low, high)]))
