"""Partial dates in file names, folder names and queries, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sidelight.functions.text import let
from sidelight.schemas import DATE, QUERY_DATE

MIN_YEAR, MAX_YEAR = 1900, 2100

# Month, season and date patterns, English and Russian.
MONTH_NAMES = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
MONTHS = (
    (1, r"\bjan(?:uary)?\b|\bянвар\w*\b"),
    (2, r"\bfeb(?:ruary)?\b|\bфеврал\w*\b"),
    (3, r"\bmar(?:ch)?\b|\bмарт\w*\b"),
    (4, r"\bapr(?:il)?\b|\bапрел\w*\b"),
    (6, r"\bjun(?:e)?\b|\bиюн\w*\b"),
    (7, r"\bjul(?:y)?\b|\bиюл\w*\b"),
    (8, r"\baug(?:ust)?\b|\bавгуст\w*\b"),
    (9, r"\bsep(?:t|tember)?\b|\bсентябр\w*\b"),
    (10, r"\boct(?:ober)?\b|\bоктябр\w*\b"),
    (11, r"\bnov(?:ember)?\b|\bноябр\w*\b"),
    (12, r"\bdec(?:ember)?\b|\bдекабр\w*\b"),
)
MAY = r"\bmay\b|\bма[йяею]м?\b"
SEASONS = (
    (r"\bwinter\b|\bзим\w*\b", (12, 1, 2)),
    (r"\bspring\b|\bвесн\w*\b|\bвесенн\w*\b", (3, 4, 5)),
    (r"\bsummer\b|\bлет[оа]\b|\bлетом\b|\bлетн\w*\b", (6, 7, 8)),
    (r"\b(?:autumn|fall)\b|\bосен[ьи]\b|\bосенью\b|\bосенн\w*\b", (9, 10, 11)),
)
YEAR = r"\b(?:19|20)\d{2}\b"
NAME_DATE = r"(?<!\d)((?:19|20)\d{2})[-_]?(0[1-9]|1[0-2])[-_]?(0[1-9]|[12]\d|3[01])(?!\d)"
DAY_BEFORE = r"(?<!\d)(\d{1,2})(?:\s*[-–]\s*\d{1,2})?\D{0,3}$"
DAY_AFTER = r"^\S+\D{0,3}(?<!\d)(\d{1,2})(?!\d)"
DAY_MONTH_YEAR = r"\b(\d{1,2})[.\-/](\d{1,2})[.\-/](\d{4})\b"
YEAR_MONTH_DAY = r"\b(\d{4})-(\d{2})-(\d{2})\b"
EXIF_DATE = r'(?:exif:DateTimeOriginal|xmp:CreateDate|photoshop:DateCreated)="(\d{4})-(\d{2})-(\d{2})'

_U = "(?U)(?i)"  # Java's \w and \b know ASCII alone without it


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _group(c: Column, pattern: str, n: int) -> Column:
    """A group as an integer; null where nothing matches."""
    return _int(F.nullif(F.regexp_extract(c, _U + pattern, n), F.lit("")))


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def valid_year(year: Column) -> Column:
    return year.between(MIN_YEAR, MAX_YEAR)


def find_month(text: Column) -> Column:
    """The month that stands first in the text, as struct<pos, month> with a 1-based position, or null.

    May counts only where no other month stands, as its short forms are ordinary words too.
    """
    hits = F.filter(
        F.array(*(F.struct(F.regexp_instr(text, F.lit(_U + rx)).alias("pos"), F.lit(m).alias("month")) for m, rx in MONTHS)),
        lambda h: h["pos"] > 0,
    )
    may = F.regexp_instr(text, F.lit(_U + MAY))
    return F.coalesce(F.array_min(hits), F.when(may > 0, F.struct(may.alias("pos"), F.lit(5).alias("month"))))


def find_year(text: Column) -> Column:
    return _group(text, f"({YEAR})", 1)


def find_season(text: Column) -> Column:
    """The months of the first season in the order of the list, whatever stands first in the text."""
    out = _null("array<int>")
    for rx, months in reversed(SEASONS):
        out = F.when(F.regexp_like(text, F.lit(_U + rx)), F.array(*map(F.lit, months))).otherwise(out)
    return out


def _in_month(day: Column) -> Column:
    return F.when(day.between(1, 31), day)


def _day_before(text: Column, pos: Column) -> Column:
    return _in_month(_group(F.substring(text, F.lit(1), pos - 1), DAY_BEFORE, 1))


def from_filename(stem: Column) -> Column:
    """struct<year, month, day> packed into a file name, or null."""
    parts = F.struct(*(_group(stem, NAME_DATE, n).alias(k) for n, k in ((1, "year"), (2, "month"), (3, "day"))))
    return let(parts, lambda d: F.when(d["year"].isNotNull() & valid_year(d["year"]), d))


def from_folders(parts: Column) -> Column:
    """A fold over folder names: later years and months win, and a later month resets the day."""
    start = F.struct(_null("int").alias("year"), _null("int").alias("month"), _null("int").alias("day"))

    def step(acc, part):
        def merge(x):
            found = x["found"]
            return F.struct(
                F.coalesce(find_year(x["text"]), acc["year"]).alias("year"),
                F.coalesce(found["month"], acc["month"]).alias("month"),
                F.when(found.isNotNull(), _day_before(x["text"], found["pos"])).otherwise(acc["day"]).alias("day"),
            )

        return let(F.lower(part), lambda text: let(F.struct(text.alias("text"), find_month(text).alias("found")), merge))

    return let(F.aggregate(parts, start, step), lambda out: F.when(out["year"].isNotNull() | out["month"].isNotNull(), out))


def from_exif(content: Column) -> Column:
    """The first of three date attributes; out of range it gives null, and no other is tried."""
    parts = F.struct(*(_group_cs(content, EXIF_DATE, n).alias(k) for n, k in ((1, "year"), (2, "month"), (3, "day"))))
    return let(parts, lambda d: F.when(valid_year(d["year"]) & d["month"].between(1, 12) & d["day"].between(1, 31), d))


def _group_cs(c: Column, pattern: str, n: int) -> Column:
    return _int(F.nullif(F.regexp_extract(c, pattern, n), F.lit("")))


def date_chain(content: Column, stem: Column, folders: Column) -> Column:
    """EXIF before file name before folders, tagged with where it came from."""

    def tagged(d, source):
        return let(d, lambda x: F.when(x.isNotNull(), F.struct(x["year"].alias("year"), x["month"].alias("month"), x["day"].alias("day"), F.lit(source).alias("source"))))

    return F.coalesce(tagged(from_exif(content), "exif"), tagged(from_filename(stem), "filename"), tagged(from_folders(folders), "folder")).cast(DATE)


def parse_query(query: Column) -> Column:
    """What a query says about time: struct<year, months, day>, or null. A season is three months."""
    def exact(q, pattern, y, m, d):
        parts = F.struct(*(_group(q, pattern, n).alias(k) for n, k in ((y, "year"), (m, "month"), (d, "day"))))
        return let(parts, lambda x: F.when(x["month"].between(1, 12) & x["day"].between(1, 31), F.struct(x["year"], F.array(x["month"]).alias("months"), x["day"])).cast(QUERY_DATE))

    def loose(x):
        q, found = x["q"], x["found"]
        behind = F.substring(q, found["pos"], F.length(q))
        day = F.when(found.isNotNull(), F.coalesce(_day_before(q, found["pos"]), _in_month(_group(behind, DAY_AFTER, 1))))
        months = F.coalesce(F.when(found.isNotNull(), F.array(found["month"])), find_season(q))
        parts = F.struct(find_year(q).alias("year"), months.alias("months"), day.alias("day"))
        return let(parts, lambda p: F.when(p["year"].isNotNull() | p["months"].isNotNull(), p)).cast(QUERY_DATE)

    def parsed(q):
        return F.coalesce(
            exact(q, DAY_MONTH_YEAR, 3, 2, 1), exact(q, YEAR_MONTH_DAY, 1, 2, 3),
            let(F.struct(q.alias("q"), find_month(q).alias("found")), loose),
        )

    return let(F.lower(F.coalesce(query, F.lit(""))), parsed)


def date_label(date: Column) -> Column:
    """``12 May 2017``, ``May 2017``, ``2017``, ``May``, or null. Zero parts count as missing."""
    year, month, day = (F.nullif(date[k], F.lit(0)) for k in ("year", "month", "day"))
    name = F.get(F.array(*map(F.lit, MONTH_NAMES)), month - 1)
    return (
        F.when(name.isNotNull() & day.isNotNull() & year.isNotNull(), F.concat_ws(" ", day.cast("string"), name, year.cast("string")))
        .when(name.isNotNull() & year.isNotNull(), F.concat_ws(" ", name, year.cast("string")))
        .when(year.isNotNull(), year.cast("string")).otherwise(name)
    )
