"""Text functions as Column expressions. White space is Unicode's; case-insensitive patterns fold Unicode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names in dates written out in Italian.
MONTHS = ["gennaio", "febbraio", "marzo", "aprile", "maggio", "giugno", "luglio", "agosto", "settembre", "ottobre", "novembre", "dicembre"]


def straight(x: Column, curly: str = "’‘“”") -> Column:
    """Straight quotes for curly ones. ``translate`` looks up every character of a text; a replacement only finds its own."""
    for c in curly:
        x = F.replace(x, F.lit(c), F.lit('"' if c in "“”" else "'"))
    return x


def or_null(x: Column) -> Column:
    """Null for an empty text."""
    return F.nullif(x, F.lit(""))


def is_missing(x: Column) -> Column:
    """Null or empty."""
    return F.coalesce(x, F.lit("")) == ""


def first_text(*xs: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(or_null(x) for x in xs))


def clean(x: Column) -> Column:
    """Null becomes empty, curly apostrophes straight, white space single; spaces, dots and semicolons at the ends go."""
    return F.btrim(F.regexp_replace(straight(F.coalesce(x, F.lit("")), "’"), r"(?U)\s+", " "), F.lit(" .;"))


def normalise(x: Column) -> Column:
    """For comparing quotes: straight quotes, single white space, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(straight(x), r"(?U)\s+", " ")))


def seat_and_entrance(raw: Column) -> tuple[Column, Column]:
    """("(sede via X) entrance text") to the seat and the entrance note; other addresses are (as they are, null)."""
    pattern = r"(?iu)^\(sede\s+(.+?)\)\s*(.*)"
    found = raw.rlike(pattern)
    note = F.replace(F.trim(F.regexp_extract(raw, pattern, 2)), F.lit("INGRESSO PROVVISORIO"), F.lit("Ingresso provvisorio"))
    return F.when(found, F.trim(F.regexp_extract(raw, pattern, 1))).otherwise(raw), F.when(found, or_null(note))


def number_after(x: Column, word: str) -> Column:
    """The whole number after a word, null if there is none."""
    return or_null(F.regexp_extract(x, rf"{word}\s+(\d+)", 1)).try_cast("int")


def contains_fold(x: Column, needle: Column) -> Column:
    return F.contains(F.lower(x), F.lower(needle))


def true_if_says(x: Column, phrase: str) -> Column:
    """True where the lower-cased text holds the phrase, null elsewhere: never false."""
    return F.when(F.contains(F.lower(x), F.lit(phrase)), F.lit(True))


def prose_dates(x: Column) -> Column:
    """All dates written out in Italian: array of (said, day). A day the calendar lacks is null."""
    pattern = rf"(?iu)\d{{1,2}}\s+(?:{'|'.join(MONTHS)})\s+20\d\d"
    month = F.create_map(*(F.lit(v) for i, m in enumerate(MONTHS, 1) for v in (m, i)))

    def day(said: Column) -> Column:
        parts = F.split(said, r"\s+")
        return F.try_make_date(parts[2].cast("int"), F.element_at(month, F.lower(parts[1])), parts[0].cast("int")) if hasattr(F, "try_make_date") else F.try_to_date(F.concat_ws("-", parts[2], F.element_at(month, F.lower(parts[1])).cast("string"), parts[0]), "y-M-d")

    found = F.regexp_extract_all(x, F.lit(pattern), F.lit(0))
    return F.transform(found, lambda said: F.struct(F.array_join(F.split(said, r"\s+"), " ").alias("said"), day(said).alias("day")))


def past_dates(x: Column, as_of: Column) -> Column:
    """The dates of ``prose_dates`` before ``as_of``, as said."""
    return F.transform(F.filter(prose_dates(x), lambda d: d["day"] < as_of), lambda d: d["said"])


def sentence_case(x: Column) -> Column:
    """Hyphens to spaces, first letter upper, the rest lower."""
    spaced = F.replace(x, F.lit("-"), F.lit(" "))
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.lower(F.substr(spaced, F.lit(2))))


def html_escape(x: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(raw), F.lit(safe))
    return x


def split_options(x: Column) -> tuple[Column, Column]:
    """(text, options): a last line ``OPTIONS: a | b`` is taken off and split; texts without one have no options."""
    body = F.regexp_replace(x, r"\s+$", "")
    last = F.element_at(F.split(body, "\n"), -1)
    has = F.upper(F.ltrim(last)).startswith("OPTIONS:")
    after = F.regexp_replace(last, r"(?i)^\s*OPTIONS:", "")
    options = F.filter(F.transform(F.split(after, r"\|"), lambda o: F.trim(o)), lambda o: o != "")
    text = F.regexp_replace(F.substring(body, F.lit(1), F.length(body) - F.length(last)), r"\s+$", "")
    return F.when(has, text).otherwise(x), F.when(has, options).otherwise(F.array().cast("array<string>"))


def text_of_blocks(blocks: Column) -> Column:
    """The texts of a message's text blocks, joined."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "")


def after_last_marker(blocks: Column, marker: str = "fallback", dropped: tuple[str, ...] = ("thinking", "redacted_thinking", "tool_use")) -> Column:
    """Blocks up to the last marker lose the dropped types; those after it stay, as do all if there is no marker."""
    places = F.transform(blocks, lambda b, i: F.when(b["type"] == marker, i).otherwise(-1))
    last = F.coalesce(F.array_max(places), F.lit(-1))
    return F.filter(blocks, lambda b, i: (i > last) | ~F.coalesce(b["type"].isin(*dropped), F.lit(False)))


def thousands(n: Column) -> Column:
    """A whole number with separators."""
    return F.format_number(n, 0)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def date_part_of(stamp: Column) -> Column:
    """The date of an ISO timestamp text."""
    return F.substring(stamp, 1, 10)
