"""Text, time and colour expressions on columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that stay as they are within a title.
ARTICLES = ("a", "an", "of", "the", "is", "and", "at", "in", "on", "yes")


def title_case(text: Column, small: Sequence[str] = ARTICLES, keep: str | None = "YES") -> Column:
    """Every word with a capital and then lower case, but for small words after the first; ``keep`` stays as it is."""
    capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))
    words = F.transform(F.split(text, " "), lambda w, i: F.when((i > 0) & w.isin(*small), w).otherwise(capital(w)))
    out = F.array_join(words, " ")
    return out if keep is None else F.when(text == keep, text).otherwise(out)


def is_number(text: Column) -> Column:
    return F.coalesce(text.try_cast("double").isNotNull(), F.lit(False))


def has_digit(text: Column) -> Column:
    return text.rlike("[0-9]")


def decode_cell(cell: Column) -> Column:
    """``CAT[k1;k2]`` to struct(category, keys); text without brackets has no keys."""
    keys = F.regexp_extract(cell, r"\[(.*)\]", 1)
    return F.struct(F.regexp_extract(cell, r"^([^\[]*)", 1).alias("category"), F.when(keys == "", F.array().cast("array<string>")).otherwise(F.split(keys, ";")).alias("keys"))


def tokens(text: Column) -> Column:
    """Lower-case words without ASCII punctuation."""
    clean = F.regexp_replace(F.lower(text), r"""[!-/:-@\[-`{-~]""", "")
    return F.filter(F.split(clean, r"\s+"), lambda w: w != "")


def name_from_uri(uri: Column) -> Column:
    """The last part of a URI, without angle brackets, underscores as spaces."""
    return F.regexp_replace(F.regexp_extract(F.regexp_replace(uri, "[<>]", ""), r"([^/#]*)$", 1), "_", " ")


def day_text(ts: Column) -> Column:
    return F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd")


def start_of_day(ts: Column) -> Column:
    return ts - F.pmod(ts, F.lit(86400))


def seconds_of_day(ts: Column) -> Column:
    return F.pmod(ts, F.lit(86400))


def is_weekend(ts: Column) -> Column:
    """Day 0 of the epoch is a Thursday; Monday is 0."""
    return F.pmod(F.floor(ts / 86400) + 3, F.lit(7)) >= 5


def hour_minute(ts: Column) -> Column:
    return F.date_format(F.timestamp_seconds(ts), "HH:mm")


def local_and_utc(text: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS[.f] ±hhmm`` to struct(utc, local, offset) in seconds, with local = utc - offset; blank text gives 0."""
    wall = F.coalesce(F.unix_timestamp(F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy-MM-dd HH:mm:ss"))), F.lit(0))
    sign = F.when(F.regexp_extract(text, r"([+-])\d{4}$", 1) == "-", -1).otherwise(1)
    zone = F.regexp_extract(text, r"[+-](\d{4})$", 1)
    east = F.when(zone == "", 0).otherwise(sign * (F.substring(zone, 1, 2).try_cast("long") * 3600 + F.substring(zone, 3, 2).try_cast("long") * 60))
    return F.struct((wall - east).alias("utc"), wall.alias("local"), (-east).alias("offset"))


def seconds_in_hours(start: Column, end: Column, hours: Sequence[tuple[int, int]]) -> Column:
    """Seconds of [start, end] within hour ranges of one day; a range includes its last hour to hh:59:59."""
    day = start_of_day(start)
    total = F.lit(0).cast("long")
    for first, last in hours:
        total = total + F.greatest(F.lit(0).cast("long"), F.least(end, day + last * 3600 + 3599) - F.greatest(start, day + first * 3600))
    return total


def full_address(*parts: Column) -> Column:
    return F.concat_ws(", ", *[F.nullif(F.trim(p), F.lit("")) for p in parts])


def colour(name: Column, palette: Sequence[str], home: str = "#000000") -> Column:
    """A colour by the name's length; home has its own."""
    index = F.pmod(F.length(name), F.lit(len(palette))) + 1
    return F.when(F.lower(name) == "home", home).otherwise(F.element_at(F.array(*[F.lit(c) for c in palette]), index))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words, each padded with two blanks before and one behind."""
    words = F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: w != "")
    of = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, of)))


def trigram_numbers(grams: Column) -> Column:
    """Trigrams of letters, digits and blanks as whole numbers, one each, so that arrays of them are compared without strings."""
    code = lambda g, i: F.ascii(F.substring(g, i, 1)).cast("int")
    return F.transform(grams, lambda g: code(g, 1) * 65536 + code(g, 2) * 256 + code(g, 3))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams as a share of all; 0 where neither text has any."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(F.array_union(a, b))
    return F.when(every > 0, both / every).otherwise(F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Share of a's trigrams in b: an upper bound of how well a fits some extent of b's words."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(0.0))


def rounded(number: Column, digits: int) -> Column:
    """A double rounded as C's round of the shifted number does (half away from zero), as DuckDB has it: zero keeps its sign, and what the product makes a half is one. Spark's own goes by the decimal digits."""
    scale = float(10**digits)
    return F.when(number == 0, number).when(number < 0, -(F.round(-number * scale, 0) / scale)).otherwise(F.round(number * scale, 0) / scale)


def parse_tags(tags: Column) -> Column:
    """``"k"=>"v", ...`` to a map."""
    return F.str_to_map(F.regexp_replace(tags, '"', ""), F.lit(",\\s*"), F.lit("=>"))
