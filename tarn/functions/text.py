"""Names, labels and paths as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tarn.constants import MATCH_QUALITIES, METHOD_LABELS, REPORT_ZONE, SIMILARITY_COLORS


def like_escaped(text: str) -> str:
    """``text`` for LIKE with a backslash before its wildcards."""
    return "".join("\\" + c if c in "\\%_" else c for c in text)


def contains_text(column: Column, text: str) -> Column:
    """Whether a column holds ``text``, whatever the case."""
    return F.lower(column).contains(text.strip().lower())


def display_name(name: Column, site_id: Column, state: Column) -> Column:
    trimmed = F.trim(name)
    named = name.isNotNull() & (trimmed != "") & (trimmed != site_id.cast("string"))
    return (
        F.when(named, name)
        .when(state.isNotNull(), F.format_string("Unnamed Lake #%s (%s)", site_id, state))
        .otherwise(F.format_string("Unnamed Lake #%s", site_id))
    )


@F.pandas_udf(StringType())
def without_accents(names: pd.Series) -> pd.Series:
    """Names without combining marks; Spark has no expression that decomposes text."""
    bare = lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    return names.map(bare, na_action="ignore")


def first_number(*candidates: Column) -> Column:
    """The first candidate that is a number other than 0; else 0."""
    return F.coalesce(*(F.nullif(c.try_cast("double"), F.lit(0.0)) for c in candidates), F.lit(0.0))


def lat_lon(lat: Column, lon: Column) -> Column:
    side = lambda v, plus, minus: F.concat(
        F.format_string("%.4f°", F.abs(v)), F.lit(" "), F.when(v >= 0, plus).otherwise(minus)
    )
    return F.concat(side(lat, "N", "S"), F.lit(", "), side(lon, "E", "W"))


def percent(score: Column) -> Column:
    return F.when(score.isNull(), "—").otherwise(F.format_string("%.1f%%", score * 100))


def _banded(score: Column, bands: tuple[tuple[float, str], ...]) -> Column:
    """The word of the first band that the score reaches; the last one's below all."""
    out = F.lit(bands[-1][1])
    for least, word in reversed(bands[:-1]):
        out = F.when(score >= least, word).otherwise(out)
    return out


def match_quality(score: Column) -> Column:
    return F.when(score.isNull(), "—").otherwise(_banded(score, MATCH_QUALITIES))


def similarity_color(score: Column) -> Column:
    return _banded(score, SIMILARITY_COLORS)


def _measure(value: Column, digits: int, unit: str) -> Column:
    return F.when(value.isNull(), "—").otherwise(F.concat(F.format_number(value, digits), F.lit(f" {unit}")))


def square_km(value: Column) -> Column:
    return _measure(value, 2, "km²")


def kilometres(value: Column) -> Column:
    return _measure(value, 1, "km")


def milliseconds(value: Column) -> Column:
    """A duration; none, and 0, is a dash."""
    return _measure(F.nullif(value, F.lit(0.0)), 0, "ms")


def method_label(method: Column) -> Column:
    """The name of a similarity method as shown; other names as they are."""
    pairs = F.create_map(*(F.lit(x) for pair in METHOD_LABELS.items() for x in pair))
    return F.coalesce(F.element_at(pairs, method), method)


def report_time(moment: Column, zone: str = "UTC") -> Column:
    """A wall-clock time of ``zone`` as a report shows it, in Indian time."""
    there = F.convert_timezone(F.lit(zone), F.lit(REPORT_ZONE), moment)
    return F.date_format(there, "MMMM dd, yyyy 'at' hh:mm a 'IST'")


def slug(name: Column) -> Column:
    """A file name's part: other characters than letters and digits become ``_``."""
    bare = F.regexp_replace(F.regexp_replace(name, r"[^0-9A-Za-z]+", "_"), r"^_+|_+$", "")
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit("lake"))


def image_path(root: Column, year: Column, site_id: Column) -> Column:
    return F.format_string("%s/%d/lake_%06d.tif", root, year.cast("int"), site_id.cast("long"))


#: A year's folder right above a file, or one folder higher.
_LAYOUTS = (r"^(.*)/(\d{4})/[^/]+$", r"^(.*)/(\d{4})/[^/]+/[^/]+$")


def path_root(path: Column, year: Column | None = None) -> Column:
    """What stands before the folder of the year, or of any year if none is given.

    The folder is the file's own or the one above; null if neither is the year's.
    """

    def root(layout: str) -> Column:
        found = F.regexp_extract(path, layout, 2)
        right = found != "" if year is None else found == F.format_string("%04d", year.cast("int"))
        before = F.regexp_extract(path, layout, 1)
        return F.when(right, F.when(before == "", "/").otherwise(before))

    return F.coalesce(*map(root, _LAYOUTS))


def path_year(path: Column) -> Column:
    """The year of the folder that ``path_root`` stands before."""
    return F.coalesce(*(F.nullif(F.regexp_extract(path, layout, 2), F.lit("")) for layout in _LAYOUTS)).cast("int")


def trend(first: Column, last: Column, rising: str = "increasing", falling: str = "declining") -> Column:
    return F.when(last > first, rising).when(last < first, falling).otherwise("stable")
