"""Dates as people write them (inventory D1-D8)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import case_fold, normalize

_NUMERIC = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})\z"
_WORDS = r"(?U)^ng[aà]y\s+(\d{1,2})\s+th[aá]ng\s+(\d{1,2})\s+n[aă]m\s+(\d{4})\z"
_WORDS_IN = r"(?iU)ngày\s+(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})"
# Dates that stand for a missing one.
DEFAULTS = ("01/01/2023", "01/01/1970", "01/01/2000", "01/01/2024")


def _dmy(c: Column, pattern: str, sep: str = "/") -> Column:
    """dd/mm/yyyy from the three groups of a pattern; NULL where it doesn't match."""
    d, m, y = (F.regexp_extract(c, pattern, i) for i in (1, 2, 3))
    return F.when(d != "", F.concat_ws(sep, F.lpad(d, 2, "0"), F.lpad(m, 2, "0"), y))


def iso_date(c: Column) -> Column:
    """ISO form of a text that is wholly a date of the calendar, else NULL."""
    t = case_fold(c)
    d = F.coalesce(_dmy(t, _NUMERIC), _dmy(t, _WORDS))
    return F.date_format(F.try_to_date(d, "dd/MM/yyyy"), "yyyy-MM-dd")


def comparable_value(c: Column, is_date: bool = False, accent_insensitive: bool = False) -> Column:
    """The form in which extracted values are compared."""
    t = normalize(c, accent_insensitive)
    return F.coalesce(iso_date(t), t) if is_date else t


def day_first(c: Column) -> Column:
    """dd/mm/yyyy from numeric, worded and ISO dates, wherever they stand; others stay. No calendar check."""
    iso = F.regexp_extract(c, r"(\d{4})-(\d{2})-(\d{2})", 0)
    flipped = F.concat_ws("/", F.substring(iso, 9, 2), F.substring(iso, 6, 2), F.substring(iso, 1, 4))
    any_num = _dmy(c, r"(\d{1,2})[/\-](\d{1,2})[/\-](\d{4})")
    worded = _dmy(c, r"(?iU)(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})")
    return F.when(c.rlike(r"^\d{2}/\d{2}/\d{4}\z"), c).otherwise(F.coalesce(any_num, worded, F.when(iso != "", flipped), c))


def without_defaults(c: Column) -> Column:
    """Dates that stand for a missing one become ''."""
    return F.when(c.isin(*DEFAULTS), "").otherwise(c)


def first_date(c: Column) -> Column:
    """The first worded date of a text as dd/mm/yyyy, '' for none."""
    return F.coalesce(_dmy(c, _WORDS_IN), F.lit(""))


def header_date(c: Column) -> Column:
    """A worded date in a header, even where recognition split it: whole, with gaps, or its two halves apart."""
    gaps = r"(?isU)ngày\s+(\d{1,2}).{0,80}?tháng\s+(\d{1,2}).{0,80}?năm\s+(\d{4})"
    day = F.regexp_extract(c, r"(?iU)ngày\s+(\d{1,2})", 1)
    month, year = (F.regexp_extract(c, r"(?iU)(\d{1,2})\s+năm\s+(\d{4})", i) for i in (1, 2))
    halves = F.when((day != "") & (month != ""), F.concat_ws("/", F.lpad(day, 2, "0"), F.lpad(month, 2, "0"), year))
    return F.coalesce(_dmy(c, _WORDS_IN), _dmy(c, gaps), halves, F.lit(""))


def weekday_name(c: Column) -> Column:
    """Mon to Sun."""
    return F.element_at(F.array(*[F.lit(x) for x in ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")]), F.weekday(c) + 1)


def label_date(c: Column) -> Column:
    """The date a label is made of: numeric after its word, worded as day/month/year without padding, else the first numeric one of the first twenty lines; '' for none."""
    numeric = F.nullif(F.regexp_extract(c, r"(?iuU)ngày\s+(\d{1,2}[/\-.]\d{1,2}[/\-.]\d{4})", 1), F.lit(""))
    worded = r"(?U)[Nn]gày\s+(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})"
    spelt = F.when(F.regexp_extract(c, worded, 1) != "", F.concat_ws("/", *[F.regexp_extract(c, worded, i) for i in (1, 2, 3)]))
    head = F.array_join(F.slice(F.split(c, "\n"), 1, 20), "\n")
    return F.coalesce(numeric, spelt, F.regexp_extract(head, r"(\d{1,2}/\d{1,2}/\d{4})", 1), F.lit(""))
