"""Column functions: null-safe arithmetic, dates, text, and a few scalar helpers for the driver.

A missing value is NULL everywhere; NaN and infinities become NULL at the boundary.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS_A_YEAR = 365.25


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """NULL for NaN and the infinities."""
    c = _col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def safe_div(num: Column | str, den: Column | str) -> Column:
    """num / den; NULL if either is missing, the denominator is 0 or the result is not finite."""
    return finite(F.try_divide(_col(num).cast("double"), _col(den).cast("double")))


def positive_ratio(num: Column | str, den: Column | str) -> Column:
    """num / den where the denominator is above 0, else NULL."""
    return F.when(_col(den) > 0, safe_div(num, den))


def clamp(c: Column | str, lo: float, hi: float) -> Column:
    """Clip to [lo, hi]; NULL stays NULL."""
    c = _col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi))))


def or_zero(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit(0.0))


def sum_of_present(*cols: Column | str) -> Column:
    """Sum of the values that are there; NULL only if none is."""
    cols = [_col(c) for c in cols]
    total = sum((or_zero(c) for c in cols[1:]), or_zero(cols[0]))
    return F.when(F.coalesce(*cols).isNotNull(), total)


def iso_date(c: Column | str) -> Column:
    """The date in the first ten characters of an ISO text; NULL if there is none."""
    return F.try_to_timestamp(F.substring(_col(c), 1, 10), F.lit("yyyy-MM-dd")).cast("date")


def month_key(c: Column | str) -> Column:
    return F.date_format(_col(c), "yyyy-MM")


def month_end_back(c: Column | str, months: int) -> Column:
    """The last day of the month ``months`` before."""
    return F.last_day(F.add_months(_col(c), -months))


def prior_month_end(c: Column | str) -> Column:
    return month_end_back(c, 1)


def shift_months(c: Column | str, months: int) -> Column:
    """The same day ``months`` later, clamped to the end of a shorter month."""
    return F.add_months(_col(c), months)


def years_between(later: Column | str, earlier: Column | str) -> Column:
    return F.datediff(_col(later), _col(earlier)) / F.lit(DAYS_A_YEAR)


def padded_id(c: Column | str, width: int = 10) -> Column:
    return F.lpad(_col(c).cast("string"), width, "0")


def money(c: Column | str) -> Column:
    """A number from text such as ``$1,234.50``; NULL for what is none."""
    return finite(F.regexp_replace(F.trim(_col(c)), r"[$,%\s]", "").try_cast("double"))


def contains_text(c: Column | str, query: str) -> Column:
    """Case-insensitive substring; no wildcards."""
    return F.contains(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit(query.strip().lower()))


def whole_word(c: Column | str, *words: str) -> Column:
    """Whether one of the words occurs whole, in any case; plurals are other words."""
    return F.coalesce(_col(c), F.lit("")).rlike(r"(?i)\b(" + "|".join(words) + r")\b")


#: What a missing value shows as, month names, and short forms of sectors.
DASH = "\u2014"
MONTH_NAMES = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
SHORT_SECTORS = {
    "Consumer Discretionary": "Cons. Disc.",
    "Consumer Staples": "Cons. Staples",
    "Basic Materials": "Materials",
    "Telecommunications": "Telecom",
    "Health Care": "Health Care",
    "Miscellaneous": "Misc.",
    "Real Estate": "Real Estate",
}


def display_name(c: Column | str) -> Column:
    """A company's name without the kind of security; a share class is kept as its letter."""
    bare = F.regexp_replace(F.regexp_replace(_col(c), r"(?i)\s+Common Stock.*$", ""), r"(?i)\s+Ordinary Shares.*$", "")
    return F.trim(F.regexp_replace(bare, r"(?i)\s+Class ([A-Z])\s*$", " ($1)"))


def short_sector(c: Column | str) -> Column:
    c = _col(c)
    named = F.coalesce(*(F.when(c == k, v) for k, v in SHORT_SECTORS.items()), c)
    return F.when(c.isNull() | (c == ""), DASH).otherwise(named)


def _shown(c: Column, text: Column) -> Column:
    """A dash for what is missing or no number."""
    return F.when(finite(c).isNull(), DASH).otherwise(text)


def money_text(c: Column | str, digits: int = 2) -> Column:
    c = _col(c)
    return _shown(c, F.concat(F.lit("$"), F.format_number(c, digits)))


def cap_text(c: Column | str) -> Column:
    """Money in trillions, billions, millions or plain, with fewer digits the smaller the unit; trillions and billions are taken to six digits before."""
    c = _col(c)
    shown = lambda x, digits: F.round(F.round(x * 1e6) / 1e6, digits) if digits else x
    in_unit = lambda size, digits, unit: F.format_string(f"$%.{digits}f{unit}", shown(c / size, digits))
    return _shown(c, F.when(c >= 1e12, in_unit(1e12, 2, "T")).when(c >= 1e9, in_unit(1e9, 1, "B")).when(c >= 1e6, in_unit(1e6, 0, "M")).otherwise(in_unit(1, 0, "")))


def percent_text(c: Column | str, digits: int = 2) -> Column:
    """A change that is in percent already, with its sign."""
    c = _col(c)
    return _shown(c, F.concat(F.when(c >= 0, "+").otherwise(""), F.format_string(f"%.{digits}f%%", c)))


def metric_text(c: Column | str, unit: Column | str) -> Column:
    """A measure in its own unit: ``pct`` and ``pp`` are shares, ``x`` multiples; others have two digits."""
    c, unit = _col(c), _col(unit)
    points = F.concat(F.when(c >= 0, "+").otherwise(""), F.format_string("%.1fpp", c * 100))
    return _shown(c, F.when(unit == "pct", F.format_string("%.1f%%", c * 100)).when(unit == "pp", points).when(unit == "x", F.format_string("%.2fx", c)).otherwise(F.format_string("%.2f", c)))


def _month_name(c: Column) -> Column:
    return F.get(F.array(*map(F.lit, MONTH_NAMES)), F.month(c) - 1)


def month_label(c: Column | str) -> Column:
    """``Aug 2026`` of a month key."""
    day = F.to_date(F.concat(_col(c), F.lit("-01")))
    return F.concat_ws(" ", _month_name(day), F.date_format(day, "yyyy"))


def day_month(c: Column | str) -> Column:
    """``31 Aug``, or a dash."""
    c = _col(c)
    return F.when(c.isNull(), DASH).otherwise(F.concat_ws(" ", F.dayofmonth(c).cast("string"), _month_name(c)))


def full_date(c: Column | str) -> Column:
    """``31 Aug 2026``, or a dash."""
    c = _col(c)
    return F.when(c.isNull(), DASH).otherwise(F.concat_ws(" ", day_month(c), F.date_format(c, "yyyy")))


def share_link(ids: Column | str, days: Column | str) -> Column:
    """``ID:date,ID:date`` from parallel arrays."""
    pairs = F.zip_with(_col(ids), _col(days), lambda i, d: F.concat_ws(":", i, d.cast("string")))
    return F.array_join(pairs, ",")


def parse_share_link(c: Column | str, default_day: str) -> Column:
    """Entries (id, day) of a link: malformed ones go, of repeated ids the first stays, a missing day is the default."""
    entries = F.filter(F.transform(F.split(_col(c), ","), lambda x: F.upper(F.trim(x))), lambda x: x.rlike(r"^[A-Z][A-Z0-9.\-]{0,9}(:\d{4}-\d{2}-\d{2})?$"))
    parsed = F.transform(
        entries,
        lambda x, i: F.struct(
            F.substring_index(x, ":", 1).alias("id"), i.alias("at"), F.coalesce(F.try_element_at(F.split(x, ":"), F.lit(2)), F.lit(default_day)).alias("day")
        ),
    )
    # Equal ids stand side by side once sorted, so each is compared to one other; the array is a lambda's variable, which is made once.
    firsts = F.transform(F.array(F.array_sort(parsed)), lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["id"] != x["id"])))
    inorder = F.array_sort(F.transform(F.get(firsts, F.lit(0)), lambda x: F.struct(x["at"], x["id"], x["day"])))
    return F.transform(inorder, lambda x: F.struct(x["id"].alias("id"), x["day"].alias("day")))


def rebalance(weights: dict[str, float], key: str, value: float) -> dict[str, float]:
    """Set one weight and spread the rest equally, in hundredths; the result always sums to 100."""
    value = min(100.0, max(0.0, round(value, 2)))
    others = [k for k in weights if k != key]
    if not others:
        return {key: 100.0}
    whole, spare = divmod(round((100 - value) * 100), len(others))
    return {k: value if k == key else (whole + (others.index(k) < spare)) / 100 for k in weights}


def rebalanced(keys: list[str], key: Column | str, value: Column | str) -> Column:
    """``rebalance`` of equal weights as a column: a struct of ``keys``, the one named by ``key`` at ``value``."""
    given = F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), _col(value))), 2)
    spread, n = F.round((100 - given) * 100).cast("long"), len(keys) - 1
    mine = lambda k: _col(key) == k
    at = F.array_position(F.array(*map(F.lit, keys)), _col(key)) - 1
    place = lambda i: F.when(at < i, F.lit(i - 1)).otherwise(F.lit(i))  # noqa: E731  # among the others
    share = lambda i: (F.floor(spread / n) + (place(i) < F.pmod(spread, F.lit(n))).cast("long")) / 100
    return F.struct(*(F.when(mine(k), given).otherwise(share(i)).alias(k) for i, k in enumerate(keys)))


def parse_csv(text: str) -> list[list[str]]:
    """RFC 4180 rows of a small text: quotes, doubled quotes, CRLF."""
    rows, row = [], []
    for m in re.finditer(r'(?:"((?:[^"]|"")*)"|([^,\r\n]*))(,|\r?\n|$)', text):
        if m.end() == m.start() and not row:
            break
        row.append(m[1].replace('""', '"') if m[1] is not None else m[2])
        if m[3] != ",":
            rows.append(row)
            row = []
        if m.end() == len(text):
            break
    return rows


def quote_csv(rows: list[list[str]]) -> str:
    quoted = lambda x: '"' + x.replace('"', '""') + '"' if re.search(r'[",\r\n]', x) else x
    return "\r\n".join(",".join(map(quoted, r)) for r in rows)
