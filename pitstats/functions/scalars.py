"""Scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters and what they become; fixed by the name rule.
ACCENTS, PLAIN = "áàâäãåéèêëíìîïóòôöõúùûüñçý", "aaaaaaeeeeiiiiooooouuuuncy"


def name_normalise(name: Column) -> Column:
    """Lower case without accents, punctuation, generational suffixes and repeated blanks."""
    plain = F.translate(F.lower(name), ACCENTS, PLAIN)
    words = F.regexp_replace(plain, r"[^a-z0-9 ]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(words, r"( jr| sr| ii| iii| iv| v)+$", ""), r" +", " "))


def lookup(key: Column, mapping: dict, default=None) -> Column:
    """Map lookup; unknown keys give the default (null)."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def local_to_utc(wall: Column, zone: str = "America/New_York") -> Column:
    return F.to_utc_timestamp(wall, zone)


def slate(instant: Column, zone: str = "America/New_York") -> Column:
    """Class of the local weekday and hour: Thu, Sun early, Sun late, Mon, other."""
    local = F.from_utc_timestamp(instant, zone)
    day, hour = F.dayofweek(local), F.hour(local)
    return (
        F.when(day == 5, "Thu").when((day == 1) & (hour < 15), "Sun early").when(day == 1, "Sun late").when(day == 2, "Mon")
        .otherwise("other")
    )


def season_of(day: Column, last_month: int = 2) -> Column:
    """The season a day belongs to: months up to `last_month` belong to the year before."""
    return (F.year(day) - (F.month(day) <= last_month).cast("int")).cast("long")


def parse_stamp(text: Column) -> Column:
    """UTC stamps: compact (yyyyMMdd'T'HHmmss'Z') or ISO with an offset; null where neither fits."""
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmss'Z'")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))
    )


def band(x: Column, edges: list[float]) -> Column:
    """1 plus the number of edges at or below x (left-closed bands); null for null."""
    return F.when(x.isNotNull(), F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= x)).cast("long") + 1)


def cut(x: Column, edges: list[float], labels: list[str]) -> Column:
    """Right-closed bins (edges[i], edges[i+1]]; null outside."""
    out = None
    for low, high, label in zip(edges, edges[1:], labels):
        hit = (x > low) & (x <= high)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def tiers(x: Column, upper: list[float], prefix: str) -> list[Column]:
    """One-hot tiers with inclusive upper bounds; the first is open below, the last above."""
    bounds = [None, *upper, None]
    out = []
    for i, (low, high) in enumerate(zip(bounds, bounds[1:])):
        hit = F.lit(True)
        if low is not None:
            hit = hit & (x > low)
        if high is not None:
            hit = hit & (x <= high)
        out.append(F.coalesce(hit.cast("long"), F.lit(0)).alias(f"{prefix}{i + 1}"))
    return out


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den where den is positive, else null."""
    return F.when(den > 0, num / den)


def shrunk_rate(num: Column, den: Column, prior, k: float) -> Column:
    return (num + k * prior) / (den + k)


def quantile_interp(q: Column, u: Column) -> Column:
    """Value at u of a quantile array on the grid i/(n+1), linear inside and held at both ends."""
    n = F.size(q)
    at = F.greatest(F.lit(1.0), F.least(n.cast("double"), u * (n + 1)))
    low = F.floor(at).cast("int")
    high = F.least(low + 1, n)
    return F.element_at(q, low) + (at - low) * (F.element_at(q, high) - F.element_at(q, low))


def id_hash(text: Column, modulus: int = 2147483647) -> Column:
    """31-polynomial hash of the character codes."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: (a * 31 + c) % modulus)


def portable_uniform(*keys) -> Column:
    """A uniform number in [0, 1) from the md5 of the keys: the same in any engine and partitioning."""
    text = F.concat_ws("|", *(k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(1 << 48)
