"""Column expressions of the signal model: windows, bands, decibels, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def window_count(n: Column | str, window: int, stride: int) -> Column:
    """Whole windows that fit into ``n`` samples; no padding."""
    n = _c(n)
    return F.when(n < window, F.lit(0)).otherwise(F.floor((n - window) / stride) + 1).cast("long")


def centre(start: Column | str, window: int) -> Column:
    return _c(start) + window // 2


def overlap_fraction(window: int, stride: int) -> Column:
    return F.lit(0.0) if window == 0 else F.greatest(F.lit(0.0), F.lit(1 - stride / window))


def carrier_offset(lower: Column | str, upper: Column | str, center: Column | str) -> Column:
    """Middle of a band from the centre frequency; null where any of them is."""
    return (_c(lower) + _c(upper)) / 2 - _c(center)


def power_db(power: Column | str, floor: float = 1e-30) -> Column:
    return 10 * F.log10(_c(power) + floor)


def amplitude_db(amplitude: Column | str, floor: float = 1e-12) -> Column:
    return 20 * F.log10(_c(amplitude) + floor)


def pool_bucket(row: Column | str, n: Column | int, m: int) -> Column:
    """Bucket of a row when ``n`` rows are pooled into ``m``: bucket b begins at floor(b n / m)."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.floor(((_c(row) + 1) * m - 1) / n).cast("long")


def seeded_order(seed: int, *parts: Column | str) -> Column:
    """A key that orders rows the same way for one seed, whatever their input order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[_c(p).cast("string") for p in parts]))


def half_even(x: Column, scale: int = 0) -> Column:
    return F.bround(x, scale)


def dirname_at(path: Column | str, level: int) -> Column:
    """Name of the directory ``level`` above the file; null above the root."""
    if level < 1:
        raise ValueError("level counts from 1")
    parts = F.split(_c(path), "/")
    return F.when(F.size(parts) > level, F.element_at(parts, -(level + 1)))


UNGROUPED = "(ungrouped) "
MIXED = "(mixed)"


def group_by_pattern(record_id: Column | str, pattern: str, groups: int) -> Column:
    """Unit of a record: the pattern's groups joined by a bar, or the whole match; no match is a unit of its own."""
    r = _c(record_id)
    found = F.concat_ws("|", *[F.regexp_extract(r, pattern, i + 1) for i in range(groups)]) if groups else F.regexp_extract(r, pattern, 0)
    return F.when(r.rlike(pattern), found).otherwise(F.concat(F.lit(UNGROUPED), r))


def group_by_collection(record_id: Column | str, collection: Column | str) -> Column:
    c = F.trim(_c(collection))
    return F.when(F.length(c) > 0, c).otherwise(F.concat(F.lit(UNGROUPED), _c(record_id)))


def number_key(x: Column | str) -> Column:
    """Text of a number to 12 significant digits without trailing zeros, so that equal settings get one key."""
    v = _c(x).cast("double")
    magnitude = F.floor(F.log10(F.abs(v)))
    rounded = F.format_string("%.11e", v)
    mantissa = F.regexp_replace(F.regexp_extract(rounded, r"^(-?\d\.\d+)e", 1), r"\.?0+$", "")
    scientific = F.concat(mantissa, F.lit("e"), F.regexp_extract(rounded, r"e([+-]\d+)$", 1))
    return (
        F.when(v.isNull(), "(none)")
        .when(v == 0, "0")
        .when((v == F.floor(v)) & (F.abs(v) < 1e12), v.cast("long").cast("string"))
        .when(magnitude.between(-4, 11), _significant(v, 4))
        .otherwise(scientific)
    )


def _significant(v: Column, extra: int) -> Column:
    magnitude = F.floor(F.log10(F.abs(v))).cast("int")
    out = None
    for m in range(-extra, 12):
        text = F.format_string(f"%.{max(0, 11 - m)}f", v)
        text = F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)
        out = F.when(magnitude == m, text) if out is None else out.when(magnitude == m, text)
    return out
