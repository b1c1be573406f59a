"""Column functions over quality strings (Phred + 33)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = 33
ALPHABET = 72  # symbols a trained quantiser knows

#: The eight levels of the public Illumina binning and the lowest Phred value of each.
ILLUMINA_FROM, ILLUMINA_LEVEL = (0, 2, 10, 20, 25, 30, 35, 40), (0, 6, 15, 22, 27, 33, 37, 40)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def recode(c: Column | str, to) -> Column:
    """Replace every quality symbol by ``to`` of its Phred value; one pass over the string."""
    codes = range(0, 95)
    return F.translate(_col(c), "".join(chr(q + ZERO) for q in codes), "".join(chr(to(q) + ZERO) for q in codes))


def illumina_level(q: int) -> int:
    return max(level for low, level in zip(ILLUMINA_FROM, ILLUMINA_LEVEL) if q >= low)


def illumina_bin(c: Column | str) -> Column:
    return recode(c, illumina_level)


def threshold(c: Column | str, at: int, high: int, low: int) -> Column:
    """``high`` where the Phred value is at least ``at``, else ``low``; needs low <= at <= high."""
    if not low <= at <= high:
        raise ValueError("binary quality needs low <= threshold <= high")
    return recode(c, lambda q: high if q >= at else low)


def phred(c: Column | str) -> Column:
    """Phred values as an array."""
    return F.transform(F.filter(F.split(_col(c), ""), lambda x: x != ""), lambda x: F.ascii(x) - ZERO)


def error_probability(q: Column) -> Column:
    return F.pow(F.lit(10.0), -q / 10.0)


def pack4(c: Column | str) -> Column:
    """Strings of the four symbols F : , # as hexadecimal, four symbols a byte, and the tail of up to three symbols.

    The length of a string is a multiple of four after the tail is cut; other symbols make the result null.
    """
    c = _col(c)
    n = F.length(c) - F.length(c) % 4
    body, tail = F.substr(c, F.lit(1), n), F.substr(c, n + 1, F.lit(3))
    digit = F.translate(body, "F:,#", "0123")
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(n / 2 - 1, F.lit(0)).cast("int")), lambda i: F.conv(F.substr(digit, i * 2 + 1, F.lit(2)), 4, 16))
    packed = F.when(n > 0, F.array_join(pairs, "")).otherwise(F.lit(""))
    return F.when(F.regexp_like(c, F.lit("^[F:,#]*$")), F.struct(packed.alias("packed"), tail.alias("tail")))


def unpack4(packed: Column | str, tail: Column | str) -> Column:
    """The string that ``pack4`` took."""
    packed = _col(packed)
    out = F.aggregate(F.filter(F.split(packed, ""), lambda x: x != ""), F.lit(""), lambda a, x: F.concat(a, F.lpad(F.conv(x, 16, 4), 2, "0")))
    return F.concat(F.translate(out, "0123", "F:,#"), _col(tail))
