"""Decoders of 16-bit register words, as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def signed16(w: Column) -> Column:
    return w - F.when(w >= 32768, 65536).otherwise(0)


def unsigned32(high: Column, low: Column) -> Column:
    return high * 65536 + low


def signed32(high: Column, low: Column) -> Column:
    return signed16(high) * 65536 + low


def fixed_point(high: Column, low: Column) -> Column:
    return high + low / 65536.0


def nibble(w: Column, n: int) -> Column:
    return F.shiftright(w, 4 * n).bitwiseAND(F.lit(15))


def packed_decimal(w: Column) -> Column:
    """Four decimal digits; a word with another nibble stands for itself."""
    digits = [nibble(w, n) for n in range(4)]
    valid = F.lit(True)
    for d in digits:
        valid = valid & (d <= 9)
    return F.when(valid, sum((d * 10**n for n, d in enumerate(digits)), F.lit(0))).otherwise(w)


def _float(sign: Column, exponent: Column, mantissa: Column, bits: int, bias: int) -> Column:
    unit = float(2**bits)
    top = 2 * bias + 1
    size = (
        F.when(exponent == 0, mantissa / unit * F.pow(F.lit(2.0), F.lit(1.0 - bias)))
        .when((exponent == top) & (mantissa == 0), F.lit(float("inf")))
        .when(exponent == top, F.lit(None).cast("double"))
        .otherwise((1 + mantissa / unit) * F.pow(F.lit(2.0), exponent - float(bias)))
    )
    return F.when(sign == 1, -size).otherwise(size)


def binary16(w: Column) -> Column:
    """IEEE half precision; not-a-number becomes null."""
    return _float(F.shiftright(w, 15), F.shiftright(w, 10).bitwiseAND(F.lit(31)), w.bitwiseAND(F.lit(1023)), 10, 15)


def binary32(high: Column, low: Column) -> Column:
    """IEEE single precision from two words; not-a-number becomes null."""
    exponent = F.shiftright(high, 7).bitwiseAND(F.lit(255))
    mantissa = high.bitwiseAND(F.lit(127)) * 65536 + low
    return _float(F.shiftright(high, 15), exponent, mantissa, 23, 127)


def version_pair(w: Column) -> Column:
    return F.concat(F.shiftright(w, 8).bitwiseAND(F.lit(255)).cast("string"), F.lit("."), w.bitwiseAND(F.lit(255)).cast("string"))


def flags(w: Column, names: dict[int, str]) -> Column:
    """Names of the bits that are set, by bit; NONE without any."""
    parts = [F.when(F.shiftright(w, b).bitwiseAND(F.lit(1)) == 1, F.lit(n)) for b, n in sorted(names.items())]
    joined = F.concat_ws(", ", *parts)
    return F.when(joined == "", F.lit("NONE")).otherwise(joined)


def enumerated(w: Column, names: dict[int, str]) -> Column:
    known = F.create_map(*[x for k, v in names.items() for x in (F.lit(k).cast("long"), F.lit(v))])
    return F.coalesce(F.try_element_at(known, w), F.concat(F.lit("UNKNOWN_"), w.cast("string")))
