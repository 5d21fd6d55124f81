"""Checksums of serial frames, as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed values of the checksum: start and reversed polynomial.
START, POLYNOMIAL = 0xFFFF, 0xA001


def word_bytes(*words: Column) -> Column:
    """High and low byte of each 16-bit word, in order."""
    low = lambda w: w.bitwiseAND(F.lit(255)).cast("int")
    return F.array(*[b for w in words for b in (low(F.shiftright(w, 8)), low(w))])


def hex_bytes(text: Column) -> Column:
    """Bytes of an even number of hexadecimal digits; null for other texts."""
    pairs = F.regexp_extract_all(text, F.lit("([0-9A-Fa-f]{2})"), 1)
    return F.when(text.rlike("^([0-9A-Fa-f]{2})+$"), F.transform(pairs, lambda p: F.conv(p, 16, 10).cast("int")))


def crc16(data: Column) -> Column:
    """Checksum of an array of bytes, eight shifts a byte."""

    def shift(crc: Column, _: Column) -> Column:
        half = F.shiftright(crc, 1)
        return F.when(crc.bitwiseAND(F.lit(1)) == 1, half.bitwiseXOR(F.lit(POLYNOMIAL))).otherwise(half)

    turns = F.sequence(F.lit(1), F.lit(8))
    return F.aggregate(data, F.lit(START), lambda crc, b: F.aggregate(turns, crc.bitwiseXOR(b), shift))


def response_words(pdu: Column) -> Column:
    """Words of a reading reply in hexadecimal: a function code, the number of bytes, then the bytes.

    Null where the code is an error's or the bytes are not as many as are told.
    """
    data = hex_bytes(pdu)
    told = F.get(data, 1)
    sound = (F.get(data, 0) < 128) & (told % 2 == 0) & (F.size(data) == told + 2)
    pairs = F.sequence(F.lit(0), F.shiftright(told, 1) - 1)
    word = lambda n: F.get(data, 2 + 2 * n) * 256 + F.get(data, 3 + 2 * n)
    return F.when(sound & (told > 0), F.transform(pairs, word)).when(sound, F.array().cast("array<int>"))
