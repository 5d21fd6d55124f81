"""Decoding register fields by the decoder that a catalog names, as columns.

A field is an array of 16-bit words; context is a map from address to word, of the same device
and poll.  Decoders with an argument are written ``name:argument``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gridlore.functions import words as w

#: Addresses of the context words, and what they say.
VOLTS, AMPS, FIRMWARE, OUTPUT_VOLTS = (0, 1), (2, 3), 4, 13
#: Firmware from which halves are floats, word of a missing sensor, full scales of a current.
FLOAT_FIRMWARE, NO_SENSOR = 19, 0x80
HIGH_LINE, HIGH_LINE_SCALE, LOW_LINE_SCALE = 180, 6.4, 17.0

NUL, FILL = "\\x00", "\ue000"


def little_words(fields: Column) -> Column:
    """Words, lowest first, as one integer; seven words at most."""
    turned = F.reverse(F.transform(fields, lambda x: x.bitwiseAND(F.lit(65535)).cast("decimal(38,0)")))
    return F.aggregate(turned, F.lit(0).cast("decimal(38,0)"), lambda sum_, x: (sum_ * 65536 + x).cast("decimal(38,0)"))


def ascii_text(fields: Column, high_first: bool) -> Column:
    """Two characters a word; zeros, ones bytes and spaces at the end are no text, other bytes beyond ASCII are U+FFFD."""
    low = lambda x: x.bitwiseAND(F.lit(255))
    high = lambda x: low(F.shiftright(x, 8))
    pair = (lambda x: F.array(high(x), low(x))) if high_first else (lambda x: F.array(low(x), high(x)))
    char = lambda b: F.when(b == 255, FILL).when(b > 127, "\ufffd").otherwise(F.char(b.cast("long")))
    text = F.array_join(F.transform(F.flatten(F.transform(fields, pair)), char), "")
    cut = F.regexp_replace(text, f"[{NUL}{FILL} ]+$", "")
    return F.regexp_replace(F.regexp_replace(cut, FILL, "\ufffd"), r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def bus_address(word: Column) -> Column:
    """(bus, address) packed into one word, the bus in the high byte."""
    return F.struct(
        F.shiftright(word, 8).bitwiseAND(F.lit(255)).alias("bus"), word.bitwiseAND(F.lit(255)).alias("address")
    )


def wire_seconds(request_bytes: Column, response_bytes: Column, baud: Column, bits: Column) -> Column:
    """Time that a request and its response take on a serial line, with ``bits`` a byte."""
    return F.try_divide((request_bytes + response_bytes) * bits.cast("double"), baud)


def decode(decoder: Column, fields: Column, context: Column) -> Column:
    """(number, text): one is set, or neither where the decoder is unknown or words are missing."""
    base, size = F.element_at(F.split(decoder, ":"), 1), F.size(fields)
    factor = F.try_element_at(F.split(decoder, ":"), F.lit(2)).try_cast("double")
    word = lambda n: F.get(fields, n).bitwiseAND(F.lit(65535)).cast("long")
    at = lambda address: F.coalesce(F.try_element_at(context, F.lit(address)), F.lit(0)).cast("long")
    raw, signed = word(0), w.signed16(word(0))
    volts, amps = (w.fixed_point(at(a), at(b)) for a, b in (VOLTS, AMPS))
    two = lambda value: F.when(size == 2, value)
    by_volts, by_amps = signed * volts / 32768.0, signed * amps / 32768.0
    floats = w.packed_decimal(at(FIRMWARE)) >= FLOAT_FIRMWARE
    scale = F.when(at(OUTPUT_VOLTS) >= HIGH_LINE, HIGH_LINE_SCALE).otherwise(LOW_LINE_SCALE)
    numbers = {
        "raw": raw,
        "s16": signed,
        "f16": w.binary16(raw),
        "f32": two(w.binary32(word(0), word(1))),
        "bcd": w.packed_decimal(raw),
        "u32": two(w.unsigned32(word(0), word(1))),
        "s32": two(w.signed32(word(0), word(1))),
        "u32_factor": two(w.unsigned32(word(0), word(1)) * factor),
        "s32_factor": two(w.signed32(word(0), word(1)) * factor),
        "bitfield_words": little_words(fields),
        "f16_percent": w.binary16(raw) * 100.0,
        "factor": signed * factor,
        "ufactor": raw * factor,
        "divide": F.try_divide(signed, factor),
        "udivide": F.try_divide(raw, factor),
        "percent": F.try_divide(raw * 100.0, factor),
        "tristar_voltage": by_volts,
        "tristar_current": by_amps,
        "tristar_power": raw * volts * amps / 131072.0,
        "tristar_rts_temp": F.when(raw != NO_SENSOR, signed),
        "ts600_voltage": F.when(floats, w.binary16(raw)).otherwise(by_volts),
        "ts600_current": F.when(floats, w.binary16(raw)).otherwise(by_amps),
        "suresine_classic_current": signed * scale / 32768.0,
    }
    texts = {
        "byte_pair_version": w.version_pair(raw),
        "ascii_lo_hi": ascii_text(fields, False),
        "ascii_hi_lo": ascii_text(fields, True),
        "tristar_rts_temp": F.when(raw == NO_SENSOR, "DISCONNECTED"),
    }
    number, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    number = F.when(base.startswith("ts600_"), F.when(floats, w.binary16(raw)).otherwise(raw)).otherwise(number)
    for name, value in numbers.items():
        number = F.when(base == name, value.cast("double")).otherwise(number)
    for name, value in texts.items():
        text = F.when(base == name, value).otherwise(text)
    filled = size > 0
    return F.struct(F.when(filled, number).alias("number"), F.when(filled, text).alias("text"))
