"""Record digests and their order-free combination."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tag and part markers of the digested record.
RECORD_TAG = "AF3_FASTA_RECORD_V1"
HEADER_MARK = "01"
SEQUENCE_MARK = "02"
LANES = 4

_MASK32 = 0xFFFFFFFF
_MASK16 = 0xFFFF


def _little_endian(size: Column) -> Column:
    text = F.lpad(F.hex(size.cast("bigint")), 16, "0")
    return F.unhex(F.concat(*[F.substring(text, i, 2) for i in range(15, 0, -2)]))


def record_digest(header: Column, sequence: Column) -> Column:
    """Hex SHA-256 of a tagged (header, sequence) record."""
    head, body = header.cast("binary"), sequence.cast("binary")
    return F.sha2(
        F.concat(
            F.lit(RECORD_TAG).cast("binary"),
            F.unhex(F.lit(HEADER_MARK)),
            head,
            F.unhex(F.lit(SEQUENCE_MARK)),
            body,
            _little_endian(F.octet_length(head)),
            _little_endian(F.octet_length(body)),
        ),
        256,
    )


def word(digest: str, index: int) -> Column:
    """The 32-bit little-endian word ``index`` of a hex digest column, as bigint."""
    pairs = ", ".join(f"substring({digest}, {8 * index + 1 + i}, 2)" for i in (6, 4, 2, 0))
    return F.expr(f"cast(conv(concat({pairs}), 16, 10) as bigint)")


def square_words(high: str, low: str) -> tuple[Column, Column]:
    """(high, low) 32-bit words of the square of ``high * 2^32 + low`` modulo 2^64.

    ``high`` and ``low`` name bigint columns below 2^32. With low = a * 2^16 + b,
    every product stays below 2^63.
    """
    a, b = f"shiftright({low}, 16)", f"({low} & {_MASK16}L)"
    cross = f"(2 * {a} * {b})"
    bottom = f"({b} * {b} + shiftleft({cross} & {_MASK16}L, 16))"
    product = f"(({high} & {_MASK16}L) * {low} + shiftleft((shiftright({high}, 16) * {b}) & {_MASK16}L, 16))"
    top = f"(shiftright({bottom}, 32) + shiftright({cross}, 16) + {a} * {a} + 2 * {product})"
    return F.expr(f"{top} & {_MASK32}L"), F.expr(f"{bottom} & {_MASK32}L")


def wrapped(high: str, low: str) -> Column:
    """``high * 2^32 + low`` modulo 2^64 of two non-negative SQL numbers, as decimal."""
    two32 = f"cast({1 << 32} as decimal(11,0))"
    top = f"cast(pmod(cast({high} as decimal(30,0)), {two32}) as decimal(11,0))"
    whole = f"cast({top} * {two32} as decimal(32,0)) + cast({low} as decimal(30,0))"
    return F.expr(f"cast(pmod({whole}, cast({1 << 64} as decimal(20,0))) as decimal(20,0))")
