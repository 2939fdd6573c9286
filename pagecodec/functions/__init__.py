"""Scalar functions as Catalyst expressions; Arrow functions only where Spark has no expression."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: code -> (name, width in bytes); strings have no fixed width
PTYPES = {1: ("int8", 1), 2: ("int16", 2), 3: ("int32", 4), 4: ("int64", 8), 5: ("uint8", 1), 6: ("uint16", 2), 7: ("uint32", 4), 8: ("uint64", 8), 9: ("float32", 4), 10: ("float64", 8), 11: ("string", 0)}
PTYPE_CODES = {name: code for code, (name, _) in PTYPES.items()}


def ptype_class(name: str) -> str:
    """signed, unsigned, float or string."""
    return "unsigned" if name.startswith("u") else "signed" if name.startswith("int") else name.rstrip("0123456789")


def ptype_of(kind: T.DataType) -> str:
    """The physical type that carries a Spark type; decimals, dates and timestamps are carried by integers."""
    found = {"tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "boolean": "uint8", "date": "int32", "timestamp": "int64", "timestamp_ntz": "int64", "float": "float32", "double": "float64", "string": "string", "binary": "string"}
    name = kind.simpleString()
    if isinstance(kind, T.DecimalType):
        if kind.precision > 18:
            raise ValueError(f"{name} doesn't fit 64 bits; split it into columns first")
        return "int64"
    if name not in found:
        raise ValueError(f"{name} has no physical type; split it into columns first")
    return found[name]


def physical(col: Column, kind: T.DataType) -> Column:
    """The carrier value: unscaled decimals, days, microseconds, 0/1."""
    if isinstance(kind, T.DecimalType):
        ptype_of(kind)
        return (col * F.lit(10**kind.scale)).cast("bigint")
    if isinstance(kind, T.DateType):
        return F.unix_date(col)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(col.cast("timestamp"))
    return col.cast("smallint") if isinstance(kind, T.BooleanType) else col


def bit_length(v: Column) -> Column:
    """Bits needed; 0 for 0, 64 for negative numbers."""
    return F.when(v == 0, F.lit(0)).otherwise(F.length(F.bin(v))).cast("int")


def packed_bytes(n: Column, bits: Column) -> Column:
    """Bytes of n values of so many bits."""
    return F.floor((n.cast("bigint") * bits.cast("bigint") + 7) / 8).cast("bigint")


_LOW = (1 << 32) - 1


def halves(v: Column) -> tuple[Column, Column]:
    """The signed upper and the unsigned lower 32 bits of a long."""
    return F.shiftright(v, 32), v.bitwiseAND(F.lit(_LOW))


def joined(hi: Column, lo: Column) -> Column:
    """The long of sums of halves; carries go up, and what goes beyond 64 bits is lost."""
    return F.shiftleft(hi + F.shiftright(lo, 32), 32).bitwiseOR(lo.bitwiseAND(F.lit(_LOW)))


def wrapping_add(a: Column, b: Column) -> Column:
    """a + b modulo 2^64, which no overflow check refuses."""
    (x, y), (u, v) = halves(a), halves(b)
    return joined(x + u, y + v)


def wrapping_subtract(a: Column, b: Column) -> Column:
    """a - b modulo 2^64."""
    (x, y), (u, v) = halves(a), halves(b)
    return joined(x - u, y - v)


def wrapping_scale(v: Column, by: Column) -> Column:
    """v * by modulo 2^64, for 0 <= by < 2^31."""
    hi, lo = halves(v)
    return joined(hi * by, lo * by)


def trailing_zeros(v: Column) -> Column:
    """Zero bits below the lowest set one; 64 for 0."""
    return F.bit_count(F.bitwise_not(v).bitwiseAND(wrapping_subtract(v, F.lit(1).cast("bigint"))))


#: Fixed values of the 64-bit finaliser: shift, multiplier.
MIX_STEPS = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB))
MIX_LAST = 31


@F.arrow_udf(T.LongType())
def mix64(v: pa.Array) -> pa.Array:
    """The splitmix64 finaliser of a long's bits (null stays null); Spark has no product modulo 2^64."""
    x = v.fill_null(0).to_numpy(zero_copy_only=False).astype("int64").view("uint64")
    for shift, by in MIX_STEPS:
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return pa.array((x ^ (x >> np.uint64(MIX_LAST))).view("int64"), mask=np.asarray(v.is_null()))


def zigzag(v: Column) -> Column:
    """Signed to unsigned, small magnitudes first."""
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(z: Column) -> Column:
    return F.shiftrightunsigned(z, 1).bitwiseXOR(-(z.bitwiseAND(F.lit(1).cast("bigint"))))


@F.arrow_udf(T.LongType())
def float_bits(v: pa.Array) -> pa.Array:
    """IEEE-754 bits of doubles (null stays null); Spark has no expression for it."""
    bits = v.fill_null(0.0).to_numpy(zero_copy_only=False).astype("float64").view("int64")
    return pa.array(bits, mask=np.asarray(v.is_null()))


@F.arrow_udf(T.DoubleType())
def bits_float(b: pa.Array) -> pa.Array:
    """The double of IEEE-754 bits."""
    return pa.array(b.fill_null(0).to_numpy(zero_copy_only=False).astype("int64").view("float64"), mask=np.asarray(b.is_null()))
