"""Identifiers and digests, all from built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The URL namespace of name-based UUIDs.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """Name-based (version 5) UUID."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lit("89ab")
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"),
        variant.substr(F.pmod(nibble, F.lit(4)) + 1, F.lit(1)), F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12),
    )


def content_id(prefix: str, *parts: Column, width: int = 24) -> Column:
    """``prefix`` and the first digits of the SHA-256 of the NUL-joined parts."""
    joined = F.concat_ws("\x00", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, width))


def canonical_json(*columns: str) -> Column:
    """A record as compact JSON with sorted keys, nulls included."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def seal(*columns: str) -> Column:
    """The digest of a record without its own pin."""
    return F.sha2(canonical_json(*columns), 256)


def ordered_digest(digests: Column) -> Column:
    """SHA-256 of digests in order, each ended by a newline."""
    return F.sha2(F.concat(F.array_join(digests, "\n"), F.lit("\n")), 256)


def fnv1a64(text: Column) -> Column:
    """FNV-1a of the UTF-8 bytes as an unsigned decimal. The product is taken in two halves, as 64 bits overflow otherwise."""
    octets = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1))
    low, prime_low = 1 << 32, 0x1B3  # the prime is 2**40 + 0x1B3

    def step(acc: Column, octet: Column) -> Column:
        hi, lo = acc["hi"], acc["lo"].bitwiseXOR(F.conv(octet, 16, 10).cast("bigint"))
        product = lo * prime_low
        high = hi * prime_low + F.shiftleft(lo, 8) + F.shiftright(product, 32)
        return F.struct(high.bitwiseAND(F.lit(low - 1)).alias("hi"), product.bitwiseAND(F.lit(low - 1)).alias("lo"))

    start = F.struct(F.lit(0xCBF29CE4).cast("bigint").alias("hi"), F.lit(0x84222325).cast("bigint").alias("lo"))
    return F.aggregate(octets, start, step, lambda a: a["hi"].cast("decimal(20,0)") * F.lit(low).cast("decimal(11,0)") + a["lo"].cast("decimal(20,0)")).cast("decimal(20,0)")
