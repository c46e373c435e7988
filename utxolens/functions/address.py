"""Locking-script templates, addresses and script types as native columns.

All matching is done with regular expressions over the lower-case hex of
the script, anchored at both ends, so every pattern is byte aligned.

* P2PKH is ``DUP HASH160 <20 bytes> EQUALVERIFY CHECKSIG`` matched on the
  parsed form, so any of the four push encodings of the 20-byte hash counts.
* P2SH is the exact 23-byte template ``HASH160 0x14 <20 bytes> EQUAL``.
* PUB_KEY is ``<push of 2+ bytes> CHECKSIG``, any push encoding.

Addresses are Base58Check with version byte 0 for both P2PKH and P2SH,
as the reference does; ``p2sh_version`` can set the network's 5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .encoding import base58check_hex, hex_lower

# Fixed patterns (lower-case hex of the whole script).
P2PKH_RE = r"^76a9(?:14|4c14|4d1400|4e14000000)([0-9a-f]{40})88ac$"
P2SH_RE = r"^a914([0-9a-f]{40})87$"


def _push_then_checksig(h: Column) -> Column:
    """True when the script is one data push of >= 2 bytes followed by CHECKSIG."""
    n = F.length(h) / 2                      # script length in bytes
    b0 = F.conv(F.substring(h, 1, 2), 16, 10).cast("int")

    def le(pos: int, nbytes: int) -> Column:
        # little-endian unsigned integer of nbytes starting at byte pos (0-based)
        return F.conv(F.array_join(F.reverse(F.regexp_extract_all(
            F.substring(h, 2 * pos + 1, 2 * nbytes), F.lit("(..)"), 1)), ""), 16, 10).cast("bigint")

    ends_checksig = F.substring(h, -2, 2) == "ac"
    direct = (b0 >= 2) & (b0 <= 75) & (n == b0 + 2)
    pd1 = (b0 == 0x4C) & (n >= 3) & (le(1, 1) >= 2) & (n == le(1, 1) + 3)
    pd2 = (b0 == 0x4D) & (n >= 4) & (le(1, 2) >= 2) & (n == le(1, 2) + 4)
    pd4 = (b0 == 0x4E) & (n >= 6) & (le(1, 4) >= 2) & (n == le(1, 4) + 6)
    return ends_checksig & (direct | pd1 | pd2 | pd4)


def p2pkh_hash_hex(script: Column) -> Column:
    h = hex_lower(script)
    return F.nullif(F.regexp_extract(h, P2PKH_RE, 1), F.lit(""))


def p2sh_hash_hex(script: Column) -> Column:
    h = hex_lower(script)
    return F.nullif(F.regexp_extract(h, P2SH_RE, 1), F.lit(""))


def script_hash160_hex(script: Column) -> Column:
    """The 20-byte hash an address is made of (P2PKH first, then P2SH), or NULL."""
    return F.coalesce(p2pkh_hash_hex(script), p2sh_hash_hex(script))


def address_version_hex(script: Column, p2sh_version: int = 0) -> Column:
    """Version byte (hex) of the address of a script, or NULL if it has none."""
    return (F.when(p2pkh_hash_hex(script).isNotNull(), F.lit("00"))
            .when(p2sh_hash_hex(script).isNotNull(), F.lit(f"{p2sh_version:02x}")))


def hash160_to_address(hash_hex: Column, version_hex: Column | str = "00") -> Column:
    """Base58Check address text of a 20-byte hash given as hex (NULL stays NULL)."""
    v = F.lit(version_hex) if isinstance(version_hex, str) else version_hex
    return base58check_hex(v, hash_hex)


def address_col(script: Column, p2sh_version: int = 0) -> Column:
    """Locking script → address text, or NULL (raw keys, multisig, RETURN,
    malformed and NULL scripts have none)."""
    return hash160_to_address(script_hash160_hex(script), address_version_hex(script, p2sh_version))


def with_hash160_address(df: DataFrame, hash_col: str, out: str,
                         version_hex: Column | str = "00") -> DataFrame:
    """Add ``out`` = address of the hex hash in ``hash_col``."""
    return df.withColumn(out, hash160_to_address(F.col(hash_col), version_hex))


def with_address(df: DataFrame, script_col: str = "script", out: str = "address",
                 hash_out: str = "hash160", p2sh_version: int = 0) -> DataFrame:
    """Add ``hash_out`` (hex hash160 or NULL) and ``out`` (address text or NULL)."""
    s = F.col(script_col)
    df = df.withColumn(hash_out, script_hash160_hex(s))
    return df.withColumn(out, hash160_to_address(F.col(hash_out), address_version_hex(s, p2sh_version)))


def script_type(script: Column) -> Column:
    """P2PKH, PUB_KEY, P2SH or NO_TYPE, tested in that order."""
    h = hex_lower(script)
    return (F.when(h.rlike(P2PKH_RE), F.lit("P2PKH"))
            .when(_push_then_checksig(h), F.lit("PUB_KEY"))
            .when(h.rlike(P2SH_RE), F.lit("P2SH"))
            .otherwise(F.lit("NO_TYPE")))


def has_address(script: Column) -> Column:
    h = hex_lower(script)
    return h.rlike(P2PKH_RE) | h.rlike(P2SH_RE)
