"""Byte/hex/hash column functions, all built-in Spark expressions.

Hex strings are lower case. Nothing here leaves the JVM.
"""

from __future__ import annotations

import binascii

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The Base58 alphabet (digits, upper and lower case letters
# without 0, O, I and l), in digit order.
BASE58_ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"

_LIMB = 58 ** 5            # one limb holds five base-58 digits


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a one-element
    ``transform``). Filters pushed into scans or joins get no common
    subexpression elimination, so an expression that reads one derived
    value many times binds it here instead of recomputing it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hex_lower(c: Column) -> Column:
    """Binary → lower-case hex."""
    return F.lower(F.hex(c))


def reverse_bytes_hex(hex_col: Column) -> Column:
    """Reverse the byte order of a hex string (hash display order)."""
    return F.array_join(F.reverse(F.regexp_extract_all(hex_col, F.lit("(..)"), 1)), "")


def sha256_hex(c: Column) -> Column:
    """SHA-256 of a binary column, as lower-case hex."""
    return F.sha2(c, 256)


def double_sha256_hex(c: Column) -> Column:
    """SHA-256(SHA-256(x)) of a binary column, as lower-case hex."""
    return F.sha2(F.unhex(F.sha2(c, 256)), 256)


# --- vectorised Base58 (Arrow batches) --------------------------------------

_ALPHABET_BYTES = np.frombuffer(BASE58_ALPHABET.encode(), dtype=np.uint8)
_POW58 = np.array([58 ** k for k in range(4, -1, -1)], dtype=np.int64)


def _base58_rows(raw: np.ndarray) -> list[str]:
    """Base58 digits, without leading ones, of rows of equally many bytes.

    16-bit pieces are folded into limbs of base 58^5 by int64 arithmetic over
    all rows; limb * 2^16 + carry stays below 2^46. Limbs cover the bytes'
    digits (a byte is less than 1.37 of them)."""
    n, width = raw.shape
    if width % 2:
        raw = np.concatenate([np.zeros((n, 1), raw.dtype), raw], axis=1)
    pieces = (raw[:, 0::2].astype(np.int64) << 8) | raw[:, 1::2]
    limbs = np.zeros((n, width * 137 // 500 + 1), dtype=np.int64)
    for i in range(pieces.shape[1]):
        carry = pieces[:, i]
        for j in range(limbs.shape[1]):
            v = limbs[:, j] * 65536 + carry
            limbs[:, j] = v % _LIMB
            carry = v // _LIMB
    digits = (limbs[:, ::-1, None] // _POW58[None, None, :]) % 58
    text = np.ascontiguousarray(_ALPHABET_BYTES[digits.reshape(n, -1)])
    return [r.decode().lstrip("1") for r in text.view(f"S{text.shape[1]}").ravel()]


def _bytes_of_hex(h: str | None) -> bytes | None:
    """Bytes of a hex text; an odd digit in front is a byte of its own, as in
    ``unhex``. None for NULL and for texts with any other character."""
    if h is None or h != h:
        return None
    try:
        return binascii.unhexlify(h if len(h) % 2 == 0 else "0" + h)
    except ValueError:
        return None


def base58_encode_batch(hex_values: pd.Series) -> pd.Series:
    """Base58 text for a batch of hex byte strings of any length (NULL and
    texts that are not hex give NULL). Leading zero bytes become leading ones;
    rows whose other bytes are equally many are converted together."""
    out = np.full(len(hex_values), None, dtype=object)
    by_size: dict[int, list[tuple[int, int, bytes]]] = {}
    for i, h in enumerate(hex_values):
        whole = _bytes_of_hex(h)
        if whole is not None:
            rest = whole.lstrip(b"\x00")
            by_size.setdefault(len(rest), []).append((i, len(whole) - len(rest), rest))
    for size, rows in by_size.items():
        raw = np.frombuffer(b"".join(r for _, _, r in rows), np.uint8).reshape(len(rows), size)
        for (i, zeros, _), text in zip(rows, _base58_rows(raw) if size else [""] * len(rows)):
            out[i] = "1" * zeros + text
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.StringType())
def _base58_udf(s: pd.Series) -> pd.Series:
    return base58_encode_batch(s)


def base58_hex(hex_col: Column) -> Column:
    """Base58 text of a hex byte string column of any length; NULL and
    texts that are not hex give NULL."""
    return _base58_udf(hex_col)


def base58check_hex(version_hex: Column, payload_hex: Column) -> Column:
    """Base58Check text of ``version || payload`` (hex columns). The checksum
    (4 bytes of SHA-256d) is computed natively; only the radix change runs
    in the vectorised batch function."""
    body = F.concat(version_hex, payload_hex)
    checksum = F.substring(double_sha256_hex(F.unhex(body)), 1, 8)
    return base58_hex(F.concat(body, checksum))
