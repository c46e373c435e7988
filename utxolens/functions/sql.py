"""SQL surface: ``register_functions(spark)`` makes the column functions
callable from ``spark.sql``.

Template matching, hashes and time formats are temporary SQL functions
(pure expressions, inlined by the analyzer, so they stay native and
codegen'd); the script parser, Base58 and RIPEMD-160 are the registered
Arrow UDFs.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import encoding, scripts, validate
from .address import P2PKH_RE, P2SH_RE
from .timefmt import BLOCK_TIME_FORMAT, ISO_FORMAT

_H = "lower(hex(s))"
_SMALL = "(cast(conv({}, 16, 10) as int) - 80)"
_M, _N = _SMALL.format(f"substr({_H}, 1, 2)"), _SMALL.format(f"substr({_H}, -4, 2)")
# a script that is one direct push: its first byte is the length of the rest
_ONE_PUSH = (f"(octet_length(s) BETWEEN 2 AND 76 AND "
             f"cast(conv(substr({_H}, 1, 2), 16, 10) as int) = octet_length(s) - 1)")


def _push_length(at: int, width: int) -> str:
    return f"cast(conv(reverse_hex(substr({_H}, {2 * at + 1}, {2 * width})), 16, 10) as bigint)"


# a push of two bytes or more and CHECKSIG: opcode, bytes of the length, bytes beside the data
_KEY_CHECKSIG = f"({_H} LIKE '%ac' AND (" + " OR ".join(
    [f"(octet_length(s) BETWEEN 4 AND 77 AND cast(conv(substr({_H}, 1, 2), 16, 10) as int) = octet_length(s) - 2)"]
    + [f"({_H} LIKE '{code}%' AND octet_length(s) >= {width + 2} AND {_push_length(1, width)} >= 2 "
       f"AND {_push_length(1, width)} = octet_length(s) - {width + 2})"
       for code, width in (("4c", 1), ("4d", 2), ("4e", 4))]) + "))"
# structures that the hex text decides, NULL for other scripts
_TEMPLATE = f"""CASE WHEN s IS NULL THEN 'ERROR' WHEN {_H} = '' THEN ''
    WHEN {_H} LIKE '6a%' THEN 'RETURN'
    WHEN {_H} RLIKE '{P2PKH_RE}' THEN '{scripts._P2PKH_STRUCT}'
    WHEN {_H} RLIKE '{P2SH_RE}' THEN '{scripts._P2SH_STRUCT}'
    WHEN {_H} RLIKE '{scripts._P2PK_RE}' THEN '{scripts._P2PK_STRUCT}'
    WHEN {_H} RLIKE '{scripts._WITNESS_V0_RE}' OR {_H} = '00' OR {_ONE_PUSH} THEN ''
    WHEN {_H} RLIKE '{scripts._WITNESS_V1_RE}' THEN '1'
    WHEN {_H} RLIKE '{scripts._MULTISIG_RE}' THEN
        CASE WHEN {_M} = {_N} THEN concat({_M}, '[2] CHECKMULTISIG')
             ELSE concat({_M}, '[1] ', {_N}, '[1] CHECKMULTISIG') END END"""

_NATIVE = [
    ("script_hash160", "s BINARY", "STRING",
     f"coalesce(nullif(regexp_extract(lower(hex(s)), '{P2PKH_RE}', 1), ''), "
     f"nullif(regexp_extract(lower(hex(s)), '{P2SH_RE}', 1), ''))"),
    ("script_address_version", "s BINARY", "STRING",
     f"CASE WHEN lower(hex(s)) RLIKE '{P2PKH_RE}' OR lower(hex(s)) RLIKE '{P2SH_RE}' "
     f"THEN '00' END"),
    ("double_sha256_hex", "b BINARY", "STRING", "sha2(unhex(sha2(b, 256)), 256)"),
    ("reverse_hex", "h STRING", "STRING", "array_join(reverse(regexp_extract_all(h, '(..)', 1)), '')"),
    ("block_time_text", "t BIGINT", "STRING",
     f"date_format(timestampadd(SECOND, t, TIMESTAMP_NTZ'1970-01-01 00:00:00'), "
     f"'{BLOCK_TIME_FORMAT}')"),
    ("block_iso_time", "t BIGINT", "STRING",
     f"date_format(timestampadd(SECOND, t, TIMESTAMP_NTZ'1970-01-01 00:00:00'), "
     f"\"{ISO_FORMAT}\")"),
    ("script_type", "s BINARY", "STRING",
     f"CASE WHEN {_H} RLIKE '{P2PKH_RE}' THEN 'P2PKH' WHEN {_KEY_CHECKSIG} THEN 'PUB_KEY' "
     f"WHEN {_H} RLIKE '{P2SH_RE}' THEN 'P2SH' ELSE 'NO_TYPE' END"),
    ("script_template", "s BINARY", "STRING", _TEMPLATE),
    # parsed only where no template decides
    ("script_structure", "s BINARY", "STRING", "coalesce(script_template(s), "
     "script_structure_parse(CASE WHEN script_template(s) IS NULL THEN s END))"),
    ("script_is_multisig", "s BINARY", "BOOLEAN", "script_flags(s).is_multisig"),
    ("script_is_cltv", "s BINARY", "BOOLEAN", "script_flags(s).is_cltv"),
    ("script_is_op_return", "s BINARY", "BOOLEAN", "script_flags(s).is_op_return"),
    ("script_pubkey", "s BINARY", "STRING", "get(script_pubkeys(s), 0)"),
    ("cltv_sender", "s BINARY", "STRING", "script_cltv(s).sender_hex"),
    ("cltv_recipient", "s BINARY", "STRING", "script_cltv(s).recipient_hex"),
    ("cltv_expiry", "s BINARY", "BIGINT", "script_cltv(s).expiry"),
]


def register_functions(spark: SparkSession) -> list[str]:
    """Register all functions for SQL; returns their names."""
    from ..session import ship_package

    ship_package(spark)
    udfs = {
        "base58_hex": encoding._base58_udf,
        "script_structure_parse": scripts._structure_udf,
        "script_asm": scripts._asm_udf,
        "script_sigops": scripts._sigops_udf,
        "script_p2sh_sigops": scripts._p2sh_sigops_udf,
        "script_parse": scripts._parse_udf,
        "script_flags": scripts._flags_udf,
        "script_pubkeys": scripts._pubkeys_udf,
        "script_nonminimal": scripts._nonminimal_udf,
        "script_cltv": scripts._cltv_udf,
        "ripemd160_hex": validate._ripemd160_hex_udf,
        "decode_address": validate._decode_udf,
    }
    for name, f in udfs.items():
        spark.udf.register(name, f)
    for name, args, ret, body in _NATIVE:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {ret} RETURN {body}")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION script_address(s BINARY) RETURNS STRING
                 RETURN base58_hex(concat(script_address_version(s), script_hash160(s),
                   substring(double_sha256_hex(unhex(concat(script_address_version(s),
                             script_hash160(s)))), 1, 8)))""")
    from .tablefuncs import register_table_functions

    return sorted(list(udfs) + [n for n, *_ in _NATIVE] + ["script_address"]
                  + register_table_functions(spark))
