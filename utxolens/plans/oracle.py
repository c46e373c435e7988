"""DuckDB SQL that computes the same results as ``plans.queries``.

Only the raw test tables exist on the DuckDB side, so each statement
inlines the ledger views of ``FIXTURES.md`` as CTEs. Values that depend on
script parsing are written per fixture script class (column ``cls``):
outputs use ``l_suppkey % 8`` (``-1`` for the empty script of line 7),
inputs use 10 (redeem-script push) and 11 (empty script).
Base58 text is computed in SQL with the same limb arithmetic idea as the
Spark side (``list_reduce`` over 16-bit pieces); RIPEMD-160 of a 32-byte
digest is one ``list_reduce`` over the 80 steps.
"""

from __future__ import annotations

import math

B58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_LIMB = 58 ** 5

ELEMENTS = """
elements AS (
  SELECT 1 AS type,
         sha256(CAST(CAST(o_orderdate AS DATE) AS VARCHAR)) AS block_hash,
         CAST(l_orderkey % 1000 AS INTEGER) AS tx_idx,
         CAST(l_orderkey AS VARCHAR) AS tx_hash,
         CAST(l_linenumber AS BIGINT) AS idx,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS amount,
         CASE WHEN l_linenumber = 7 THEN -1 ELSE CAST(l_suppkey % 8 AS INTEGER) END AS cls,
         sha256(CAST(l_partkey AS VARCHAR)) AS ph,
         sha256(CAST(l_suppkey AS VARCHAR)) AS sh
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL
  SELECT 0, sha256(CAST(CAST(l_shipdate AS DATE) AS VARCHAR)), 0,
         CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS BIGINT), CAST(0 AS BIGINT),
         CASE WHEN l_suppkey % 8 = 2 THEN 10 ELSE 11 END,
         sha256(CAST(l_partkey AS VARCHAR)), sha256(CAST(l_suppkey AS VARCHAR))
  FROM lineitem WHERE l_returnflag = 'R'
)"""

SCRIPT_HEX = """CASE cls
    WHEN -1 THEN ''
    WHEN 0 THEN concat('76a914', substring(ph, 1, 40), '88ac')
    WHEN 1 THEN concat('76a94c14', substring(ph, 1, 40), '88ac')
    WHEN 2 THEN concat('a914', substring(ph, 1, 40), '87')
    WHEN 3 THEN concat('2102', ph, 'ac')
    WHEN 4 THEN '6a04deadbeef'
    WHEN 5 THEN concat('512102', ph, '2102', sh, '52ae')
    WHEN 6 THEN '76a94c'
    WHEN 7 THEN concat('632102', ph, 'ad670340420fb175682102', sh, 'ac')
    WHEN 10 THEN concat('25512102', ph, '51ae')
    ELSE '' END"""

STRUCTURE = """CASE cls
    WHEN 0 THEN 'DUP[1] HASH160[1] EQUALVERIFY[1] CHECKSIG'
    WHEN 1 THEN 'DUP[1] HASH160[1] EQUALVERIFY[1] CHECKSIG'
    WHEN 2 THEN 'HASH160[1] EQUAL'
    WHEN 3 THEN 'CHECKSIG'
    WHEN 4 THEN 'RETURN'
    WHEN 5 THEN '1[1] 2[1] CHECKMULTISIG'
    WHEN 6 THEN 'ERROR'
    WHEN 7 THEN 'IF[1] CHECKSIGVERIFY[1] ELSE[1] CHECKLOCKTIMEVERIFY[1] DROP[1] ENDIF[1] CHECKSIG'
    ELSE '' END"""

HASH160 = "CASE WHEN cls IN (0, 1, 2) THEN substring(ph, 1, 40) END"

SCRIPT_TYPE = """CASE WHEN cls IN (0, 1) THEN 'P2PKH' WHEN cls = 3 THEN 'PUB_KEY'
    WHEN cls = 2 THEN 'P2SH' ELSE 'NO_TYPE' END"""

SIGOPS = "CASE cls WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 3 THEN 1 WHEN 5 THEN 20 WHEN 7 THEN 2 ELSE 0 END"

ASM = """CASE cls
    WHEN -1 THEN ''
    WHEN 11 THEN ''
    WHEN 0 THEN concat('DUP HASH160 PUSHDATA(20)[', substring(ph, 1, 40), '] EQUALVERIFY CHECKSIG')
    WHEN 1 THEN concat('DUP HASH160 PUSHDATA1[', substring(ph, 1, 40), '] EQUALVERIFY CHECKSIG')
    WHEN 2 THEN concat('HASH160 PUSHDATA(20)[', substring(ph, 1, 40), '] EQUAL')
    WHEN 3 THEN concat('PUSHDATA(33)[02', ph, '] CHECKSIG')
    WHEN 4 THEN 'RETURN'
    WHEN 5 THEN concat('1 PUSHDATA(33)[02', ph, '] PUSHDATA(33)[02', sh, '] 2 CHECKMULTISIG')
    WHEN 7 THEN concat('IF PUSHDATA(33)[02', ph, '] CHECKSIGVERIFY ELSE PUSHDATA(3)[40420f] ',
                       'CHECKLOCKTIMEVERIFY DROP ENDIF PUSHDATA(33)[02', sh, '] CHECKSIG')
    WHEN 10 THEN concat('PUSHDATA(37)[512102', ph, '51ae]')
    END"""


def _chunk(pos, opcode, name, data, start):
    return (f"{{'pos': {pos}, 'opcode': {opcode}, 'name': '{name}', "
            f"'data_hex': {data}, 'start': {start}}}")


_NULL = "CAST(NULL AS VARCHAR)"
_H20 = "substring(ph, 1, 40)"

CHUNKS = f"""CASE cls
    WHEN 0 THEN [{_chunk(0, 118, 'DUP', _NULL, 0)}, {_chunk(1, 169, 'HASH160', _NULL, 1)},
                 {_chunk(2, 20, 'PUSHDATA(20)', _H20, 2)}, {_chunk(3, 136, 'EQUALVERIFY', _NULL, 23)},
                 {_chunk(4, 172, 'CHECKSIG', _NULL, 24)}]
    WHEN 1 THEN [{_chunk(0, 118, 'DUP', _NULL, 0)}, {_chunk(1, 169, 'HASH160', _NULL, 1)},
                 {_chunk(2, 76, 'PUSHDATA1', _H20, 2)}, {_chunk(3, 136, 'EQUALVERIFY', _NULL, 24)},
                 {_chunk(4, 172, 'CHECKSIG', _NULL, 25)}]
    WHEN 2 THEN [{_chunk(0, 169, 'HASH160', _NULL, 0)}, {_chunk(1, 20, 'PUSHDATA(20)', _H20, 1)},
                 {_chunk(2, 135, 'EQUAL', _NULL, 22)}]
    WHEN 3 THEN [{_chunk(0, 33, 'PUSHDATA(33)', "concat('02', ph)", 0)},
                 {_chunk(1, 172, 'CHECKSIG', _NULL, 34)}]
    WHEN 4 THEN [{_chunk(0, 106, 'RETURN', "'04deadbeef'", 0)}]
    WHEN 5 THEN [{_chunk(0, 81, '1', _NULL, 0)}, {_chunk(1, 33, 'PUSHDATA(33)', "concat('02', ph)", 1)},
                 {_chunk(2, 33, 'PUSHDATA(33)', "concat('02', sh)", 35)},
                 {_chunk(3, 82, '2', _NULL, 69)}, {_chunk(4, 174, 'CHECKMULTISIG', _NULL, 70)}]
    WHEN 7 THEN [{_chunk(0, 99, 'IF', _NULL, 0)}, {_chunk(1, 33, 'PUSHDATA(33)', "concat('02', ph)", 1)},
                 {_chunk(2, 173, 'CHECKSIGVERIFY', _NULL, 35)}, {_chunk(3, 103, 'ELSE', _NULL, 36)},
                 {_chunk(4, 3, 'PUSHDATA(3)', "'40420f'", 37)},
                 {_chunk(5, 177, 'CHECKLOCKTIMEVERIFY', _NULL, 41)},
                 {_chunk(6, 117, 'DROP', _NULL, 42)}, {_chunk(7, 104, 'ENDIF', _NULL, 43)},
                 {_chunk(8, 33, 'PUSHDATA(33)', "concat('02', sh)", 44)},
                 {_chunk(9, 172, 'CHECKSIG', _NULL, 78)}]
    WHEN 10 THEN [{_chunk(0, 37, 'PUSHDATA(37)', "concat('512102', ph, '51ae')", 0)}]
    END"""

OPCODE_NAMES = """CASE cls
    WHEN 0 THEN ['DUP', 'HASH160', 'EQUALVERIFY', 'CHECKSIG']
    WHEN 1 THEN ['DUP', 'HASH160', 'EQUALVERIFY', 'CHECKSIG']
    WHEN 2 THEN ['HASH160', 'EQUAL']
    WHEN 3 THEN ['CHECKSIG']
    WHEN 4 THEN ['RETURN']
    WHEN 5 THEN ['1', '2', 'CHECKMULTISIG']
    WHEN 7 THEN ['IF', 'CHECKSIGVERIFY', 'ELSE', 'CHECKLOCKTIMEVERIFY', 'DROP', 'ENDIF', 'CHECKSIG']
    END"""


def base58_sql(hex_expr: str) -> str:
    """DuckDB expression: Base58 text of a hex byte string (<= 26 bytes)."""
    fields, carry = [], "p"
    for j in range(7):
        v = f"(acc.l{j} * 65536 + {carry})"
        fields.append(f"l{j} := {v} % {_LIMB}")
        carry = f"({v} // {_LIMB})"
    step = "lambda acc, p: struct_pack(" + ", ".join(fields) + ")"
    init = "struct_pack(" + ", ".join(f"l{j} := CAST(0 AS BIGINT)" for j in range(7)) + ")"
    pieces = (f"list_transform(range(13), lambda i: CAST(('0x' || substring(lpad({hex_expr}, 52, '0'), "
              f"4 * i + 1, 4)) AS BIGINT))")
    limbs = f"list_reduce({pieces}, {step}, {init})"
    powers = "[11316496, 195112, 3364, 58, 1]"
    digits = (f"array_to_string(list_transform(range(35), lambda k: substring('{B58}', "
              f"CAST((([L.l6, L.l5, L.l4, L.l3, L.l2, L.l1, L.l0][k // 5 + 1] // "
              f"{powers}[k % 5 + 1]) % 58) + 1 AS INTEGER), 1)), '')")
    # L is bound through a one-element list so the fold runs once per row.
    body = f"list_transform([{limbs}], lambda L: {digits})[1]"
    zeros = f"repeat('1', CAST(length(regexp_extract({hex_expr}, '^((?:00)*)', 1)) // 2 AS INTEGER))"
    return f"concat({zeros}, ltrim({body}, '1'))"


def base58_long_sql(hex_expr: str) -> str:
    """DuckDB expression: Base58 text of a hex byte string of up to 66 bytes, by
    schoolbook multiplication of single digits (no limbs)."""
    carry = "(d * 256 + s.c)"
    step = (f"list_reduce(acc, lambda s, d: struct_pack(o := list_append(s.o, {carry} % 58), "
            f"c := {carry} // 58), struct_pack(o := CAST([] AS BIGINT[]), c := b)).o")
    data = (f"list_transform(range(length({hex_expr}) // 2), "
            f"lambda i: CAST(('0x' || substring({hex_expr}, 2 * i + 1, 2)) AS BIGINT))")
    digits = (f"list_reduce({data}, lambda acc, b: {step}, "
              f"list_transform(range(91), lambda i: CAST(0 AS BIGINT)))")
    text = (f"array_to_string(list_transform(list_reverse({digits}), "
            f"lambda x: substring('{B58}', CAST(x + 1 AS INTEGER), 1)), '')")
    zeros = f"repeat('1', CAST(length(regexp_extract({hex_expr}, '^((?:00)*)', 1)) // 2 AS INTEGER))"
    return f"concat({zeros}, ltrim({text}, '1'))"


def base58check_sql(version_hex: str, payload_hex: str) -> str:
    body = f"concat({version_hex}, {payload_hex})"
    check = f"substring(sha256(unhex(sha256(unhex({body})))), 1, 8)"
    return base58_sql(f"concat({body}, {check})")


# RIPEMD-160 of one 32-byte message (a SHA-256 digest) in DuckDB SQL: the
# message fits one padded block, so the 80 steps of both lines run as one
# list_reduce over a struct state. Its tables follow from the rules of the
# specification, not from the code under test.
_M32 = 4294967295


# Fixed values of the RIPEMD-160 specification: the permutation of message
# words between rounds, and the rotation of each message word per round.
_RHO = [7, 4, 13, 1, 10, 6, 15, 3, 12, 0, 9, 5, 2, 14, 11, 8]
_ROTATIONS = [
    [11, 14, 15, 12, 5, 8, 7, 9, 11, 13, 14, 15, 6, 7, 9, 8],
    [12, 13, 11, 15, 6, 9, 9, 7, 12, 15, 11, 13, 7, 8, 7, 7],
    [13, 15, 14, 11, 7, 7, 6, 8, 13, 14, 13, 12, 5, 5, 6, 9],
    [14, 11, 12, 14, 8, 6, 5, 5, 15, 12, 15, 14, 9, 9, 8, 6],
    [15, 12, 13, 13, 9, 5, 8, 6, 14, 11, 12, 11, 8, 6, 5, 5],
]


def _ripemd_tables() -> dict[str, list[int]]:
    """Message order: rho per round, on the right line after word 9 i + 5;
    constants: 2^30 times square (left) and cube (right) roots of 2, 3, 5, 7."""
    order = {"l": list(range(16)), "r": [(9 * i + 5) % 16 for i in range(16)]}
    out: dict[str, list[int]] = {f"{t}{side}": [] for t in "rs" for side in "lr"}
    for rotations in _ROTATIONS:
        for side in "lr":
            out[f"r{side}"] += order[side]
            out[f"s{side}"] += [rotations[w] for w in order[side]]
            order[side] = [_RHO[w] for w in order[side]]
    roots = (2, 3, 5, 7)
    out["kl"] = [0] + [math.isqrt(p << 60) for p in roots]
    out["kr"] = [int(round(p ** (1 / 3) * 2 ** 30, 6)) for p in roots] + [0]
    return out


def _lst(xs) -> str:
    return "[" + ", ".join(str(x) for x in xs) + "]"


def _not32(x: str) -> str:
    return f"({_M32} - {x})"


def _rol32(x: str, n: str) -> str:
    return f"(((({x}) << ({n})) | (({x}) >> (32 - ({n})))) & {_M32})"


def _round_fn(rnd: str, x: str, y: str, z: str) -> str:
    return (f"CASE {rnd} WHEN 0 THEN xor(xor({x}, {y}), {z}) "
            f"WHEN 1 THEN ({x} & {y}) | ({_not32(x)} & {z}) "
            f"WHEN 2 THEN xor(({x} | {_not32(y)}), {z}) "
            f"WHEN 3 THEN ({x} & {z}) | ({y} & {_not32(z)}) "
            f"ELSE xor({x}, ({y} | {_not32(z)})) END")


def _line_step(side: str, rnd: str, order: str, shifts: str, consts: str) -> str:
    a, b, c, d, e = (f"s.{v}{side}" for v in "abcde")
    inner = (f"(({a} + {_round_fn(rnd, b, c, d)} + s.x[{order}[j + 1] + 1] "
             f"+ {consts}[j // 16 + 1]) & {_M32})")
    return f"({_rol32(inner, f'{shifts}[j + 1]')} + {e}) & {_M32}"


def ripemd160_sql(hex32: str) -> str:
    """DuckDB expression: RIPEMD-160 (hex) of a 32-byte message given as hex."""
    def word(i: int) -> str:      # little-endian 32-bit word i of the message
        b = [f"substring({hex32}, {8 * i + 2 * k + 1}, 2)" for k in range(4)]
        return f"CAST(('0x' || {b[3]} || {b[2]} || {b[1]} || {b[0]}) AS BIGINT)"

    # 8 message words, then the padding: 0x80, zeros, bit length 256
    x = "[" + ", ".join([word(i) for i in range(8)] + ["128", "0", "0", "0", "0", "0", "256", "0"]) + "]"
    t = _ripemd_tables()
    left = _line_step("l", "(j // 16)", _lst(t["rl"]), _lst(t["sl"]), _lst(t["kl"]))
    right = _line_step("r", "((79 - j) // 16)", _lst(t["rr"]), _lst(t["sr"]), _lst(t["kr"]))
    step = (f"lambda s, j: struct_pack(x := s.x, "
            f"al := s.el, el := s.dl, dl := {_rol32('s.cl', '10')}, cl := s.bl, bl := {left}, "
            f"ar := s.er, er := s.dr, dr := {_rol32('s.cr', '10')}, cr := s.br, br := {right})")
    h = [0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476, 0xC3D2E1F0]
    init = ("struct_pack(x := " + x + ", " + ", ".join(
        f"{v}{side} := CAST({h[i]} AS BIGINT)" for side in "lr" for i, v in enumerate("abcde")) + ")")
    final = f"list_reduce(range(80), {step}, {init})"
    words = [f"({h[1]} + s.cl + s.dr) & {_M32}", f"({h[2]} + s.dl + s.er) & {_M32}",
             f"({h[3]} + s.el + s.ar) & {_M32}", f"({h[4]} + s.al + s.br) & {_M32}",
             f"({h[0]} + s.bl + s.cr) & {_M32}"]
    le_hex = [f"printf('%02x%02x%02x%02x', ({w}) & 255, (({w}) >> 8) & 255, "
              f"(({w}) >> 16) & 255, (({w}) >> 24) & 255)" for w in words]
    return f"list_transform([{final}], lambda s: {' || '.join(le_hex)})[1]"


ADDRESS = f"CASE WHEN cls IN (0, 1, 2) THEN {base58check_sql(chr(39) + '00' + chr(39), _H20)} END"

UNSPENT_KEYS = """
unspent_keys AS (
  SELECT tx_hash, idx FROM elements GROUP BY tx_hash, idx
  HAVING count(*) = 1 AND max(type) = 1
)"""

UNSPENT = """
unspent AS (
  SELECT e.* FROM elements e JOIN unspent_keys k USING (tx_hash, idx) WHERE e.type = 1
)"""

BLOCK_INDEX = """
block_index AS (
  SELECT CAST(d AS VARCHAR) AS rowkey, count(*) AS "transactionCounter",
         CAST(date_diff('day', DATE '1970-01-01', d) * 86400 AS INTEGER) AS "transactionDate",
         concat('blk', substring(CAST(d AS VARCHAR), 1, 4), '.dat') AS file,
         CAST(sum(round(o_totalprice)) AS INTEGER) AS size
  FROM (SELECT CAST(o_orderdate AS DATE) AS d, o_totalprice FROM orders) x GROUP BY d
)"""

BLOCKS_TS = """
blocks AS (
  SELECT *, make_timestamp(CAST("transactionDate" AS BIGINT) * 1000000) AS ts FROM block_index
)"""

TX_INDEX = """
tx_index AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS rowkey,
         CAST(count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS INTEGER) AS "inputNo",
         CAST(count(l_orderkey) AS INTEGER) AS "outputNo"
  FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey
)"""

BLOCK_VALUES = """
block_values AS (
  SELECT CAST(date_diff('day', DATE '1970-01-01', d) * 86400 AS INTEGER) AS t,
         strftime(CAST(d AS TIMESTAMP), '%Y-%m-%d %H::%M') AS time,
         sha256(CAST(d AS VARCHAR)) AS hash,
         CAST(coalesce(sum(round(l_extendedprice * 100)), 0) AS BIGINT) AS value,
         CAST(count(DISTINCT o_orderkey) AS INTEGER) AS no
  FROM (SELECT CAST(o_orderdate AS DATE) AS d, o_orderkey FROM orders) o
  LEFT JOIN lineitem ON o_orderkey = l_orderkey
  GROUP BY d
)"""


# Nested records: two transactions per lineitem (tx_idx 0 and 1).
NESTED_OUT = """
lines AS (
  SELECT l.*, CASE WHEN l_linenumber = 7 THEN -1 ELSE CAST(l_suppkey % 8 AS INTEGER) END AS cls,
         sha256(CAST(CAST(l_shipdate AS DATE) AS VARCHAR)) AS block_hash,
         CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) * 86400 AS INTEGER) AS t,
         sha256(CAST(l_partkey AS VARCHAR)) AS ph, sha256(CAST(l_suppkey AS VARCHAR)) AS sh
  FROM lineitem l
),
outs AS (
  SELECT block_hash, t, 0 AS tx_idx, CAST(l_orderkey AS VARCHAR) AS tx_hash, CAST(0 AS BIGINT) AS idx,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS value, cls, ph, sh
  FROM lines WHERE l_linenumber % 4 >= 1
  UNION ALL
  SELECT block_hash, t, 0, CAST(l_orderkey AS VARCHAR), 1, CAST(round(l_discount * 100) AS BIGINT),
         cls, ph, sh FROM lines WHERE l_linenumber % 4 >= 2
  UNION ALL
  SELECT block_hash, t, 0, CAST(l_orderkey AS VARCHAR), 2, CAST(round(l_tax * 100) AS BIGINT),
         cls, ph, sh FROM lines WHERE l_linenumber % 4 = 3
  UNION ALL
  SELECT block_hash, t, 1, concat('p', l_partkey), 0, CAST(round(l_quantity) AS BIGINT),
         cls, ph, sh FROM lines
)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    E = ELEMENTS
    q["elements_scan"] = _with(E) + """
SELECT type, count(*) AS n_elements, CAST(sum(amount) AS BIGINT) AS total_amount
FROM elements GROUP BY type"""
    q["outpoint_key"] = _with(E) + """
SELECT concat(tx_hash, '_', CAST(idx AS VARCHAR)) AS outpoint, count(*) AS n
FROM elements GROUP BY tx_hash, idx"""
    q["outpoint_state"] = _with(E) + """
SELECT tx_hash, idx, CAST(CASE WHEN count(*) > 1 THEN 2 ELSE max(type) END AS INTEGER) AS state
FROM elements GROUP BY tx_hash, idx"""
    q["unspent_outputs"] = _with(E, UNSPENT_KEYS, UNSPENT) + f"""
SELECT type, block_hash, tx_idx, tx_hash, idx, amount, {SCRIPT_HEX} AS script_hex FROM unspent"""
    q["top_unspent"] = _with(E, UNSPENT_KEYS, UNSPENT) + """
SELECT type, block_hash, tx_idx, tx_hash, idx, amount FROM unspent
ORDER BY amount DESC, tx_hash, idx LIMIT 100"""
    q["top_unspent_with_script"] = _with(E, UNSPENT_KEYS, UNSPENT) + f"""
SELECT type, tx_idx, tx_hash, idx, amount, {SCRIPT_HEX} AS script_hex FROM unspent
ORDER BY amount DESC, tx_hash, idx LIMIT 100"""
    q["output_addresses"] = _with(E, UNSPENT_KEYS, UNSPENT) + f"""
SELECT tx_hash, idx, {ADDRESS} AS address, {HASH160} AS hash160, amount AS balance
FROM unspent WHERE cls IN (0, 1, 2)"""
    q["element_addresses"] = _with(E) + f"""
SELECT type, tx_hash, idx, CASE WHEN type = 1 THEN {ADDRESS} END AS address FROM elements"""
    q["top_addresses"] = _with(E, UNSPENT_KEYS, UNSPENT) + f"""
SELECT address, balance FROM (
  SELECT {ADDRESS} AS address, amount AS balance, tx_hash, idx FROM unspent
  WHERE cls IN (0, 1, 2) ORDER BY amount DESC, tx_hash, idx LIMIT 10000) t"""
    q["address_balances"] = _with(E, UNSPENT_KEYS, UNSPENT) + f"""
SELECT {base58check_sql("'00'", 'h')} AS address, balance, n_outputs FROM (
  SELECT {HASH160} AS h, CAST(sum(amount) AS BIGINT) AS balance, count(*) AS n_outputs
  FROM unspent WHERE cls IN (0, 1, 2) GROUP BY 1) t"""
    q["address_validation"] = _with(E, UNSPENT_KEYS, UNSPENT) + f"""
SELECT tx_hash, idx, {ADDRESS} AS address, true AS valid, 0 AS version, {HASH160} AS payload_hex
FROM unspent WHERE cls IN (0, 1, 2)"""
    q["address_checks"] = f"""
WITH a AS (
  SELECT p_partkey, p_partkey % 7 AS k, h, {base58check_sql("'00'", 'h')} AS a
  FROM (SELECT p_partkey, substring(sha256(CAST(p_partkey AS VARCHAR)), 1, 40) AS h FROM part) x
)
SELECT p_partkey, CASE k
         WHEN 1 THEN concat(a[:-2], CASE WHEN a[-1:] = '2' THEN '3' ELSE '2' END)
         WHEN 2 THEN concat('0', a) WHEN 3 THEN a[:3] WHEN 4 THEN '3QJmnh' WHEN 5 THEN NULL
         ELSE a END AS text,
       CASE WHEN k = 5 THEN NULL ELSE k IN (0, 4, 6) END AS valid,
       CAST(CASE WHEN k IN (0, 6) THEN 0 END AS INTEGER) AS version,
       CASE WHEN k = 4 THEN '' WHEN k IN (0, 6) THEN h END AS payload_hex
FROM a"""
    q["block_script_structs"] = _with(E) + f"""
SELECT block_hash AS "blockId", {STRUCTURE} AS "scriptStruct" FROM elements"""
    q["blocks_without_opcodes"] = _with(E) + f"""
SELECT block_hash AS "blockId", {STRUCTURE} AS "scriptStruct" FROM elements
WHERE ({STRUCTURE}) = '' ORDER BY "blockId" LIMIT 30"""
    q["script_distribution"] = _with(E) + f"""
SELECT {STRUCTURE} AS "scriptType", count(*) AS "count" FROM elements WHERE type = 1 GROUP BY 1"""
    q["unspent_script_types"] = _with(E, UNSPENT_KEYS, UNSPENT) + f"""
SELECT {STRUCTURE} AS "scriptStruct", count(*) AS "count" FROM unspent GROUP BY 1"""
    q["script_type_distribution"] = _with(E) + f"""
SELECT {SCRIPT_TYPE} AS script_type, count(*) AS n FROM elements WHERE type = 1 GROUP BY 1"""
    q["script_chunks"] = _with(E) + f"""
SELECT type, tx_hash, idx, CAST(c.pos AS INTEGER) AS pos, CAST(c.opcode AS INTEGER) AS opcode,
       c.name AS name, c.data_hex AS data_hex, CAST(c.start AS INTEGER) AS start
FROM (SELECT type, tx_hash, idx, unnest({CHUNKS}) AS c FROM elements) x"""
    q["opcode_histogram"] = _with(E) + f"""
SELECT name, count(*) AS n FROM (SELECT unnest({OPCODE_NAMES}) AS name FROM elements) x GROUP BY name"""
    q["script_asm"] = _with(E) + f"""
SELECT type, tx_hash, idx, {ASM} AS asm FROM elements"""
    q["script_flags"] = _with(E) + """
SELECT type, tx_hash, idx, cls = 5 AS is_multisig, cls = 7 AS is_cltv, cls = 4 AS is_op_return
FROM elements"""
    h160 = ripemd160_sql("sha256(unhex(concat('02', ph)))")
    q["pubkey_addresses"] = _with(E) + f"""
SELECT tx_hash, idx, pubkey_hex, hash160, {base58check_sql("'00'", 'hash160')} AS address FROM (
  SELECT tx_hash, idx, concat('02', ph) AS pubkey_hex, {h160} AS hash160
  FROM elements WHERE cls = 3) x"""
    q["script_pubkeys"] = _with(E) + """
SELECT type, tx_hash, idx, concat('02', ph) AS pubkey_hex FROM elements WHERE cls = 3"""
    q["cltv_channels"] = _with(E) + """
SELECT tx_hash, idx, concat('02', sh) AS sender_hex, concat('02', ph) AS recipient_hex,
       CAST(1000000 AS BIGINT) AS expiry
FROM elements WHERE cls = 7"""
    q["sigops_per_block"] = _with(E) + f"""
SELECT block_hash, CAST(sum({SIGOPS}) AS BIGINT) AS sigops FROM elements GROUP BY block_hash"""
    q["p2sh_sigops_per_block"] = _with(E) + """
SELECT block_hash, CAST(sum(CASE WHEN cls = 10 THEN 1 ELSE 0 END) AS BIGINT) AS p2sh_sigops,
CAST(count(CASE WHEN cls IS NULL THEN 1 END) AS BIGINT) AS n_unparsable
FROM elements WHERE type = 0 GROUP BY block_hash"""
    q["nonminimal_pushes"] = _with(E) + """
SELECT block_hash, CAST(count(*) AS BIGINT) AS n_nonminimal FROM elements WHERE cls = 1
GROUP BY block_hash"""

    # --- block index / tx index ---------------------------------------------
    BI, BT = BLOCK_INDEX, BLOCKS_TS
    q["block_index_scan"] = _with(BI) + "SELECT * FROM block_index"
    q["tx_index_scan"] = _with(TX_INDEX) + "SELECT * FROM tx_index"
    q["block_count"] = _with(BI) + 'SELECT \'result\' AS "_1", count(*) AS "_2" FROM block_index'
    q["transaction_count"] = _with(TX_INDEX) + \
        'SELECT \'result\' AS "_1", count(*) AS "_2" FROM tx_index'
    q["block_ts"] = _with(BI, BT) + 'SELECT rowkey, "transactionDate", ts FROM blocks'
    size = "2 * ((\"transactionDate\" // 86400) % 64 + 1)"
    q["base58_text"] = _with(BI) + f"""
SELECT rowkey, bytes_hex, {base58_long_sql("bytes_hex")} AS text FROM (
  SELECT rowkey, concat(repeat('00', CAST("transactionCounter" % 3 AS INTEGER)),
    substring(concat(sha256(rowkey), sha256(concat(rowkey, '#'))), 1, CAST({size} AS INTEGER))) AS bytes_hex
  FROM block_index)"""
    q["block_iso_time"] = _with(BI, BT) + \
        "SELECT rowkey, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso_time FROM blocks"
    q["blocks_per_year"] = _with(BI, BT) + """
SELECT CAST(year(ts) AS INTEGER) AS year, count(1) AS n_blocks FROM blocks GROUP BY 1 ORDER BY 1"""
    extremes = """
SELECT CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
       min("transactionCounter") AS min_tx, max("transactionCounter") AS max_tx,
       min(size) AS min_size, max(size) AS max_size
FROM blocks GROUP BY 1, 2 ORDER BY 1, 2"""
    q["block_extremes_per_month"] = _with(BI, BT) + extremes
    q["sql_over_views"] = _with(BI, BT) + extremes
    q["small_blocks_per_month"] = _with(BI, BT) + """
SELECT CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, count(1) AS n_blocks
FROM (SELECT * FROM blocks WHERE "transactionCounter" < 10) x GROUP BY 1, 2 ORDER BY 1, 2"""
    q["blocks_fewest_tx"] = _with(BI) + \
        'SELECT * FROM block_index ORDER BY "transactionCounter", rowkey LIMIT 1000'
    q["largest_blocks"] = _with(BI, BT) + "SELECT * FROM blocks ORDER BY size DESC, rowkey LIMIT 100"
    q["reversed_hash"] = _with(BI) + """
SELECT rowkey, sha256(rowkey) AS block_hash,
       array_to_string(list_reverse(regexp_extract_all(sha256(rowkey), '..')), '') AS display_hash
FROM block_index"""
    q["double_sha256"] = _with(BI) + """
SELECT rowkey, sha256(unhex(sha256(rowkey))) AS hash256 FROM block_index"""

    # --- block values ---------------------------------------------------------
    q["block_values"] = _with(BLOCK_VALUES) + "SELECT * FROM block_values ORDER BY t, hash"
    q["recent_blocks"] = _with(BLOCK_VALUES) + """
SELECT * FROM block_values WHERE t > (SELECT max(t) FROM block_values) - 30 * 86400 ORDER BY t, hash"""
    q["flatten_outputs"] = _with(E) + """
SELECT block_hash, tx_hash, idx, amount AS value FROM elements WHERE type = 1"""
    q["blocks_scan"] = """
SELECT sha256(CAST(d AS VARCHAR)) AS block_hash,
       CAST(date_diff('day', DATE '1970-01-01', d) * 86400 AS INTEGER) AS t,
       CAST(count(DISTINCT o_orderkey) AS INTEGER) AS n_transactions,
       count(l_orderkey) AS n_outputs
FROM (SELECT CAST(o_orderdate AS DATE) AS d, o_orderkey FROM orders) o
LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY d"""

    # --- nested records -------------------------------------------------------
    N = NESTED_OUT
    q["nested_block_values"] = _with(N) + """
SELECT t, strftime(make_timestamp(CAST(t AS BIGINT) * 1000000), '%Y-%m-%d %H::%M') AS time,
       block_hash AS hash, CAST(sum(value) AS BIGINT) AS value, CAST(max(n) AS BIGINT) AS no
FROM outs JOIN (SELECT block_hash, 2 * count(*) AS n FROM lines GROUP BY block_hash) x USING (block_hash)
GROUP BY t, block_hash"""
    q["nested_transactions"] = _with(N) + """
SELECT block_hash, t, 0 AS tx_idx, CAST(l_orderkey AS VARCHAR) AS tx_hash,
       CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS INTEGER) AS n_inputs,
       CAST(l_linenumber % 4 AS INTEGER) AS n_outputs FROM lines
UNION ALL
SELECT block_hash, t, 1, concat('p', l_partkey), 0, 1 FROM lines"""
    q["nested_outputs"] = _with(N) + f"""
SELECT block_hash, tx_hash, idx, value, {SCRIPT_HEX} AS script_hex FROM outs"""
    q["nested_elements"] = _with(N) + f"""
SELECT 1 AS type, block_hash, tx_idx, tx_hash, idx, value AS amount, {SCRIPT_HEX} AS script_hex
FROM outs
UNION ALL
SELECT 0, block_hash, 0, CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS BIGINT), CAST(0 AS BIGINT),
       CASE WHEN l_suppkey % 8 = 2 THEN concat('25512102', ph, '51ae') ELSE '' END
FROM lines WHERE l_returnflag = 'R'"""

    # --- stored tables, raw files, cells, SQL table functions ----------------
    q["top_unspent_by_address"] = q["top_unspent"]
    q["unspent_outputs_filtered"] = q["unspent_outputs"]
    q["sql_script_chunks"] = q["script_chunks"]
    q["block_index_cells"] = q["block_index_scan"]
    q["tx_index_cells"] = q["tx_index_scan"]
    # a transaction without inputs is written with the null input
    q["block_file_scan"] = _with(N) + """
SELECT t, n AS n_records, 2 * n AS n_transactions, 2 * n AS n_inputs, CAST(n_out AS BIGINT) AS n_outputs, value
FROM (SELECT t, count(*) AS n, sum(l_linenumber % 4) + count(*) AS n_out FROM lines GROUP BY t) a
JOIN (SELECT t, CAST(sum(value) AS BIGINT) AS value FROM outs GROUP BY t) b USING (t)"""

    # --- mode ---------------------------------------------------------------
    q["mode_max"] = """
WITH per AS (SELECT event_type, CAST(floor(value) AS INTEGER) AS v, count(*) AS c
             FROM events GROUP BY 1, 2),
r AS (SELECT event_type, v,
             row_number() OVER (PARTITION BY event_type ORDER BY (v IS NULL), c DESC, v DESC) AS rn
      FROM per)
SELECT event_type, coalesce(v, 0) AS mode_value FROM r WHERE rn = 1"""
    return q
