"""Script opcode names.

Fixed values: the public script opcode names (without the ``OP_`` prefix),
by code, in code order. Codes not listed print as ``NON_OP(<code>)``;
pushes print as ``PUSHDATA(<n>)`` for direct pushes of n bytes.
"""

from __future__ import annotations

# Fixed values (code → name), in code order.
OPCODE_NAMES: dict[int, str] = {
    0x00: "0",
    0x4C: "PUSHDATA1",
    0x4D: "PUSHDATA2",
    0x4E: "PUSHDATA4",
    0x4F: "1NEGATE",
    0x50: "RESERVED",
    0x51: "1", 0x52: "2", 0x53: "3", 0x54: "4", 0x55: "5", 0x56: "6", 0x57: "7", 0x58: "8",
    0x59: "9", 0x5A: "10", 0x5B: "11", 0x5C: "12", 0x5D: "13", 0x5E: "14", 0x5F: "15", 0x60: "16",
    0x61: "NOP",
    0x62: "VER",
    0x63: "IF",
    0x64: "NOTIF",
    0x65: "VERIF",
    0x66: "VERNOTIF",
    0x67: "ELSE",
    0x68: "ENDIF",
    0x69: "VERIFY",
    0x6A: "RETURN",
    0x6B: "TOALTSTACK",
    0x6C: "FROMALTSTACK",
    0x6D: "2DROP",
    0x6E: "2DUP",
    0x6F: "3DUP",
    0x70: "2OVER",
    0x71: "2ROT",
    0x72: "2SWAP",
    0x73: "IFDUP",
    0x74: "DEPTH",
    0x75: "DROP",
    0x76: "DUP",
    0x77: "NIP",
    0x78: "OVER",
    0x79: "PICK",
    0x7A: "ROLL",
    0x7B: "ROT",
    0x7C: "SWAP",
    0x7D: "TUCK",
    0x7E: "CAT",
    0x7F: "SUBSTR",
    0x80: "LEFT",
    0x81: "RIGHT",
    0x82: "SIZE",
    0x83: "INVERT",
    0x84: "AND",
    0x85: "OR",
    0x86: "XOR",
    0x87: "EQUAL",
    0x88: "EQUALVERIFY",
    0x89: "RESERVED1",
    0x8A: "RESERVED2",
    0x8B: "1ADD",
    0x8C: "1SUB",
    0x8D: "2MUL",
    0x8E: "2DIV",
    0x8F: "NEGATE",
    0x90: "ABS",
    0x91: "NOT",
    0x92: "0NOTEQUAL",
    0x93: "ADD",
    0x94: "SUB",
    0x95: "MUL",
    0x96: "DIV",
    0x97: "MOD",
    0x98: "LSHIFT",
    0x99: "RSHIFT",
    0x9A: "BOOLAND",
    0x9B: "BOOLOR",
    0x9C: "NUMEQUAL",
    0x9D: "NUMEQUALVERIFY",
    0x9E: "NUMNOTEQUAL",
    0x9F: "LESSTHAN",
    0xA0: "GREATERTHAN",
    0xA1: "LESSTHANOREQUAL",
    0xA2: "GREATERTHANOREQUAL",
    0xA3: "MIN",
    0xA4: "MAX",
    0xA5: "WITHIN",
    0xA6: "RIPEMD160",
    0xA7: "SHA1",
    0xA8: "SHA256",
    0xA9: "HASH160",
    0xAA: "HASH256",
    0xAB: "CODESEPARATOR",
    0xAC: "CHECKSIG",
    0xAD: "CHECKSIGVERIFY",
    0xAE: "CHECKMULTISIG",
    0xAF: "CHECKMULTISIGVERIFY",
    0xB0: "NOP1",
    0xB1: "CHECKLOCKTIMEVERIFY",
    0xB2: "NOP3",
    0xB3: "NOP4",
    0xB4: "NOP5",
    0xB5: "NOP6",
    0xB6: "NOP7",
    0xB7: "NOP8",
    0xB8: "NOP9",
    0xB9: "NOP10",
}

# Extra spellings accepted when looking a name up.
OPCODE_ALIASES: dict[str, int] = {"NOP2": 0xB1}

INVALID_OPCODE = 0xFF

# Opcode constants used by the parser and predicates.
OP_0 = 0x00
OP_PUSHDATA1, OP_PUSHDATA2, OP_PUSHDATA4 = 0x4C, 0x4D, 0x4E
OP_1NEGATE, OP_1, OP_16 = 0x4F, 0x51, 0x60
OP_IF, OP_ELSE, OP_ENDIF, OP_RETURN = 0x63, 0x67, 0x68, 0x6A
OP_DROP, OP_DUP, OP_EQUAL, OP_EQUALVERIFY, OP_HASH160 = 0x75, 0x76, 0x87, 0x88, 0xA9
OP_CHECKSIG, OP_CHECKSIGVERIFY = 0xAC, 0xAD
OP_CHECKMULTISIG, OP_CHECKMULTISIGVERIFY = 0xAE, 0xAF
OP_CHECKLOCKTIMEVERIFY = 0xB1


def opcode_name(code: int) -> str:
    name = OPCODE_NAMES.get(code)
    return name if name is not None else f"NON_OP({code})"


def push_name(code: int) -> str:
    name = OPCODE_NAMES.get(code)
    return name if name is not None else f"PUSHDATA({code})"


def opcode_of(name: str) -> int:
    """Name → code; unknown names give the invalid opcode 0xff."""
    if name in OPCODE_ALIASES:
        return OPCODE_ALIASES[name]
    for code, n in OPCODE_NAMES.items():
        if n == name:
            return code
    return INVALID_OPCODE
