"""Cursors, natural keys, signatures and addresses."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_MASK = (1 << 64) - 1


def cursor(row_id: Column) -> Column:
    """base64url without padding of the decimal id."""
    return F.rtrim(F.translate(F.base64(row_id.cast("string").cast("binary")), "+/=", "-_ "))


def cursor_id(text: Column) -> Column:
    """The id of a cursor; 0 for the empty cursor, null if it is malformed."""
    padded = F.concat(F.translate(text, "-_", "+/"), F.substring(F.lit("==="), F.lit(1), (F.lit(4) - F.length(text) % 4) % 4))
    raw = F.try_to_binary(padded, F.lit("base64")).cast("string")
    return F.when(text == "", F.lit(0).cast("long")).when(raw.rlike("^[0-9]+$"), raw.try_cast("long"))


def reversal_key(uid: Column, reason: Column) -> Column:
    return F.concat_ws(":", F.lit("reversal"), uid, reason)


def pending_expiry_key(journal_id: Column) -> Column:
    return F.concat(F.lit("pending:expire:journal="), journal_id)


def deposit_key(chain: Column, tx: Column, seq: Column) -> Column:
    return F.concat_ws("-", F.lit("deposit"), chain.cast("string"), tx, seq.cast("string"))


def sweep_key(chain: Column, token: Column, nonce: Column) -> Column:
    return F.concat_ws("-", F.lit("sweep"), chain.cast("string"), token, nonce.cast("string"))


def channel_ref(tx: Column, seq: Column) -> Column:
    return F.concat_ws("#", tx, seq.cast("string"))


def row_uid(key: Column) -> Column:
    """A stable identifier from an idempotency key, in the form of a UUID."""
    h = F.md5(key.cast("binary"))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


@F.pandas_udf(StringType())
def _hmac_hex(secret: pd.Series, body: pd.Series) -> pd.Series:
    return pd.Series([None if s is None or b is None else hmac.new(s.encode(), b.encode(), hashlib.sha256).hexdigest() for s, b in zip(secret, body, strict=True)], dtype=object)


def signature(secret: Column, body: Column) -> Column:
    """HMAC-SHA256 in lower-case hexadecimal."""
    return _hmac_hex(secret, body)


def _rounds() -> list[int]:
    """The 24 round constants of Keccak-f, from its linear feedback shift register."""
    out, state = [], 1
    for _ in range(24):
        word = 0
        for j in range(7):
            if state & 1:
                word |= 1 << ((1 << j) - 1)
            state = (state << 1) ^ (0x171 if state & 0x80 else 0)
        out.append(word)
    return out


_ROUNDS = _rounds()


def _turn(x: int, n: int) -> int:
    n %= 64
    return (x << n | x >> (64 - n)) & _MASK


def keccak256(data: bytes) -> bytes:
    """Keccak-256 with the original padding (not SHA3-256)."""
    rate = 136
    padded = bytearray(data) + b"\x01" + bytes(-(len(data) + 1) % rate)
    padded[-1] |= 0x80
    a = [[0] * 5 for _ in range(5)]
    for start in range(0, len(padded), rate):
        for i in range(rate // 8):
            a[i % 5][i // 5] ^= int.from_bytes(padded[start + 8 * i : start + 8 * i + 8], "little")
        for constant in _ROUNDS:
            c = [a[x][0] ^ a[x][1] ^ a[x][2] ^ a[x][3] ^ a[x][4] for x in range(5)]
            d = [c[(x + 4) % 5] ^ _turn(c[(x + 1) % 5], 1) for x in range(5)]
            a = [[a[x][y] ^ d[x] for y in range(5)] for x in range(5)]
            # rho and pi: walk the 24 lanes, each turned by the next triangular number
            b = [[0] * 5 for _ in range(5)]
            b[0][0] = a[0][0]
            x, y = 1, 0
            for t in range(24):
                b[y][(2 * x + 3 * y) % 5] = _turn(a[x][y], (t + 1) * (t + 2) // 2)
                x, y = y, (2 * x + 3 * y) % 5
            a = [[b[x][y] ^ (~b[(x + 1) % 5][y] & b[(x + 2) % 5][y]) for y in range(5)] for x in range(5)]
            a[0][0] ^= constant
    return b"".join(a[i % 5][i // 5].to_bytes(8, "little") for i in range(4))


def checksummed(address: str) -> str:
    """The mixed-case form of a 20-byte hexadecimal address."""
    plain = address.lower().removeprefix("0x")
    digest = keccak256(plain.encode()).hex()
    return "0x" + "".join(c.upper() if int(h, 16) > 7 else c for c, h in zip(plain, digest, strict=False))


def create2(deployer: str, salt: bytes, init_code_hash: bytes) -> str:
    """The address a factory gives a contract for a salt."""
    return checksummed(keccak256(b"\xff" + bytes.fromhex(deployer.removeprefix("0x")) + salt + init_code_hash)[12:].hex())


@F.pandas_udf(StringType())
def checksum_address(address: pd.Series) -> pd.Series:
    """``checksummed`` as a column; null for what isn't an address."""
    import re

    return pd.Series([checksummed(a) if a is not None and re.fullmatch("(0x)?[0-9a-fA-F]{40}", a) else None for a in address], dtype=object)
