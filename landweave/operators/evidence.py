"""Canonical JSON, hashes, Ed25519 signatures and signed evidence envelopes."""

from __future__ import annotations

import base64
import hashlib
import json
from functools import lru_cache
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical(value: Any) -> bytes:
    """Keys sorted at every level, no blanks, UTF-8."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def canonical_text(c: Column) -> Column:
    """Canonical form of a JSON text column; null where it can't be read."""

    def run(s: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                return None if t is None else canonical(json.loads(t)).decode()
            except ValueError:
                return None

        return s.map(one)

    return F.pandas_udf(run, "string")(c)


#: What stands before the key in its PKCS 8 form (RFC 8410).
_PKCS8 = bytes.fromhex("302e020100300506032b657004220420")

# Ed25519 as RFC 8032 defines it, over the curve -x^2 + y^2 = 1 + d x^2 y^2.
_P = 2**255 - 19
_L = 2**252 + 27742317777372353535851937790883648493
_D = -121665 * pow(121666, _P - 2, _P) % _P
_I = pow(2, (_P - 1) // 4, _P)


def _x_of(y: int, odd: int) -> int:
    xx = (y * y - 1) * pow(_D * y * y + 1, _P - 2, _P) % _P
    x = pow(xx, (_P + 3) // 8, _P)
    if (x * x - xx) % _P:
        x = x * _I % _P
    if (x * x - xx) % _P:
        raise ValueError("no point of the curve")
    return _P - x if x & 1 != odd else x


_BY = 4 * pow(5, _P - 2, _P) % _P
_BX = _x_of(_BY, 0)
_B = (_BX, _BY, 1, _BX * _BY % _P)


def _add(p: tuple, q: tuple) -> tuple:
    a, b = (p[1] - p[0]) * (q[1] - q[0]) % _P, (p[1] + p[0]) * (q[1] + q[0]) % _P
    c, d = 2 * p[3] * q[3] * _D % _P, 2 * p[2] * q[2] % _P
    e, f, g, h = b - a, d - c, d + c, b + a
    return e * f % _P, g * h % _P, f * g % _P, e * h % _P


@lru_cache(maxsize=16)
def _windows(p: tuple) -> list[list[tuple]]:
    """For each four bits of a factor, their multiples of ``p``; the base and the few keys recur in every row."""
    out = []
    for _ in range(64):
        row = [(0, 1, 1, 0)]
        for _ in range(15):
            row.append(_add(row[-1], p))
        out.append(row)
        p = _add(row[-1], p)
    return out


def _times(n: int, p: tuple) -> tuple:
    q, rows = (0, 1, 1, 0), _windows(p)
    i = 0
    while n:
        if n & 15:
            q = _add(q, rows[i][n & 15])
        n >>= 4
        i += 1
    return q


def _pack(p: tuple) -> bytes:
    z = pow(p[2], _P - 2, _P)
    x, y = p[0] * z % _P, p[1] * z % _P
    return (y | (x & 1) << 255).to_bytes(32, "little")


def _unpack(b: bytes) -> tuple:
    y = int.from_bytes(b, "little")
    odd, y = y >> 255, y & (1 << 255) - 1
    x = _x_of(y, odd)
    return x, y, 1, x * y % _P


def _secret(seed: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(seed).digest()
    a = int.from_bytes(h[:32], "little")
    return a & (1 << 254) - 8 | 1 << 254, h[32:]


@lru_cache(maxsize=16)
def public_key(seed: bytes) -> bytes:
    return _pack(_times(_secret(seed)[0], _B))


def _mod(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little") % _L


def sign(seed: bytes, message: bytes) -> bytes:
    a, prefix = _secret(seed)
    key = public_key(seed)
    r = _mod(prefix, message)
    point = _pack(_times(r, _B))
    return point + ((r + _mod(point, key, message) * a) % _L).to_bytes(32, "little")


def verify(key: bytes, message: bytes, signature: bytes) -> bool:
    try:
        if len(signature) != 64:
            return False
        s = int.from_bytes(signature[32:], "little")
        if s >= _L:
            return False
        left, right = _times(s, _B), _add(_unpack(signature[:32]), _times(_mod(signature[:32], key, message), _unpack(key)))
        return _pack(left) == _pack(right)
    except ValueError:
        return False


def key_id(key: bytes) -> str:
    return hashlib.sha256(key).hexdigest()[:16]


class Registry:
    """Trusted public keys by name. A key registers again without effect; another key under a taken name is refused."""

    def __init__(self, keys: dict[str, bytes] | None = None):
        self.keys: dict[str, bytes] = {}
        for name, key in (keys or {}).items():
            self.register(name, key)

    def register(self, name: str, key: bytes) -> None:
        if len(key) != 32:
            raise ValueError("a public key has 32 bytes")
        if self.keys.setdefault(name, key) != key:
            raise ValueError(f"another key is registered as {name}")

    def to_json(self) -> str:
        return json.dumps({n: k.hex() for n, k in sorted(self.keys.items())})

    @classmethod
    def from_json(cls, text: str) -> Registry:
        return cls({n: bytes.fromhex(k) for n, k in json.loads(text).items()})


def seed_of(pem_or_raw: bytes) -> bytes:
    """The 32 bytes of a private key, given as such or as an unencrypted PEM of PKCS 8."""
    if len(pem_or_raw) == 32:
        return pem_or_raw
    body = base64.b64decode(b"".join(x for x in pem_or_raw.strip().splitlines() if not x.startswith(b"-----")))
    if len(body) != 48 or body[:16] != _PKCS8:
        raise ValueError("no Ed25519 private key")
    return body[16:]


def pem_of(seed: bytes) -> bytes:
    return b"-----BEGIN PRIVATE KEY-----\n" + base64.b64encode(_PKCS8 + seed) + b"\n-----END PRIVATE KEY-----\n"


def payload(created_at_utc: Column, parcel_ids: Column, record_ids: Column, conflict_types: Column, **more: Column) -> Column:
    """JSON of an evidence payload: ids sorted, the time of making, and further parts as they are given."""
    parts = {"schema_version": F.lit("1"), "created_at_utc": created_at_utc, "parcel_ids": F.sort_array(parcel_ids), "source_record_ids": F.sort_array(record_ids), "conflict_types": conflict_types, **more}
    return F.to_json(F.struct(*[c.alias(n) for n, c in parts.items()]), {"ignoreNullFields": "false"})


def envelope(payload: dict, seed: bytes) -> dict:
    """The payload with its hash, signature and the id of the key."""
    raw = canonical(payload)
    return {**payload, "evidence_hash": hashlib.sha256(raw).hexdigest(), "signature": sign(seed, raw).hex(), "signing": {"algorithm": "Ed25519", "key_id": key_id(public_key(seed))}}


def check_envelope(env: dict, trusted: dict[str, bytes]) -> str:
    """OK, or what is wrong: a missing part, a changed payload, an unknown key or a bad signature."""
    signing, sig, digest = env.get("signing") or {}, env.get("signature"), env.get("evidence_hash")
    if not signing.get("key_id"):
        return "MISSING_KEY_ID"
    if not sig or not digest:
        return "MISSING_SIGNATURE" if not sig else "MISSING_HASH"
    raw = canonical({k: v for k, v in env.items() if k not in ("evidence_hash", "signature", "signing")})
    if hashlib.sha256(raw).hexdigest() != digest:
        return "HASH_MISMATCH"
    key = trusted.get(signing["key_id"])
    if key is None:
        return "UNKNOWN_KEY"
    try:
        good = verify(key, raw, bytes.fromhex(sig))
    except ValueError:
        good = False
    return "OK" if good else "BAD_SIGNATURE"


def sign_rows(df: DataFrame, payload_json: str, seed: bytes) -> DataFrame:
    """Adds ``envelope``, the signed envelope of each row's payload as JSON."""
    run = lambda s: s.map(lambda t: None if t is None else canonical(envelope(json.loads(t), seed)).decode())
    return df.withColumn("envelope", F.pandas_udf(run, "string")(payload_json))


def verify_rows(df: DataFrame, trusted: dict[str, bytes]) -> DataFrame:
    """Adds ``verdict`` of each row's ``envelope``."""
    run = lambda s: s.map(lambda t: check_envelope(json.loads(t), trusted))
    return df.withColumn("verdict", F.pandas_udf(run, "string")("envelope"))
