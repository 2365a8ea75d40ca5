"""Secret scanning with structural confirmation.

Pattern hits are reported as such. Base64 and hex candidates are decoded, and are
reported only if what they hold parses: private keys in DER with nested lengths that
fit exactly, OpenSSH key blobs with length-prefixed fields, signed tokens whose header
is JSON that names an algorithm, PEM blocks around any of these.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scored

# The base patterns of the contract, in the order of their kinds.
BASE = {
    "assign": (re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 32),
}
#: Kinds in report order where two spans start alike.
KINDS = [*BASE, "pem", "jwt", "openssh", "der"]

_LONG_HEX = re.compile(r"[0-9a-f]{32,}")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:\r?\n[A-Za-z0-9-]+:[^\r\n]*)*)([A-Za-z0-9+/=\s]+)-----END \1-----")
_CIPHER = re.compile(r"^DEK-Info:\s*(DES|AES|CAMELLIA|BF|IDEA|RC2|SEED)[A-Z0-9-]*,\s*((?:[0-9A-Fa-f]{16}){1,2})\s*$", re.M)
_JWT = re.compile(r"(?<![A-Za-z0-9_.-])([A-Za-z0-9_-]{10,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])")
_B64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
_HEXES = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9a-f]{2}){24,}(?![0-9A-Fa-f])|(?<![0-9A-Fa-f])(?:[0-9A-F]{2}){24,}(?![0-9A-Fa-f])")
_BLANKS = re.compile(r"\S{24}")


def decode64(s: str) -> bytes | None:
    """Bytes of base64 in either alphabet, with or without padding; None if it isn't any."""
    s = "".join(s.split()).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True) if len(s) % 4 != 1 else None
    except binascii.Error:
        return None


def tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the DER value at ``at``; None if its length is malformed or runs over ``end``."""
    if at + 2 > end:
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n >= 128:
        k = n & 127
        if not 1 <= k <= 4 or at + k > end or data[at] == 0:
            return None
        n, at = int.from_bytes(data[at : at + k], "big"), at + k
        if n < 128:
            return None
    return (tag, at, at + n) if at + n <= end else None


def children(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """The values that fill [start, end) exactly; None if they don't."""
    out = []
    while start < end:
        v = tlv(data, start, end)
        if v is None:
            return None
        out.append(v)
        start = v[2]
    return out


# Algorithms of PKCS#8 keys, as encoded object identifiers.
RSA, EC, DSA = b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x01", b"\x2a\x86\x48\xce\x3d\x02\x01", b"\x2a\x86\x48\xce\x38\x04\x01"


def _sequence(data: bytes) -> list[tuple[int, int, int]] | None:
    """The values of a SEQUENCE that is all of ``data``; None if it isn't one."""
    top = tlv(data, 0, len(data))
    return children(data, top[1], top[2]) if top and top[0] == 0x30 and top[2] == len(data) else None


def _is_pkcs1(data: bytes) -> bool:
    """RSA (version 0 or 1 and eight numbers) or DSA (version and five numbers): nothing but integers, and for RSA with several primes a last list."""
    parts = _sequence(data) or []
    tags = [p[0] for p in parts]
    return len(tags) >= 6 and set(tags) <= {2, 0x30} and tags[:6] == [2] * 6 and data[parts[0][1] : parts[0][2]] in (b"\0", b"\1")


def _is_sec1(data: bytes) -> bool:
    parts = _sequence(data) or []
    return [p[0] for p in parts[:2]] == [2, 4] and data[parts[0][1] : parts[0][2]] == b"\1" and 16 <= parts[1][2] - parts[1][1] <= 80


def is_der_key(data: bytes) -> bool:
    """A private key: PKCS#8 (plain or encrypted), PKCS#1, DSA or SEC1, each nested length fitting exactly.

    The key that PKCS#8 holds in its octets must parse too, as its algorithm has it.
    """
    parts = _sequence(data)
    if not parts:
        return False
    tags = [p[0] for p in parts]
    inside = [data[p[1] : p[2]] for p in parts]
    if tags[:3] == [2, 0x30, 4]:
        named = children(data, parts[1][1], parts[1][2])
        if not named or named[0][0] != 6 or inside[0] not in (b"\0", b"\1") or not set(tags[3:]) <= {0xA0, 0x81, 0xA1}:
            return False
        kind, key = data[named[0][1] : named[0][2]], inside[2]
        if kind == RSA:
            return _is_pkcs1(key)
        if kind == EC:
            return _is_sec1(key)
        held = tlv(key, 0, len(key))
        return held is not None and held[2] == len(key) and (kind != DSA or held[0] == 2)
    if tags == [0x30, 4]:
        named = children(data, parts[0][1], parts[0][2])
        return bool(named) and named[0][0] == 6 and len(inside[1]) >= 16
    return _is_pkcs1(data) or _is_sec1(data)


def is_openssh(data: bytes) -> bool:
    """The OpenSSH private key format: magic, then cipher, kdf and options, the count of keys, their public blobs and the private blob, which ends the data.

    Ciphers that authenticate leave a tag of 16 bytes behind the last blob.
    """
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at, cipher = len(magic), b""

    def field() -> bytes | None:
        nonlocal at
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return None
        at += 4 + n
        return data[at - n : at]

    for i in range(3):
        got = field()
        if got is None:
            return False
        cipher = cipher or got
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    if not 1 <= keys <= 64 or any(not field() for _ in range(keys + 1)):
        return False
    return len(data) - at == (16 if b"gcm" in cipher or b"poly1305" in cipher else 0)


def is_encrypted_pem(headers: str, data: bytes) -> bool:
    """The old encrypted form: its headers name the cipher and a start value as long as a block, of which the data holds whole ones."""
    m = _CIPHER.search(headers)
    return bool(m) and "ENCRYPTED" in headers and len(data) > 0 and len(data) % (len(m[2]) // 2) == 0


def is_token_header(segment: str) -> bool:
    data = decode64(segment)
    try:
        head = json.loads(data or b"")
    except ValueError:
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


def confirmed(text: str) -> list[tuple[str, int, int]]:
    """Spans whose structure was confirmed by decoding, leftmost and non-overlapping for each kind."""
    out = []
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            data = decode64(m[3])
            if data and (is_der_key(data) or is_openssh(data) or is_encrypted_pem(m[2], data)):
                out.append(("pem", *m.span()))
    if "." in text:
        out += [("jwt", *m.span()) for m in _JWT.finditer(text) if is_token_header(m[1])]
    for m in _B64.finditer(text):
        data = decode64(m[0])
        if data and is_openssh(data):
            out.append(("openssh", *m.span()))
        elif data and is_der_key(data):
            out.append(("der", *m.span()))
    for m in _HEXES.finditer(text):
        data = bytes.fromhex(m[0])
        if is_openssh(data):
            out.append(("openssh", *m.span()))
        elif is_der_key(data):
            out.append(("der", *m.span()))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        pattern, group, least = BASE["assign"]
        out += [("assign", *m.span()) for m in pattern.finditer(text) if len(m[group]) >= least]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in BASE["access"][0].finditer(text) if len(m[0]) >= BASE["access"][2]]
    if _BLANKS.search(text):
        out += [("hex", *m.span()) for m in _LONG_HEX.finditer(text)]  # the runs of BASE["hex"] that are long enough
    return out


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all columns) plus secrets: array of (kind, start, end), ordered by start, then kind.

    Offsets are code points, end exclusive. Null and empty texts hold none. Whole
    texts are read; a text is scanned by itself, so rows never shuffle. A column of
    the input named ``secrets`` is replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != "secrets"]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    rank = {k: i for i, k in enumerate(KINDS)}

    def score(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts:
            t = t.as_py() or ""
            found = base_spans(t)
            if _BLANKS.search(t) or "-----BEGIN " in t:
                found += confirmed(t)
            rows.append([{"kind": k, "start": a, "end": b} for k, a, b in sorted(set(found), key=lambda x: (x[1], rank[x[0]], x[2]))])
        return pa.StructArray.from_arrays([pa.array(rows, kind)], names=["secrets"])

    return scored(docs, keep, F.col(text), score, "secrets array<struct<kind:string,start:int,end:int>>")


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of each base kind, the digest of the base spans and all spans as text, for each document.

    Null and empty texts hold none; null and repeated ids keep their rows; spans that
    start alike come in the order of their kinds. Whole texts are read; further columns
    are ignored. Empty table: no rows.
    """
    found = scan(docs.select("doc_id", "text"), keep=["doc_id"])
    said = "concat_ws(':', x.kind, cast(x.start as string), cast(x.end as string))"
    base = "x -> x.kind in ('assign', 'access', 'hex')"
    return found.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(secrets, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in BASE],
        F.sha2(F.expr(f"concat_ws(',', transform(filter(secrets, {base}), x -> {said}))"), 256).alias("base_sha256"),
        F.expr(f"concat_ws(',', transform(secrets, x -> {said}))").alias("spans"),
    )


def brute_force(text: str | None) -> dict:
    """The base columns by the plain patterns, for tests."""
    found = []
    for i, (kind, (pattern, group, least)) in enumerate(BASE.items()):
        found += [(m.start(), i, m.end(), kind) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))
    return {f"n_{k}": sum(f[3] == k for f in found) for k in BASE} | {"base_sha256": hashlib.sha256(joined.encode()).hexdigest()}
