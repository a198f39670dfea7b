"""Secret scans by structural confirmation.

Three base patterns (assignments, access keys, long hexadecimal runs) are
reported as they match. Beyond them a candidate is decoded and reported only if
its bytes have the structure of a secret:

- `der`, in base64 or hexadecimal anywhere in a run of such characters, wrapped
  over lines or not: a DER element whose length tells where it ends and whose
  nested lengths all close: PKCS#1, SEC1, DSA, PKCS#8 (with the key inside parsed
  as its algorithm asks) or encrypted PKCS#8; or an OpenSSH container, of which
  every nested string is parsed.
- `pem`: an armoured block with one of these, or with an encrypted body whose
  headers give a cipher, an initial vector and whole blocks of that cipher.
- `token`: a signed token whose header is JSON with an `alg` other than none and
  whose payload and non-empty signature decode.

Defined cases: null and empty texts have no spans; every row is scanned whole
and by itself, so ties, repeated rows and empty tables need no rule; keys are
found whatever their size, and wrapped at four characters or more; other columns are ignored by the query and
kept by `with_secrets`, which raises if out_col is one of them.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import small_batches, table

KINDS = ("assign", "access", "hex", "pem", "der", "token")
_BASE = 3
_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
_ASSIGN_HINTS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_BREAK = r"(?:\r?\n|\\r\\n|\\n)[ \t]*"
_PEM = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]*PRIVATE KEY)-----")
_HEADERS = re.compile(r"Proc-Type: ?4,ENCRYPTED\s+DEK-Info: ?([A-Z0-9-]+),([0-9A-Fa-f]+)\s")
_BASE64 = re.compile(rf"[A-Za-z0-9+/]+(?:{_BREAK}[A-Za-z0-9+/]+)*")
#: Where a DER sequence or an OpenSSH container may begin, in lines of four characters or more.
_BEGINS = re.compile(r"M(?=[A-P][A-Za-z0-9+/]{2})|b(?=3Bl)")
_HEX = re.compile(r"[0-9a-f]{32,}")
_HEXES = re.compile(rf"[0-9A-Fa-f]+(?:{_BREAK}[0-9A-Fa-f]+)*")
_HEX_BEGINS = re.compile(r"3(?=0[0-9A-Fa-f]{2})|6(?=[fF]70)")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
#: Characters that are looked at first, and how far a container without a length of its own is looked for at once.
_HEAD, _REACH = 200, 1 << 17
_MAGIC = b"openssh-key-v1\0"
# Object identifiers in DER, and block sizes of PEM ciphers.
_RSA, _EC, _DSA, _DH = (bytes.fromhex(x) for x in ("2a864886f70d010101", "2a8648ce3d0201", "2a8648ce380401", "2a864886f70d010301"))
_CURVES = {bytes.fromhex("2b656e"): 32, bytes.fromhex("2b656f"): 56, bytes.fromhex("2b6570"): 32, bytes.fromhex("2b6571"): 57}
_PBES, _PKCS12 = bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01")
_BLOCKS = {"AES": 16, "DES": 8, "CAMELLIA": 16, "SEED": 16, "IDEA": 8, "RC2": 8, "BF": 8, "CAST5": 8}


def _tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the contents of the DER element at `at`, if it closes by `end`."""
    if at + 2 > end:
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n >= 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end:
            return None
        n, at = int.from_bytes(data[at:at + k], "big"), at + k
    return (tag, at, at + n) if at + n <= end else None


def _members(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    found = []
    while at < end:
        x = _tlv(data, at, end)
        if x is None:
            return None
        found.append(x)
        at = x[2]
    return found


def _integers(data: bytes, at: int, end: int, n: int) -> bool:
    parts = _members(data, at, end)
    return bool(parts) and len(parts) == n and all(t == 0x02 and a < b for t, a, b in parts)


def _is_rsa(data: bytes, at: int, end: int) -> bool:
    parts = _members(data, at, end)
    if not parts or len(parts) < 9 or any(t != 0x02 or a == b for t, a, b in parts[:9]):
        return False
    version = data[parts[0][1]:parts[0][2]]
    return version == b"\0" and len(parts) == 9 or version == b"\1" and len(parts) == 10 and parts[9][0] == 0x30


def _is_ec(data: bytes, at: int, end: int) -> bool:
    parts = _members(data, at, end)
    if not parts or len(parts) < 2 or data[parts[0][1]:parts[0][2]] != b"\1" or parts[0][0] != 0x02:
        return False
    known = all(t in (0xA0, 0xA1) and _members(data, a, b) for t, a, b in parts[2:])
    return known and parts[1][0] == 0x04 and 16 <= parts[1][2] - parts[1][1] <= 72


def _is_dsa(data: bytes, at: int, end: int) -> bool:
    return _integers(data, at, end, 6) and data[at:at + 3] == b"\x02\x01\0"


def _is_inner_key(algorithm: bytes, data: bytes, at: int, end: int) -> bool:
    """The key in the octet string of a PKCS#8 container, as its algorithm asks."""
    top = _tlv(data, at, end)
    if top is None or top[2] != end:
        return False
    tag, a, b = top
    if algorithm == _RSA:
        return tag == 0x30 and _is_rsa(data, a, b)
    if algorithm == _EC:
        return tag == 0x30 and _is_ec(data, a, b)
    if algorithm in (_DSA, _DH):
        return tag == 0x02 and a < b
    if algorithm in _CURVES:
        return tag == 0x04 and b - a == _CURVES[algorithm]
    # an algorithm that isn't known here: a whole element of a kind that keys have
    return tag == 0x30 and bool(_members(data, a, b)) or tag in (0x02, 0x04) and b - a >= 16


def _is_pkcs8(data: bytes, at: int, end: int) -> bool:
    parts = _members(data, at, end)
    if not parts or len(parts) < 3 or [p[0] for p in parts[:3]] != [0x02, 0x30, 0x04] or data[parts[0][1]:parts[0][2]] not in (b"\0", b"\1"):
        return False
    kind = _members(data, *parts[1][1:])
    more = all(t in (0xA0, 0xA1, 0x81) for t, _, _ in parts[3:])
    return bool(kind) and kind[0][0] == 0x06 and more and _is_inner_key(data[kind[0][1]:kind[0][2]], data, *parts[2][1:])


def _is_encrypted(data: bytes, at: int, end: int) -> bool:
    parts = _members(data, at, end)
    if not parts or [p[0] for p in parts] != [0x30, 0x04] or parts[1][2] - parts[1][1] < 16:
        return False
    kind = _members(data, *parts[0][1:])
    if not kind or len(kind) != 2 or kind[0][0] != 0x06 or kind[1][0] != 0x30 or not _members(data, *kind[1][1:]):
        return False
    return data[kind[0][1]:kind[0][2]].startswith((_PBES, _PKCS12))


def _strings(data: bytes, at: int, n: int) -> tuple[list[bytes], int] | None:
    """The n strings from `at` on, each after its length, and where they end."""
    found = []
    for _ in range(n):
        size = int.from_bytes(data[at:at + 4], "big")
        if at + 4 + size > len(data):
            return None
        found.append(data[at + 4:at + 4 + size])
        at += 4 + size
    return found, at


def _openssh_end(data: bytes) -> int:
    """Where an OpenSSH container that begins data ends; 0 if it is none."""
    head = _strings(data, len(_MAGIC), 3) if data.startswith(_MAGIC) else None
    if head is None or not re.fullmatch(rb"[a-z0-9@.-]+", head[0][0]) or not re.fullmatch(rb"[a-z0-9]+", head[0][1]):
        return 0
    (cipher, _, _), at = head
    n = int.from_bytes(data[at:at + 4], "big")
    body = _strings(data, at + 4, n + 1) if 1 <= n <= 16 else None
    if body is None:
        return 0
    *public, private = body[0]
    names = [_strings(p, 0, 1) for p in public]
    if any(x is None or not re.fullmatch(rb"[a-z0-9@.-]+", x[0][0]) for x in names) or len(private) < 16 or len(private) % 8:
        return 0
    if cipher == b"none":
        first = _strings(private, 8, 1)
        if private[:4] != private[4:8] or first is None or first[0][0] != names[0][0][0]:
            return 0
    return body[1]


def key_end(data: bytes) -> int:
    """Where a private key that begins data ends; 0 if it has not the structure of one."""
    if data.startswith(_MAGIC):
        return _openssh_end(data)
    top = _tlv(data, 0, len(data))
    if top is None or top[0] != 0x30:
        return 0
    _, a, b = top
    return b if any(f(data, a, b) for f in (_is_rsa, _is_ec, _is_dsa, _is_pkcs8, _is_encrypted)) else 0


def is_private_key(data: bytes) -> bool:
    """Exactly a private key in DER or in an OpenSSH container."""
    return bool(data) and key_end(data) == len(data)


def is_signed_token(text: str) -> bool:
    try:
        header, _, signature = (base64.urlsafe_b64decode(x + "=" * (-len(x) % 4)) for x in text.split("."))
        header = json.loads(header)
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and header["alg"].lower() != "none" and len(signature) > 0


def _from_base64(text: str) -> bytes:
    body = "".join(text.split()).rstrip("=")
    body = body[:len(body) - (len(body) % 4 == 1)]
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4))
    except (ValueError, binascii.Error):
        return b""


def _pem_spans(text: str) -> list[tuple[int, int]]:
    """Each BEGIN with the END that follows it at once, if what is between them has the structure of a key."""
    found, begin = [], None
    for m in _PEM.finditer(text):
        if m[1] == "END" and begin is not None and begin[2] == m[2] and _is_armoured(text[begin.end():m.start()]):
            found.append((begin.start(), m.end()))
        begin = m if m[1] == "BEGIN" else None
    return found


def _is_armoured(body: str) -> bool:
    body = body.replace("\\r", "").replace("\\n", "\n")
    headers = _HEADERS.match(body.lstrip())
    if headers is None:
        return re.fullmatch(r"[A-Za-z0-9+/=\s]+", body, re.ASCII) is not None and is_private_key(_from_base64(body))
    block = _BLOCKS.get(headers[1].split("-")[0])
    data = _from_base64(body.lstrip()[headers.end():])
    return block is not None and len(headers[2]) == 2 * block and len(data) >= 2 * block and len(data) % block == 0


def _run(text: str, run, at: int, characters: int) -> tuple[str, str]:
    """The run of encoded characters from `at` on, as it stands and without line breaks, at least so many if it has them."""
    reach = 2 * characters + _HEAD
    while True:
        whole = run.match(text, at, at + reach)[0]
        clean = re.sub(_BREAK, "", whole) if "\n" in whole or "\\" in whole else whole
        if len(clean) >= characters or len(whole) < reach - 8 or at + reach >= len(text):  # a break can be cut in two
            return whole, clean
        reach *= 4


def _behind(whole: str, characters: int) -> int:
    """Where so many characters of a run, line breaks not counted, end."""
    at = 0
    for gap in re.finditer(_BREAK, whole) if len(whole) > characters else ():
        if gap.start() - at >= characters:
            break
        characters -= gap.start() - at
        at = gap.end()
    return at + characters


def _key_spans(text: str, run, begins, decode, per: tuple[int, int]) -> list[tuple[int, int]]:
    """Keys in runs of encoded characters, per[0] of which hold per[1] bytes; a length in the first bytes tells how many belong to one."""
    found, done = [], 0
    for x in begins.finditer(text):
        at = x.start()
        if at < done:
            continue
        head = decode(_run(text, run, at, 40)[1][:40])
        if head[:1] == b"0":
            top = _tlv(head, 0, 1 << 40)
            # all that is looked for goes on with an integer of one byte or a sequence
            if top is None or head[top[1]:top[1] + 2] != b"\x02\x01" and head[top[1]:top[1] + 1] != b"0":
                continue
            size = top[2]
            needed = -(-size * per[0] // per[1])
            if needed > len(text) - at:
                continue
            whole, clean = _run(text, run, at, needed)
            end = key_end(decode(clean[:needed])[:size])
        elif head.startswith(_MAGIC):
            end, needed = 0, _REACH
            while not end:
                whole, clean = _run(text, run, at, needed)
                end = key_end(decode(clean))
                if len(clean) < needed:
                    break
                needed *= 4
        else:
            continue
        if not end:
            continue
        used = -(-end * per[0] // per[1])
        done = at + _behind(whole, used)
        if decode is _from_base64:  # what fills the last group
            after = text[done:done + 2]
            done += min(-used % 4, len(after) - len(after.lstrip("=")))
        found.append((at, done))
    return found


def _from_hex(text: str) -> bytes:
    return bytes.fromhex(text[:len(text) // 2 * 2])


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """(start, index in KINDS, end) of every secret, sorted; code points, end exclusive."""
    found = []
    low = text.lower()
    if any(h in low for h in _ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    armoured = _pem_spans(text) if "-----BEGIN " in text else []
    found += [(a, 3, b) for a, b in armoured]
    keys = _key_spans(text, _BASE64, _BEGINS, _from_base64, (4, 3)) + _key_spans(text, _HEXES, _HEX_BEGINS, _from_hex, (2, 1))
    found += [(a, 4, b) for a, b in keys if not any(x <= a < y for x, y in armoured)]
    if "eyJ" in text:
        found += [(m.start(), 5, m.end()) for m in _TOKEN.finditer(text) if is_signed_token(m[0])]
    return sorted(set(found))


def _scan(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans_of(t)] for t in texts.fillna("")])


def with_secrets(docs: DataFrame, text_col: str = "text", out_col: str = "secrets") -> DataFrame:
    """docs with out_col: array of (kind, start, end), by start and then kind."""
    if out_col in docs.columns:
        raise ValueError(f"there is a column {out_col} already")
    small_batches(docs.sparkSession)
    scan = F.pandas_udf(_scan, "array<struct<kind:string,start:long,end:long>>")
    return docs.withColumn(out_col, scan(F.coalesce(F.col(text_col), F.lit(""))))


def _joined(column: str):
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_secrets(docs).drop("text")
    base = F.filter("secrets", lambda s: s["kind"].isin(*KINDS[:_BASE]))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.withColumn("base", base).select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS[:_BASE]),
        F.sha2(_joined("base"), 256).alias("base_sha256"),
        _joined("secrets").alias("spans"))


def digest(spans: list[tuple[int, int, int]]) -> str:
    """base_sha256 of spans, for tests."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans if k < _BASE).encode()).hexdigest()


QUERIES = {"op10_secret_scan": op10_secret_scan}
ORACLE_SQL: dict[str, str] = {}
