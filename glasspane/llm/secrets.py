"""Secrets in texts, confirmed by structure.

Fixed forms (assignments, access keys, long hex) give the base spans. Besides, every long run of base64 or hex and every dotted
triple is a candidate, which is decoded and reported only if its structure holds:

* signed_token: three base64url parts of which the first is a JSON object that names an algorithm and the second a JSON object,
* key_block: a text block between BEGIN and END lines of a private key whose base64 is a key encoding, or, with a DEK-Info line, whole blocks
  of the cipher named there; its line ends may be written as \\n, as in JSON and in files of settings,
* encoded_key: base64 that decodes to a key encoding, on one line or broken into lines of one width (line ends as above, lines may be indented),
* hex_key: hex of one case that does.

A key encoding is a DER sequence whose nested lengths all fit and that holds a version and the parts of a private key
(PKCS#1, PKCS#8, SEC 1) or a password-based algorithm and what it encrypted (encrypted PKCS#8), or a binary key file of
length-prefixed fields that fill it (the format of SSH).

Texts are searched where they lie, whole; nothing is shuffled. Null texts count as empty, ids may be null or repeated, every
row gives one row. Positions are code points, the end is exclusive.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "signed_token", "key_block", "encoded_key", "hex_key")


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# Names of secrets that are assigned.
NAMES = ("password", "passwd", "secret", "token", "api_?key")
_ASSIGN = re.compile(rf"({'|'.join(map(_any_case, NAMES))})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_MAY_ASSIGN = (b"password", b"passwd", b"secret", b"token", b"key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]*)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,2}PRIVATE KEY-----((?:[^-]|-(?!----))*)-----END (?:[A-Z0-9]+ ){0,2}PRIVATE KEY-----")
_LONG64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
_LONGHEX = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9a-f]{64,}|[0-9A-F]{64,})(?![0-9A-Fa-f])")
_LINE_END = r"(?:\r?\n|(?:\\+r)?\\+n)[\x20\t]*"
_BREAK = re.compile(_LINE_END)
_LINES = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/]{{40,}}(?:{_LINE_END}[A-Za-z0-9+/]+)+")
_DEK = re.compile(r"DEK-Info:\x20*([A-Z0-9-]+),([0-9A-Fa-f]+)")

# Object identifiers of password-based encryption (PKCS#5, PKCS#12), and block sizes of ciphers by the start of their names.
PASSWORD_BASED = (b"\x2a\x86\x48\x86\xf7\x0d\x01\x05", b"\x2a\x86\x48\x86\xf7\x0d\x01\x0c\x01")
CIPHER_BLOCKS = {"AES-": 16, "CAMELLIA-": 16, "DES-": 8}
_SSH = base64.b64encode(b"openssh-key-v1").decode()[:18]


def decoded(text: str) -> bytes | None:
    """Bytes of base64 of either alphabet, with or without padding."""
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except binascii.Error:
        return None


def elements(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and contents of DER elements that fill the bytes exactly, or None."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n >= 0x80:
            width = n & 0x7F
            if not 1 <= width <= 4 or at + width > len(data) or data[at] == 0:
                return None
            n, at = int.from_bytes(data[at:at + width], "big"), at + width
            if n < 0x80:
                return None
        if at + n > len(data):
            return None
        out.append((tag, data[at:at + n]))
        at += n
    return out


def is_key(data: bytes) -> bool:
    """Whether bytes are a private key encoding."""
    if data.startswith(b"openssh-key-v1\0"):
        return _fields(data[15:])
    if len(data) < 32 or data[0] != 0x30:
        return False
    outer = elements(data)
    if not outer or len(outer) != 1:
        return False
    parts = elements(outer[0][1])
    if parts and len(parts) == 2 and [t for t, _ in parts] == [0x30, 0x04]:  # encrypted PKCS#8: algorithm, encrypted bytes
        algorithm = elements(parts[0][1])
        return bool(algorithm) and len(algorithm) == 2 and algorithm[0][0] == 0x06 and algorithm[0][1].startswith(PASSWORD_BASED) and len(parts[1][1]) >= 16
    if not parts or len(parts) < 3 or parts[0][0] != 0x02 or len(parts[0][1]) != 1:
        return False
    tags = [t for t, _ in parts]
    if len(parts) >= 9 and all(t == 0x02 for t in tags[:9]):  # PKCS#1: version and eight numbers
        return True
    if tags[1] == 0x30 and tags[2] == 0x04:  # PKCS#8: algorithm, key in an octet string
        algorithm = elements(parts[1][1])
        return bool(algorithm) and algorithm[0][0] == 0x06 and len(parts[2][1]) >= 16
    return tags[1] == 0x04 and len(parts[1][1]) >= 20 and tags[2] in (0xA0, 0xA1)  # SEC 1


def _fields(data: bytes) -> bool:
    """Cipher, derivation and its options, a count, then as many public keys and one private part: all by their lengths."""
    at = 0

    def field() -> bytes | None:
        nonlocal at
        if at + 4 > len(data):
            return None
        n = int.from_bytes(data[at:at + 4], "big")
        if at + 4 + n > len(data):
            return None
        at += 4 + n
        return data[at - n:at]
    if any(field() is None for _ in range(3)) or at + 4 > len(data):
        return False
    count = int.from_bytes(data[at:at + 4], "big")
    at += 4
    return 1 <= count <= 16 and all(field() for _ in range(count + 1)) and at == len(data)


def is_signed(head: str, body: str) -> bool:
    """Whether two parts of a token are JSON objects and the first names an algorithm."""
    try:
        first, second = (json.loads(decoded(x) or b"") for x in (head, body))
    except (ValueError, RecursionError):
        return False
    return isinstance(first, dict) and isinstance(first.get("alg"), str) and isinstance(second, dict)


def is_block(body: str) -> bool:
    """Whether the lines between BEGIN and END are a key: base64 of a key encoding, or of whole cipher blocks that a DEK-Info line announces."""
    lines = _BREAK.split(body)
    data = decoded(re.sub(r"[\s\\]", "", "".join(x for x in lines if ":" not in x))) or b""
    named = _DEK.search(body)
    if named is None:
        return is_key(data)
    size = next((n for start, n in CIPHER_BLOCKS.items() if named[1].startswith(start)), 0)
    return size > 0 and len(named[2]) == 2 * size and len(data) >= 32 and len(data) % size == 0


def _needed(line: str) -> int:
    """Base64 characters of the DER sequence that a line begins, by its own length; 0 where it begins none of up to 64 KB."""
    head = decoded(line[:8]) or b"\0"
    if head[0] != 0x30:
        return 0
    if head[1] < 0x80:
        size = 2 + head[1]
    elif head[1] in (0x81, 0x82):
        size = 2 + head[1] - 0x80 + int.from_bytes(head[2:2 + head[1] - 0x80], "big")
    else:
        return 0
    return -(-size * 4 // 3)


def broken(text: str) -> list[tuple[int, int]]:
    """Start and end of keys whose base64 is broken into lines of one width, the last one may be shorter."""
    out = []
    for m in _LINES.finditer(text):
        cuts = [(m.start(), m.start()), *((m.start() + x.start(), m.start() + x.end()) for x in _BREAK.finditer(m[0])), (m.end(), m.end())]
        lines = [(b, text[b:c]) for (_, b), (c, _) in zip(cuts, cuts[1:])]
        i, tried = 0, False
        while i < len(lines) - 1:
            at, first = lines[i]
            ssh, width = first.startswith(_SSH) and not tried, len(first)
            need = len(m[0]) if ssh else _needed(first)
            if width < 40 or need <= width:
                i += 1
                continue
            j, have = i, 0
            while j < len(lines) and have < need and len(lines[j][1]) <= width:
                have, j = have + len(lines[j][1]), j + 1
                if len(lines[j - 1][1]) < width:
                    break
            # The length that a key states may end it inside its last line, which then holds other letters: no key.
            whole = "".join(x for _, x in lines[i:j])
            if (ssh or len(whole) == need) and is_key(decoded(whole) or b""):
                stop = lines[j - 1][0] + len(lines[j - 1][1])
                while stop < len(text) and text[stop] == "=" and (len(whole) + stop - lines[j - 1][0] - len(lines[j - 1][1])) % 4:
                    stop += 1
                out.append((at, stop))
                i = j
            else:
                tried, i = tried or ssh, i + 1
    return out


def spans(body: bytes) -> list[tuple[int, int, int]]:
    """start, number of the kind, end of every secret in a text, in order."""
    text, low, out = body.decode("utf-8", "replace"), body.lower(), []
    if any(name in low for name in _MAY_ASSIGN):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in body:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if b"eyJ" in body:
        out += [(m.start(), 3, m.end()) for m in _TOKEN.finditer(text) if is_signed(m[1], m[2])]
    blocks = []
    if b"PRIVATE KEY-----" in body:
        for m in _BLOCK.finditer(text):
            if is_block(m[1]):
                blocks.append((m.start(), m.end()))
                out.append((m.start(), 4, m.end()))
    for m in _LONG64.finditer(text):
        inside = any(a <= m.start() < b for a, b in blocks)
        if not inside and is_key(decoded(m[0]) or b""):
            out.append((m.start(), 5, m.end()))
    out += [(a, 5, b) for a, b in broken(text) if not any(c <= a < d for c, d in blocks)]
    for m in _LONGHEX.finditer(text):
        if len(m[0]) % 2 == 0 and is_key(bytes.fromhex(m[0])):
            out.append((m.start(), 6, m.end()))
    return sorted(out)


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.string()), ("stop", pa.int64())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(_SPAN))])


def find(docs: DataFrame) -> DataFrame:
    """doc_id and spans (start, kind, stop; in order) of every row."""
    def work(bodies, rows):
        return {"doc_id": rows["doc_id"], "spans": [[{"start": a, "kind": KINDS[k], "stop": b} for a, k, b in spans(x)] for x in bodies]}
    rows = C.texts(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(C.by_block(work, _FOUND), "doc_id long, spans array<struct<start: long, kind: string, stop: long>>")
