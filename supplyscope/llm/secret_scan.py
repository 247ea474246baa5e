"""Secret scan with structural confirmation.

Three base patterns (assigned values, access key ids, hex runs) are always reported.  Beside them,
candidates in base64, base64url or hex and armoured key blocks are decoded, and reported only if
what comes out has the structure of a secret: a signed token whose header is JSON naming an algorithm,
a DER key whose nested lengths all fit (PKCS#1, PKCS#8, encrypted PKCS#8, SEC 1, DSA), or an OpenSSH key whose length-prefixed fields fill it.
Escaped line breaks (backslash n, r or t) in armour count as white space; base64 wrapped over lines, without armour, is joined before it is decoded;
base64 or hex of a text that holds an armoured key is a key too (one layer).

Positions are code points, ends exclusive.  Defined cases: a null text is empty and has no spans; a very
long text is scanned whole; repeated rows give repeated rows; an empty table gives no rows.  Only doc_id and text are read.
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

from supplyscope.llm.common import map_arrow, text_of

# The base patterns and the least lengths of what they report.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of [0-9a-f]+ that are long enough
BASE_KINDS = ("assign", "access", "hex")

# Candidates of the structural step, and the kinds in the order of equal starts.
SIGNED = re.compile(r"([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")
PACKED = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
HEX_PACKED = re.compile(r"[0-9A-Fa-f]{64,}")
ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:[A-Za-z0-9+/=\s]|\\+(?:[nrt/]|u002[fFbB]|u003[dD]))*)-----END \1-----")
ESCAPE = re.compile(r"\\+(?:([nrt])|(/)|u00(2[fFbB]|3[dD]))")
BREAK = r"(?:[\x20\t]*\r?\n[\x20\t]*|(?:\\+r)?\\+n)"
WRAPPED = re.compile(rf"(?:(?<=\\n)|(?<![A-Za-z0-9+/_\\-]))[A-Za-z0-9+/_-]{{16,}}(?:{BREAK}[A-Za-z0-9+/_-]+)+={{0,2}}")
BROKEN = re.compile(BREAK)
KINDS = (*BASE_KINDS, "signed_token", "key_block", "base64_key", "hex_key")
OPENSSH_MAGIC = b"openssh-key-v1\0"


def _decode64(text: str) -> bytes | None:
    """The bytes of base64 or base64url text, padded or not; None if it is neither."""
    text = text.rstrip("=").translate({45: "+", 95: "/"})
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _json(data: bytes | None) -> dict | None:
    try:
        got = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def is_signed_token(header: str, payload: str) -> bool:
    """A header that decodes to JSON naming an algorithm, and a payload that decodes to a JSON object."""
    head = _json(_decode64(header))
    return bool(head) and isinstance(head.get("alg"), str) and _json(_decode64(payload)) is not None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """The (tag, content) items that fill ``data`` exactly, lengths in shortest form; None if they don't."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > len(data):
                return None
            n = int.from_bytes(data[at:at + k], "big")
            if n < 128 or (k > 1 and n < 1 << 8 * (k - 1)):
                return None
            at += k
        if at + n > len(data):
            return None
        items.append((tag, data[at:at + n]))
        at += n
    return items


INTEGER, OCTETS, OBJECT_ID, SEQUENCE = 0x02, 0x04, 0x06, 0x30


def is_der_key(data: bytes) -> bool:
    """A private key in DER: PKCS#1, SEC 1, PKCS#8, or encrypted PKCS#8."""
    if len(data) < 32 or data[0] != SEQUENCE:
        return False
    outer = der_items(data)
    if not outer or len(outer) != 1:
        return False
    inner = der_items(outer[0][1])
    if not inner or len(inner) < 2:
        return False
    tags = [t for t, _ in inner]
    if tags[0] == INTEGER and inner[0][1] in (b"\0", b"\1"):
        if len(tags) >= 9 and all(t == INTEGER for t in tags[:9]):  # version, modulus, exponents, primes ...
            return len(inner[1][1]) >= 32
        if len(tags) == 6 and all(t == INTEGER for t in tags):  # DSA: version 0, p, q, g, public and private key
            return inner[0][1] == b"\0" and len(inner[1][1]) >= 64 and 20 <= len(inner[2][1]) <= 33 and len(inner[5][1]) <= len(inner[2][1])
        if tags[1] == OCTETS:  # SEC 1: version 1, key
            return inner[0][1] == b"\1" and 16 <= len(inner[1][1]) <= 80
        if len(tags) >= 3 and tags[1] == SEQUENCE and tags[2] == OCTETS:  # PKCS#8: version, algorithm, key
            algorithm = der_items(inner[1][1])
            return bool(algorithm) and algorithm[0][0] == OBJECT_ID and len(inner[2][1]) >= 16
    if tags == [SEQUENCE, OCTETS]:  # encrypted PKCS#8: algorithm, data
        algorithm = der_items(inner[0][1])
        return bool(algorithm) and algorithm[0][0] == OBJECT_ID and len(inner[1][1]) >= 16
    return False


def is_openssh_key(data: bytes) -> bool:
    """An OpenSSH private key: magic, three named fields, the number of keys, public keys, one private part to the end."""
    if not data.startswith(OPENSSH_MAGIC):
        return False
    at = len(OPENSSH_MAGIC)

    def field() -> bytes | None:
        nonlocal at
        n = int.from_bytes(data[at:at + 4], "big")
        if at + 4 + n > len(data):
            return None
        at += 4 + n
        return data[at - n:at]

    if any(field() is None for _ in range(3)) or at + 4 > len(data):
        return False
    keys = int.from_bytes(data[at:at + 4], "big")
    at += 4
    if not 1 <= keys <= 16 or any(not field() for _ in range(keys)):
        return False
    return bool(field()) and at == len(data)


def is_key(data: bytes | None) -> bool:
    return data is not None and (is_der_key(data) or is_openssh_key(data))


def _armoured(text: str) -> list[tuple[int, int]]:
    """(start, end) of the armoured blocks that decode to a key."""
    out = []
    if "-----BEGIN" in text:
        for m in ARMOUR.finditer(text):
            body = ESCAPE.sub(lambda e: " " if e[1] else e[2] or chr(int(e[3], 16)), m[2]) if "\\" in m[2] else m[2]
            if is_key(_decode64("".join(body.split()))):
                out.append((m.start(), m.end()))
    return out


def holds_key(data: bytes | None) -> bool:
    """A key, or a text with an armoured key."""
    return data is not None and (is_key(data) or (b"-----BEGIN" in data and bool(_armoured(data.decode("latin-1")))))


def _encoded_size(data: bytes) -> int | None:
    """The length that the key at the start of ``data`` says it has."""
    if len(data) > 2 and data[0] == SEQUENCE:
        k = data[1] & 0x7F
        return 2 + k + int.from_bytes(data[2:2 + k], "big") if data[1] & 0x80 else 2 + k
    if data.startswith(OPENSSH_MAGIC):
        at = len(OPENSSH_MAGIC)
        number = lambda: int.from_bytes(data[at:at + 4], "big")
        for _ in range(3):
            at += 4 + number()
        keys, at = number(), at + 4
        for _ in range(keys + 1 if keys <= 16 else 0):
            at += 4 + number()
        return at
    m = ARMOUR.search(data.decode("latin-1")) if b"-----BEGIN" in data else None
    return m.end() if m else None


def _wrapped(text: str) -> list[tuple[int, int]]:
    """(start, end) of the keys in base64 over two or more lines.  A key may start at any line and ends at the line that its length tells."""
    out = []
    for m in WRAPPED.finditer(text):
        lines, at = [], m.start()
        for b in BROKEN.finditer(text, m.start(), m.end()):
            lines.append((at, b.start()))
            at = b.end()
        lines.append((at, m.end()))
        first = 0
        while first < len(lines):
            last = _last_line(text, lines, first)
            if last is not None:
                out.append((lines[first][0], lines[last][1]))
                first = last
            first += 1
    return out


def _last_line(text: str, lines: list[tuple[int, int]], first: int) -> int | None:
    """The line with which a key of two or more lines ends that starts with line ``first``."""
    start = text[lines[first][0]:lines[first][0] + 5]
    if first and not start.startswith(("M", "b3Blb", "LS0tL")):  # DER, OpenSSH, armour
        return None
    run = "".join(text[a:b] for a, b in lines[first:]).rstrip("=")
    data = _decode64(run[:len(run) // 4 * 4] if len(run) % 4 == 1 else run)
    size = _encoded_size(data) if data else None
    if size is None or size > len(data):
        return None
    n, last = -(-size * 4 // 3), first  # characters without padding
    while n > (own := len(text[lines[last][0]:lines[last][1]].rstrip("="))) and last + 1 < len(lines):
        n, last = n - own, last + 1
    return last if last > first and holds_key(data[:size]) else None


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base patterns, in order."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):  # else no match is possible
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def structural_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the candidates whose decoded structure is that of a secret."""
    out = []
    if "." in text and "ey" in text:  # a header in base64url starts with {" or { and a space
        out += [(m.start(), 3, m.end()) for m in SIGNED.finditer(text) if is_signed_token(m[1], m[2])]
    blocks = _armoured(text)
    out += [(a, 4, b) for a, b in blocks]
    out += [(a, 5, b) for a, b in _wrapped(text) if not any(x <= a and b <= y for x, y in blocks)]
    for m in PACKED.finditer(text):
        if holds_key(_decode64(m[0])):
            out.append((m.start(), 5, m.end()))
        if len(m[0]) >= 64:  # hex runs are runs of this class too
            out += [(h.start(), 6, h.end()) for h in HEX_PACKED.finditer(text, m.start(), m.end())
                    if (h.end() - h.start()) % 2 == 0 and holds_key(bytes.fromhex(h[0]))]
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_confirmed long, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: counts of each base kind, of confirmed structures, the digest of
    the base spans, and all spans as ``kind:start:end`` joined by commas, by start and then by kind."""

    def run(batch: pa.RecordBatch):
        cols: list[list] = [[] for _ in range(6)]
        for value in batch.column(1):
            text = value.as_py() or ""
            base = base_spans(text)
            more = structural_spans(text)
            counts = [sum(k == i for _, k, _ in base) for i in range(3)]
            row = (*counts, len(more), hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + more)))
            for c, v in zip(cols, row):
                c.append(v)
        types = [pa.int64()] * 4 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))],
                                         names=["doc_id", "n_assign", "n_access", "n_hex", "n_confirmed", "base_sha256", "spans"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), text_of()), SCHEMA, run)
