"""Secret scans with structural confirmation.

Three base patterns mark assignments, access keys and hex strings.  Beyond
them, longer base64 and hex candidates are decoded and reported only if their
structure holds: nested lengths of DER keys, the fields of SSH keys, the
header of signed tokens.
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

from ._common import table, whole_texts

BASE = ("assign", "access", "hex")
CONFIRMED = ("pem", "token", "der", "ssh")
KINDS = BASE + CONFIRMED


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join([_either(w) for w in ("password", "passwd", "secret", "token")] + [_either("api") + "_?" + _either("key")])
ASSIGN = re.compile(rf"""(?:{KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# a word without its first letter is enough to tell whether ASSIGN can match at all
HINT = re.compile(r"""(?:[dD]|[tT]|[nN]|[yY])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]""")
HEX = re.compile(r"[0-9a-f]{32,}")
LONG_HEX = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){24,}(?![0-9A-Fa-f])")
#: Pairs of hex digits parted by colons, over lines too.
COLON_HEX = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}:\s*){23,}[0-9A-Fa-f]{2}(?![0-9A-Fa-f])")
#: A run of base64, which may go on over line ends, plain or escaped.
B64 = re.compile(r"[A-Za-z0-9+/_-]{40,}(?:(?:\\[rn]|[\r\n])+[\x20\t]*[A-Za-z0-9+/_-]+)*={0,2}")
BREAKS = re.compile(r"\\[rn]|\s")
#: How a DER sequence, an SSH key of either kind begin in base64.
STARTS = re.compile(r"(?=M[A-P]|AAAA|b3Bl)")
#: JSON begins with a brace or a blank, so the base64 of header and payload with one of four letters.
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])([eICD][A-Za-z0-9_-]{7,})\.([eICD][A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])")
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----((?:[A-Za-z0-9+/=\s:,-]|\\[rn])*?)-----END \1-----")
#: Header lines of the old encrypted form: a cipher and its initial vector.
DEK = re.compile(r"Proc-Type:\s*4,ENCRYPTED\s*DEK-Info:\s*([A-Z0-9-]+),([0-9A-Fa-f]+)\s+([A-Za-z0-9+/=\s]+)")
#: Object identifiers of key algorithms: RSA, RSA-PSS, EC, Ed25519, Ed448, X25519, X448, DSA.
OIDS = {bytes.fromhex(x) for x in ("2a864886f70d010101", "2a864886f70d01010a", "2a8648ce3d0201", "2b6570", "2b6571", "2b656e", "2b656f", "2a8648ce380401")}
#: And of what encrypts them: PBES2, PBES1 and the PKCS#12 schemes.
LOCKS = {bytes.fromhex(x) for x in ("2a864886f70d01050d", *(f"2a864886f70d0105{k:02x}" for k in (1, 3, 4, 6, 10, 11)), *(f"2a864886f70d010c01{k:02x}" for k in range(1, 7)))}
SSH_FIELDS = {b"ssh-rsa": 3, b"ssh-dss": 5, b"ssh-ed25519": 2, b"ssh-ed448": 2, b"ecdsa-sha2-nistp256": 3, b"ecdsa-sha2-nistp384": 3, b"ecdsa-sha2-nistp521": 3, b"sk-ssh-ed25519@openssh.com": 3, b"sk-ecdsa-sha2-nistp256@openssh.com": 4}


def _b64(s: str) -> bytes | None:
    body = s.rstrip("=")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """The tag-length-value items that fill data exactly, or None."""
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
            n, at = int.from_bytes(data[at : at + k], "big"), at + k
            if n < 0x80:
                return None
        if at + n > len(data):
            return None
        items.append((tag, data[at : at + n]))
        at += n
    return items


def is_der_key(data: bytes) -> bool:
    """PKCS#1, PKCS#8, SEC1 or SubjectPublicKeyInfo, by nested lengths and types."""
    outer = der_items(data) if data[:1] == b"\x30" else None
    if not outer or len(outer) != 1:
        return False
    inner = der_items(outer[0][1])
    if not inner:
        return False
    tags = [t for t, _ in inner]
    if len(tags) == 9 and set(tags) == {2}:
        return inner[0][1] in (b"\0", b"\1") and 2 * len(inner[3][1]) >= len(inner[1][1]) // 2
    algorithm = {0x02: 1, 0x30: 0}.get(tags[0])
    if algorithm is not None and len(inner) > algorithm + 1 and tags[algorithm] == 0x30:
        parts = der_items(inner[algorithm][1])
        if parts and parts[0][0] == 0x06 and parts[0][1] in OIDS:
            return tags[algorithm + 1] == (0x04 if algorithm else 0x03)
        if parts and parts[0][0] == 0x06 and parts[0][1] in LOCKS:
            return tags == [0x30, 0x04]
    if len(inner) >= 2 and inner[0] == (2, b"\1") and tags[1] == 0x04 and len(inner[1][1]) in (28, 32, 48, 66):
        return all(t in (0xA0, 0xA1) for t in tags[2:])
    return len(tags) == 2 and tags == [2, 2] and len(inner[0][1]) >= 64 and len(inner[1][1]) in (1, 3)


def _field(data: bytes, at: int) -> tuple[bytes, int] | None:
    """A length-prefixed field and where it ends, or None if there isn't so much."""
    n = int.from_bytes(data[at : at + 4], "big")
    return (data[at + 4 : at + 4 + n], at + 4 + n) if at + 4 + n <= len(data) and at + 4 <= len(data) else None


def _ssh_public_end(data: bytes) -> int | None:
    got = _field(data, 0)
    count = SSH_FIELDS.get(got[0]) if got else None
    for _ in range((count or 0) - 1):
        got = _field(data, got[1])
        if not got:
            return None
    return got[1] if count else None


def ssh_end(data: bytes) -> int | None:
    """Where an SSH key that begins data ends, or None: a public one, or an OpenSSH private one.

    The private one is read to its end: cipher, derivation and its options,
    the public keys, and the private part, whose two check numbers are equal
    where nothing encrypts it.
    """
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return _ssh_public_end(data)
    fields, at = [], len(magic)
    for _ in range(3):
        got = _field(data, at)
        if not got:
            return None
        fields.append(got[0])
        at = got[1]
    count = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= count <= 64:
        return None
    for _ in range(count):
        got = _field(data, at)
        if not got or _ssh_public_end(got[0]) != len(got[0]):
            return None
        at = got[1]
    got = _field(data, at)
    if not got or len(got[0]) < 8 or (fields[0] == b"none" and got[0][:4] != got[0][4:8]):
        return None
    return got[1]


def is_ssh_key(data: bytes) -> bool:
    """An SSH key, public or private, that fills data exactly."""
    return ssh_end(data) == len(data) > 0


def _der_end(data: bytes) -> int | None:
    """Where the sequence that begins data ends by its own length, or None."""
    if len(data) < 6 or data[0] != 0x30:
        return None
    n, at = data[1], 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4:
            return None
        n, at = int.from_bytes(data[2 : 2 + k], "big"), 2 + k
        if n < 0x80:
            return None
    return at + n if data[at] in (0x02, 0x30) and at + n >= 24 else None


def key_in_base64(run: str) -> tuple[int, int, str] | None:
    """Start, end and kind of the first key that a run of base64 holds from some character on."""
    for m in STARTS.finditer(run):
        at = m.start()
        if run[at] == "M":
            end = _der_end(_b64(run[at : at + 12]) or b"")
            stop = at + -(-(end or 0) * 4 // 3)
            if end and stop <= len(run) and (data := _b64(run[at:stop])) and is_der_key(data[:end]):
                return at, stop, "der"
        elif (data := _b64(run[at : len(run) - (len(run) - at) % 4 if (len(run) - at) % 4 == 1 else len(run)])) and (end := ssh_end(data)):
            return at, at + -(-end * 4 // 3), "ssh"
    return None


def is_signed_token(head: str, body: str) -> bool:
    """A JSON header that names its algorithm, and a JSON object as payload."""
    try:
        h, b = (json.loads((_b64(x) or b"").decode("utf-8")) for x in (head, body))
    except (UnicodeDecodeError, ValueError, RecursionError):
        return False
    return isinstance(h, dict) and isinstance(h.get("alg"), str) and isinstance(b, dict)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping matches of each base kind that pass, in code points."""
    out = []
    if HINT.search(text):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def is_locked_key(body: str) -> bool:
    """The old encrypted form: a cipher with an initial vector of its block's size, over whole blocks."""
    m = DEK.fullmatch(body.strip())
    data = _b64("".join(m.group(3).split())) if m else None
    block = 16 if m and m.group(1).startswith(("AES", "CAMELLIA", "ARIA", "SEED")) else 8
    return bool(data) and len(m.group(2)) == 2 * block and len(data) % block == 0


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """Candidates whose decoded structure holds; none lies in another one of them."""
    out = []
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            data = _b64(BREAKS.sub("", m.group(2)))
            if (data and (is_der_key(data) or is_ssh_key(data))) or is_locked_key(m.group(2).replace("\\r", "").replace("\\n", "\n")):
                out.append((m.start(), m.end(), "pem"))
    if "." in text:
        out += [(m.start(), m.end(), "token") for m in TOKEN.finditer(text) if is_signed_token(m.group(1), m.group(2))]
    known = list(out)
    inside = lambda a, b: any(x <= a and b <= y for x, y, _ in known)
    for m in B64.finditer(text):
        if inside(*m.span()) or not STARTS.search(m.group()):
            continue
        raw = m.group().rstrip("=")
        run = BREAKS.sub("", raw) if len(BREAKS.split(raw, maxsplit=1)) > 1 else raw
        if found := key_in_base64(run):
            start, end, kind = found
            if run is raw:
                places = (start, end)
            else:  # back to places in the text
                kept = [i for i in _kept(raw)]
                places = (kept[start], kept[end - 1] + 1)
            stop = m.start() + places[1]
            while stop < m.end() and text[stop] == "=":
                stop += 1
            out.append((m.start() + places[0], stop, kind))
    for pattern in (LONG_HEX, COLON_HEX):
        for m in pattern.finditer(text):
            data = bytes.fromhex(re.sub(r"[:\s]", "", m.group()))
            if not inside(*m.span()) and (is_der_key(data) or is_ssh_key(data)):
                out.append((*m.span(), "der" if is_der_key(data) else "ssh"))
    return out


def _kept(raw: str):
    """Places of the characters that BREAKS leaves."""
    at = 0
    for m in BREAKS.finditer(raw):
        yield from range(at, m.start())
        at = m.end()
    yield from range(at, len(raw))


def scan_text(text: str) -> tuple[list, list]:
    """(base spans, all spans), each by start, then kind."""
    base = base_spans(text)
    more = confirmed_spans(text)
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]))) if more else base


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans, mark: str = "[{}]") -> str:
    """text with each run of overlapping spans replaced by a mark naming its first kind."""
    out, at, i = [], 0, 0
    while i < len(spans):
        a, b, kind = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] < b:
            i += 1
            b = max(b, spans[i][1])
        out += [text[at:a], mark.format(kind.upper())]
        at, i = b, i + 1
    return "".join(out) + text[at:]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row, over whole texts.

    Narrow: one pass, nothing is exchanged.  Null texts count as empty and
    have no spans; texts of any length are scanned whole; null doc_ids and
    repeated rows are scanned like others; spans that start together (ties)
    come by kind; other columns are not read, whatever their names; an empty
    table gives no rows.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, every = scan_text(text)
                kinds = [k for _, _, k in base]
                rows.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            cols = list(zip(*rows)) or [[]] * 5
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    whole_texts(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every secret of the text replaced by its kind in brackets; null texts stay null."""

    def run(series):
        import pandas as pd

        for texts in series:
            yield pd.Series([None if t is None else redact(t, scan_text(t)[1]) for t in texts], dtype=object)

    whole_texts(docs.sparkSession)
    clean = F.pandas_udf(run, "string", functionType=F.PandasUDFType.SCALAR_ITER)
    return docs.withColumn("text", clean("text"))


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
