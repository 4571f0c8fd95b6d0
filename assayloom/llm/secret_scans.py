"""Secret scans: structural confirmation.

Three plain kinds are reported by pattern alone. Everything else is a candidate first - a place in base64 or hex where a key's
encoding may start, an armoured block, a dotted token - and is reported only if it decodes and what comes out has the
structure of a secret: nested DER lengths that fit and the fields of a private key, plain or encrypted, the length-prefixed strings of
an OpenSSH private key, the headers of a key encrypted in its armour, or a token whose header is JSON naming an algorithm.
The lengths in the encoding say where a key ends, so base64 may be wrapped over lines, by real or escaped breaks, and text
may stand right before or after it.

Edge cases: a null text counts as empty and has no spans; the digest of no spans is that of the empty string; spans of different
kinds may overlap, but those of one plain kind never do, nor does a key repeat the armour it stands in; repeated rows give
repeated results; other columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession

from assayloom.llm._shared import map_texts, small_batches, table

#: The order of kinds at the same start.
KINDS = ("assign", "access", "hex", "jwt", "key", "pem")
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
DOTTED = re.compile(r"(?<![A-Za-z0-9_-])(e[wy][A-Za-z0-9_-]{6,})\.([A-Za-z0-9_-]*)\.([A-Za-z0-9_-]*)(?:\.([A-Za-z0-9_-]*)\.([A-Za-z0-9_-]*))?")
RUN = re.compile(r"[A-Za-z0-9+/_-]{40,}")
#: What the base64 of a DER sequence and of an OpenSSH key start with.
START = re.compile(r"M[A-P]|b3BlbnNzaC1rZXktdjE")
PART, GAP = re.compile(r"[A-Za-z0-9+/_-]+"), re.compile(r"\r?\n[ \t]*|\\r\\n|\\n")
HEX_RUN = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){48,}(?![0-9A-Fa-f])")
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----((?:(?!-----)[\s\S])*)-----END \1-----")
HEADER = re.compile(r"[A-Za-z][A-Za-z-]*:")
CIPHER = re.compile(r"DEK-Info: *[A-Z0-9-]+, *((?:[0-9A-Fa-f]{16}){1,2})\s*$")
#: The object identifiers of password-based encryption start so.
PASSWORD_BASED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
OPENSSH = b"openssh-key-v1\x00"
FIELDS = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_spans bigint"
Span = tuple[int, int, int]  # start, place of the kind in KINDS, end


def der_items(data: bytes, start: int = 0, end: int | None = None) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the DER values that fill data[start:end] exactly; None if they don't."""
    end, at, items = len(data) if end is None else end, start, []
    while at < end:
        if at + 2 > end:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end or data[at] == 0:
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
            if size < 0x80:
                return None
        if at + size > end:
            return None
        items.append((tag, at, at + size))
        at += size
    return items


def is_der_key(data: bytes) -> bool:
    """PKCS#1, PKCS#8 (plain or encrypted) or SEC1 private key: one outer SEQUENCE, and below it the fields of the form."""
    outer = der_items(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    items = der_items(data, *outer[0][1:])
    if not items or len(items) < 2:
        return False
    tags = [t for t, _, _ in items]
    if tags == [0x30, 0x04]:
        inner = der_items(data, *items[0][1:])
        return bool(inner) and inner[0][0] == 0x06 and data[inner[0][1] : inner[0][2]].startswith(PASSWORD_BASED) and items[1][2] - items[1][1] >= 16
    if tags[0] != 0x02 or items[0][2] - items[0][1] != 1:
        return False
    version = data[items[0][1]]
    if version in (0, 1) and tags[1:9] == [0x02] * 8:
        return True
    if version in (0, 1) and tags[1:3] == [0x30, 0x04]:
        inner = der_items(data, *items[1][1:])
        return bool(inner) and inner[0][0] == 0x06
    return version == 1 and tags[1] == 0x04 and items[1][2] - items[1][1] >= 16


def der_size(data: bytes) -> int:
    """The whole length of the SEQUENCE that ``data`` begins with, if it goes on like a key; else 0."""
    if len(data) < 8 or data[0] != 0x30:
        return 0
    n = data[1] & 0x7F if data[1] & 0x80 else 0
    if n > 4 or (data[1] & 0x80 and not n):
        return 0
    size = int.from_bytes(data[2 : 2 + n], "big") if n else data[1]
    inner = data[2 + n : 4 + n]
    return 2 + n + size if inner == b"\x02\x01" or inner[:1] == b"\x30" else 0


def openssh_size(data: bytes) -> int:
    """The length of the OpenSSH key that ``data`` begins with: magic, cipher, kdf and options as length-prefixed strings, a count of
    keys, the public parts and the private part, or all of ``data`` if it was cut off among the latter. 0 if it isn't one."""
    if not data.startswith(OPENSSH):
        return 0
    at, fields = len(OPENSSH), []
    for k in range(4):
        if at + 4 > len(data):
            return 0
        n = int.from_bytes(data[at : at + 4], "big")
        if k == 3:
            break
        fields.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    if not (fields[0].isascii() and fields[0] and 1 <= n <= 64):
        return 0
    at += 4
    for _ in range(n + 1):
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        if at >= len(data):
            return len(data)
    return at


def decoded(run: str) -> bytes | None:
    """The bytes of a base64 run in either alphabet, with or without padding."""
    run = run.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_key(data: bytes | None) -> bool:
    return bool(data) and (openssh_size(data) > 0 or (data[0] == 0x30 and is_der_key(data)))


def gathered(text: str, start: int, chars: int) -> tuple[str, list[int]]:
    """At most ``chars`` base64 characters from ``start`` on, over line breaks, and how many there are up to each part's end."""
    parts, ends, n, at = [], [], 0, start
    while n < chars and (m := PART.match(text, at)):
        part = m[0][: chars - n]
        n += len(part)
        parts.append(part)
        ends.append((n, m.start() + len(part)))
        gap = GAP.match(text, m.end())
        if not gap:
            break
        at = gap.end()
    return "".join(parts), ends


def keys_in(text: str) -> list[tuple[int, int]]:
    """Start and end of the private keys in base64, from every place where one may start."""
    out, done = [], 0
    for run in RUN.finditer(text):
        for m in START.finditer(text, max(run.start(), done), run.end()):
            if m.start() < done:
                continue
            if m[0][0] == "M":
                size = der_size(decoded(text[m.start() : m.start() + 12]) or b"")
            else:  # the first fields tell whether the rest is worth reading
                size = openssh_size(decoded_floor(gathered(text, m.start(), 400)[0])) and openssh_size(decoded_floor(gathered(text, m.start(), len(text))[0]))
            if not size:
                continue
            chars = -(-size * 4 // 3)
            body, ends = gathered(text, m.start(), chars)
            end = ends[-1][1] if ends else m.start()
            more = PART.match(text, end)  # a key fills its run, but for what is glued to it
            if len(body) == chars and is_key(decoded(body)) and not (more and more[0][0] not in "-_/"):
                while end < len(text) and text[end] == "=" and end < ends[-1][1] + 2:
                    end += 1
                out.append((m.start(), end))
                done = end
    return out


def decoded_floor(run: str) -> bytes:
    """What decodes of a run that may end anywhere: one letter alone is less than a byte."""
    return decoded(run[: len(run) - (len(run) % 4 == 1)]) or b""


def is_armoured(body: str) -> bool:
    """Whether the text between the lines of an armoured key is one: base64 of a key, or of whole blocks under headers that name a cipher."""
    lines = GAP.sub("\n", body).strip().split("\n")
    headers = [x for x in lines if HEADER.match(x)]
    data = decoded("".join("".join(x for x in lines if not HEADER.match(x)).split()))
    if any("ENCRYPTED" in x for x in headers):
        return any(CIPHER.match(x) for x in headers) and bool(data) and len(data) >= 32 and len(data) % 8 == 0
    return is_key(data)


def is_jwe(header: str, key: str, iv: str, body: str, tag: str | None) -> bool:
    """An encrypted token of five parts."""
    try:
        head = json.loads(decoded(header) or b"")
    except (ValueError, RecursionError):
        return False
    named = isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(head.get("enc"), str)
    return named and all(x is not None and decoded(x) for x in (iv, body, tag)) and decoded(key) is not None


def is_jwt(header: str, payload: str) -> bool:
    try:
        head, body = (json.loads(decoded(x) or b"") for x in (header, payload))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def find(text: str) -> tuple[list[Span], list[Span]]:
    """The plain spans and the confirmed ones, unordered."""
    low = text.encode().lower()
    plain = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8] if any(w in low for w in WORDS) else []
    more: list[Span] = []
    if b"akia" in low:
        plain += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    longest = max(map(len, low.split()), default=0)
    if longest >= 32:  # no run below holds white space
        plain += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        for m in DOTTED.finditer(text):
            if m[5] and is_jwe(*m.groups()):
                more.append((m.start(), 3, m.end()))
            elif is_jwt(m[1], m[2]):
                more.append((m.start(), 3, m.end(3)))
        more += [(m.start(), 4, m.end()) for m in HEX_RUN.finditer(text) if is_key(bytes.fromhex(m[0]))]
    if b"-----begin " in low:
        more += [(m.start(), 5, m.end()) for m in PEM.finditer(text) if is_armoured(m[2])]
    if longest >= 40:
        armour = [(a, b) for a, k, b in more if k == 5]
        more += [(a, 4, b) for a, b in keys_in(text) if not any(x <= a and b <= y for x, y in armour)]
    return plain, more


def say(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(set(spans)))


def scan(text: str | None) -> tuple:
    plain, more = find(text or "")
    kinds = [k for _, k, _ in plain]
    return (kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(say(plain).encode()).hexdigest(), say(plain + more), len(set(plain + more)))


def secret_scans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each of ``docs``: counts of the plain kinds, their digest, and every span; one pass, no shuffle."""
    return map_texts(docs, id_col, text_col, scan, FIELDS)


def masked(text: str | None) -> str | None:
    """The text with each span replaced by ``[kind]``; overlapping spans become one, named by the first."""
    if not text:
        return text
    plain, more = find(text)
    out, at, last = [], 0, -1
    for a, k, b in sorted(set(plain + more)):
        if a >= last:
            out += [text[at:a], f"[{KINDS[k]}]"]
        last = at = max(b, last)
    return "".join([*out, text[at:]]) if out else text


def mask_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the secrets in ``text_col`` masked; all rows and columns stay, and texts without secrets stay as they are."""
    import pyarrow as pa

    small_batches(docs.sparkSession)
    schema, at = docs.schema, docs.columns.index(text_col)

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                b = whole.slice(i, 256)
                yield b.set_column(at, b.schema.field(at), pa.array([masked(t) for t in b.column(at).to_pylist()], b.schema.field(at).type))

    return docs.mapInArrow(run, schema)


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scans(table(spark, sf_dir, "documents"))
