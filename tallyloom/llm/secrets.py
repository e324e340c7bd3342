r"""Secret scans: three base patterns, and candidates that are reported only when their structure confirms them.

Base, leftmost and non-overlapping for each kind: assign, access and hex. The method adds, after decoding:

* pem: an armoured private key whose base64 body is a DER value with lengths that nest exactly, an openssh key, or, below DEK-Info, whole cipher blocks;
* key: base64, base64url or hex (also with colons), in one line or over several, that decodes to a DER private key or to an SSH public key blob with exact nested lengths;
* jwt: three base64url parts of which the header is JSON with "alg" and the payload is JSON.

Runs of base64, base64url or hex that decode to printable text are scanned once more after decoding, up to DEPTH times; what is found there is reported
with its kind, from where the run begins to the end of the line where it ends. A key or token within a span of another kind of key is not reported again.
Line breaks and slashes within keys may be escaped, as in JSON strings, and lines may be quoted or commented out (QUOTE).

Offsets are code points, ends exclusive. Null and empty texts have no spans. Repeated rows are each scanned.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import json
import re
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import LOWER_BYTES, col, map_texts, others

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: A line break as it is, or escaped as in JSON strings.
BREAK = r"(?:[\r\n]|\\+(?:[nrt]|u000[aAdD9]))"
#: Marks before a line that is quoted or commented out.
QUOTE = r"(?:[ \t]*+[>|#*])"
#: Headers, as in encrypted keys, then base64 with white space, escaped or real, and escaped slashes.
PEM = re.compile(rf"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----(?:{BREAK}{QUOTE}++|\s|{BREAK})*+((?:[A-Za-z][A-Za-z0-9-]*:(?:(?!-----)[^\r\n\\])*+(?:[ \t]*{BREAK}{QUOTE}*+)++[ \t]*+)*+)((?:{BREAK}{QUOTE}++|[A-Za-z0-9+/=\s]|{BREAK}|\\+(?=/))++)-----END \1-----")
CIPHER = re.compile(r"DEK-Info:[ \t]*[A-Za-z0-9-]+,[ \t]*([0-9A-Fa-f]+)")
#: base64url of a brace and a quote or white space begins with ew or ey.
JWT = re.compile(r"(?<![A-Za-z0-9_-])(e[wy][A-Za-z0-9_-]+)\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])")
#: What joins the lines of one key: breaks with the blanks and marks around them, and the backslash of an escaped slash.
JOIN = rf"(?:(?:[ \t]*+{BREAK}{QUOTE}*+)++[ \t]*+|\\+(?=/))"
#: A colon between the bytes of one key.
COLON = rf":{JOIN}?"
#: Not within a word, but right after an escaped line break.
EDGE = r"(?:(?<![{0}])|(?<=\\[nrt])|(?<=\\u000[aAdD9]))"
#: DER begins with a sequence (0x30) of a short or a long length, SSH blobs with a four-byte length, so base64 of keys begins with MA to MI or AAAA.
BEGINS64, BEGINS16 = "(?:M[A-I]|AAAA)", "(?:30|000000)"


class Coding(NamedTuple):
    """How bytes stand in a text: bits a character, where keys begin, runs over lines, what joins the lines, one line, lines that may be encoded text."""

    bits: int
    start: re.Pattern
    run: re.Pattern
    join: re.Pattern
    letters: re.Pattern
    line: re.Pattern


def _coding(bits: int, letters: str, begins: str) -> Coding:
    run, line = f"[{letters}]++(?:{JOIN}[{letters}]++)*+", EDGE.format(r"\\" + letters) + f"[{letters}]{{{LINE},}}"
    return Coding(bits, re.compile(EDGE.format(letters) + begins), re.compile(run), re.compile(JOIN), re.compile(f"[{letters}]++"), re.compile(line))


#: Characters of a run's first line, at least, for it to be tried as encoded text, and how often a text is decoded.
LINE, DEPTH = 40, 2
BASE64, BASE64URL, HEXES = _coding(6, "A-Za-z0-9+/", BEGINS64), _coding(6, "A-Za-z0-9_-", BEGINS64), _coding(4, "0-9a-fA-F", BEGINS16)
COLONS = Coding(4, re.compile(r"(?<![0-9a-fA-F:])(?:30|00:00:00):"), re.compile(f"[0-9a-fA-F]{{2}}(?:{COLON}[0-9a-fA-F]{{2}})*+"), re.compile(COLON), re.compile("[0-9a-fA-F]{2}"), re.compile("(?!)"))
#: Bytes of any coding as a, others as blanks: whether a run is long enough to be tried is seen at once. The shortest header of a token has 14.
MARKED = bytes(97 if re.match(rb"[A-Za-z0-9+/_-]", bytes([i])) else 32 for i in range(256))
HEADER = 14
PRINTABLE = re.compile(rb"[\t\n\r\x20-\x7e]*")
#: Characters of a key at least.
LEAST = 64
#: Fields of SSH public keys by type; those of other types, as certificates, go as far as they fill lines.
SSH_FIELDS = {b"ssh-rsa": 3, b"ssh-dss": 5, b"ssh-ed25519": 2, b"ecdsa-sha2-nistp256": 3, b"ecdsa-sha2-nistp384": 3, b"ecdsa-sha2-nistp521": 3, b"sk-ssh-ed25519@openssh.com": 3, b"sk-ecdsa-sha2-nistp256@openssh.com": 4}

KINDS = ("assign", "access", "hex", "pem", "key", "jwt")
OUT = T.StructType([T.StructField("found", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])


def der_items(data: bytes, lo: int, hi: int, depth: int = 0) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the values that fill data[lo:hi] exactly, or None; nested sequences are checked too."""
    items = []
    while lo < hi:
        if hi - lo < 2 or depth > 16:
            return None
        tag, n, at = data[lo], data[lo + 1], lo + 2
        if n >= 128:
            k = n & 127
            if not 1 <= k <= 4 or at + k > hi:
                return None
            n, at = int.from_bytes(data[at : at + k], "big"), at + k
        if at + n > hi or tag & 31 == 31:
            return None
        if tag & 32 and der_items(data, at, at + n, depth + 1) is None:
            return None
        items.append((tag, at, at + n))
        lo = at + n
    return items


def is_der_key(data: bytes) -> bool:
    """PKCS#1, SEC 1, DSA and PKCS#8 private keys: a sequence that fills the data and begins with a small version number."""
    top = der_items(data, 0, len(data)) if data[:1] == b"0" else None
    if not top or len(top) != 1:
        return False
    inner = der_items(data, top[0][1], top[0][2])
    if not inner or len(inner) < 3 or inner[0][0] != 2 or inner[0][2] - inner[0][1] != 1 or data[inner[0][1]] > 1:
        return False
    tags = [t for t, *_ in inner]
    return tags[1] == 4 or tags[1:3] == [48, 4] or (len(tags) >= 9 and set(tags[:9]) == {2}) or tags == [2] * 6


def der_end(data: bytes, at: int) -> int | None:
    """Where the sequence at `at` ends by its header, if it begins with a number as keys do."""
    if len(data) - at < 4 or data[at] != 48:
        return None
    n, lo = data[at + 1], at + 2
    if n >= 128:
        k = n & 127
        if not 1 <= k <= 4:
            return None
        n, lo = int.from_bytes(data[lo : lo + k], "big"), lo + k
    return lo + n if data[lo : lo + 1] == b"\2" else None


def ssh_ends(data: bytes, at: int) -> list[int]:
    """Where an SSH public key at `at` may end, the likeliest first: length-prefixed fields, the first of them the name of a key type."""
    ends, kind = [], None
    while len(data) - at >= 4:
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            break
        if kind is None:
            kind = data[at + 4 : at + 4 + n] if n <= 100 else b""
            if not re.match(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]+$", kind):
                return []
        at += 4 + n
        ends.append(at)
    n = SSH_FIELDS.get(kind, len(ends))
    return ends[n - 1 : n] + ends[:0:-1]


def keys(text: str, coding: Coding) -> list[tuple[int, int]]:
    """Spans of the keys in lines of a coding that begin where its `start` matches and end, by their own lengths, where a line does."""
    bits, start, run, join, *_ = coding
    spans, lo, hi, done, unit = [], 0, 0, 0, 4 if bits == 6 else 2
    chars, places, froms, decoded = "", [], [], {}
    for m in start.finditer(text):
        at = m.start()
        if at < done:
            continue
        if at >= hi:
            lo, hi = run.match(text, at).span()
            parts, places, froms, n, a = [], [], [], 0, lo
            for j in [*join.finditer(text, lo, hi), None]:
                b = j.start() if j else hi
                parts.append(text[a:b])
                places.append(n)
                froms.append(a)
                n, a = n + b - a, j.end() if j else hi
            chars, decoded = "".join(parts), {}
        line = bisect.bisect_right(froms, at) - 1
        first = places[line] + at - froms[line]
        if len(chars) - first < LEAST:
            continue
        phase = first % unit
        if phase not in decoded:
            whole = chars[phase:]
            decoded[phase] = decode(whole, coding)
        data, byte = decoded[phase], (first - phase) * bits // 8
        der = data[byte : byte + 1] == b"0"
        for end in [der_end(data, byte)] if der else ssh_ends(data, byte):
            if end is None or end > len(data):
                continue
            last = first + -(-(end - byte) * 8 // bits)
            k = bisect.bisect_left(places, last) - 1
            whole = last == len(chars) or (k + 1 < len(places) and places[k + 1] == last)
            if not whole or last - first < LEAST or (der and not is_der_key(data[byte:end])):
                continue
            done = froms[k] + last - places[k]
            if bits == 6:
                done += len(re.match("={0,2}", text[done : done + 2])[0])
            spans.append((at, done))
            break
    return spans


def decode(chars: str, coding: Coding) -> bytes:
    """The whole bytes in characters of a coding, without what joins lines."""
    if coding.bits == 4:
        return bytes.fromhex(chars[: len(chars) & ~1])
    return unbase64(chars[: len(chars) - 1] if len(chars) % 4 == 1 else chars, coding is BASE64URL) or b""


def encoded(text: str, coding: Coding, depth: int) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of runs that decode to printable text in which a candidate is confirmed. Lines are decoded only as far as they are printable."""
    spans, done, unit = [], 0, 4 if coding.bits == 6 else 2
    for m in coding.line.finditer(text):
        if m.start() < done:
            continue
        lines, data, rest, at, n = [], [], "", m.start(), 0  # lines: (characters up to the line's end, its end in the text)
        while at is not None:
            # a line at a time: however many runs begin within one another's lines, no line is decoded twice
            stop = coding.letters.match(text, at).end()
            j = coding.join.match(text, stop)
            j = j if j and coding.letters.match(text, j.end()) else None
            n += stop - at
            lines.append((n, stop))
            rest += text[at:stop]
            cut = len(rest) // unit * unit if j else len(rest)
            piece, rest = decode(rest[:cut], coding), rest[cut:]
            good = PRINTABLE.match(piece).end()
            data.append(piece[:good])
            at = j.end() if j and good == len(piece) else None
        done, found = lines[-1][1], b"".join(data)
        inner = confirmed(found.decode(), found, depth + 1) if len(found) >= LINE // 2 else []
        if inner:
            last = -(-max(b for *_, b in inner) * 8 // coding.bits)
            end = next(e for k, e in lines if k >= last)
            done = end + len(re.match("={0,2}", text[end : end + 2])[0])
            spans.append((m.start(), min(inner)[1], done))
    return spans


def unbase64(text: str, url: bool = False) -> bytes | None:
    text = re.sub(rf"{BREAK}{QUOTE}++|\s|{BREAK}|\\+(?=/)", "", text).rstrip("=")
    if len(text) % 4 == 1:
        return None
    try:
        return (base64.urlsafe_b64decode if url else base64.b64decode)(text + "=" * (-len(text) % 4))
    except (binascii.Error, ValueError):
        return None


def is_enciphered(data: bytes, iv: str) -> bool:
    """Whole blocks of the size of the start value, 8 or 16 bytes."""
    return len(iv) in (16, 32) and len(data) >= 32 and len(data) % (len(iv) // 2) == 0


def is_token(head: str, body: str) -> bool:
    try:
        header, payload = json.loads(unbase64(head, True) or b""), json.loads(unbase64(body, True) or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(payload, dict)


def confirmed(text: str, raw: bytes, depth: int = 0) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the candidates whose structure holds; none lies within another one."""
    spans = []
    if b"PRIVATE KEY-----" in raw:
        for m in PEM.finditer(text):
            data, cipher = unbase64(m[3]), CIPHER.search(m[2])
            if data and (is_der_key(data) or data.startswith(b"openssh-key-v1\0") or (m[1].startswith("ENCRYPTED") and len(der_items(data, 0, len(data)) or []) == 1) or (cipher and is_enciphered(data, cipher[1]))):
                spans.append((m.start(), 3, m.end()))
    codings = [BASE64] * (b"M" in raw or b"AAAA" in raw)
    codings += [BASE64URL] * (bool(codings) and (b"-" in raw or b"_" in raw))
    codings += [HEXES] * (b"30" in raw or b"000000" in raw) + [COLONS] * (b"30:" in raw or b"00:00:00:" in raw)
    spans += [(a, 4, b) for coding in codings for a, b in keys(text, coding)]
    runs = raw.translate(MARKED)
    if (b"ey" in raw or b"ew" in raw) and b"a" * HEADER in runs:
        spans += [(m.start(), 5, m.end()) for m in JWT.finditer(text) if is_token(m[1], m[2])]
    if depth < DEPTH and b"a" * LINE in runs:
        spans += [s for coding in (BASE64, BASE64URL, HEXES) for s in encoded(text, coding, depth)]
    whole, reach = [], 0
    for a, k, b in sorted(spans, key=lambda s: (s[0], -s[2], s[1])):
        if b > reach:
            whole.append((a, k, b))
            reach = b
    return whole


def scan(texts: list[bytes]) -> dict:
    found = []
    for raw in texts:
        text, spans = raw.decode(), []
        low = raw.translate(LOWER_BYTES)
        if any(k in low for k in KEYWORDS):
            spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
        if b"AKIA" in raw:
            spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
        spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        spans += confirmed(text, raw)
        found.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(spans)])
    return {"found": found}


def find(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all but the text, if None) and found: spans by start, then kind as in KINDS, then end."""
    return map_texts(docs, text_col, others(docs, text_col) if keep is None else keep, OUT, lambda: scan)


def digest(found: DataFrame) -> DataFrame:
    """n_assign, n_access, n_hex, base_sha256 and spans per row of find()."""

    def said(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("found", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select(*[col(c) for c in found.columns if c != "found"], count("assign"), count("access"), count("hex"), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("found")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """docs with each found span, overlapping ones joined, replaced by `mask`; null texts stay null."""
    out = T.StructType([T.StructField("__redacted", T.StringType())])

    def run(texts: list[bytes]) -> dict:
        done = []
        for raw, spans in zip(texts, scan(texts)["found"], strict=True):
            text, parts, at = raw.decode(), [], 0
            for s in spans:
                if s["end"] <= at:
                    continue
                if s["start"] >= at:
                    parts += [text[at : s["start"]], mask]
                at = s["end"]
            done.append("".join([*parts, text[at:]]))
        return {"__redacted": done}

    kept = docs.withColumn("__null", col(text_col).isNull())
    got = map_texts(kept, text_col, others(kept, text_col), out, lambda: run)
    new = F.when(~F.col("__null"), F.col("__redacted")).alias(text_col)
    return got.select(*[new if c == text_col else col(c) for c in docs.columns])
