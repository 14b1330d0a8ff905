"""Secret scans by structural confirmation.

Three plain patterns give the base findings. Beyond them, runs that could be base64 or hex are decoded, and are reported
only when the bytes have the structure of a key: DER lengths that nest exactly, an OpenSSH key file, or a signed token
whose header and payload are JSON objects. A run that merely looks random is not reported by this step.

One map over the rows, without a shuffle: a hot source or a large group of copies is spread as the input is. Work and
memory of a text grow with its length.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.shared import over_texts

# The kinds in the order of the report, and the base patterns.
KINDS = ("assign", "access", "hex", "jwt", "key_base64", "key_hex", "key_openssh")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24

#: Shortest runs that are decoded, all lines together: the smallest private keys in DER have some 48 bytes.
MIN_BASE64, MIN_KEY_HEX = 44, 64
#: How the letters of a DER sequence or an OpenSSH key file begin, at the start of a run.
KEY_START = re.compile(r"(?<![A-Za-z0-9+/])(?:M[A-P]|b3BlbnNz)")
#: Letters of one line (JSON may escape a slash), and what may stand between lines: quotes, a sign that goes on, line ends,
#: indentation and quote marks. Escaped line ends are made real ones of the same length before.
BASE64_LINE = re.compile(r"(?:[A-Za-z0-9+/]|\\/)++={0,2}+")
BETWEEN = re.compile(r"""[ \t]*+["'`]?+[ \t]*+[+,;]?+[ \t]*+\\?+[\r\n](?:[\r\n \t"'`>|#*]*+)""")
ESCAPED_END = re.compile(r"\\+[rn]")
HEX_START = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]")
HEX_LINE = re.compile(r"[0-9A-Fa-f]++")
#: A text is searched for keys in hex if it has a run of this many digits: the shortest line of a wrapped one.
MIN_HEX_LINE = 16
JWT_RUN = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]*)\.([A-Za-z0-9_-]+)")

#: One byte per class, so that a run of a class can be looked for at the speed of a byte search.
_HEX_CLASS = bytes(ord("h") if chr(c) in "0123456789abcdefABCDEF" else ord(" ") for c in range(256))

SEQUENCE, INTEGER, OCTETS, OID = 0x30, 0x02, 0x04, 0x06
OPENSSH_MAGIC = b"openssh-key-v1\0"

RESULT = """n_assign long, n_access long, n_hex long, base_sha256 string, spans string,
    found array<struct<kind:string,first:int,last:int>>"""
NAMES = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "found")
SPAN = pa.struct({"kind": pa.string(), "first": pa.int32(), "last": pa.int32()})
KIND = pa.struct(
    dict(zip(NAMES, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(SPAN)), strict=True))
)


Read = Callable[[int, int], bytes]
#: Elements that a key or an algorithm has at most, by their definitions.
KEY_PARTS, ALGORITHM_PARTS = 10, 2


def _element(read: Read, at: int) -> tuple[int, int, int] | None:
    """Tag, begin and end of the content of the DER element at a place."""
    head = read(at, 6)
    if len(head) < 2:
        return None
    length, size = head[1], 0
    if length & 0x80:
        size = length & 0x7F
        if not 1 <= size <= 4 or len(head) < 2 + size:
            return None
        length = int.from_bytes(head[2 : 2 + size])
    return head[0], at + 2 + size, at + 2 + size + length


def _parts(read: Read, at: int, end: int, most: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill a range exactly, or None."""
    out = []
    while at < end:
        found = _element(read, at)
        if found is None or found[2] > end or len(out) == most:
            return None
        out.append(found)
        at = found[2]
    return out


def _names_algorithm(read: Read, part: tuple[int, int, int]) -> bool:
    inner = _parts(read, part[1], part[2], ALGORITHM_PARTS)
    return bool(inner) and inner[0][0] == OID and inner[0][2] - inner[0][1] >= 3


def key_length(read: Read) -> int | None:
    """Bytes of the PKCS#1, PKCS#8, encrypted PKCS#8 or SEC1 private key in DER that begins here, None if there is none.

    Every length has to nest exactly. Only the heads of the elements are read, so a refusal costs the same at any length.
    """
    outer = _element(read, 0)
    if outer is None or outer[0] != SEQUENCE or not read(outer[2] - 1, 1):
        return None
    parts = _parts(read, outer[1], outer[2], KEY_PARTS)
    if not parts or len(parts) < 2:
        return None
    tags = [tag for tag, _, _ in parts]
    version = read(parts[0][1], 1) if parts[0][2] - parts[0][1] == 1 else b""
    found = tags == [SEQUENCE, OCTETS] and _names_algorithm(read, parts[0])  # encrypted PKCS#8
    if tags[0] == INTEGER and version in (b"\x00", b"\x01"):
        if len(parts) >= 9 and set(tags[:9]) == {INTEGER}:
            found = True  # PKCS#1: version, modulus, exponents, primes
        elif tags[1] == SEQUENCE and len(parts) >= 3 and tags[2] == OCTETS:
            found = _names_algorithm(read, parts[1])  # PKCS#8
        elif version == b"\x01" and tags[1] == OCTETS and parts[1][2] - parts[1][1] >= 16:
            found = all(tag in (0xA0, 0xA1) for tag in tags[2:])  # SEC1
    return outer[2] if found else None


def openssh_length(read: Read) -> tuple[bool, int | None]:
    """Whether an OpenSSH private key file begins here, and its bytes; None if they are not all there.

    After the magic come length-prefixed cipher, key derivation and its options, the number of keys, their public parts
    and the private section.
    """
    at = len(OPENSSH_MAGIC)
    if read(0, at) != OPENSSH_MAGIC:
        return False, None

    def skipped(at: int) -> int | None:
        size = read(at, 4)
        end = at + 4 + int.from_bytes(size)
        return end if len(size) == 4 and read(end - 1, 1) else None

    for _ in range(3):
        at = skipped(at)
        if at is None:
            return False, None
    keys = int.from_bytes(read(at, 4)) if len(read(at, 4)) == 4 else 0
    end = skipped(at + 4) if keys == 1 else None
    return keys >= 1, end and skipped(end)


class _Run:
    """The letters of lines that follow each other, joined, and where each line is in the text."""

    def __init__(self, text: str, at: int, line: re.Pattern, hexadecimal: bool):
        self.text, self.hexadecimal = text, hexadecimal
        parts: list[str] = []
        #: Of each line: where it begins and ends in the text, and its first letter's number.
        self.starts: dict[int, int] = {}
        self.begins: list[int] = []
        self.ends: list[int] = []
        self.firsts = [0]
        found = line.match(text, at)
        while found:
            self.starts[found.start()] = len(parts)
            self.begins.append(found.start())
            self.ends.append(found.end())
            parts.append(found[0].rstrip("=").replace("\\", ""))
            self.firsts.append(self.firsts[-1] + len(parts[-1]))
            between = None if found[0].endswith("=") else BETWEEN.match(text, found.end())
            found = between and line.match(text, between.end())
        self.letters = "".join(parts)

    def reader(self, line: int) -> Read:
        """Reads bytes of what the letters from a line on say: fewer at the end."""
        base = self.firsts[line]

        def read(at: int, n: int) -> bytes:
            if self.hexadecimal:
                digits = self.letters[base + 2 * at : base + 2 * (at + n)]
                return bytes.fromhex(digits[: len(digits) // 2 * 2])
            first = at // 3 * 4
            letters = self.letters[base + first : base + -(-(at + n) // 3) * 4]
            if len(letters) % 4 == 1:
                letters = letters[:-1]
            return base64.b64decode(letters + "=" * (-len(letters) % 4))[at % 3 : at % 3 + n]

        return read

    def end_of(self, line: int, n: int) -> tuple[int, bool]:
        """Where n bytes from a line on end in the text, and whether a line ends there."""
        letters = self.firsts[line] + (2 * n if self.hexadecimal else n // 3 * 4 + (0, 2, 3)[n % 3])
        last = bisect_left(self.firsts, letters) - 1
        if self.firsts[last + 1] == letters:
            return self.ends[last], True
        at, missing = self.begins[last], letters - self.firsts[last]
        while missing:
            missing -= self.text[at] != "\\"
            at += 1
        return at, False


def _keys(text: str, start: re.Pattern, line: re.Pattern, hexadecimal: bool) -> Iterator[tuple[str, int, int]]:
    """Keys that begin where a pattern says, at the begin of a line, and may go on over following lines.

    Lines are joined once for all places in them, and a place is judged by heads and lengths: work grows with the text.
    """
    run: _Run | None = None
    found = start.search(text)
    while found:
        at, behind = found.start(), found.start() + 1
        if run is None or at not in run.starts:
            run = _Run(text, at, line, hexadecimal)
        here = run.starts[at]
        read = run.reader(here)
        if not hexadecimal and found[0].startswith("b3"):
            is_key, size = openssh_length(read)
            if is_key:
                # One whose lengths lead beyond what is there is cut off: it goes as far as the lines do.
                behind = run.end_of(here, size)[0] if size else run.ends[-1]
                yield "key_openssh", at, behind
        else:
            size = key_length(read)
            end, line_ends = run.end_of(here, size) if size else (0, False)
            least = MIN_KEY_HEX // 2 if hexadecimal else MIN_BASE64 * 3 // 4
            if size and line_ends and size >= least:
                behind = end
                yield "key_hex" if hexadecimal else "key_base64", at, end
        found = start.search(text, behind)


def _json_object(part: str) -> dict | None:
    try:
        found = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, binascii.Error, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def is_signed_token(header: str, payload: str) -> bool:
    """Header and payload are JSON objects, and the header names an algorithm."""
    head = _json_object(header)
    return head is not None and isinstance(head.get("alg"), str) and _json_object(payload) is not None


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Findings of the three patterns: leftmost and not overlapping within a kind, failing matches dropped."""
    raw = text.encode("utf-8", "replace")
    low = raw.lower()
    out = []
    if any(word in low for word in (b"passw", b"secret", b"token", b"api")):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if b"AKIA" in raw:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    if b"h" * MIN_HEX in raw.translate(_HEX_CLASS):
        out += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= MIN_HEX]
    return out


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """Runs whose decoded bytes have the structure of a key, and signed tokens."""
    raw = text.encode("utf-8", "replace")
    out = []
    if b"eyJ" in raw:
        out += [("jwt", m.start(), m.end()) for m in JWT_RUN.finditer(text) if is_signed_token(m[1], m[2])]
    plain = ESCAPED_END.sub(lambda m: "\n" * len(m[0]), text) if "\\" in text else text
    out += _keys(plain, KEY_START, BASE64_LINE, False)
    if b"h" * MIN_HEX_LINE in raw.translate(_HEX_CLASS):
        out += _keys(plain, HEX_START, HEX_LINE, True)
    return out


def _ordered(spans):
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def scan_text(text: str | None) -> tuple:
    """(n_assign, n_access, n_hex, base_sha256, spans, found) of one text; null counts as empty."""
    base = _ordered(base_spans(text or ""))
    spans = _ordered([*base, *confirmed_spans(text or "")])
    counts = [sum(kind == k for kind, _, _ in base) for k in KINDS[:3]]
    found = [dict(zip(("kind", "first", "last"), span, strict=True)) for span in spans]
    return (*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), found)


def scan(text: Column) -> Column:
    """Struct of counts, digest, span text and spans (code points, end exclusive) for a text column."""

    def start():
        return lambda texts: [dict(zip(NAMES, scan_text(t), strict=True)) for t in texts]

    return over_texts(text, RESULT, KIND, start)


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Null and empty texts have no findings; repeated rows are reported as often as they come; rows without an id are kept;
    other columns are ignored, whatever their names. An empty table gives no rows.
    """
    found = docs.select(F.col(id_col).alias("doc_id"), scan(F.col(text_col)).alias("s"))
    return found.select("doc_id", "s.n_assign", "s.n_access", "s.n_hex", "s.base_sha256", "s.spans")


def _redact(text: str | None, mark: str) -> str | None:
    if not text:
        return text
    out, at = [], 0
    for _, start, end in sorted([*base_spans(text), *confirmed_spans(text)], key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def redacted(text: Column, mark: str = "[secret]") -> Column:
    """The text with every reported span, overlapping ones as one, replaced by mark; null stays null."""

    def start():
        return lambda texts: [_redact(t, mark) for t in texts]

    return over_texts(text, "string", pa.string(), start)
