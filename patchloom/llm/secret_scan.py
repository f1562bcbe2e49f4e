"""Secrets in whole texts: plain patterns, and candidates confirmed by their structure.

The plain patterns find assignments, access ids and long hexadecimal runs. On top of them, runs of base64 or hexadecimal
digits are decoded and reported only if the bytes are a key: DER whose nested lengths fit exactly and whose sequence
looks like a private or public key, a length-prefixed SSH key, or a signed token whose header is JSON with a known
algorithm. Base spans always stay; the method only adds spans.

Edge cases: a null text counts as empty; rows are kept as they are (null, repeated ids too); an empty table gives an
empty result. Offsets are code points, ends exclusive. Runs go on over line ends, plain, escaped or
followed by a comment mark; a key may start anywhere in
a run, so also behind a path, and ends with one of its lines.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import itertools
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.llm.tables import slices

BASE_KINDS = ("assign", "access", "hex")
ADDED_KINDS = ("der", "ssh", "jwt")
KINDS = BASE_KINDS + ADDED_KINDS

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----([A-Za-z0-9+/=\s]+)-----END \1-----")
#: Base64 lines, the first not short; line ends may be escaped, as in JSON and string literals. Between lines a literal may
#: end and another begin, joined by a plus sign, a comma or a backslash, and a comment mark may stand before each.
_LINES = re.compile(
    r"""[A-Za-z0-9+/_-]{40,}={0,2}(?:(?:[ \t]*[\r\n]+[ \t]*//[ \t]+|[ \t]*(?:(?:\\+[rn]|[\r\n])[ \t]*)+|(?:\\+[rn])*["'][ \t]*[+,\\]?[ \t]*[\r\n]+[ \t]*["']"""
    r"""|[ \t]*[\r\n]+[ \t]*[#*][ \t]*)[A-Za-z0-9+/_-]+={0,2})*"""
)
_LINE = re.compile(r"(?:(?<=\\r)|(?<=\\n)|(?<![A-Za-z0-9+/_\\-]))[A-Za-z0-9+/_-]+={0,2}")
#: What stands between base64 lines but looks like one: it joins literals, or marks a comment.
_MARKS = ("+", "//")
#: What the base64 of a key starts with: a DER sequence, the length of an SSH type, the name of the newer SSH file.
_KEY_START = re.compile(r"M[A-P]|AAAA|b3BlbnNzaC1rZXktdjE")
_LONG_HEX = re.compile(r"[0-9A-Fa-f]{64,}")
#: Bytes in hexadecimal with colons between them, also over line ends.
_COLON_HEX = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}:\s*){31,}[0-9A-Fa-f]{2}(?![0-9A-Fa-f])")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{8,})(?=(\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*))")
#: Base64 that starts with a brace, or with white space before one.
_HEADER_START = re.compile(r"e[w-z0-9_-]|[CDI][A-Za-z0-9_-]")

#: Algorithms of signed tokens.
_ALGORITHMS = {
    "none", "HS256", "HS384", "HS512", "RS256", "RS384", "RS512", "ES256", "ES384", "ES512", "ES256K", "PS256",
    "PS384", "PS512", "EdDSA",
}
#: Key types at the start of an SSH key.
_SSH_TYPES = (
    b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521",
)
_SSH_MAGIC = b"openssh-key-v1\x00"
_INTEGER, _BITS, _OCTETS, _OID, _SEQUENCE = 0x02, 0x03, 0x04, 0x06, 0x30


def _elements(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the DER elements that fill data[start:end] exactly; None if they don't."""
    found = []
    while start < end:
        if start + 2 > end:
            return None
        tag, size, start = data[start], data[start + 1], start + 2
        if size & 0x80:
            more = size & 0x7F
            if not 1 <= more <= 4 or start + more > end:
                return None
            size = int.from_bytes(data[start : start + more], "big")
            if size < 0x80 or size >> (8 * (more - 1)) == 0:  # DER uses the shortest form
                return None
            start += more
        if start + size > end:
            return None
        found.append((tag, start, start + size))
        start += size
    return found


def is_der_key(data: bytes) -> bool:
    """One sequence with exact lengths that is laid out as a key: integers only, or version, algorithm and key."""
    outer = _elements(data, 0, len(data)) if data[:1] == b"\x30" else None
    if not outer or len(outer) != 1:
        return False
    inner = _elements(data, outer[0][1], outer[0][2])
    if not inner:
        return False
    tags = [t for t, _, _ in inner]
    if set(tags) == {_INTEGER}:  # RSA or DSA numbers; each must have a body
        return len(tags) in (2, 3, 6, 9) and all(b > a for _, a, b in inner) and max(b - a for _, a, b in inner) >= 16

    def has_oid(k: int) -> bool:
        parts = _elements(data, inner[k][1], inner[k][2]) if inner[k][0] == _SEQUENCE else None
        return bool(parts) and parts[0][0] == _OID and parts[0][2] > parts[0][1]

    if tags[:3] == [_INTEGER, _SEQUENCE, _OCTETS]:  # private key with its algorithm
        return has_oid(1)
    if tags[:2] == [_INTEGER, _OCTETS]:  # elliptic-curve private key: parameters and point are tagged
        return inner[1][2] - inner[1][1] >= 16 and all(t in (0xA0, 0xA1) for t in tags[2:])
    if tags == [_SEQUENCE, _BITS] or tags == [_SEQUENCE, _OCTETS]:  # public key, or encrypted private key
        return has_oid(0) and inner[1][2] - inner[1][1] >= 16
    return False


def is_ssh_key(data: bytes) -> bool:
    """A length-prefixed SSH public key, or the newer private key file."""
    if data.startswith(_SSH_MAGIC):
        at, fields = len(_SSH_MAGIC), 0
        while fields < 3 and at + 4 <= len(data):
            at, fields = at + 4 + int.from_bytes(data[at : at + 4], "big"), fields + 1
        return fields == 3 and at <= len(data)
    at, parts = 0, []
    while at + 4 <= len(data) and len(parts) < 8:
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return False
        parts.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return at == len(data) and len(parts) >= 2 and parts[0] in _SSH_TYPES


def _decoded(run: str) -> bytes | None:
    body = run.translate(_URL_SAFE).rstrip("=")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None


_URL_SAFE = str.maketrans("-_", "+/")


def is_token_header(part: str) -> bool:
    """Base64 of a JSON object that names the algorithm of a signed token."""
    data = _decoded(part)
    try:
        header = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return False
    algorithm = header.get("alg") if isinstance(header, dict) else None
    return isinstance(algorithm, str) and algorithm in _ALGORITHMS


def _kind(data: bytes | None) -> str | None:
    if not data:
        return None
    return "der" if is_der_key(data) else "ssh" if is_ssh_key(data) else None


def _key_sizes(data: bytes) -> list[int]:
    """How many bytes a key that starts like `data` can have."""
    if data[:1] == b"\x30":
        more = data[1] & 0x7F if data[1] & 0x80 else 0
        if more > 4 or len(data) < 2 + more:
            return []
        return [2 + more + (int.from_bytes(data[2 : 2 + more], "big") if more else data[1])]
    sizes, at = [], 0
    if data.startswith(_SSH_MAGIC):
        at, strings = len(_SSH_MAGIC), 3
        while at + 4 <= len(data):
            if not strings:  # the number of keys, then each public one, then the private ones
                strings, at = int.from_bytes(data[at : at + 4], "big") + 1, at + 4
            for _ in range(min(strings, 9)):
                at += 4 + int.from_bytes(data[at : at + 4], "big")
            if sizes:
                return [at]
            sizes, strings = [at], 0
        return []
    while at + 4 <= len(data) and len(sizes) < 8:
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        sizes.append(at)
    return sizes[1:]


def _keys_in_lines(text: str, block: re.Match) -> Iterator[tuple[int, int, str]]:
    """Keys that start anywhere in a run of base64 lines, from left to right. A key says where it ends: with a line, or before a separator."""
    found = (m for m in _LINE.finditer(text, *block.span()) if m.group() not in _MARKS)
    lines = [(m.start(), m.start() + len(m.group().rstrip("=")), m.end()) for m in found]
    joined = "".join(text[a:b] for a, b, _ in lines)
    begins = list(itertools.accumulate((b - a for a, b, _ in lines), initial=0))  # of the lines, within `joined`
    upto = 0
    for m in _KEY_START.finditer(joined):
        at = m.start()
        if at < upto:
            continue
        head = _decoded(joined[at : at + 40][: (len(joined[at : at + 40]) // 4) * 4]) or b""
        if m.group() == "AAAA" and not any(head[4:].startswith(t) for t in _SSH_TYPES) or len(head) < 2:
            continue
        whole = head if head[:1] == b"\x30" else _decoded(joined[at : at + (len(joined) - at) // 4 * 4]) or b""
        ends = {at + -(-4 * size // 3) for size in _key_sizes(whole)}
        first = bisect.bisect_right(begins, at) - 1
        for end in sorted(ends, reverse=True):
            last = bisect.bisect_left(begins, end) - 1
            if last < first or last >= len(lines):
                continue
            # with its padding where it ends with a line, else before a path or word that is glued to it
            stop = lines[last][2] if begins[last + 1] == end else lines[last][0] + end - begins[last]
            if begins[last + 1] != end and text[stop] not in "/-_":
                continue
            if kind := _kind(_decoded(joined[at:end])):
                yield lines[first][0] + at - begins[first], stop, kind
                upto = end
                break


def _tokens(text: str) -> Iterator[tuple[int, int, str]]:
    """Signed tokens: a header, which may be glued to what is before it, and two parts more."""
    for m in _JWT.finditer(text):
        header = m[1]
        for start in itertools.chain([0], (h.start() for h in _HEADER_START.finditer(header))):
            size = min(len(header) - start, 8) // 4 * 4
            if size and (_decoded(header[start : start + size]) or b"").lstrip(b" \t\r\n")[:1] not in (b"{", b""):
                continue
            if is_token_header(header[start:]):
                yield m.start() + start, m.end(2), "jwt"
                break


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return found


def added_spans(text: str) -> list[tuple[int, int, str]]:
    """Candidates whose decoded bytes are a key or a signed token's header."""
    found = []
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            if kind := _kind(_decoded("".join(m[2].split()))):
                found.append((m.start(), m.end(), kind))
    found += _tokens(text)
    if "30:" in text:  # the tag of a sequence
        for m in _COLON_HEX.finditer(text):
            if kind := _kind(bytes.fromhex("".join(m.group().replace(":", " ").split()))):
                found.append((*m.span(), kind))
    held = [(a, b) for a, b, _ in found]
    at = 0
    while m := _LINES.search(text, at):
        behind = [b for a, b in held if a <= m.start() < b]
        if behind:  # a run that begins within what is known goes on behind it
            at = max(behind)
            continue
        at = m.end()
        keys = list(_keys_in_lines(text, m))
        found += keys
        for h in _LONG_HEX.finditer(text, *m.span()):
            digits = h.group()[: len(h.group()) // 2 * 2]
            inside = any(a <= h.start() < b for a, b, _ in keys)
            if not inside and (kind := _kind(bytes.fromhex(digits))):
                found.append((h.start(), h.start() + len(digits), kind))
    return found


_RANK = {kind: k for k, kind in enumerate(KINDS)}


def ordered(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], _RANK[s[2]], s[1]))


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


SPANS = "array<struct<start:int,end:int,kind:string>>"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, and the base and added spans of each document, by start and then by kind."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text=1):
            base, added = [], []
            for text in batch.column(1).to_pylist():
                for spans, out in ((base_spans, base), (added_spans, added)):
                    found = ordered(spans(text)) if text else []
                    out.append([{"start": a, "end": b, "kind": k} for a, b, k in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base, span), pa.array(added, span)], names=["doc_id", "base", "added"]
            )

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(work, f"doc_id long, base {SPANS}, added {SPANS}")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts, the sha256 of the base spans and all spans as text."""

    def text(spans) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def rank(s) -> F.Column:
        return F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])

    merged = F.array_sort(F.transform(
        F.concat("base", "added"),
        lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")),
    ))
    def count(kind: str) -> F.Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.select(
        "doc_id", *map(count, BASE_KINDS), F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(merged).alias("spans")
    )


def masked(docs: DataFrame) -> DataFrame:
    """`docs` with every span of `text` replaced by its kind in angle brackets; overlapping spans become one. Null stays null."""
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text=at):
            texts = [mask(t) if t else t for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(work, docs.schema)


def mask(text: str) -> str:
    spans, parts, upto = ordered(base_spans(text) + added_spans(text)), [], 0
    for start, end, kind in spans:
        if start >= upto:
            parts += [text[upto:start], f"<{kind}>"]
        upto = max(upto, end)
    return "".join([*parts, text[upto:]]) if spans else text
