"""Format-preserving pseudonyms for personal numbers and dates.

What is found is validated first (check digits, calendar, ranges). Its significant part is then numbered within the set of
all values of that format and permuted there by a keyed Feistel network, walking the cycle until the result is in the set again.
So a card number stays a valid card number of the same length, a date a date, and equal values get equal pseudonyms
in all documents and in all spellings of a format, while without the key nothing leads back.

Kinds: card (check digit), iban (check digits), phone, ssn, ip, date (1900 to 2099), email (letters and digits of the local part).
Matches are taken leftmost first; at one place in this order of kinds. Cards and IBANs are also found inside longer runs of groups,
such as a card with its expiry or an IBAN before a word in capitals.

Edge cases: a null text stays null and has no spans; rows are kept as they are (null, repeated ids too); an empty table gives an
empty result. Spans are code points of the old text, ends exclusive.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.llm.tables import slices

KINDS = ("email", "iban", "card", "phone", "ssn", "ip", "date")
ROUNDS = 10

_FIRST_DAY, _LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


# ---------------------------------------------------------------- permutations


@functools.lru_cache(maxsize=1 << 16)
def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size): a Feistel network over the next square, walked until it falls into the range."""
    if size < 2:
        return value
    side = math.isqrt(size - 1) + 1
    width = (side.bit_length() + 7) // 8 + 8

    def mix(turn: int, half: int) -> int:
        text = f"{tweak}|{size}|{turn}|{half}".encode()
        found, block = b"", 0
        while len(found) < width:
            found += hashlib.blake2b(text + block.to_bytes(2, "big"), key=key, digest_size=64).digest()
            block += 1
        return int.from_bytes(found[:width], "big")

    while True:
        left, right = divmod(value, side)
        for turn in range(ROUNDS):
            left, right = right, (left + mix(turn, right)) % side
        value = left * side + right
        if value < size:
            return value


def _permute_digits(digits: str, key: bytes, tweak: str) -> str:
    return str(permute(int(digits), 10 ** len(digits), key, tweak)).zfill(len(digits)) if digits else ""


def _permute_mixed(text: str, key: bytes, tweak: str) -> str:
    """ASCII letters and digits permuted together, each staying of its sort and case; all else stays."""
    radix = [10 if c in _DIGITS else 26 if c in _LOWER or c in _UPPER else 1 for c in text]
    value = 0
    for c, r in zip(text, radix):
        value = value * r + (0 if r == 1 else ord(c) - ord("0" if r == 10 else "a" if c in _LOWER else "A"))
    value, out = permute(value, math.prod(radix), key, f"{tweak}|{_shape(text)}"), []
    for c, r in zip(reversed(text), reversed(radix)):
        value, x = divmod(value, r)
        out.append(c if r == 1 else chr(x + ord("0" if r == 10 else "a" if c in _LOWER else "A")))
    return "".join(reversed(out))


_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _shape(text: str) -> str:
    return "".join("9" if c in _DIGITS else "a" if c in _LOWER else "A" if c in _UPPER else c for c in text)


def _refill(text: str, digits: str) -> str:
    """`text` with its digits replaced in turn."""
    it = iter(digits)
    return "".join(next(it) if c in _DIGITS else c for c in text)


# ---------------------------------------------------------------- kinds: a pseudonym, or None if the match is not valid


def luhn(digits: str) -> int:
    """The check digit for these digits."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 - k % 2)
        total += d - 9 if d > 9 else d
    return -total % 10


def _card(m: re.Match, key: bytes) -> str | None:
    digits = re.sub(r"[ -]", "", m.group())
    if luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    body = digits[0] + _permute_digits(digits[1:-1], key, f"card|{digits[0]}")
    return _refill(m.group(), body + str(luhn(body)))


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _iban(m: re.Match, key: bytes) -> str | None:
    plain = m.group().replace(" ", "")
    if not 15 <= len(plain) <= 34 or _mod97(plain[4:] + plain[:4]) != 1:
        return None
    country, body = plain[:2], _permute_mixed(plain[4:], key, f"iban|{plain[:2]}")
    new = iter(country + f"{98 - _mod97(body + country + '00'):02d}" + body)
    return "".join(" " if c == " " else next(new) for c in m.group())


#: Country codes of two digits. 1 and 7 are codes themselves, all others have three, so the digits alone tell the code.
_CODES_OF_TWO = set(
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
)


def _code_length(digits: str) -> int:
    return 1 if digits[0] in "17" else 2 if digits[:2] in _CODES_OF_TWO else 3


def _phone(m: re.Match, key: bytes) -> str | None:
    digits = "".join(c for c in m.group() if c in _DIGITS)
    abroad = m.group().startswith("+")
    if not abroad or digits[0] == "1" and len(digits) == 11:
        own = digits[-10:]
        if own[0] not in "01" and own[3] not in "01":  # area and exchange begin with 2 to 9
            value = ((int(own[:3]) - 200) * 800 + int(own[3:6]) - 200) * 10_000 + int(own[6:])
            rest, line = divmod(permute(value, 800 * 800 * 10_000, key, "phone|1"), 10_000)
            area, exchange = divmod(rest, 800)
            return _refill(m.group(), digits[:-10] + f"{area + 200}{exchange + 200}{line:04d}")
        if not abroad:
            return None
    if not 8 <= len(digits) <= 15:
        return None
    code = _code_length(digits)
    return _refill(m.group(), digits[:code] + _permute_digits(digits[code:], key, f"phone|{digits[:code]}"))


def _ssn(m: re.Match, key: bytes) -> str | None:
    area, group, serial = (int(g) for g in m.groups())
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    value = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    rest, serial = divmod(permute(value, 898 * 99 * 9999, key, "ssn"), 9999)
    area, group = divmod(rest, 99)
    return f"{area + 1 + (area + 1 >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"


def _ip(m: re.Match, key: bytes) -> str | None:
    parts = m.group().split(".")
    if any(int(p) > 255 or str(int(p)) != p for p in parts):
        return None
    value = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, "ip")
    return ".".join(map(str, value.to_bytes(4, "big")))


def _date(m: re.Match, key: bytes) -> str | None:
    if m["year"]:
        parts, order = (m["year"], m["month"], m["day"]), "ymd"
    else:
        first, second = m["first"], m["second"]
        # with strokes the month comes first, unless it can't be one
        day_first = m["mark"] != "/" or int(first) > 12
        parts, order = (m["late"], *((second, first) if day_first else (first, second))), "dmy" if day_first else "mdy"
    try:
        day = datetime.date(*map(int, parts)).toordinal()
    except ValueError:
        return None
    if not _FIRST_DAY <= day <= _LAST_DAY:
        return None
    new = datetime.date.fromordinal(_FIRST_DAY + permute(day - _FIRST_DAY, _LAST_DAY - _FIRST_DAY + 1, key, "date"))
    wide = {"y": 4, "m": len(parts[1]), "d": len(parts[2])}
    told = {"y": new.year, "m": new.month, "d": new.day}
    return (m["sign"] or m["mark"]).join(str(told[c]).zfill(wide[c]) for c in order)


def _email(m: re.Match, key: bytes) -> str | None:
    local, _, domain = m.group().partition("@")
    return f"{_permute_mixed(local, key, 'email|' + domain.lower())}@{domain}"


_FINDERS = (
    ("email", re.compile(r"(?<![\w.+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w-])", re.A), _email),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", re.A), _iban),
    ("card", re.compile(r"(?<![\w.+-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-])", re.A), _card),
    ("phone", re.compile(
        r"(?<![\w.+-])(?:\+[0-9]{1,3}?(?:[ .-]?\(?[0-9]{2,4}\)?){2,4}|(?:1[ .-])?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4})(?![\w-])", re.A), _phone),
    ("ssn", re.compile(r"(?<![\w.+-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![\w-])", re.A), _ssn),
    ("ip", re.compile(r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\w|\.[0-9])", re.A), _ip),
    ("date", re.compile(
        r"(?<![\w./-])(?:(?P<year>[0-9]{4})(?P<sign>[-/.])(?P<month>[0-9]{1,2})(?P=sign)(?P<day>[0-9]{1,2})|(?P<first>[0-9]{1,2})(?P<mark>[-/.])(?P<second>[0-9]{1,2})(?P=mark)(?P<late>[0-9]{4}))(?:(?=T[0-9]{2}:)|(?![\w-]|[./][0-9]))", re.A), _date),
)
_DIGIT = re.compile(r"[0-9]")
_PART = re.compile(r"[A-Z0-9 -]+", re.A)
_GROUPS = re.compile(r"(?<![\w.+-])[0-9]+(?:[ -][0-9]+)*(?!\w)", re.A)
_GROUP = re.compile(r"[0-9]+")

#: Characters of an IBAN by country.
_IBAN_LENGTHS = {k: int(n) for k, n in (x.split(":") for x in (
    "AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BI:27 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DJ:27 DK:18 DO:28 "
    "EE:20 EG:29 ES:24 FI:18 FK:18 FO:18 FR:27 GB:22 GE:22 GI:23 GL:18 GR:27 GT:28 HR:21 HU:28 IE:22 IL:23 IQ:23 IS:26 IT:27 "
    "JO:30 KW:30 KZ:20 LB:28 LC:32 LI:21 LT:20 LU:20 LV:21 LY:25 MC:27 MD:24 ME:22 MK:19 MN:20 MR:27 MT:31 MU:30 NI:28 NL:18 "
    "NO:15 OM:23 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 RU:33 SA:24 SC:31 SD:18 SE:24 SI:19 SK:24 SM:27 SO:23 ST:25 SV:28 "
    "TL:23 TN:24 TR:26 UA:29 VA:22 VG:24 XK:20").split())}


def _is_card_layout(sizes: list[int]) -> bool:
    """Unbroken, in fours with a shorter last group, or 4-6-5 and 4-6-4."""
    fours = all(n == 4 for n in sizes[:-1]) and sizes[-1] <= 4
    return 13 <= sum(sizes) <= 19 and (len(sizes) == 1 or fours or sizes in ([4, 6, 5], [4, 6, 4]))


def _inner_cards(text: str, held: list[tuple[int, int]], key: bytes) -> Iterator[tuple[int, int, str]]:
    """Cards that begin and end with groups inside a longer run of groups; the longest at each start, from left to right."""
    for run in _GROUPS.finditer(text):
        if run.end() - run.start() < 13:
            continue
        groups = [g.span() for g in _GROUP.finditer(text, *run.span())]
        at = 0
        while at < len(groups):
            for upto in range(min(at + 5, len(groups)), at, -1):  # 19 digits are five groups at most
                start, end = groups[at][0], groups[upto - 1][1]
                marks = {text[b] for _, b in groups[at : upto - 1]}
                if len(marks) > 1 or not _is_card_layout([b - a for a, b in groups[at:upto]]):
                    continue
                if any(start < b and a < end for a, b in held):
                    continue
                if (new := _card(_PART.fullmatch(text, start, end), key)) is not None:
                    yield start, end, new
                    at = upto - 1
                    break
            at += 1


def _ibans(text: str, pattern: re.Pattern, key: bytes) -> Iterator[tuple[int, int, str]]:
    """Each IBAN by its country's length, else the whole match or one of its group ends; after none, from the next group on."""
    at = 0
    while m := pattern.search(text, at):
        places = [k for k in range(*m.span()) if text[k] != " "]
        size = _IBAN_LENGTHS.get(m.group()[:2], 0)
        ends = [places[size - 1] + 1] if 0 < size <= len(places) else []
        ends += [m.end(), *([] if size else [k for k in range(m.end() - 1, m.start(), -1) if text[k] == " "])]
        at = m.start() + 1
        for end in ends:
            if end < len(text) and (text[end].isalnum() and text[end].isascii() or text[end] == "_"):
                continue
            if (new := _iban(_PART.fullmatch(text, m.start(), end), key)) is not None:
                yield m.start(), end, new
                at = end
                break


def _matches(kind: str, pattern: re.Pattern, name: Callable, text: str, key: bytes) -> list[tuple[int, int, str]]:
    if kind == "iban":
        return list(_ibans(text, pattern, key))
    found = [(m.start(), m.end(), new) for m in pattern.finditer(text) if (new := name(m, key)) is not None]
    if kind == "card":
        found += list(_inner_cards(text, [(a, b) for a, b, _ in found], key))
    return found


def find(text: str, key: bytes) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of what is valid, without overlaps."""
    found = []
    digits = _DIGIT.search(text) is not None
    for rank, (kind, pattern, name) in enumerate(_FINDERS):
        if not digits and kind != "email" or kind == "email" and "@" not in text:
            continue
        found += [(start, rank, end, kind, new) for start, end, new in _matches(kind, pattern, name, text, key)]
    kept, upto = [], 0
    for start, _, end, kind, new in sorted(found):
        if start >= upto:
            kept.append((start, end, kind, new))
            upto = end
    return kept


def replace(text: str, found: list[tuple[int, int, str, str]]) -> str:
    parts, upto = [], 0
    for start, end, _, new in found:
        parts += [text[upto:start], new]
        upto = end
    return "".join([*parts, text[upto:]])


SPANS = "array<struct<start:int,end:int,kind:string>>"


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """`docs` with `text` replaced, and `spans`: where in the old text something was, and of what kind."""
    if not 16 <= len(key) <= 64:
        raise ValueError("the key has 16 to 64 bytes")
    kept = [c for c in docs.columns if c != "spans"]
    narrow = docs.select(*(F.col(f"`{c}`") for c in kept))
    at = kept.index("text")
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text=at):
            texts, spans = batch.column(at).to_pylist(), []
            for k, text in enumerate(texts):
                found = find(text, key) if text else []
                spans.append([{"start": a, "end": b, "kind": kind} for a, b, kind, _ in found])
                if found:
                    texts[k] = replace(text, found)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, span)], names=[*batch.schema.names, "spans"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields)
    return narrow.mapInArrow(work, f"{fields}, spans {SPANS}")
