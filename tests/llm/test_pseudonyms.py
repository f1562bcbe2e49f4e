import datetime
import random
import re

import pytest
from llm_cases import ODD

from patchloom.llm import pseudonyms as P

KEY, OTHER = b"0123456789abcdef-key", b"another key of this kind"


def new(text, key=KEY):
    return P.replace(text, P.find(text, key))


def kinds(text):
    return [k for _, _, k, _ in P.find(text, KEY)]


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000])
def test_permutation(size):
    assert sorted(P.permute(v, size, KEY, "t") for v in range(size)) == list(range(size))
    if size > 90:
        assert [P.permute(v, size, KEY, "t") for v in range(size)] != [P.permute(v, size, OTHER, "t") for v in range(size)]


def test_formats_stay_valid():
    rng = random.Random(1)
    for _ in range(60):
        body = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        card = body + str(P.luhn(body))
        got = new(card)
        assert got != card and len(got) == 16 and got[0] == "4" and P.luhn(got[:-1]) == int(got[-1])
        spaced = " ".join(card[i : i + 4] for i in range(0, 16, 4))
        assert new(spaced).replace(" ", "") == got and new(spaced)[4] == " "
        day = datetime.date.fromordinal(rng.randrange(P._FIRST_DAY, P._LAST_DAY))
        shown = new(f"{day:%Y-%m-%d}")
        moved = datetime.date.fromisoformat(shown)
        assert new(f"{day:%d.%m.%Y}") == f"{moved:%d.%m.%Y}"
        assert 1900 <= moved.year <= 2099
        ip = ".".join(str(rng.randrange(256)) for _ in range(4))
        assert re.fullmatch(r"\d+(\.\d+){3}", new(ip)) and all(int(x) < 256 for x in new(ip).split(".")) and new(ip) != ip


def test_phones_link_across_spellings():
    got = re.sub(r"\D", "", new("+1 (988) 555-2485"))
    assert re.fullmatch(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", new("+1 (988) 555-2485"))
    assert re.sub(r"\D", "", new("988-555-2485")) == got[1:] and re.fullmatch(r"\+49 \d{3} \d{4} \d{3}", new("+49 301 2345 678"))


@pytest.mark.parametrize("code,rest", [("44", "2079460958"), ("49", "3012345678"), ("7", "4951234567"), ("351", "212345678"), ("852", "25123456"), ("33", "142685300"), ("1", "9885552485")])
def test_foreign_phones_link_across_spellings(code, rest):
    """One number in four spellings has one pseudonym, in the same country."""
    shown = [f"+{code} {rest[:2]} {rest[2:6]} {rest[6:]}", f"+{code}{rest}", f"+{code}-{rest[:3]}-{rest[3:6]}-{rest[6:]}", f"+{code} ({rest[:3]}) {rest[3:]}"]
    got = {re.sub(r"\D", "", new(s)) for s in shown if kinds(s) == ["phone"]}
    assert kinds(shown[1]) == ["phone"] and len([s for s in shown if kinds(s) == ["phone"]]) >= 3
    (number,) = got
    assert number.startswith(code) and number != code + rest and len(number) == len(code + rest)


def test_dates_in_timestamps():
    moved = new("2024-01-05")
    assert new("at 2024-01-05T10:00:00Z, 2024-01-05T10:00") == f"at {moved}T10:00:00Z, {moved}T10:00"
    assert new("2024-01-05Tx 2024-01-05-1") == "2024-01-05Tx 2024-01-05-1"


def test_iban_ssn_email():
    iban = "DE89 3704 0044 0532 0130 00"
    got = new(iban).replace(" ", "")
    assert got != iban.replace(" ", "") and P._mod97(got[4:] + got[:4]) == 1 and got[:2] == "DE"
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4}", new("123-45-6789")) and kinds("000-45-6789 666-12-1234 900-11-1111 123-00-1111") == []
    assert re.fullmatch(r"[a-z]{4}\.\d\d@mail2\.example\.com", new("ahrk.19@mail2.example.com")) and "ahrk.19" not in new("ahrk.19@mail2.example.com")


def test_not_valid_is_left():
    for text in ("4111111111111112", "2123465659789240", "300.1.2.3 1.2.3", "2021-02-30 99.99.2020 2021-13-01", "v1.2.3.4.5", "1111111111111111"[:15], "a@b", "DE00 3704 0044 0532 0130 00", "0000000000000000"):
        assert new(text) == text
    assert kinds("31/12/1999 12/31/1999 1.2.2020") == ["date"] * 3


def test_documents(documents):
    card = "4111111111111111"
    rows = [(10, f"pay {card}, call +1 (988) 555-2485."), (11, f"{card}"), *ODD]
    done = P.pseudonymise(documents(rows).repartition(3).withColumnRenamed("lang", "spans"), KEY)
    got = {r.doc_id: r for r in done.collect()}
    assert len(P.pseudonymise(documents(ODD), KEY).collect()) == len(ODD)
    first = got[10].text.split()[1].rstrip(",")
    assert got[11].text == first and P.luhn(first[:-1]) == int(first[-1]) and first != card
    assert [(s.start, s.end, s.kind) for s in got[10].spans] == [(4, 20, "card"), (27, 44, "phone")]
    assert got[1].text is None and got[1].spans == [] and got[2].text == "" and got[4].text == "word " * 40_000
    assert P.pseudonymise(documents([]), KEY).count() == 0
    with pytest.raises(ValueError):
        P.pseudonymise(documents([]), b"short")


def test_valid_numbers_inside_longer_matches():
    card, pl, es = "4111 1111 1111 1111", "PL61109010140000071219812874", "ES91 2100 0418 4502 0005 1332"
    for text, kind, inner in [
        (f"{card} 123", "card", card), (f"{card} 12/27", "card", card), (f"{card.replace(' ', '-')}-1234567", "card", card.replace(" ", "-")),
        ("4111111111111111 123", "card", "4111111111111111"), (f"12 {card} 99", "card", card), ("3782 822463 10005 1234", "card", "3782 822463 10005"),
        (f"{pl} BANK", "iban", pl), (f"{es} PLEASE", "iban", es), (f"AB12 {es}", "iban", es), (f"{es} {pl}", "iban", es),
    ]:
        spans = {(text[a:b], k) for a, b, k, _ in P.find(text, KEY)}
        assert (inner, kind) in spans and inner not in new(text), text
    assert [k for _, _, k, _ in P.find(f"{es} {pl}", KEY)] == ["iban", "iban"]
