import hashlib
import re
from datetime import date, timedelta

import pytest

from factorweave.llm import pii
from factorweave.llm.pii import pseudonymize

KEY = "k'ey\\"
TEXTS = [
    "a@b.com x 4041894974608795 y", "4111-1111-1111-1111, 4111111111111111 4111 1111 1111 1111", "+1 (456) 555-2186; 456-555-2186 (456) 555-2186 4524132264652876",
    "call +33 6 12 34 56 78 or +33612345678 4524132264652876", "1999-12-31 31/12/1999 12/31/1999 1.2.2003 2023-02-30", "123-45-6789, 666-12-1234", "10.0.0.1 300.1.1.1 42.144.35.254.",
    "DE89370400440532013000 GB82WEST12345698765432 DE00370400440532013000", "DE89 3704 0044 0532 0130 00, GB82 WEST 1234 5698 7654 32.", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"###', "x.y-z+1@sub.example-host.org.",
]


def hashed(key, bits, *message):
    f = {256: hashlib.sha256, 512: hashlib.sha512}[bits]
    inner = f("|".join([key, *map(str, message)]).encode()).hexdigest()
    return f("|".join([key, inner]).encode()).hexdigest()


def pair(key, tweak, le, ri, a, b):
    for i in range(1, 9):
        le = (le + int(hashed(key, 256, tweak, "l", i, ri)[:13], 16)) % a
        ri = (ri + int(hashed(key, 256, tweak, "r", i, le)[:13], 16)) % b
    return le, ri


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10


def outputs(spark, texts, key=KEY):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pseudonymize(df, key).orderBy("doc_id").collect()]


def test_restores_and_keeps_formats(spark, docs, odd):
    rows = odd + [(100 + i, t) for i, t in enumerate(TEXTS)] + [(200, TEXTS[0] + " words" * 20000)]
    out = pseudonymize(docs(rows), KEY)
    assert out.columns == ["doc_id", "text", "score", "level", "block", "pii_kinds"]
    shape = lambda t: t and re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d+", lambda m: "0" * (len(m[0]) > 3) or "0", t)))
    new = {r.doc_id: r for r in out.collect()}
    for i, t in rows:
        if i is not None and i < 109:
            assert shape(new[i].text) == shape(t)
    assert sorted((r.doc_id or 0, r.text or "") for r in pseudonymize(out, KEY, restore=True).collect()) == sorted((i or 0, t or "") for i, t in rows)
    assert new[5].text is None and new[5].pii_kinds == []


def test_equals_a_plain_computation(spark):
    card, ssn, ip, day = "4041894974608795", "123-45-6789", "42.144.35.254", "1999-12-31"
    got = outputs(spark, [card, ssn, ip, day])
    le, ri = pair(KEY, "card15", int(card[:7]), int(card[7:15]), 10**7, 10**8)
    body = f"{le:07d}{ri:08d}"
    assert got[0][:15] == body and luhn(got[0]) == 0
    le, ri = pair(KEY, "ssn", 122, 44 * 9999 + 6788, 898, 99 * 9999)
    assert got[1] == f"{le + 1 + (le >= 665):03d}-{ri // 9999 + 1:02d}-{ri % 9999 + 1:04d}"
    le, ri = pair(KEY, "ip", 42 * 256 + 144, 35 * 256 + 254, 65536, 65536)
    assert got[2] == f"{le // 256}.{le % 256}.{ri // 256}.{ri % 256}"
    i = (date(1999, 12, 31) - date(1700, 1, 1)).days
    le, ri = pair(KEY, "date", i // 773, i % 773, 189, 773)
    assert got[3] == str(date(1700, 1, 1) + timedelta(days=le * 773 + ri))


def test_equal_values_stay_linked(spark):
    a, b, c, d = outputs(spark, ["x 4111-1111-1111-1111", "4111111111111111 y", "31/12/1999", "1999-12-31"])
    assert a[2:].replace("-", "") == b[:16]
    spaced, bare = outputs(spark, ["to DE89 3704 0044 0532 0130 00!", "DE89370400440532013000"])
    assert spaced[3:-1].replace(" ", "") == bare != "DE89370400440532013000" and [len(x) for x in spaced[3:-1].split()] == [4, 4, 4, 4, 4, 2]
    assert int("".join(str(int(x, 36)) for x in bare[4:] + bare[:4])) % 97 == 1
    assert c == "/".join(reversed(d.split("-")))
    phones = re.findall(r"\d{3}\W+\d{3}-\d{4}", outputs(spark, [TEXTS[2]])[0])
    assert len({re.sub(r"\D", "", p) for p in phones}) == 1
    assert outputs(spark, ["4111111111111111"], "other") != [b[:16]]


def test_only_valid_values_change(spark):
    kept = ["4111111111111112", "666-12-1234", "000-12-1234", "300.1.1.1", "2023-02-30", "31.02.2020", "DE00370400440532013000", "DE00 3704 0044 0532 0130 00", "1234-5", "a@b", "0000000000000000"]
    assert outputs(spark, kept) == kept


def test_a_key_that_plans_do_not_show(spark, tmp_path, capsys):
    (tmp_path / "key.txt").write_text("hidden-secret")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    out = pseudonymize(df, spark.read.text(str(tmp_path / "key.txt")).scalar())
    assert out.columns == ["doc_id", "text", "pii_kinds"]
    assert [r.text for r in out.orderBy("doc_id").collect()] == outputs(spark, TEXTS, "hidden-secret")
    out.explain(True)
    assert "hidden-secret" not in capsys.readouterr().out


def test_columns_of_clashing_names_stay(spark):
    df = spark.createDataFrame([(1, "x", 7, 8, ["a"])], "doc_id long, text string, pii0_0 int, __pii3 int, pii_kinds array<string>")
    assert [tuple(r) for r in pseudonymize(df, KEY).collect()] == [(1, "x", 7, 8, [])]


@pytest.mark.parametrize("n", [13, 16, 19])
def test_cards_are_permuted(spark, n):
    bodies = [str(10 ** (n - 2) + 7919 * i) for i in range(60)]
    cards = [next(b + str(c) for c in range(10) if luhn(b + str(c)) == 0) for b in bodies]
    out = outputs(spark, cards)
    assert len(set(out)) == 60 and all(luhn(x) == 0 and len(x) == n for x in out)


def with_check(country, bban):
    """An IBAN with its check digits."""
    number = "".join(str(int(c, 36)) for c in f"{bban}{country}00")
    return f"{country}{98 - int(number) % 97:02d}{bban}"


def grouped(iban):
    return " ".join(iban[i : i + 4] for i in range(0, len(iban), 4))


@pytest.mark.parametrize(("country", "length"), [(c, n) for n, codes in pii.IBAN_LENGTHS.items() for c in codes.split()[:2]])
def test_ibans_of_every_length_before_a_capital_word(spark, country, length):
    iban = with_check(country, "21000418450200051332ABCDEFGH"[: length - 4])
    texts = [f"{grouped(iban)}{after}" for after in ("", " EUR", " BIC code", " A", " 12", ".", " DE89 3704 0044 0532 0130 00")]
    for old, new in zip(texts, outputs(spark, texts), strict=True):
        shown = grouped(iban)
        assert len(new) == len(old) and new[: len(shown)] != shown and new[:2] == country
        bare = new[: len(shown)].replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1
        assert " DE89" in old or new[len(shown) :] == old[len(shown) :]
    assert [r.text for r in pseudonymize(spark.createDataFrame(list(enumerate(outputs(spark, texts))), "doc_id long, text string"), KEY, restore=True).orderBy("doc_id").collect()] == texts


def test_cards_and_phones_next_to_each_other(spark):
    card, phone = "4111 1111 1111 1111", "+33612345678"
    texts = [f"+49 {card}", f"+1 {card}", "+49 4111111111111111", "+49 4111-1111-1111-1111.", f"{phone} 4111111111111111", f"{phone} {card}"]
    for old, new in zip(texts, outputs(spark, texts), strict=True):
        assert "1111" not in new.replace(" ", "").replace("-", "")[-16:] and re.sub("[0-9]", "0", new) == re.sub("[0-9]", "0", old)
        assert luhn(re.sub("[^0-9]", "", new)[-16:]) == 0
    assert all(phone not in x for x in outputs(spark, texts)[4:])
