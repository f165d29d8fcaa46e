"""Pseudonyms: bijective, valid, of the same format, linked across documents; the rest of a text stays."""

import re
from datetime import date

import regex
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from saleslens.llm import pii

from . import brute

KEY = "k"


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(d[0::2] + [x * 2 - 9 * (x > 4) for x in d[1::2]]) % 10 == 0


def iban(s):
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def shape(s):
    return re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "9", s)))


def run(spark, texts, key=KEY):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.text, r.n_pseudonyms) for r in pii.pseudonymize(df, key).orderBy("doc_id").collect()]


def test_permutations(spark):
    for base, width in ((10, 3), (10, 1), (26, 2), (16, 2)):
        values = [[]]
        for _ in range(width):
            values = [[*v, c] for v in values for c in range(base)]
        df = spark.createDataFrame([([(c, base) for c in v],) for v in values], f"s {pii.SYMBOLS}")
        got = [[x.v for x in r[0]] for r in df.select(pii.permute(F.col("s"), KEY, F.lit("t"))).collect()]
        assert sorted(got) == values and (width == 1 or got != values)
        assert got[:40] == [brute.feistel(v, [base] * width, KEY, "t") for v in values[:40]]
    days = spark.range(20_000).select(F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    new = [r[0] for r in days.select(pii.pseudonym(F.col("d"), KEY)).collect()]
    assert len(set(new)) == 20_000 and all(1800 <= date.fromisoformat(d).year < 2200 for d in new)


def test_whole_table_against_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: (r.text, r.n_pseudonyms) for r in pii.pseudonymize(docs, KEY).collect()}
    assert got == {r.doc_id: brute.pseudonymized(r.text, KEY, pii) for r in docs.collect()}
    assert sum(n for _, n in got.values()) > 10


@given(st.lists(st.lists(st.sampled_from(["4111 1111 1111 1111", "3782 822463 10005", "5500005555555559", "1234 5678 9012 3456", "12/27", "123", "42", "7", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947",
                                 "GB82WEST12345698765432", "+49 (0)30 12345678", "+493012345678", "+1 (980) 555-2833", "980-555-2833", "123-45-6789", "000-45-6789", "10.2.3.4", "v10.2.3.4", "version 1.2.3.4",
                                 "2021-02-28", "30.02.2021", "12/31/2020", "31/12/2020", "Jane.Doe7@example.org", "a_b@x.y.z", "4BB0C75CC3B0398440B6", "c0ffee00c0ffee00ab", "é", "x", "AB CD"]),
                         max_size=5).map(" ".join), min_size=1, max_size=30))
@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
def test_mixed_values_against_plain_python(spark, texts):
    assert run(spark, texts) == [brute.pseudonymized(t, KEY, pii) for t in texts]


def test_pseudonyms_stay_valid_and_share_no_part(spark):
    rows = spark.range(3000).select(F.format_string("%03d-%02d-%04d", F.col("id") % 665 + 1, F.col("id") % 99 + 1, F.col("id") + 1).alias("s"))
    new = [r[0] for r in rows.select(pii.pseudonym(F.col("s"), KEY)).collect()]
    assert len(set(new)) == 3000 and all(regex.fullmatch(pii.SSN, s) for s in new)
    (a, _), (b, _) = run(spark, ["4111111111111111", "4111111111112119"])
    assert luhn(a) and luhn(b) and a[:4] != b[:4] and a[4:8] != b[4:8] and a[8:12] != b[8:12]
    phones = ["+49 30 12345678", "+493012345678", "+49 (0)30 1234-5678", "+1 (980) 555-2833", "(980) 555-2833", "980-555-2833"]
    digits = [re.sub(r"\D", "", t.replace("(0)", "")) for t, n in run(spark, phones) if n == 1]
    assert len(digits) == 6 and len(set(digits[:3])) == 1 and digits[3] == "1" + digits[4] and digits[4] == digits[5]
    cased = ["Jane.Doe@x.org", "jane.doe@x.org", "4BB0C75CC3B0398440B6", "4bb0c75cc3b0398440b6"]
    got = [t for t, _ in run(spark, cased)]
    assert got[0].lower() == got[1] and got[2].lower() == got[3]


def test_texts_of_a_million_characters(spark):
    """Of every pattern its own repeating unit, and an address with thousands of labels."""
    units = ["a@", "b.", "a@b.", "1 ", "1-", "a", "f0", "12", "10.2.3.4 ", "123-45-6789 ", "DE89 3704 ", "AB12 ", "2021-02-28 ", "+1 (", "+49 30 1234 ", "(212) ", "jane@x.org ", "version 1."]
    texts = [u * (1_000_000 // len(u)) for u in units] + ["a@" + "b." * 20_000 + "c"]
    got = run(spark, texts)
    counts = dict(zip(units, (n for _, n in got), strict=False))
    assert counts["2021-02-28 "] == 90_909 and counts["123-45-6789 "] == 83_333 and counts["jane@x.org "] == 90_909 and counts["f0"] == 1 and counts["1 "] == 0
    assert got[-1][1] == 1 and got[-1][0][1:] == texts[-1][1:] and got[-1][0][0] != "a"


def test_values_stay_valid_linked_and_in_format(spark):
    values = {"card": "4111 1111-1111 1111".replace("-", " "), "iban": "DE89 3704 0044 0532 0130 00", "ip": "192.168.10.254", "date": "2021-02-28", "email": "Jane.Doe7@example.org", "ssn": "123-45-6789", "phone": "+49 30 1234 5678"}
    texts = [f"é pre {v}, post." for v in values.values()] + [f"again ({v}) and {v}" for v in values.values()]
    got = run(spark, texts)
    for i, (kind, v) in enumerate(values.items()):
        text, n = got[i]
        assert n == 1 and text.startswith("é pre ") and text.endswith(", post."), (kind, text)
        new = text[len("é pre "):-len(", post.")]
        assert new != v and (kind == "ip" or shape(new) == shape(v)), (kind, new)
        assert got[i + len(values)] == (f"again ({new}) and {new}", 2), kind
        if kind == "card":
            assert luhn(new)
        if kind == "iban":
            assert iban(new) and new[:2] == "DE"
        if kind == "ip":
            assert all(0 <= int(x) < 256 for x in new.split("."))
        if kind == "email":
            assert new.endswith("@example.org")
    assert run(spark, texts, "other key") != got


def test_defined_cases(spark):
    same = [None, "", "no digits here", "4111 1111 1111 1112 is no card", "2021-02-30", "999.1.1.1", "DE00 3704 0044 0532 0130 00", "page 12 of 300", "000-12-3456", "666-12-3456", "version 10.2.3.4", "v1.2.3.4", "0000 0000 0000 0000"]
    assert run(spark, same) == [(t, 0) for t in same]
    df = spark.createDataFrame([(1, "on 2020-01-01 " * 20_000, "c", 5), (None, "10.0.0.1", None, None)], "doc_id long, text string, N_Pseudonyms string, __x int")
    got = {r.doc_id: r for r in pii.pseudonymize(df, KEY).collect()}
    assert got[1].n_pseudonyms == 20_000 and got[None].n_pseudonyms == 1
    assert pii.pseudonymize(df.limit(0), KEY).count() == 0


def test_values_beside_other_numbers_and_words(spark):
    cards = ["4111 1111 1111 1111", "4111111111111111", "3782 822463 10005", "4222222222222", "6212345678900000003"]
    ibans = ["ES91 2100 0418 4502 0005 1332", "AT61 1904 3002 3457 3201", "NO93 8601 1117 947", "GB82WEST12345698765432"]
    by_cards = ["{} 12/27", "{} 123", "42 {}", "7 42 {} 12 123", "1234 {}", "{} 123-45-6789", "{} 12/27/2025", "{} 2021-02-28", "{} 10.0.0.1"]
    by_ibans = ["{} IN", "{} USD", "{} 2024", "{} AB CD 12"]
    cases = [(f, v) for fs, vs in ((by_cards, cards), (by_ibans, ibans)) for f in fs for v in vs]
    both = [f"{cards[0]} {cards[2]} 1234", f"{ibans[1]} {cards[0]}"]
    got = run(spark, [*cards, *ibans, *by_cards, *(f.format(v) for f, v in cases), *both])
    alone, got = dict(zip([*cards, *ibans], got, strict=False)), got[len(cards) + len(ibans):]
    assert all(n == 1 and t != v and (luhn(t) if v in cards else iban(t)) for v, (t, n) in alone.items())
    rest, got = dict(zip(by_cards, got, strict=False)), got[len(by_cards):]
    for (f, v), now in zip(cases, got, strict=False):
        form, n = rest.get(f, (f, 0))
        assert now == (form.format(alone[v][0]), n + 1), (f, v)
    assert got[-2:] == [(f"{alone[cards[0]][0]} {alone[cards[2]][0]} 1234", 2), (f"{alone[ibans[1]][0]} {alone[cards[0]][0]}", 2)]
