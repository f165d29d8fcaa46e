"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Candidates are found by one regular expression and validated (Luhn and leading digit, mod 97, octets, calendar, number plans); what is
valid is written as symbols of given radices and permuted as a whole by a keyed Feistel network, whose round function is SHA-256: two
halves, each added in turn, symbol by symbol, to what the other one yields.  So the same value with the same key has the same
pseudonym in every document, whatever its separators, different values have different ones, and nothing is stored.  The rest of a text is unchanged.

Kinds and what is permuted: ``card`` (all digits but the check digit, which is recomputed), ``iban`` (digits of the account,
check digits recomputed), ``phone`` (digits after the country code, without a bracketed trunk zero; numbers of plan 1 with and without
code are equal), ``ssn`` (ranks of area, group and serial among the valid ones), ``ip`` (octets), ``date``
(the day within 1800-2199, written in the same way), ``email`` (letters and digits of the local part), ``secret`` (hexadecimal
tokens of 16 or more).  Radices keep every pseudonym valid: a digit that can't lead isn't put first.  Separators stay, and so does letter
case but in tokens of both cases, which become lower case.

Defined cases: a null text stays null with count 0; an empty text stays empty; invalid candidates stay as they are, and so do four-part
numbers after ``version``, ``release``, ``ver``, ``rev``, ``build`` or ``v``.  A run of digits is searched for cards in usual groups at every
separator; only if none is valid, its longest beginning counts as one.  No pattern recurses on repetition, so texts may have any length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: Days in the 400-year cycle from 1800-01-01, and its factors (the two halves of a date).
DAYS, DAYS_A, DAYS_B = 146_097, 189, 773

# Candidate formats.  Repeated groups are possessive or bounded.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,127}+"
DATE = r"(?<![\d.,/-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d/-])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IP = rf"(?<![\d.])(?=\d{{1,3}}\.)(?<!(?i:version|release|ver|rev|build|v)[ .:]{{0,2}})(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)"
#: Lengths of account numbers by country, as registered; other letters may have any length.
IBAN_LENGTHS = {15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH CR HR LI LV",
                22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
                26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
                31: "MT SC", 32: "LC", 33: "RU"}
_IBANS = "|".join(f"(?:{'|'.join(c.split())})\\d{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
IBAN = rf"(?<![A-Za-z0-9])(?:{_IBANS}|[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?)(?![A-Za-z0-9])"
#: Country codes of one, two and three digits; with 15 digits at most in all.
CODES = (r"[17]", r"(?:2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])", r"(?!2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])[2-9]\d\d")
_GAP = r"(?:[ .()-]{0,2}\d)"
PHONE = (rf"(?<![\w+])\+(?:{CODES[0]}{_GAP}{{10}}|{CODES[1]}{_GAP}{{6,13}}|{CODES[2]}{_GAP}{{5,12}})(?!\d)"
         r"|(?<![\w+])\([2-9]\d{2}\) ?[2-9]\d{2}-\d{4}(?!\d)|(?<![\d-])[2-9]\d{2}-[2-9]\d{2}-\d{4}(?![\d-])")
SSN = r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])"
SECRET = r"(?<![A-Za-z0-9])(?=[a-fA-F]*\d)(?=\d*[a-fA-F])[0-9a-fA-F]{16,}+(?![A-Za-z0-9])"
#: A run of digits that may hold cards among other numbers (label, expiry, security code); it ends before values of other kinds.
CARD = rf"(?<!\d)\d(?:(?![ -](?:{DATE}|{IP}|{SSN}|\d{{3}}-\d{{3}}-\d{{4}}(?![\d-])))[ -]?\d){{12,}}+"
#: Digits in the groups of a card, the likelier first; besides, 13 to 19 digits without separators.
CARD_GROUPS = ((4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3), (8, 8), (4, 3, 3, 3), (4, 4, 4, 1))
#: Leading digits of payment cards.
CARD_LEADS = "[2-6]"
PATTERN = "|".join((EMAIL, DATE, IP, IBAN, PHONE, SSN, SECRET, CARD))
SYMBOLS = "array<struct<v:int,r:int>>"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), use), 0)


def permute(symbols: Column, key: str, tweak: Column) -> Column:
    """Keyed permutation of the arrays of (value v, radix r) with the same radices, 0 <= v < r; changed values, same radices."""

    def added(part: Column, other: Column, turn: Column) -> Column:
        seen = F.array_join(F.transform(other, lambda s: s["v"].cast("string")), ",")
        head = F.sha2(F.concat_ws("|", F.lit(key), tweak, F.size(symbols).cast("string"), turn.cast("string"), seen), 256)

        def stream(h: Column) -> Column:  # 32 bits a symbol
            blocks = F.sequence(F.lit(0), F.floor(F.size(part) / 8).cast("int"))
            text = F.array_join(F.transform(blocks, lambda b: F.sha2(F.concat(h, b.cast("string")), 256)), "")
            return F.slice(F.regexp_extract_all(text, F.lit("[0-9a-f]{8}"), F.lit(0)), 1, F.size(part))

        def add(s: Column, x: Column) -> Column:
            return F.struct(F.pmod(s["v"] + F.conv(x, 16, 10).cast("long"), s["r"]).cast("int").alias("v"), s["r"].alias("r"))

        return F.zip_with(part, once(head, stream), add)

    def step(s: Column, turn: Column) -> Column:
        odd = turn % 2 == 1
        return F.struct(F.when(odd, s["a"]).otherwise(added(s["a"], s["b"], turn)).alias("a"), F.when(odd, added(s["b"], s["a"], turn)).otherwise(s["b"]).alias("b"))

    half = F.floor(F.size(symbols) / 2).cast("int")
    start = F.struct(F.slice(symbols, F.lit(1), half).alias("a"), F.slice(symbols, half + 1, F.size(symbols) - half).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.concat(s["a"], s["b"]))


def only(s: Column, keep: str) -> Column:
    return F.regexp_replace(s, f"[^{keep}]", "")


def symbol(value: Column, radix: Column | int) -> Column:
    return F.struct(value.cast("int").alias("v"), (F.lit(radix) if isinstance(radix, int) else radix).cast("int").alias("r"))


def digit_symbols(digits: Column) -> Column:
    return F.transform(F.split(digits, ""), lambda c: symbol(c, 10))


def joined(symbols: Column) -> Column:
    return F.array_join(F.transform(symbols, lambda s: s["v"].cast("string")), "")


def refill(shape: Column, new: Column) -> Column:
    """``shape``, a short string, with its letters and digits replaced in order by those of ``new``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("i"))

    def step(s: Column, c: Column) -> Column:
        hit = c.rlike("[A-Z0-9]")
        return F.struct(F.concat(s["out"], F.when(hit, F.substring(new, s["i"], F.lit(1))).otherwise(c)).alias("out"), (s["i"] + F.when(hit, 1).otherwise(0)).alias("i"))

    return F.aggregate(F.split(shape, ""), start, step, lambda s: s["out"])


def luhn_sum(digits: Column, check: int) -> Column:
    """Luhn sum of ``digits`` followed by ``check`` more digits."""
    def weigh(acc: Column, x: Column) -> Column:
        d = x.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.struct((acc["sum"] + F.when(acc["i"] % 2 == 1, twice).otherwise(d)).alias("sum"), (acc["i"] + 1).alias("i"))
    return F.aggregate(F.split(F.reverse(digits), ""), F.struct(F.lit(0).alias("sum"), F.lit(check).alias("i")), weigh, lambda a: a["sum"])


def valid_card(digits: Column) -> Column:
    return F.length(digits).between(13, 19) & digits.rlike(f"^{CARD_LEADS}") & (luhn_sum(digits, 0) % 10 == 0)


def mod97(s: Column) -> Column:
    """Of letters and digits, a letter counting 10 to 35, as IBAN check digits do."""
    def step(acc: Column, c: Column) -> Column:
        n = F.conv(c, 36, 10).cast("long")
        return (F.when(n > 9, acc * 100).otherwise(acc * 10) + n) % 97
    return F.aggregate(F.split(s, ""), F.lit(0).cast("long"), step)


_DMY = r"(\d{2})\D(\d{2})\D(\d{4})"


def _day_first(m: Column) -> Column:
    return F.try_to_date(F.regexp_replace(m, _DMY, "$3-$2-$1"), "yyyy-MM-dd")


def _day(m: Column) -> Column:
    """Days since 1800 of the valid date that a candidate writes, else null; dd before mm, unless only the other order is valid."""
    date = F.when(m.rlike(r"^\d{4}-"), F.try_to_date(m, "yyyy-MM-dd")).otherwise(F.coalesce(_day_first(m), F.try_to_date(F.regexp_replace(m, _DMY, "$3-$1-$2"), "yyyy-MM-dd")))
    return F.datediff(date, F.lit("1800-01-01").cast("date"))


def _whole(pattern: str) -> str:
    return f"^(?:{pattern})$"


def _code(m: Column) -> Column:
    """Country code of a phone number; numbers without one are of plan 1."""
    code = F.regexp_extract(m, rf"^\+({'|'.join(CODES)})", 1)
    return F.when(code == "", "1").otherwise(code)


def _subscriber(m: Column) -> Column:
    """Digits after the country code; a bracketed trunk zero isn't one of them."""
    digits = only(F.replace(m, F.lit("(0)"), F.lit("")), "0-9")
    return F.when(m.startswith("+"), F.substring(digits, F.length(_code(m)) + 1, F.length(digits))).otherwise(digits)


def _phone_symbols(code: Column, digits: Column) -> Column:
    """Digits that lead a number or, in plan 1, an exchange, stay among those that can, or that can't."""
    def one(c: Column, i: Column) -> Column:
        plan = F.when((code == "1") & i.isin(0, 3), F.when(c >= "2", 8).otherwise(2)).when(i == 0, F.when(c == "0", 1).otherwise(9)).otherwise(10)
        return F.transform(F.array(plan), lambda r: symbol(c.cast("int") - F.when((r == 8), 2).when(r == 9, 1).otherwise(0), r))[0]

    return F.transform(F.split(digits, ""), one)


def _phone_digits(symbols: Column) -> Column:
    return F.array_join(F.transform(symbols, lambda s: (s["v"] + F.when(s["r"] == 8, 2).when(s["r"] == 9, 1).otherwise(0)).cast("string")), "")


def _local_symbols(local: Column) -> Column:
    """A symbol per character; those that stay have radix 1."""
    def one(c: Column) -> Column:
        return F.when(c.rlike("[a-z]"), symbol(F.ascii(c) - 97, 26)).when(c.rlike("[0-9]"), symbol(F.ascii(c) - 48, 10)).otherwise(symbol(F.lit(0), 1))
    return F.transform(F.split(F.lower(local), ""), one)


def _local(local: Column, symbols: Column) -> Column:
    def one(c: Column, s: Column) -> Column:
        return F.when(c.rlike("[A-Z]"), F.char(s["v"] + 65)).when(c.rlike("[a-z]"), F.char(s["v"] + 97)).when(c.rlike("[0-9]"), s["v"].cast("string")).otherwise(c)
    return F.array_join(F.zip_with(F.split(local, ""), symbols, one), "")


def _values(m: Column) -> Column:
    """(kind, tweak, symbols) of one candidate; null if it isn't valid."""
    digits, bare = only(m, "0-9"), F.replace(m, F.lit(" "), F.lit(""))
    account = F.substring(bare, F.lit(5), F.length(bare))
    area = F.substring(digits, 1, 3).cast("int")

    def of(kind: str, symbols: Column, tweak: Column | None = None) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.concat_ws(":", F.lit(kind), *([] if tweak is None else [tweak])).alias("tweak"), symbols.cast(SYMBOLS).alias("symbols"))

    day = once(_day(m), lambda n: F.when(n.between(0, DAYS - 1), F.array(symbol(F.floor(n / DAYS_B), DAYS_A), symbol(n % DAYS_B, DAYS_B))))
    octets = F.transform(F.split(m, r"\."), lambda x: symbol(x, 256))
    ranks = F.array(symbol(area - F.when(area > 666, 2).otherwise(1), 898), symbol(F.substring(digits, 4, 2).cast("int") - 1, 99), symbol(F.substring(digits, 6, 4).cast("int") - 1, 9999))
    payload = F.substring(digits, F.lit(1), F.length(digits) - 1)
    card = F.transform(F.split(payload, ""), lambda c, i: F.when(i == 0, symbol(c.cast("int") - 2, 5)).otherwise(symbol(c, 10)))
    return (F.when(m.contains("@"), of("email", _local_symbols(F.substring_index(m, "@", 1))))
            .when(m.rlike(_whole(DATE)), once(day, lambda s: F.when(s.isNotNull(), of("date", s))))
            .when(m.rlike(_whole(IP)), of("ip", octets))
            .when(m.rlike(_whole(IBAN)), F.when(mod97(F.concat(account, F.substring(bare, 1, 4))) == 1, of("iban", digit_symbols(only(account, "0-9")), F.concat(F.substring(bare, 1, 2), only(account, "A-Z")))))
            .when(m.rlike(_whole(PHONE)), of("phone", _phone_symbols(_code(m), _subscriber(m)), _code(m)))
            .when(m.rlike(_whole(SSN)), of("ssn", ranks))
            .when(m.rlike(_whole(SECRET)), of("secret", F.transform(F.split(F.lower(m), ""), lambda c: symbol(F.conv(c, 16, 10), 16))))
            .when(m.rlike(_whole(CARD)), F.when(valid_card(digits), of("card", card))))


def _written(m: Column, kind: Column, s: Column) -> Column:
    """The symbols ``s`` in the format of ``m``."""
    def v(i: int) -> Column:
        return F.get(s, i)["v"]

    new_day = F.date_add(F.lit("1800-01-01").cast("date"), v(0) * DAYS_B + v(1))
    date = F.when(m.contains("-"), F.date_format(new_day, "yyyy-MM-dd")).when(m.contains("."), F.date_format(new_day, "dd.MM.yyyy")) \
        .when(_day_first(m).isNotNull(), F.date_format(new_day, "dd/MM/yyyy")).otherwise(F.date_format(new_day, "MM/dd/yyyy"))
    bare = F.replace(m, F.lit(" "), F.lit(""))

    def iban(digits: Column) -> Column:
        account = once(F.substring(bare, F.lit(5), F.length(bare)), lambda a: _refill_digits(a, digits))
        country = F.substring(bare, 1, 2)
        return once(account, lambda a: refill(m, F.concat(country, F.lpad((98 - mod97(F.concat(a, country, F.lit("00")))).cast("string"), 2, "0"), a)))

    def phone(digits: Column) -> Column:
        shape = F.replace(m, F.lit("(0)"), F.lit("(∅)"))  # the trunk zero is no digit of the number
        return F.replace(refill(shape, F.concat(F.when(m.startswith("+"), _code(m)).otherwise(""), digits)), F.lit("∅"), F.lit("0"))

    hexes = F.array_join(F.transform(s, lambda x: F.lower(F.hex(x["v"]))), "")
    first = F.get(s, 0)["v"] + 2
    payload = F.concat(first.cast("string"), joined(F.slice(s, F.lit(2), F.size(s))))
    return (F.when(kind == "email", F.concat(_local(F.substring_index(m, "@", 1), s), F.regexp_extract(m, "(@.*)$", 1)))
            .when(kind == "date", date)
            .when(kind == "ip", F.array_join(F.transform(s, lambda x: x["v"].cast("string")), "."))
            .when(kind == "iban", once(joined(s), iban))
            .when(kind == "phone", once(_phone_digits(s), phone))
            .when(kind == "ssn", F.concat_ws("-", F.lpad((v(0) + F.when(v(0) > 664, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((v(1) + 1).cast("string"), 2, "0"), F.lpad((v(2) + 1).cast("string"), 4, "0")))
            .when(kind == "secret", F.when(m == F.upper(m), F.upper(hexes)).otherwise(hexes))
            .when(kind == "card", once(payload, lambda p: refill(m, F.concat(p, F.pmod(-luhn_sum(p, 1), F.lit(10)).cast("string"))))))


def _refill_digits(shape: Column, digits: Column) -> Column:
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("i"))

    def step(s: Column, c: Column) -> Column:
        hit = c.rlike("[0-9]")
        return F.struct(F.concat(s["out"], F.when(hit, F.substring(digits, s["i"], F.lit(1))).otherwise(c)).alias("out"), (s["i"] + F.when(hit, 1).otherwise(0)).alias("i"))

    return F.aggregate(F.split(shape, ""), start, step, lambda s: s["out"])


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one candidate; null if it isn't valid."""
    def of(x: Column) -> Column:
        return F.when(x.isNotNull(), once(permute(x["symbols"], key, x["tweak"]), lambda s: _written(m, x["kind"], s)))

    return once(_values(m), of)


def card_pieces(run: Column) -> Column:
    """The pieces of a run of digits, in order: valid cards in usual groups, and what lies between.  Without any, the longest
    beginning of at most 19 digits and the rest."""
    found = F.regexp_extract_all(run, F.lit(r"[ -]?\d+"), F.lit(0))
    return once(found, lambda parts: once(F.transform(parts, lambda p: F.length(only(p, "0-9"))), lambda sizes: _pieces(parts, sizes)))


def _pieces(parts: Column, sizes: Column) -> Column:
    def text(i: Column, n: Column) -> Column:
        return F.array_join(F.slice(parts, i, n), "")

    def valid(i: Column, n: int) -> Column:
        return valid_card(only(text(i, F.lit(n)), "0-9"))

    def groups(i: Column) -> Column:
        usual = [F.when((F.slice(sizes, i, len(g)) == F.array(*map(F.lit, g))) & valid(i, len(g)), len(g)) for g in CARD_GROUPS]
        return F.coalesce(F.when(F.get(sizes, i - 1).between(13, 19) & valid(i, 1), 1), *usual, F.lit(0))

    every = F.sequence(F.lit(1), F.size(parts))
    hits = F.filter(F.transform(every, lambda i: F.struct(i.alias("at"), groups(i).alias("n"))), lambda h: h["n"] > 0)
    none = F.struct(F.expr("cast(array() as array<struct<at:int,n:int>>)").alias("got"), F.lit(1).alias("next"))
    chosen = F.aggregate(hits, none, lambda s, h: F.when(h["at"] >= s["next"], F.struct(F.concat(s["got"], F.array(h)).alias("got"), (h["at"] + h["n"]).alias("next"))).otherwise(s), lambda s: s["got"])

    def cut(cards: Column) -> Column:
        def end(k: Column) -> Column:
            return F.when(k < 0, 1).otherwise(F.get(cards, k)["at"] + F.get(cards, k)["n"])

        def around(h: Column, k: Column) -> Column:
            card = text(h["at"], h["n"])
            return F.array(text(end(k - 1), h["at"] - end(k - 1)), F.regexp_extract(card, "^[ -]?", 0), F.regexp_replace(card, "^[ -]", ""))

        last = end(F.size(cards) - 1)
        return F.concat(F.flatten(F.transform(cards, around)), F.array(text(last, F.size(parts) + 1 - last)))

    fits = F.size(F.filter(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(19))), lambda n: F.aggregate(F.slice(sizes, F.lit(1), n), F.lit(0), lambda a, x: a + x) <= 19))
    whole = once(fits, lambda n: F.array(text(F.lit(1), n), text(n + 1, F.size(parts))))
    return once(chosen, lambda cards: F.when(F.size(cards) > 0, cut(cards)).otherwise(whole))


def pseudonymize(df: DataFrame, key: str, text: str = "text", out: str = "text", count: str = "n_pseudonyms") -> DataFrame:
    """``df`` with the pseudonymized text in ``out`` and the number of replaced values in ``count`` (columns of these names are
    replaced).  The expression is scanned for only in texts that hold a digit or an @."""
    keep = [c for c in df.columns if c.lower() not in {out.lower(), count.lower()}]
    kept = [F.col(f"`{c}`") for c in keep]
    source = F.col(f"`{text}`")
    found = F.when(source.rlike("[0-9@]"), F.regexp_extract_all(source, F.lit(PATTERN), F.lit(0)))
    rows = df.select(*kept, source.alias("__text"), found.alias("__found"))
    # A candidate is one piece, or several if it is a run of digits.
    pieces = F.transform("__found", lambda m: F.when(m.rlike(_whole(CARD)), card_pieces(m)).otherwise(F.array(m)))
    rows = rows.select(*kept, "__text", F.when(F.size("__found") > 0, pieces).alias("__found"))
    new: Callable[[Column], Column] = lambda m: pseudonym(m, key)
    rows = rows.select(*kept, "__text", "__found", F.transform("__found", lambda ps: F.transform(ps, new)).alias("__new"))
    # Gaps and matches alternate; a piece that isn't valid is put back as it was.
    put = F.zip_with("__new", "__found", lambda ns, ps: F.array_join(F.zip_with(ns, ps, lambda n, p: F.coalesce(n, p)), ""))
    text_new = F.when(F.size("__found") > 0, F.array_join(F.zip_with(F.split("__text", PATTERN, -1), put, lambda g, p: F.concat(g, F.coalesce(p, F.lit("")))), "")).otherwise(F.col("__text"))
    return rows.select(*kept, text_new.alias(out), F.coalesce(F.size(F.filter(F.flatten("__new"), lambda n: n.isNotNull())), F.lit(0)).alias(count))
