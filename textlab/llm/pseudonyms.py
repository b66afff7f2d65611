"""Format-preserving pseudonyms of personal data by a keyed Feistel permutation.

Numbers and dates that pass their check are permuted among all values of the same format, so the
result passes the check as well, two values never meet in one, and a value is the same pseudonym
wherever it stands. Addresses of mail and secrets have no format to count through and get keyed
digests of the same look. Everything is built from DataFrame functions.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where a session names the key.
KEY_SETTING = "textlab.pseudonyms.key"
ROUNDS = 8

#: Patterns by kind; where several fit at one place the first one decides.
PATTERNS = {
    "mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "secret": r"(?<![A-Za-z0-9_])(?i:token|secret|password|passwd|api_?key)[\x20]{0,2}[=:][\x20]{0,2}[\"']?[A-Za-z0-9_/+-]{16,}+",
    "credential": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|sk-[A-Za-z0-9_-]{20,}+|gh[pousr]_[A-Za-z0-9]{36,}+)(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){2,7}(?:[\x20]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?![0-9]|[./-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)[\x20.-]?|[0-9]{2,4}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9A-Za-z])",
    "plus": r"(?<![0-9A-Za-z+])\+[0-9]{8,15}(?![0-9])",
}
ANY = "|".join(PATTERNS.values())
#: A text without any of these has nothing to replace: every pattern has a sign of mails or secrets,
#: or two digits that touch or have one dot, blank or hyphen between them.
HINT = r"[@=:]|[0-9][.\x20-]?[0-9]|AKIA|sk-|gh[pousr]_"
#: Country codes of phone numbers; those not listed have three digits.
COUNTRY = r"^(\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}))"
#: Set around a card or IBAN that is shorter than the longest match; no pattern holds or needs it.
END, SELF = "\uffff", "\ufffe"
#: Letters and digits of an IBAN by country.
IBAN_LENGTHS = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT SD ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO EG GT HU LB NI PL SV",
        29: "BR PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}


def digest(*parts: Column) -> Column:
    """60 bits of a keyed digest, the round function of the permutation."""
    return F.conv(F.substring(F.sha2(F.encode(F.concat_ws("|", *[p.cast("string") for p in parts]), "UTF-8"), 256), 1, 15), 16, 10).cast("long")


def quotient(a: Column, b) -> Column:
    b = b if isinstance(b, Column) else F.lit(b)
    return ((a - F.pmod(a, b)) / b).cast("long")


def permuted(value: Column, low: Column, high: Column, kind: Column, key: str) -> Column:
    """Permutation of 0 to ``low * high - 1``: the halves take turns in shifting each other.

    The value is left * low + right; both factors are below 2 ** 31.
    """
    start = F.struct(quotient(value, low).alias("left"), F.pmod(value, low).alias("right"))

    def turn(a, i):
        even = F.pmod(i, F.lit(2)) == 0
        shift = digest(F.lit(key), kind, i, low, high, F.when(even, a["right"]).otherwise(a["left"]))
        return F.struct(
            F.when(even, F.pmod(a["left"] + shift, high)).otherwise(a["left"]).alias("left"),
            F.when(even, a["right"]).otherwise(F.pmod(a["right"] + shift, low)).alias("right"),
        )

    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)
    return done["left"] * low + done["right"]


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def laid_out(digits: Column, like: Column) -> Column:
    """The digits in the places that digits have in ``like``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def put(a, c):
        digit = (c >= "0") & (c <= "9")
        return F.struct(
            F.concat(a["out"], F.when(digit, F.substring(digits, a["at"], F.lit(1))).otherwise(c)).alias("out"),
            (a["at"] + digit.cast("int")).alias("at"),
        )

    return F.aggregate(F.split(like, ""), start, put)["out"]


def luhn(digits: Column, doubled: int) -> Column:
    """Luhn sum of digits; from the right, the first (1) or second (0) one is doubled first."""
    start = F.struct(F.lit(0).alias("sum"), F.lit(doubled).alias("double"))

    def add(a, c):
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.struct((a["sum"] + F.when(a["double"] == 1, twice).otherwise(d)).alias("sum"), (1 - a["double"]).alias("double"))

    return F.aggregate(F.split(F.reverse(digits), ""), start, add)["sum"]


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed and planned once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_card(digits: Column) -> Column:
    """Whether 13 to 19 digits pass the Luhn check."""
    return F.char_length(digits).between(13, 19) & (F.pmod(luhn(digits, 0), F.lit(10)) == 0)


def job(kind: Column | str, number: Column, low: Column | int, high: Column | int, digits: Column | int = 0) -> Column:
    """A number to be permuted among ``low * high``, and the digits that the result is filled up to."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        lit(kind).alias("kind"), number.cast("long").alias("number"), lit(low).cast("long").alias("low"),
        lit(high).cast("long").alias("high"), lit(digits).cast("int").alias("digits"),
    )


def digit_jobs(kind: Column, parts: Column) -> Column:
    """One job per string of at most 18 digits, the second of its own kind."""

    def one(digits: Column, i: Column) -> Column:
        n = F.char_length(digits)
        half = F.floor(n / 2)
        power = lambda x: F.round(F.pow(F.lit(10.0), x))
        return job(F.when(i == 0, kind).otherwise(F.concat(kind, F.lit("2"))), F.concat(F.lit("0"), digits), power(n - half), power(half), n)

    return F.transform(F.filter(parts, lambda x: x != ""), one)


def ssn_job(value: Column) -> Column:
    """Social security numbers with an area, group and serial that are given out."""
    return let(
        F.transform(F.split(value, "-"), lambda x: x.cast("int")),
        lambda p: F.when(
            (p[0] > 0) & (p[0] < 900) & (p[0] != 666) & (p[1] > 0) & (p[2] > 0),
            job("ssn", ((p[0] - 1 - (p[0] > 666).cast("int")) * 99 + p[1] - 1).cast("long") * 9999 + p[2] - 1, 9999, 898 * 99),
        ),
    )


def ssn_of(out: Column) -> Column:
    def show(left: Column) -> Column:
        area = quotient(left, 99) + 1
        parts = [(area + (area >= 666).cast("int"), 3), (F.pmod(left, F.lit(99)) + 1, 2), (F.pmod(out, F.lit(9999)) + 1, 4)]
        return F.concat_ws("-", *[F.lpad(x.cast("string"), n, "0") for x, n in parts])

    return let(quotient(out, 9999), show)


def ip_job(value: Column) -> Column:
    return let(
        F.transform(F.split(value, "[.]"), lambda x: x.cast("long")),
        lambda octets: F.when(
            F.forall(octets, lambda x: x <= 255), job("ip", F.aggregate(octets, F.lit(0).cast("long"), lambda a, x: a * 256 + x), 65536, 65536)
        ),
    )


def ip_of(out: Column) -> Column:
    return F.concat_ws(".", *[F.pmod(F.shiftright(out, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)])


def date_parts(value: Column) -> Column:
    """Year, month and day of a date as written, and whether year and month come first.

    Four digits first are year, month, day; with dots day, month, year; with slashes month, day,
    year, or day first where only that is a date.
    """

    def named(p: Column) -> Column:
        year_first = F.char_length(p[0]) == 4
        month_first = year_first | (value.contains("/") & (p[0].cast("int") <= 12))
        y, a, b = (F.when(year_first, p[i]).otherwise(p[j]) for i, j in ((0, 2), (1, 0), (2, 1)))
        return F.struct(
            y.alias("y"), F.when(month_first, a).otherwise(b).alias("m"), F.when(month_first, b).otherwise(a).alias("d"),
            year_first.alias("year_first"), month_first.alias("month_first"),
        )

    return let(F.split(value, "[./-]"), named)


def century(year: Column) -> Column:
    return F.make_date((quotient(year, 100) * 100).cast("int"), F.lit(1), F.lit(1))


def date_job(value: Column) -> Column:
    """Dates of the calendar from 1800 to 2199, each permuted inside its century."""

    def made(t: Column) -> Column:
        year, month, day = t["y"], t["m"], t["d"]
        leap = (F.pmod(year, F.lit(4)) == 0) & ((F.pmod(year, F.lit(100)) != 0) | (F.pmod(year, F.lit(400)) == 0))
        longest = F.when(month == 2, 28 + leap.cast("int")).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
        valid = year.between(1800, 2199) & month.between(1, 12) & (day >= 1) & (day <= longest)
        # A century has 92 * 397 days, or 75 * 487 if its first year is a leap year.
        long = F.pmod(quotient(year, 100), F.lit(4)) == 0
        low, high = (F.when(long, p).otherwise(q) for p, q in ((487, 397), (75, 92)))
        return F.when(valid, job("date", F.datediff(F.make_date(year, month, day), century(year)), low, high))

    return let(date_parts(value), lambda p: let(F.struct(*[p[k].cast("int").alias(k) for k in "ymd"]), made))


def date_of(value: Column, out: Column) -> Column:
    """A date as it is written, with the day that ``out`` days of its century lead to."""

    def show(t: Column) -> Column:
        p, new = t["p"], t["new"]
        fit = lambda x, like: F.lpad(x.cast("string"), F.when(F.char_length(like) == 2, 2).otherwise(F.char_length(x.cast("string"))), F.lit("0"))
        month, day, year = fit(F.month(new), p["m"]), fit(F.day(new), p["d"]), F.lpad(F.year(new).cast("string"), 4, "0")
        mark = F.regexp_extract(value, "([./-])", 1)
        two = F.when(p["month_first"], F.concat(month, mark, day)).otherwise(F.concat(day, mark, month))
        return F.when(p["year_first"], F.concat(year, mark, two)).otherwise(F.concat(two, mark, year))

    return let(
        date_parts(value),
        lambda p: let(F.struct(p.alias("p"), F.date_add(century(p["y"].cast("int")), out.cast("int")).alias("new")), show),
    )


def remainder(letters_and_digits: Column) -> Column:
    """Of a number modulo 97, a letter standing for two digits from A = 10 on."""
    return F.aggregate(
        F.split(letters_and_digits, ""),
        F.lit(0),
        lambda a, c: F.pmod(F.when((c >= "0") & (c <= "9"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55), F.lit(97)),
    )


def is_iban(plain: Column) -> Column:
    """Whether a number without blanks has 1 to 30 digits behind its check and passes it."""
    digits = F.char_length(digits_of(F.substring(plain, 5, 99)))
    checked = remainder(F.concat(F.substring(plain, 5, 99), F.substring(plain, 1, 4))) == 1
    return (F.char_length(plain) >= 12) & (digits > 0) & (digits <= 30) & checked


def without_blanks(value: Column) -> Column:
    return F.regexp_replace(value, " ", "")


def iban_of(value: Column, body: Column) -> Column:
    """An account number with other digits, check digits to match, and blanks where they were."""
    country = F.substring(value, 1, 2)
    check = F.lpad((98 - remainder(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0")

    def spaced(out: Column) -> Column:
        return F.aggregate(
            F.split(value, ""),
            F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
            lambda a, c: F.struct(
                F.concat(a["out"], F.when(c == " ", c).otherwise(F.substring(out, a["at"], F.lit(1)))).alias("out"),
                (a["at"] + (c != " ").cast("int")).alias("at"),
            ),
        )["out"]

    return let(F.concat(country, check, body), spaced)


def keyed(value: Column, kind: str, key: str) -> Column:
    return F.sha2(F.encode(F.concat_ws("|", F.lit(key), F.lit(kind), value), "UTF-8"), 256)


def mail(value: Column, key: str) -> Column:
    """A digest for the name; the host stays."""
    return F.concat(F.lit("u"), F.substring(keyed(F.lower(value), "mail", key), 1, 12), F.lit("@"), F.regexp_extract(value, "@(.*)", 1))


def secret(value: Column, key: str) -> Column:
    """What stands before the secret, or its well-known first letters, then a digest as long."""
    head = F.regexp_extract(value, "^([^=:]*[=:] {0,2}[\"']?|AKIA|sk-|gh[pousr]_)", 1)
    return let(
        F.struct(head.alias("head"), F.substring(value, F.char_length(head) + 1, F.lit(1 << 20)).alias("tail")),
        lambda s: F.concat(s["head"], F.rpad(keyed(s["tail"], "secret", key), F.char_length(s["tail"]), keyed(s["tail"], "more", key))),
    )


def kind_of(value: Column) -> Column:
    """The kind of a match, the first whose pattern it fits as a whole."""
    found = F.when(value.contains("@"), "mail").when(value.rlike("^(?:[A-Za-z_]+ {0,2}[=:]|AKIA|sk-|gh[pousr]_)"), "secret")
    for kind in ("iban", "ip", "date", "ssn", "phone", "card"):
        found = found.when(value.rlike("^(?:" + PATTERNS[kind] + ")$"), kind)
    return found.otherwise("phone")


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one match, or the match itself where it fails its check.

    The kind is decided once. What can be counted becomes one number, or two of long account
    numbers, all kinds go through the same permutation, and the result is written as the match was:
    cards and accounts with a new check digit, phone numbers with their country code.
    """

    def read(m: Column) -> Column:
        v, kind = m["v"], m["kind"]
        rest = (
            F.when(kind == "phone", F.substring(v, F.char_length(F.regexp_extract(v, COUNTRY, 1)) + 1, F.lit(99)))
            .when(kind == "iban", F.substring(without_blanks(v), 5, 99))
            .otherwise(v)
        )
        return let(F.struct(v.alias("v"), kind.alias("kind"), rest.alias("rest"), digits_of(rest).alias("digits")), counted)

    def counted(m: Column) -> Column:
        v, kind, digits = m["v"], m["kind"], m["digits"]
        none = F.array().cast("array<string>")
        parts = (
            F.when((kind == "card") & is_card(digits), F.array(F.substring(digits, F.lit(1), F.char_length(digits) - 1)))
            .when(kind == "phone", F.array(digits))
            .when((kind == "iban") & is_iban(without_blanks(v)), F.array(F.substring(digits, 1, 15), F.substring(digits, 16, 15)))
            .otherwise(none)
        )
        number = F.when(kind == "ssn", ssn_job(v)).when(kind == "ip", ip_job(v)).when(kind == "date", date_job(v))
        jobs = F.concat(digit_jobs(kind, parts), F.filter(F.array(number), lambda x: x.isNotNull()))
        outs = F.transform(
            jobs,
            lambda x: let(
                permuted(x["number"], x["low"], x["high"], x["kind"], key),
                lambda out: F.struct(out.alias("number"), F.lpad(out.cast("string"), x["digits"], F.lit("0")).alias("digits")),
            ),
        )
        return let(F.struct(m.alias("m"), outs.alias("outs")), shown)

    def shown(r: Column) -> Column:
        v, kind, rest = r["m"]["v"], r["m"]["kind"], r["m"]["rest"]
        body = F.array_join(F.transform(r["outs"], lambda x: x["digits"]), "")
        # The check digit of a card follows from the others.
        new = let(body, lambda b: F.when(kind == "card", F.concat(b, F.pmod(10 - F.pmod(luhn(b, 1), F.lit(10)), F.lit(10)).cast("string"))).otherwise(b))
        laid = laid_out(new, rest)
        out = F.get(r["outs"], F.lit(0))["number"]
        written = (
            F.when(kind.isin("card", "phone", "iban"), let(laid, lambda t: (
                F.when(kind == "iban", iban_of(v, t)).when(kind == "phone", F.concat(F.regexp_extract(v, COUNTRY, 1), t)).otherwise(t)
            )))
            .when(kind == "ssn", ssn_of(out))
            .when(kind == "ip", ip_of(out))
            .when(kind == "date", date_of(v, out))
        )
        return F.when(F.size(r["outs"]) > 0, written).otherwise(v)

    def routed(m: Column) -> Column:
        return F.when(m["kind"] == "mail", mail(m["v"], key)).when(m["kind"] == "secret", secret(m["v"], key)).otherwise(read(m))

    return F.coalesce(let(F.struct(value.alias("v"), kind_of(value).alias("kind")), routed), value)


def shortened(value: Column) -> Column:
    """One match, with ``END`` around the part that passes where that is not the whole.

    Parts begin at the start of the match or, of a card, behind a blank or hyphen, and end before
    one. The first beginning that passes is taken, and of its parts the longest; of an IBAN first
    the one as long as its country has them.
    """
    n = F.char_length(value)
    after = lambda i: F.substring(value, i + 1, F.lit(1))
    cut = lambda a, b: F.substring(value, a, b - a + 1)
    ends = F.filter(F.sequence(F.greatest(n, F.lit(12)), F.lit(12), F.lit(-1)), lambda i: after(i).isin("", " ", "-"))
    lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])

    def card_part(ends: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(1), F.greatest(n - 12, F.lit(1))), lambda a: (a == 1) | after(a - 2).isin(" ", "-"))
        pairs = F.flatten(F.transform(begins, lambda a: F.transform(ends, lambda b: F.struct(a.alias("a"), b.alias("b")))))
        return F.get(F.filter(pairs, lambda p: let(digits_of(cut(p["a"], p["b"])), is_card)), F.lit(0))

    def iban_part(ends: Column) -> Column:
        passing = F.filter(F.transform(ends, lambda b: F.struct(F.lit(1).alias("a"), b.alias("b"))), lambda p: let(without_blanks(cut(F.lit(1), p["b"])), is_iban))
        due = F.element_at(lengths, F.substring(value, 1, 2))
        own = lambda p: F.char_length(without_blanks(cut(F.lit(1), p["b"]))) == due
        return let(passing, lambda found: F.coalesce(F.get(F.filter(found, own), F.lit(0)), F.get(found, F.lit(0))))

    def marked(p: Column) -> Column:
        before = F.when(p["a"] > 1, F.concat(cut(F.lit(1), p["a"] - 1), F.lit(END))).otherwise("")
        behind = F.when(p["b"] < n, F.concat(F.lit(END), F.substring(value, p["b"] + 1, n))).otherwise("")
        return F.concat(before, cut(p["a"], p["b"]), behind)

    best = let(ends, lambda e: F.when(value.rlike("^[0-9]"), card_part(e)).otherwise(iban_part(e)))
    fits = value.rlike(f"^(?:{PATTERNS['card']}|{PATTERNS['iban']})$")
    return F.when((n > 12) & fits, F.coalesce(let(best, marked), value)).otherwise(value)


def replaced(value: Column, rule) -> Column:
    """The text with ``rule`` applied to every match."""
    gaps, found = F.split(value, ANY, -1), F.regexp_extract_all(value, F.lit(ANY), 0)
    return F.concat(
        F.array_join(F.zip_with(F.slice(gaps, 1, F.size(found)), F.transform(found, rule), lambda a, b: F.concat(a, b)), ""),
        F.element_at(gaps, -1),
    )


def with_ends(value: Column) -> Column:
    """``END`` around every card and IBAN that is shorter than its match.

    What follows one is searched again, as it may begin the next match, until nothing is new.
    Each turn but the last sets one more ``END`` at least, with 12 characters or more before it.
    """
    turns = F.sequence(F.lit(0), F.floor(F.char_length(value) / 12).cast("int"))
    start = F.struct(value.alias("text"), F.lit("").alias("before"))

    def turn(a, _):
        again = F.struct(replaced(a["text"], shortened).alias("text"), a["text"].alias("before"))
        return F.when(a["text"] != a["before"], again).otherwise(a)

    return F.when(value.rlike(f"{PATTERNS['card']}|{PATTERNS['iban']}"), F.aggregate(turns, start, turn)["text"]).otherwise(value)


def pseudonymised(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``df`` with the personal data of its text replaced; all other columns stay as they are.

    Null stays null, a text without personal data stays as it is to the byte, and numbers that
    fail their check stay. Cards and IBANs with an expiry, a code or a word behind them are found,
    and cards behind other digits. A phone number is the same pseudonym in any notation. Whole texts
    are searched; repeated rows get equal texts, an empty table gives no rows. Whoever has ``key``
    can invert the pseudonyms.
    """
    value = F.col(text)

    def joined(marked: Column) -> Column:
        return F.replace(F.regexp_replace(replaced(marked, lambda m: pseudonym(m, key)), END + "(?!" + SELF + ")", ""), F.lit(END + SELF), F.lit(END))

    # Marks that the text has by itself get a sign behind them.
    whole = let(with_ends(F.replace(value, F.lit(END), F.lit(END + SELF))), joined)
    return df.withColumn(text, F.when(value.rlike(HINT) & value.rlike(ANY), whole).otherwise(value))


def session_key(spark: SparkSession) -> str:
    """The key that the session names in KEY_SETTING; where it names none, one is drawn and kept for
    this session, so that nobody can invert the pseudonyms later."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(16)
        spark.conf.set(KEY_SETTING, key)
    return key


def document_pseudonyms(df: DataFrame, key: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, the new ``text``, and whether it is ``changed``; every row gives one."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("old"), F.col(text).cast("string").alias("text"))
    return pseudonymised(rows, key).select("doc_id", "text", (~F.col("text").eqNullSafe(F.col("old"))).alias("changed"))
