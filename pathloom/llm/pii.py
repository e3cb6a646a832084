"""Format-preserving pseudonyms for personal data.

Validated numbers and dates go through a keyed Feistel permutation of their own format: a card number becomes another
card number with a right check digit, a date another date written alike. The permutation works on the value without its
separators and is one-to-one, so equal values stay linked across documents and different ones stay apart. Texts are split
where values may begin and put together again, all with DataFrame functions and without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.scalars import let
from pathloom.llm.spans import matches, starts
from pathloom.operators.skew import pin

KINDS = ("email", "iban", "ip", "card", "ssn", "phone", "date")
#: One pattern a kind; at one place the first kind that fits wins. Possessive parts and look-behinds keep scans linear.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}(?<four>[ -])[0-9]{4}\k<four>[0-9]{4}\k<four>[0-9]{4}|[0-9]{4}(?<six>[ -])[0-9]{6}\k<six>[0-9]{5}|[0-9]{13,19})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "date": r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9/-])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: An empty match where a value may begin, so that no match hides those inside it or across its end.
BEGINS, HERE = f"(?={ANY})", f"(?=({ANY}))"
#: Countries by the length of their IBANs.
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST",
    26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: These kinds are told by a check, which a phone number has not.
CHECKED = ("iban", "ip", "card", "ssn", "date")
ROUNDS = 10
#: Dates of one whole Gregorian cycle of 146,097 = 189 x 773 days.
FIRST_DAY, DAY_ROWS, DAY_COLUMNS = "1800-01-01", 189, 773
#: Its 4,800 months have 88,497 = 9 x 9,833 days after the twelfth.
MONTHS, LATE_ROWS, LATE_COLUMNS = 4800, 9, 9833
MONTH_FIRST = "MM/dd/yyyy"


def feistel(left: Column, right: Column, lefts: Column, rights: Column, key: str, tweak: Column | str) -> Column:
    """A keyed permutation of the pairs (left < lefts, right < rights) as ``struct(l, r)``; halves take turns."""
    tweak = F.lit(tweak) if isinstance(tweak, str) else tweak

    def turn(value: Column, step: Column, size: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, step.cast("string"), value.cast("string")), 256)
        return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), size)

    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, F.pmod(acc["l"] + turn(acc["r"], i, lefts), lefts)).otherwise(acc["l"]).alias("l"),
            F.when(even, acc["r"]).otherwise(F.pmod(acc["r"] + turn(acc["l"], i, rights), rights)).alias("r"),
        )

    return F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")),
        lambda acc, i: step(acc, i))


def _ten(n: Column) -> Column:
    return F.concat(F.lit("1"), F.repeat(F.lit("0"), n.cast("int"))).cast("long")


def _digits(value: Column, n: Column) -> Column:
    return F.lpad(value.cast("string"), n.cast("int"), "0")


def permute_digits(digits: Column, key: str, tweak: str) -> Column:
    """A keyed permutation of all strings of 2 to 36 digits of this length."""
    size = F.length(digits)
    half = (size / 2).cast("int")
    return let(
        feistel(F.substr(digits, F.lit(1), half).cast("long"), F.substr(digits, half + 1).cast("long"), _ten(half), _ten(size - half), key,
                F.concat(F.lit(tweak), size.cast("string"))),
        lambda p: F.concat(_digits(p["l"], half), _digits(p["r"], size - half)))


def refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by ``digits``; separators stay."""
    first = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    return F.aggregate(
        F.split(shape, ""), first,
        lambda acc, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(acc["out"], F.substr(digits, acc["at"], F.lit(1))).alias("out"), (acc["at"] + 1).alias("at")))
        .otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["at"].alias("at"))),
        lambda acc: acc["out"])


def _only(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _number(value: Column, start: int, size: int) -> Column:
    return F.substring(value, start, size).cast("long")


def email(value: Column, key: str) -> Column:
    return F.concat(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(value)), 256), 1, 16), F.lit("@pseudonym.invalid"))


def ip(value: Column, key: str) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda x: x.cast("long"))
    octets = lambda p: [F.floor(p["l"] / 256), p["l"] % 256, F.floor(p["r"] / 256), p["r"] % 256]
    out = let(parts, lambda o: let(
        feistel(F.get(o, F.lit(0)) * 256 + F.get(o, F.lit(1)), F.get(o, F.lit(2)) * 256 + F.get(o, F.lit(3)), F.lit(65536), F.lit(65536), key, "ip"),
        lambda p: F.concat_ws(".", *[x.cast("long").cast("string") for x in octets(p)])))
    return F.when(~F.exists(parts, lambda o: o > 255), out)


def card(value: Column, key: str) -> Column:
    """The first digit stays, the others but the last are permuted, the last makes the Luhn sum right."""
    def renewed(d: Column) -> Column:
        body = F.concat(F.substring(d, 1, 1), permute_digits(F.substr(d, F.lit(2), F.length(d) - 2), key, "card"))
        return let(body, lambda b: F.get(F.filter(
            F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: F.concat(b, c.cast("string"))), lambda x: F.call_function("luhn_check", x)), F.lit(0)))

    return let(_only(value), lambda d: F.when(F.call_function("luhn_check", d), refill(value, renewed(d))))


def ssn(value: Column, key: str) -> Column:
    """Areas 001-899 but 666, groups 01-99, serials 0001-9999."""
    def renewed(d: Column) -> Column:
        area, rest = _number(d, 1, 3), (_number(d, 4, 2) - 1) * 9999 + _number(d, 6, 4) - 1
        return let(feistel(area - F.when(area > 666, 2).otherwise(1), rest, F.lit(898), F.lit(99 * 9999), key, "ssn"), lambda p: F.concat_ws(
            "-", _digits(p["l"] + F.when(p["l"] >= 665, 2).otherwise(1), F.lit(3)), _digits(F.floor(p["r"] / 9999) + 1, F.lit(2)), _digits(p["r"] % 9999 + 1, F.lit(4))))

    valid = lambda d: _number(d, 1, 3).between(1, 899) & (_number(d, 1, 3) != 666) & (_number(d, 4, 2) > 0) & (_number(d, 6, 4) > 0)
    return let(_only(value), lambda d: F.when(valid(d), renewed(d)))


def phone(value: Column, key: str) -> Column:
    """The last ten digits; with area and exchange from 200 up they stay so, else all ten digit strings are the format."""
    def ten(d: Column) -> Column:
        area, rest = _number(d, 1, 3), _number(d, 4, 7)
        planned = let(feistel(area - 200, rest - 2_000_000, F.lit(800), F.lit(8_000_000), key, "phone"),
                      lambda p: F.concat((p["l"] + 200).cast("string"), (p["r"] + 2_000_000).cast("string")))
        return F.when((area >= 200) & (rest >= 2_000_000), planned).otherwise(_unplanned(d))

    def _unplanned(d: Column) -> Column:
        """Cycle walking is not needed: areas below 200 and exchanges below 200 are a box each."""
        area, rest = _number(d, 1, 3), _number(d, 4, 7)
        low = let(feistel(area, rest, F.lit(200), F.lit(10_000_000), key, "phone-area"),
                  lambda p: F.concat(_digits(p["l"], F.lit(3)), _digits(p["r"], F.lit(7))))
        flat = let(feistel(area - 200, rest, F.lit(800), F.lit(2_000_000), key, "phone-exchange"),
                   lambda p: F.concat(_digits(p["l"] + 200, F.lit(3)), _digits(p["r"], F.lit(7))))
        return F.when(area < 200, low).otherwise(flat)

    return let(_only(value), lambda d: refill(value, F.concat(F.substr(d, F.lit(1), F.length(d) - 10), ten(F.right(d, F.lit(10))))))


def _late_day(place: Column) -> Column:
    """The date at ``place`` among all days after the twelfth of their month, from the first month on."""
    first = F.lit(FIRST_DAY).cast("date")
    start = lambda month: F.add_months(first, month.cast("int"))
    before = lambda month: F.datediff(start(month), first) - 12 * month
    # Months have 16 to 19 such days, so an even share tells the month but for its neighbours.
    guess = F.floor(place * MONTHS / (LATE_ROWS * LATE_COLUMNS))
    months = F.sequence(F.greatest(guess - 2, F.lit(0)), F.least(guess + 2, F.lit(MONTHS - 1)))
    month = F.get(F.filter(months, lambda m: (before(m) <= place) & (place < before(m + 1))), F.lit(0))
    return let(month, lambda m: F.date_add(start(m), (12 + place - before(m)).cast("int")))


def date(value: Column, key: str) -> Column:
    """Dates of 1800 to 2199, as year-month-day, day/month/year (or month/day/year where only that is valid), day.month.year.

    A month-first date has a day after the twelfth, and so has its pseudonym: it reads as month-first again, and days that
    read as day-first belong to the others. Each form is a permutation of its own values.
    """
    first = F.lit(FIRST_DAY).cast("date")

    def moved(day: Column) -> Column:
        number = F.datediff(day, first)
        return let(feistel(F.floor(number / DAY_COLUMNS), number % DAY_COLUMNS, F.lit(DAY_ROWS), F.lit(DAY_COLUMNS), key, "date"),
                   lambda p: F.date_add(first, (p["l"] * DAY_COLUMNS + p["r"]).cast("int")))

    def moved_late(day: Column) -> Column:
        month = (F.year(day) - F.year(first)) * 12 + F.month(day) - 1
        number = F.datediff(day, first) - 12 * (month + 1)
        return let(feistel(F.floor(number / LATE_COLUMNS), number % LATE_COLUMNS, F.lit(LATE_ROWS), F.lit(LATE_COLUMNS), key, "late-date"),
                   lambda p: let(p["l"] * LATE_COLUMNS + p["r"], _late_day))

    tries = [F.struct(F.try_to_timestamp(value, F.lit(f)).cast("date").alias("day"), F.lit(f).alias("form")) for f in ("yyyy-MM-dd", "dd/MM/yyyy", MONTH_FIRST, "dd.MM.yyyy")]
    year = lambda x: F.year(x["day"]).between(1800, 2199)
    told = F.get(F.filter(F.array(*tries), lambda x: x["day"].isNotNull() & year(x)), F.lit(0))
    return let(told, lambda x: F.when(x["form"] == MONTH_FIRST, let(moved_late(x["day"]), lambda d: F.date_format(d, MONTH_FIRST))).otherwise(
        let(moved(x["day"]), lambda d: F.coalesce(*[F.when(x["form"] == f, F.date_format(d, f)) for f in ("yyyy-MM-dd", "dd/MM/yyyy", "dd.MM.yyyy")]))))


def _mod97(text: Column) -> Column:
    return F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda acc, c: F.when(
        c.rlike("^[0-9]$"), (acc * 10 + c.cast("long")) % 97).when(c.rlike("^[A-Z]$"), (acc * 100 + F.ascii(c) - 55) % 97).otherwise(acc))


def iban(value: Column, key: str) -> Column:
    """Country and letters stay, the account's digits are permuted, the check digits are made right.

    ``struct(value, size)`` of the part of ``value`` that is an IBAN: a match may run into following words, so its part
    of the country's length is tried first, then the whole match, also of other countries.
    """
    def renewed(v: Column) -> Column:
        account = F.substr(v, F.lit(5))
        return let(F.concat(refill(account, permute_digits(_only(account), key, "iban"))), lambda a: F.concat(
            F.substring(v, 1, 2), _digits(98 - _mod97(F.concat(a, F.substring(v, 1, 2), F.lit("00"))), F.lit(2)), a))

    def valid(v: Column) -> Column:
        size = F.length(_only(F.substr(v, F.lit(5))))
        return (_mod97(F.concat(F.substr(v, F.lit(5)), F.substring(v, 1, 4))) == 1) & size.between(2, 30)

    plain = lambda v: F.replace(v, F.lit(" "))
    spaced = lambda v, new: F.when(v.contains(" "), F.trim(F.regexp_replace(new, "(.{4})", "$1 "))).otherwise(new)
    lengths = F.create_map(*[F.lit(x) for n, names in IBAN_COUNTRIES.items() for c in names.split() for x in (c, n)])
    parts = F.split(value, " ")
    fronts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), " "))
    own = F.filter(fronts, lambda v: F.length(plain(v)) == F.element_at(lengths, F.substring(v, 1, 2)))
    best = F.get(F.filter(F.concat(own, F.array(value)), lambda v: valid(plain(v))), F.lit(0))
    return let(best, lambda v: F.when(v.isNotNull(), F.struct(spaced(v, renewed(plain(v))).alias("value"), F.length(v).alias("size"))))


RENEW = {"email": email, "iban": iban, "ip": ip, "card": card, "ssn": ssn, "phone": phone, "date": date}


def pseudonym(value: Column, key: str) -> Column:
    """``struct(kind, value, size)`` for one match: the first kind whose pattern and checks it meets and the length of that, else nulls."""
    def tried(kind: str) -> Column:
        new = RENEW[kind](value, key)
        new = new if kind == "iban" else let(new, lambda v: F.when(v.isNotNull(), F.struct(v.alias("value"), F.length(value).alias("size"))))
        return F.when(value.rlike(f"^(?:{PATTERNS[kind]})$"), new)

    named = F.array(*[let(tried(k), lambda x, k=k: F.struct(F.lit(k).alias("kind"), x["value"].alias("value"), x["size"].alias("size"))) for k in KINDS])
    none = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("int").alias("size"))
    return F.coalesce(F.get(F.filter(named, lambda x: x["value"].isNotNull()), F.lit(0)), none)


def chosen(found: Column, pieces: Column) -> Column:
    """Per candidate ``struct(kind, value, start, end, cut)``: the leftmost valid ones that do not overlap have a kind.
    A phone number inside which a checked value begins has none.

    ``pieces`` are the text before the first candidate and from each to the next; ``cut`` is how much of the front of
    a candidate's piece lies in a chosen one.
    """
    row = "struct<kind:string,value:string,start:int,end:int,cut:int>"
    first = F.struct(F.length(F.get(pieces, F.lit(0))).alias("at"), F.lit(0).alias("end"), F.array().cast(f"array<{row}>").alias("out"))

    def back(acc: Column, x: Column) -> Column:
        """From the last to the first: how far from a candidate's start the next checked value begins."""
        far = acc["far"] + F.length(x["p"])
        return F.struct(F.when(x["f"]["kind"].isin(*CHECKED), 0).otherwise(far).alias("far"), F.concat(acc["out"], F.array(
            F.struct(F.when((x["f"]["kind"] != "phone") | (far >= x["f"]["size"]), x["f"]).alias("f"), x["p"].alias("p")))).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        taken = x["f"]["kind"].isNotNull() & (acc["at"] >= acc["end"])
        return let(F.when(taken, acc["at"] + x["f"]["size"]).otherwise(acc["end"]), lambda end: F.struct(
            (acc["at"] + F.length(x["p"])).alias("at"), end.alias("end"),
            F.concat(acc["out"], F.array(F.struct(
                F.when(taken, x["f"]["kind"]).alias("kind"), F.when(taken, x["f"]["value"]).alias("value"),
                acc["at"].alias("start"), end.alias("end"), F.greatest(end - acc["at"], F.lit(0)).alias("cut")))).alias("out")))

    zipped = F.arrays_zip(found.alias("f"), F.slice(pieces, 2, F.size(found)).alias("p"))
    pair = "array<struct<f:struct<kind:string,value:string,size:int>,p:string>>"
    held = F.aggregate(F.reverse(zipped), F.struct(F.lit(1 << 30).alias("far"), F.array().cast(pair).alias("out")), back, lambda acc: F.reverse(acc["out"]))
    # Few texts have a phone number; the others need no second fold.
    return F.aggregate(F.when(F.exists(found, lambda f: f["kind"] == "phone"), held).otherwise(zipped), first, step, lambda acc: acc["out"])


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced, and ``pii``: array of (kind, start, end, pseudonym).

    Kinds: e-mail addresses (a keyed address), and by Feistel permutation IBANs (mod 97), IPv4 addresses (octets up to
    255), card numbers (Luhn), US social security numbers, ten-digit phone numbers and dates. At each place the first kind
    whose pattern and check fit counts, and of finds that overlap the leftmost, but a phone number, which has no
    check, yields to a checked value that begins inside it. Numbers that fail their check stay, but
    values that begin inside them do not; an IBAN ends at its country's length if it is valid so. ``start`` and ``end`` are code points of the text as it was, end exclusive. ``key`` decides the permutations.

    Defined cases: a null text stays null and an empty one empty, with no finds; equal values get equal pseudonyms in
    every row; repeated rows each get theirs; other columns stay, but a column named ``pii`` is replaced; no rows give
    no rows.
    """
    text, none = F.col("__text"), F.array().cast("array<string>")
    others = [c for c in docs.columns if c not in (text_col, "pii")]
    row = F.struct(F.lit(0).alias("__none"), *[F.col(f"`{c}`") for c in others])
    plain = docs.select(row.alias("__row"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    # No kind goes without a digit or an at sign, and that test is far cheaper than the patterns.
    any_ = F.rlike(text, F.lit("[0-9@]")) & F.rlike(text, F.lit(ANY))
    cut = pin(plain, __m=F.when(any_, matches(text, HERE, 1)).otherwise(none), __s=F.when(any_, F.split(text, BEGINS, -1)).otherwise(F.array(text)))
    # An empty match at the very start splits nothing off.
    pieces = F.when(F.size("__s") == F.size("__m"), F.concat(F.array(F.lit("")), F.col("__s"))).otherwise(F.col("__s"))
    done = pin(cut.drop("__text"), __p=F.transform("__m", lambda m: pseudonym(m, key)), __s=pieces)
    done = pin(done.drop("__m"), __p=F.when(F.size("__p") > 0, chosen(F.col("__p"), F.col("__s"))).otherwise(F.array()))
    at = lambda i: F.get(F.col("__p"), i - 1)
    pieces = F.transform("__s", lambda s, i: F.when(i == 0, s).otherwise(F.concat(F.coalesce(at(i)["value"], F.lit("")), F.substr(s, at(i)["cut"] + 1))))
    finds = F.filter(
        F.transform("__p", lambda p: F.struct(p["kind"].alias("kind"), p["start"].alias("start"), p["end"].alias("end"), p["value"].alias("pseudonym"))),
        lambda x: x["kind"].isNotNull())
    whole = F.when(F.get(F.col("__s"), F.lit(0)).isNotNull(), F.array_join(pieces, ""))
    out = done.select(F.struct(F.col("__row").alias("row"), whole.alias("text"), finds.alias("pii")).alias("__pseudonymised"))
    part = F.col("__pseudonymised").getField
    value = lambda c: part("text") if c == text_col else part("row").getField(c)
    return out.select(*[value(c).alias(c) for c in docs.columns if c != "pii"], part("pii").alias("pii"))
