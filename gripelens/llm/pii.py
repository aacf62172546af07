"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Values are found by patterns, checked (Luhn for cards, mod 97 for IBANs, octets,
social-security ranges, the calendar) and replaced by a keyed Feistel permutation of
all values of the same format, so a pseudonym is valid where the value was, equal
values get equal pseudonyms in all documents, and different ones stay different.

Two networks are used.  Strings of digits and letters are cut into two halves; a
round shifts each character of one half inside its class (digit, small letter,
capital) by amounts drawn from a keyed digest of the other half.  Pairs of numbers
(octet pairs, calendar days as 189 x 773, social-security numbers as area and rest)
are shifted modulo their own ranges.  Both are permutations by construction.

A card keeps its first digit and gets a new check digit; an IBAN keeps its country
and gets new check digits; a phone number keeps its country code; an e-mail address
keeps its domain; a token keeps the prefix that names its kind; a date stays a date
between 1800 and 2199.  Numbers that fail their
check are ordinary numbers and stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gripelens.llm.columns import let

ROUNDS = 8

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: What may be a value; the kinds are told apart by the same parts.
EMAIL = r"[\p{L}0-9][\p{L}0-9._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
#: A name, perhaps in quotes, a sign with blanks around it, and the quote that opens the
#: value, if any.  After a colon and a blank a bare value needs a digit, else it is prose.
SECRET_NAME = (
    r"(?i:password|passwd|pwd|secret|token|api_?key)(?:[\"']\]?)?"
    r"(?:[ \t]*+(?::?=++>?|:)[ \t]*+(?:\"\"\"|'{3}|[\"'])|[ \t]*+:?=++>?[ \t]*+(?![\"'])"
    r"|:(?![\"' \t])|[ \t]*+:[ \t]*+(?=[^\s\"',;0-9]*+[0-9]))"
)
#: A quoted value ends with its quote, which a backslash can escape.
SECRET = rf"{SECRET_NAME}(?:(?=\S)(?:" + "|".join(
    rf"(?<={q})(?:[^{q}\\\r\n]|\\.)++(?={q})" for q in ('"', "'")
) + r")|[^\s\"',;]+)"
CLOUD_KEY = r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])"
#: Tokens with a prefix that names their kind, which stays.
TOKEN_PREFIX = r"sk-|gh[pousr]_|eyJ"
TOKEN = (
    r"sk-[A-Za-z0-9_-]{16,}+|gh[pousr]_[A-Za-z0-9]{20,}+"
    r"|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{4,}+(?:\.[A-Za-z0-9_-]++)?"
)
HEX_KEY = r"[0-9A-Fa-f]{32,}(?![0-9A-Za-z])"
IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"
ADDRESS = rf"(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9A-Za-z]|\.[0-9])"
_GROUP = r"[0-9A-Fa-f]{1,4}"
#: Eight groups, or fewer with one gap; with a digit, so that names of code stay.
LONG_ADDRESS = (
    rf"(?=[A-Fa-f:]*[0-9])(?:(?:{_GROUP}:){{7}}{_GROUP}"
    rf"|(?=[0-9A-Fa-f]{{3,4}}:|{_GROUP}:{_GROUP}:)(?:{_GROUP}:){{1,6}}(?::{_GROUP}){{1,6}})(?![0-9A-Za-z:])"
)
ISO_DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9A-SU-Ya-su-z-]|[Tt](?![0-9])|Z[0-9A-Za-z])"
DATE = r"[0-9]{2}([./])[0-9]{2}\1[0-9]{4}(?![0-9A-Za-z])"
YEAR_FIRST = r"[0-9]{4}/[0-9]{2}/[0-9]{2}(?![0-9A-Za-z/])"
SHORT_DATE = r"[1-3]?[0-9]\.1?[0-9]\.[0-9]{4}(?![0-9A-Za-z])"
SOCIAL = r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
PHONE = (
    r"(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9A-Za-z])"
    r"|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9A-Za-z])"
    r"|00[1-9][0-9]{0,2}[ .-][0-9]{1,5}(?:[ .-][0-9]{2,10}){1,3}(?![0-9A-Za-z])"
    r"|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z])"
)
CARD = (
    r"(?:(?:[0-9]{4}[ -]){3}[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})(?![0-9A-Za-z])"
)
#: ``DATE`` comes first: its separator is group 1.  IBANs go between the two parts: a
#: text's own ones, since only their check tells where they end.
BEFORE_IBAN = r"(?<![\p{L}0-9])(?:" + "|".join((DATE, EMAIL, SECRET, CLOUD_KEY, TOKEN, LONG_ADDRESS, HEX_KEY))
AFTER_IBAN = "|" + "|".join((ADDRESS, ISO_DATE, YEAR_FIRST, SHORT_DATE, SOCIAL, PHONE, CARD)) + ")"

#: Lengths of the countries' IBANs.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FK FO FI GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC",
    32: "LC", 33: "RU",
}
_COUNTRIES = {c: n for n, names in IBAN_LENGTHS.items() for c in names.split()}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _digest(key: str, label: str, turn: Column, other: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(label), turn.cast("string"), other.cast("string")), 512)


def _by_class(c: Column, inside: Callable[[int, int], Column], letters: int) -> Column:
    """A character moved by ``inside(first, size)`` of its class; others stay."""
    return (
        F.when(c.rlike("^[0-9]$"), inside(48, 10))
        .when(c.rlike("^[a-z]$"), inside(97, letters))
        .when(c.rlike("^[A-Z]$"), inside(65, letters))
        .otherwise(c)
    )


def _shifted(half: Column, digest: Column, letters: int) -> Column:
    """Each character moved inside its class by two hexadecimal digits of the digest."""

    def moved(c: Column, i: Column) -> Column:
        by = F.conv(F.substr(digest, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")

        def inside(first: int, size: int) -> Column:
            return F.char(F.pmod(F.ascii(c) - first + by, F.lit(size)) + first)

        return _by_class(c, inside, letters)

    chars = F.filter(F.split(half, ""), lambda c: c != "")
    return F.array_join(F.transform(chars, moved), "")


def _turned(c: Column, key: str, label: str, letters: int) -> Column:
    """One character moved inside its class by an amount drawn for key, label and class."""

    def inside(first: int, size: int) -> Column:
        drawn = F.conv(F.substring(_digest(key, label, F.lit("one"), F.lit(first)), 1, 12), 16, 10).cast("long")
        by = F.pmod(drawn, F.lit(size - 1)) + 1
        return F.char(F.pmod(F.ascii(c) - first + by, F.lit(size)) + first)

    return _by_class(c, inside, letters)


def permuted(value: Column, key: str, label: str, letters: int = 26) -> Column:
    """Feistel permutation of the digits and letters of a string, class by class.

    A string of one character is shifted by a keyed amount that is never zero.
    """
    cut = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substr(value, F.lit(1), cut).alias("l"), F.substr(value, cut + 1).alias("r"))

    def turn(s: Column, i: Column) -> Column:
        even = F.pmod(i, F.lit(2)) == 0
        left = F.when(even, _shifted(s["l"], _digest(key, label, i, s["r"]), letters)).otherwise(s["l"])
        right = F.when(even, s["r"]).otherwise(_shifted(s["r"], _digest(key, label, i, s["l"]), letters))
        return F.struct(left.alias("l"), right.alias("r"))

    turns = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    long = F.aggregate(turns, start, turn, lambda s: F.concat(s["l"], s["r"]))
    return F.when(F.length(value) > 1, long).otherwise(_turned(value, key, label, letters))


def permuted_pair(a: Column, b: Column, sizes: tuple[int, int], key: str, label: str) -> Column:
    """Feistel permutation of all pairs (a, b) with a < sizes[0] and b < sizes[1]."""

    def drawn(i: Column, other: Column) -> Column:
        return F.conv(F.substring(_digest(key, label, i, other), 1, 12), 16, 10).cast("long")

    def turn(s: Column, i: Column) -> Column:
        even = F.pmod(i, F.lit(2)) == 0
        left = F.when(even, F.pmod(s["a"] + drawn(i, s["b"]), F.lit(sizes[0]))).otherwise(s["a"])
        right = F.when(even, s["b"]).otherwise(F.pmod(s["b"] + drawn(i, s["a"]), F.lit(sizes[1])))
        return F.struct(left.cast("long").alias("a"), right.cast("long").alias("b"))

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _luhn_sum(digits: Column) -> Column:
    """Sum in which every second digit from the right, from the second on, is doubled."""
    chars = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")

    def weight(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(F.pmod(i, F.lit(2)) == 1, twice).otherwise(d)

    return F.aggregate(F.transform(chars, weight), F.lit(0), lambda s, x: s + x)


def _refilled(value: Column, digits: Column) -> Column:
    """``value`` with its digits and letters replaced, in order, by ``digits``."""
    plain = F.lit("[^0-9A-Za-z]")
    chars = F.filter(F.split(value, ""), lambda c: c != "")

    def put(c: Column, i: Column) -> Column:
        nth = F.length(F.regexp_replace(F.substr(value, F.lit(1), i + 1), plain, F.lit("")))
        return F.when(c.rlike("^[0-9A-Za-z]$"), F.substr(digits, nth, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(chars, put), "")


def _card(value: Column, key: str) -> Column:
    def replaced(digits: Column) -> Column:
        middle = permuted(F.substr(digits, F.lit(2), F.length(digits) - 2), key, "card")
        payload = F.concat(F.substring(digits, 1, 1), middle)

        def finished(p: Column) -> Column:
            check = F.pmod(F.lit(10) - F.pmod(_luhn_sum(F.concat(p, F.lit("0"))), F.lit(10)), F.lit(10))
            return _refilled(value, F.concat(p, check.cast("string")))

        return F.when(F.pmod(_luhn_sum(digits), F.lit(10)) == 0, let(payload, finished)).otherwise(value)

    return let(_digits(value), replaced)


def _mod97(code: Column) -> Column:
    """Remainder of an IBAN's letters and digits, its first four moved to the end."""
    turned = F.concat(F.substr(code, F.lit(5)), F.substring(code, 1, 4))
    chars = F.filter(F.split(turned, ""), lambda c: c != "")

    def step(s: Column, c: Column) -> Column:
        number = c.rlike("^[0-9]$")
        return F.when(number, F.pmod(s * 10 + c.cast("int"), F.lit(97))).otherwise(
            F.pmod(s * 100 + F.ascii(c) - 55, F.lit(97))
        )

    return F.aggregate(chars, F.lit(0), step)


def _iban(value: Column, key: str) -> Column:
    def replaced(code: Column) -> Column:
        country = F.substring(code, 1, 2)
        account = permuted(F.substr(code, F.lit(5)), key, "iban")

        def finished(a: Column) -> Column:
            check = F.lpad((F.lit(98) - _mod97(F.concat(country, F.lit("00"), a))).cast("string"), 2, "0")
            return _refilled(value, F.concat(country, check, a))

        return F.when(_mod97(code) == 1, let(account, finished)).otherwise(value)

    return let(F.regexp_replace(value, " ", ""), replaced)


def _ibans(text: Column) -> Column:
    """The distinct IBANs of a text, longest first.

    What follows a number may look like more of it, so of each place's longest match
    all prefixes that end with a group are tried: the one of the country's length
    first, then from the longest on.  Places overlap, so none hides another.
    """
    lengths = F.create_map(*[F.lit(x) for item in _COUNTRIES.items() for x in item])

    def valid(longest: Column) -> Column:
        def prefixes(groups: Column) -> Column:
            ends = F.sequence(F.size(groups), F.lit(1), F.lit(-1))
            cut = F.transform(ends, lambda n: F.array_join(F.slice(groups, 1, n), " "))
            good = F.filter(cut, lambda p: p.rlike(f"^{IBAN}$") & (_mod97(F.replace(p, F.lit(" "))) == 1))
            usual = lengths[F.substring(longest, 1, 2)]
            own = F.filter(good, lambda p: F.length(F.replace(p, F.lit(" "))) == usual)
            return F.coalesce(F.get(own, F.lit(0)), F.get(good, F.lit(0)))

        return let(F.split(longest, " "), prefixes)

    places = F.regexp_extract_all(text, F.lit(f"(?=({IBAN}))(?<![A-Za-z0-9])"), F.lit(1))
    found = F.filter(F.transform(F.array_distinct(places), valid), lambda p: p.isNotNull())
    order = F.transform(F.array_distinct(found), lambda p: F.struct(-F.length(p), p.alias("iban")))
    return F.array_sort(order)["iban"]


def _address(value: Column, key: str) -> Column:
    def replaced(o: Column) -> Column:
        number = [o[i].cast("long") for i in range(4)]
        pair = permuted_pair(number[0] * 256 + number[1], number[2] * 256 + number[3], (65536, 65536), key, "address")
        return let(
            pair,
            lambda p: F.concat_ws(
                ".", *[F.floor(p[s] / d % 256).cast("string") for s in ("a", "b") for d in (256, 1)]
            ),
        )

    return let(F.split(value, r"\."), replaced)


def _social(value: Column, key: str) -> Column:
    """Valid numbers: area 001-899 but not 666, group 01-99, serial 0001-9999."""

    def replaced(p: Column) -> Column:
        area, group, serial = (p[i].cast("int") for i in range(3))
        good = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
        at = area - F.when(area > 666, 2).otherwise(1)
        pair = permuted_pair(at, (group - 1) * 9999 + serial - 1, (898, 99 * 9999), key, "social")
        made = let(
            pair,
            lambda q: F.concat_ws(
                "-",
                F.lpad((q["a"] + F.when(q["a"] >= 665, 2).otherwise(1)).cast("string"), 3, "0"),
                F.lpad((F.floor(q["b"] / 9999) + 1).cast("string"), 2, "0"),
                F.lpad((q["b"] % 9999 + 1).cast("string"), 4, "0"),
            ),
        )
        return F.when(good, made).otherwise(value)

    return let(F.split(value, "-"), replaced)


#: Days of the 400 years from 1800 on, and those of them behind the 12th of a month.
_DAYS = 146097
_LATE_DAYS = _DAYS - 400 * 12 * 12
_FIRST = "1800-01-01"


def _number(value: Column, form: str) -> Column:
    """The day that a string of this form names, from 0; null if it names none."""
    day = F.to_date(F.try_to_timestamp(value, F.lit(form)))
    number = F.date_diff(day, F.lit(_FIRST).cast("date"))
    return F.when(day.isNotNull() & (number >= 0) & (number < _DAYS), number)


def _printed(number: Column, form: str) -> Column:
    return F.date_format(F.date_add(F.lit(_FIRST).cast("date"), number.cast("int")), form)


def _dated(value: Column, form: str, key: str) -> Column:
    """A day becomes another one, the same in all forms; days are 189 x 773 pairs."""

    def replaced(number: Column) -> Column:
        pair = permuted_pair(F.floor(number / 773), number % 773, (189, 773), key, "date")
        return let(pair, lambda p: F.coalesce(_printed(p["a"] * 773 + p["b"], form), value))

    return let(_number(value, form), replaced)


def _slashed(value: Column, key: str) -> Column:
    """Strings with slashes are one set, whichever of day and month comes first.

    It has a string for each day with the month first, and another one for each day behind
    the 12th with the day first; up to the 12th these are the same strings.  They are
    numbered in this order, 18 x 13033 in all, and permuted as such.
    """

    def before(month: Column) -> Column:
        """Late days in front of a month, counted from the first one."""
        first = F.add_months(F.lit(_FIRST).cast("date"), month.cast("int"))
        return F.date_diff(first, F.lit(_FIRST).cast("date")) - 12 * month

    def month_of(number: Column) -> Column:
        day = F.date_add(F.lit(_FIRST).cast("date"), number.cast("int"))
        return (F.year(day) - 1800) * 12 + F.month(day) - 1

    def late(rank: Column) -> Column:
        """The day of the late day of this rank: months have about 18.4 of them."""
        near = F.floor(rank * 4800 / _LATE_DAYS)
        month = near - 1 + sum((before(near + i) <= rank).cast("long") for i in (0, 1))
        return rank + 12 * month + 12

    def replaced(n: Column) -> Column:
        late_rank = n["d"] - 12 * (month_of(n["d"]) + 1)
        at = F.coalesce(n["m"], late_rank + _DAYS)
        pair = permuted_pair(F.floor(at / 13033), at % 13033, (18, 13033), key, "slashed")

        def made(to: Column) -> Column:
            return F.when(to < _DAYS, _printed(to, "MM/dd/yyyy")).otherwise(_printed(late(to - _DAYS), "dd/MM/yyyy"))

        return let(pair, lambda p: let(p["a"] * 13033 + p["b"], lambda to: F.coalesce(made(to), value)))

    return let(F.struct(_number(value, "MM/dd/yyyy").alias("m"), _number(value, "dd/MM/yyyy").alias("d")), replaced)


def _phone(value: Column, key: str) -> Column:
    """All digits but the country code, which are those in front of the last ten."""

    def replaced(digits: Column) -> Column:
        code = F.when(value.startswith("+"), F.greatest(F.length(digits) - 10, F.lit(1))).otherwise(F.lit(0))
        rest = permuted(F.substr(digits, code + 1), key, "phone")
        return _refilled(value, F.concat(F.substr(digits, F.lit(1), code), rest))

    return let(_digits(value), replaced)


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one found value; values that fail their check stay.

    A secret that is a value of another kind gets the pseudonym of that kind.
    """

    def named(name: Column) -> Column:
        def replaced(own: Column) -> Column:
            secret = permuted(own, key, "secret")
            return let(
                _of_kind(own, key),
                lambda made: F.concat(name, F.when((name != "") & (made == own), secret).otherwise(made)),
            )

        return let(F.substr(value, F.length(name) + 1), replaced)

    return let(F.regexp_extract(value, f"^{SECRET_NAME}", 0), named)


def _of_kind(value: Column, key: str) -> Column:
    """The pseudonym of a value that is no secret by its name; others stay."""
    whole = lambda pattern: value.rlike(f"^(?:{pattern})$")
    local = F.substring_index(value, "@", 1)
    prefix = F.regexp_extract(value, f"^(?:{TOKEN_PREFIX})", 0)
    hexed = permuted(F.when(value == F.upper(value), F.lower(value)).otherwise(value), key, "hex", 6)
    return (
        F.when(whole(EMAIL), F.concat(permuted(local, key, "mail"), F.lit("@"), F.substring_index(value, "@", -1)))
        .when(whole(CLOUD_KEY), F.concat(F.lit("AKIA"), permuted(F.substr(value, F.lit(5)), key, "cloud")))
        .when(whole(HEX_KEY), F.when(value == F.upper(value), F.upper(hexed)).otherwise(hexed))
        .when(whole(IBAN), _iban(value, key))
        .when(whole(ADDRESS), _address(value, key))
        .when(whole(TOKEN), F.concat(prefix, permuted(F.substr(value, F.length(prefix) + 1), key, "token")))
        .when(whole(LONG_ADDRESS), permuted(F.lower(value), key, "long address", 6))
        .when(whole(ISO_DATE), _dated(value, "yyyy-MM-dd", key))
        .when(whole(YEAR_FIRST), _dated(value, "yyyy/MM/dd", key))
        .when(value.rlike(r"^[0-9]{2}\.[0-9]{2}\.[0-9]{4}$"), _dated(value, "dd.MM.yyyy", key))
        .when(whole(SHORT_DATE), _dated(value, "d.M.yyyy", key))
        .when(value.rlike("^[0-9]{2}/[0-9]{2}/[0-9]{4}$"), _slashed(value, key))
        .when(whole(SOCIAL), _social(value, key))
        .when(whole(PHONE), _phone(value, key))
        .when(whole(CARD), _card(value, key))
        .otherwise(value)
    )


def _pattern(text: Column) -> Column:
    """The pattern of all values of a text: the fixed ones and the text's own IBANs."""

    def whole(ibans: Column) -> Column:
        own = F.concat(F.lit("|(?:"), F.array_join(ibans, "|"), F.lit(")(?![0-9A-Za-z])"))
        return F.concat(F.lit(BEFORE_IBAN), F.when(F.size(ibans) > 0, own).otherwise(""), F.lit(AFTER_IBAN))

    return let(_ibans(text), whole)


def pseudonymised(text: Column, key: str) -> Column:
    """Struct of the text with its values replaced and the number of changed values.

    A null text stays null with no values.
    """

    def with_pattern(pattern: Column) -> Column:
        return let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda found: joined(found, pattern))

    def joined(found: Column, pattern: Column) -> Column:
        def with_rest(rest: Column) -> Column:
            def with_names(names: Column) -> Column:
                pieces = F.transform(
                    rest, lambda r, i: F.concat(r, F.coalesce(F.get(names, i), F.lit("")))
                )
                changed = F.filter(F.zip_with(found, names, lambda a, b: a != b), lambda x: x)
                return F.struct(F.array_join(pieces, "").alias("text"), F.size(changed).cast("long").alias("n"))

            return let(F.transform(found, lambda v: pseudonym(v, key)), with_names)

        return let(F.split(text, pattern, -1), with_rest)

    plain = F.struct(text.alias("text"), F.lit(0).cast("long").alias("n"))
    may = text.rlike("[0-9@=:]|AKIA|sk-|gh[pousr]_|eyJ")
    return F.when(may, let(_pattern(text), with_pattern)).otherwise(plain)


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with the text's personal data replaced.

    Rows are independent; a null text stays null, an empty one empty.  Keep ``key``
    secret: whoever has it can undo the permutation.
    """
    columns = [pseudonymised(docs[c], key)["text"].alias(c) if c == text else docs[c] for c in docs.columns]
    return docs.select(*columns)


def pseudonym_counts(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(doc_id, text, n_values): the new text and how many values were replaced."""
    made = docs.select(docs["doc_id"], pseudonymised(docs[text], key).alias("made"))
    return made.select("doc_id", F.col("made.text").alias("text"), F.col("made.n").alias("n_values"))
