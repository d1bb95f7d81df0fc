"""Format-preserving pseudonyms for personal data, by Feistel networks over mixed digits.

A value becomes a list of digits, each with its own radix: the octets of an address, the parts of a
telephone number, the letters and digits of a mail name, the place of a date in its 28-year block.
The first half of the list is shifted by a keyed hash of the second, then the second by a hash of
the first, for ``ROUNDS`` rounds: a permutation of all values of that format, so equal values get
equal pseudonyms in every document, and different values different ones.  Checks that make a value
valid (check digits, ranges, calendars) hold for the pseudonym as well; a value that fails its check
is left alone, and so is everything around it.

Only built-in expressions are used.  The key is part of the plan and must be kept secret.

Rows: NULL stays NULL and empty texts stay empty.  Repeated rows are treated alike.  Other columns
are left alone.  An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwright.llm.common import fresh

ROUNDS = 10
#: First year and number of whole 28-year blocks: each has the same number of days, 21 * 487.
FIRST_YEAR, BLOCK_YEARS, BLOCKS = 1901, 28, 7
BLOCK_DIGITS = (21, 487)
DATE_FIRST, DATE_DAYS = "1901-01-01", 10_227

# The formats; nothing of the same sort may touch them on either side.
MAIL = r"(?<![\p{L}\p{M}0-9._%+-])[\p{L}0-9][\p{L}\p{M}0-9._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
DATE = r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?![\d/-]|\.\d)"
ADDRESS = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)"
SOCIAL = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
#: Characters of an account number by country; countries that are not named take any length.
ACCOUNT_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _account_pattern() -> str:
    """Account numbers in one piece or in groups of four, as long as their country has them."""
    known, forms = " ".join(ACCOUNT_LENGTHS.values()).replace(" ", "|"), []
    for length, countries in ACCOUNT_LENGTHS.items():
        fours, rest = divmod(length - 4, 4)
        tail = f" ?[A-Z0-9]{{{rest}}}" if rest else ""
        forms.append(f"(?:{countries.replace(' ', '|')})\\d{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}{tail}")
    forms.append(f"(?!{known})[A-Z]{{2}}\\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?")
    return f"(?<![A-Za-z0-9])(?=[A-Z]{{2}}\\d{{2}})(?:{'|'.join(forms)})(?![A-Za-z0-9])"


ACCOUNT = _account_pattern()
CARD = r"(?<!\d)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)"
PHONE = (
    r"(?<![\d+(])(?:\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}"
    r"|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}"
    r"|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|\d{3} \d{3} \d{4})(?![\d-])"
)
SECRET = (
    r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"
    r"|(?i:password|passwd|secret|token|api[_-]?key)[ ]?[=:][ ]?[\x22']?[A-Za-z0-9+/_-]{8,}"
)
#: Texts without any of these hold none of the formats.
HINT = r"[0-9@]|(?i:passw|secret|token|api.?key)[a-z ]*[=:]"


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _digits(text: Column) -> Column:
    """The decimal digits of ``text`` as numbers."""
    return F.transform(_chars(F.regexp_replace(text, r"\D", "")), lambda c: c.cast("int"))


def _pad(value: Column, width: int) -> Column:
    return F.lpad(value.cast("string"), width, "0")


def _radices(values: Column, radix: int) -> Column:
    return F.transform(values, lambda _: F.lit(radix))


def permute(values: Column, radices: Column, key: str, tweak: Column) -> Column:
    """``values`` (whole numbers below ``radices``) permuted among all lists of these radices.

    A list of one digit is only shifted.  ``tweak`` names the format: each has a permutation of its own.
    """
    half = F.ceil(F.size(values) / 2).cast("int")
    parts = F.struct(
        F.slice(values, 1, half).alias("a"),
        F.slice(values, half + 1, F.greatest(F.size(values) - half, F.lit(0))).alias("b"),
    )
    first, second = F.slice(radices, 1, half), F.slice(radices, half + 1, F.greatest(F.size(radices) - half, F.lit(0)))

    def shift(side: Column, radix: Column, other: Column, number: Column) -> Column:
        # seven hex digits a place: the hash is drawn anew for every nine places
        seed = F.concat_ws("|", F.lit(key), tweak, number, F.array_join(other.cast("array<string>"), ","))

        def moved(value: Column, place: Column) -> Column:
            digest = F.sha2(F.concat_ws("|", seed, F.floor(place / 9).cast("string")), 256)
            drawn = F.conv(F.substr(digest, place % 9 * 7 + 1, F.lit(7)), 16, 10).cast("bigint")
            return F.pmod(value + drawn, F.element_at(radix, place + 1)).cast("int")

        return F.transform(side, moved)

    def one_round(state: Column, number: Column) -> Column:
        even = number % 2 == 0
        return F.struct(
            F.when(even, shift(state["a"], first, state["b"], number.cast("string"))).otherwise(state["a"]).alias("a"),
            F.when(even, state["b"]).otherwise(shift(state["b"], second, state["a"], number.cast("string"))).alias("b"),
        )

    done = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), parts, one_round)
    return F.concat(done["a"], done["b"])


def refill(template: Column, digits: Column) -> Column:
    """``template`` with its decimal digits replaced by ``digits`` in order; all else stays."""
    start = F.struct(F.lit(0).alias("used"), F.lit("").alias("text"))

    def put(state: Column, char: Column) -> Column:
        is_digit = char.rlike("[0-9]")
        taken = F.element_at(digits, F.least(state["used"] + 1, F.size(digits))).cast("string")
        return F.struct(
            (state["used"] + is_digit.cast("int")).alias("used"),
            F.concat(state["text"], F.when(is_digit, taken).otherwise(char)).alias("text"),
        )

    return F.aggregate(_chars(template), start, put)["text"]


def _whole(digits: Column, start: int, length: int) -> Column:
    """Digits ``start``, ... (from 1) read as one number."""
    return F.array_join(F.slice(digits, start, length).cast("array<string>"), "").cast("int")


# Kind by kind: the check a value must pass, the digits it becomes (values, radices and a tweak that
# names what stays), and the text that new digits make of the old one.


def _plan(values: Column, radices: Column, *tweak: Column) -> Column:
    return F.struct(
        values.cast("array<int>").alias("values"),
        radices.cast("array<int>").alias("radices"),
        F.concat(F.lit(""), *tweak).alias("tweak"),
    )


def _luhn_check(digits: Column) -> Column:
    """The digit to put behind ``digits``: every second from the right is doubled, and all sum up to tens."""

    def weighed(digit: Column, place: Column) -> Column:
        return F.when(place % 2 == 0, digit * 2 - F.when(digit > 4, 9).otherwise(0)).otherwise(digit)

    total = F.aggregate(F.transform(F.reverse(digits), weighed), F.lit(0), lambda total, digit: total + digit)
    return F.pmod(-total, F.lit(10)).cast("int")


def card_check(text: Column) -> Column:
    digits = _digits(text)
    body = F.slice(digits, 1, F.greatest(F.size(digits) - 1, F.lit(0)))
    return (F.element_at(digits, 1) > 0) & (_luhn_check(body) == F.element_at(digits, -1))


def card_digits(text: Column) -> Column:
    """The first digit, which tells the issuer's trade, stays, and the check digit follows."""
    digits = _digits(text)
    inner = F.slice(digits, 2, F.greatest(F.size(digits) - 2, F.lit(0)))
    return _plan(inner, _radices(inner, 10), F.substr(text, F.lit(1), F.lit(1)))


def card_text(old: Column, new: Column) -> Column:
    body = F.array(F.concat(F.slice(_digits(old), 1, 1), new))
    return refill(old, F.transform(body, lambda b: F.concat(b, F.array(_luhn_check(b))))[0])


def address_check(text: Column) -> Column:
    return F.forall(F.split(text, r"\."), lambda octet: octet.cast("int") <= 255)


def address_digits(text: Column) -> Column:
    octets = F.split(text, r"\.")
    return _plan(octets, _radices(octets, 256))


def address_text(_: Column, new: Column) -> Column:
    return F.array_join(new.cast("array<string>"), ".")


def _social_parts(text: Column) -> list[Column]:
    return [F.substr(text, F.lit(a), F.lit(n)).cast("int") for a, n in ((1, 3), (5, 2), (8, 4))]


def social_check(text: Column) -> Column:
    area, group, serial = _social_parts(text)
    return (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)


def social_digits(text: Column) -> Column:
    area, group, serial = _social_parts(text)
    values = F.array(area - F.when(area > 666, 2).otherwise(1), group - 1, serial - 1)
    return _plan(values, F.array(F.lit(898), F.lit(99), F.lit(9999)))


def social_text(_: Column, new: Column) -> Column:
    area = new[0] + F.when(new[0] >= 665, 2).otherwise(1)
    return F.concat_ws("-", _pad(area, 3), _pad(new[1] + 1, 2), _pad(new[2] + 1, 4))


def _national(text: Column) -> Column:
    """Whether ``text`` is a number of the North American plan, with or without +1 before it."""
    size = F.size(_digits(text))
    return F.when(text.startswith("+"), text.rlike(r"^\+1(?!\d\d[ .(-])") & (size == 11)).otherwise(size == 10)


def _ten(text: Column) -> Column:
    """The last ten digits."""
    digits = _digits(text)
    return F.slice(digits, F.greatest(F.size(digits) - 9, F.lit(1)), F.lit(10))


def _country(text: Column) -> Column:
    """The digits of the country code after the plus."""
    return F.regexp_extract(text, r"^\+(\d{1,3}?)(?=[ .(-]|\d{8})", 1)


def _least(text: Column) -> list[Column]:
    """The least area and exchange code of the sort ``text`` has: 200 for those of the plan, 0 for those below."""
    return [F.when(F.element_at(_ten(text), place) >= 2, 200).otherwise(0) for place in (1, 4)]


def phone_check(text: Column) -> Column:
    abroad = text.startswith("+") & F.size(_digits(text)).between(9, 15) & ~text.startswith("+0")
    return _national(text) | abroad


def phone_digits(text: Column) -> Column:
    """Area and exchange stay in the range the plan allows, or below it if they are there; abroad the country's digits stay."""
    ten, country, least = _ten(text), _country(text), _least(text)
    values = F.array(_whole(ten, 1, 3) - least[0], _whole(ten, 4, 3) - least[1], _whole(ten, 7, 4))
    digits = _digits(text)
    rest = F.slice(digits, F.length(country) + 1, F.greatest(F.size(digits) - F.length(country), F.lit(0)))
    sizes = [F.when(x > 0, 800).otherwise(200) for x in least]
    outside = F.concat(*[F.when(x > 0, F.lit("")).otherwise(F.lit(n)) for x, n in zip(least, ("area", "exchange"), strict=True)])
    planned = _plan(values, F.array(*sizes, F.lit(10_000)), outside)
    return F.when(_national(text), planned).otherwise(_plan(rest, _radices(rest, 10), F.lit("+"), country))


def phone_text(old: Column, new: Column) -> Column:
    least = _least(old)
    ten = F.concat(_pad(new[0] + least[0], 3), _pad(new[1] + least[1], 3), _pad(new[2], 4))
    planned = F.concat(F.when(old.startswith("+"), F.lit("1")).otherwise(F.lit("")), ten)
    abroad = F.concat(_country(old), F.array_join(new.cast("array<string>"), ""))
    return refill(old, _digits(F.when(_national(old), planned).otherwise(abroad)))


def _day(text: Column) -> Column:
    """The date of ``text`` or NULL: year first, day first with points, month first (else day first) with slashes."""
    patterns = ((r"^\d{4}-", "yyyy-M-d"), (r"\.", "d.M.yyyy"), (r"/", "M/d/yyyy"), (r"/", "d/M/yyyy"))
    return F.coalesce(*[F.when(text.rlike(p), F.try_to_timestamp(text, F.lit(f)).cast("date")) for p, f in patterns])


def _block(text: Column) -> Column:
    return F.floor(F.datediff(_day(text), F.lit(DATE_FIRST).cast("date")) / DATE_DAYS).cast("int")


def date_check(text: Column) -> Column:
    return F.year(_day(text)).between(FIRST_YEAR, FIRST_YEAR + BLOCK_YEARS * BLOCKS - 1)


def date_digits(text: Column) -> Column:
    """The place in a block of 28 years, which stays."""
    within = F.datediff(_day(text), F.lit(DATE_FIRST).cast("date")) % DATE_DAYS
    values = F.array(within % BLOCK_DIGITS[0], F.floor(within / BLOCK_DIGITS[0]).cast("int"))
    return _plan(values, F.array(*[F.lit(r) for r in BLOCK_DIGITS]), _block(text).cast("string"))


def date_text(old: Column, new: Column) -> Column:
    """In the same way of writing; zeros in front stay or stay away."""
    place = _block(old) * DATE_DAYS + new[1] * BLOCK_DIGITS[0] + new[0]
    padded = old.rlike(r"^0|[./]0|^\d\d[./]\d\d[./]")

    def write(found: Column) -> Column:
        forms = (
            (old.rlike(r"^\d{4}-"), "yyyy-MM-dd", "yyyy-MM-dd"),
            (old.contains("."), "dd.MM.yyyy", "d.M.yyyy"),
            (F.try_to_timestamp(old, F.lit("M/d/yyyy")).isNotNull(), "MM/dd/yyyy", "M/d/yyyy"),
            (F.lit(True), "dd/MM/yyyy", "d/M/yyyy"),
        )
        return F.coalesce(
            *[
                F.when(test, F.when(padded, F.date_format(found, long)).otherwise(F.date_format(found, short)))
                for test, long, short in forms
            ]
        )

    return F.transform(F.array(F.date_add(F.lit(DATE_FIRST).cast("date"), place)), write)[0]


#: Alphabets (first character, size) that a character is moved in; other characters stay.
ALPHABETS = tuple(
    (ord(first), ord(last) - ord(first) + 1)
    for first, last in ("09", "az", "AZ", "àö", "øÿ", "ÀÖ", "ØÞ", "Āſ", "αω", "ΑΡ", "ΣΩ", "ая", "АЯ", "ѐџ", "ЀЏ")
)


def _in_alphabet(point: Column, pick: int) -> Column:
    """First character or size of the alphabet of a code point; NULL where it has none."""
    return F.coalesce(*[F.when(point.between(a[0], a[0] + a[1] - 1), F.lit(a[pick])) for a in ALPHABETS])


def _letters(text: Column, *tweak: Column) -> Column:
    """Digits, small and capital letters, each within its alphabet; other characters have one value only."""

    def place(char: Column) -> Column:
        return F.coalesce(F.ascii(char) - _in_alphabet(F.ascii(char), 0), F.lit(0))

    def size(char: Column) -> Column:
        return F.coalesce(_in_alphabet(F.ascii(char), 1), F.lit(1))

    return _plan(F.transform(_chars(text), place), F.transform(_chars(text), size), *tweak)


def _spelled(text: Column, new: Column) -> Column:
    """``text`` with its digits and letters replaced by the places ``new`` in their alphabets."""

    def write(char: Column, value: Column) -> Column:
        point = F.lpad(F.hex(_in_alphabet(F.ascii(char), 0) + value), 4, "0")
        return F.coalesce(F.decode(F.unhex(point), "UTF-16BE"), char)

    return F.array_join(F.zip_with(_chars(text), new, write), "")


def mail_digits(text: Column) -> Column:
    """The name before the last @; the domain stays."""
    return _letters(F.regexp_extract(text, r"^(.*)@", 1), F.lower(F.regexp_extract(text, r"@([^@]*)$", 1)))


def mail_text(old: Column, new: Column) -> Column:
    return F.concat(_spelled(F.regexp_extract(old, r"^(.*)@", 1), new), F.regexp_extract(old, r"(@[^@]*)$", 1))


def _remainder(text: Column) -> Column:
    """Remainder by 97 of a text of digits and capital letters, these read as 10 to 35."""

    def step(total: Column, char: Column) -> Column:
        point = F.ascii(char)
        return F.when(char.rlike("[0-9]"), (total * 10 + point - 48) % 97).otherwise((total * 100 + point - 55) % 97)

    return F.aggregate(_chars(text), F.lit(0), lambda total, char: step(total, char).cast("int"))


def _without_blanks(text: Column) -> Column:
    return F.regexp_replace(text, " ", "")


def account_check(text: Column) -> Column:
    plain = _without_blanks(text)
    moved = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    return F.length(plain).between(15, 34) & (_remainder(moved) == 1)


def account_digits(text: Column) -> Column:
    """The country stays, and the two check digits follow."""
    return _letters(F.substr(_without_blanks(text), F.lit(5)), F.substr(text, F.lit(1), F.lit(2)))


def account_text(old: Column, new: Column) -> Column:
    country = F.substr(old, F.lit(1), F.lit(2))
    body = F.array(_spelled(F.substr(_without_blanks(old), F.lit(5)), new))

    def write(b: Column) -> Column:
        check = _pad(F.lit(98) - _remainder(F.concat(b, country, F.lit("00"))), 2)
        whole = F.concat(country, check, b)

        def put(state: Column, char: Column) -> Column:
            blank = char == " "
            taken = F.substr(whole, state["used"] + 1, F.lit(1))
            return F.struct(
                (state["used"] + (~blank).cast("int")).alias("used"),
                F.concat(state["text"], F.when(blank, char).otherwise(taken)).alias("text"),
            )

        return F.aggregate(_chars(old), F.struct(F.lit(0).alias("used"), F.lit("").alias("text")), put)["text"]

    return F.transform(body, write)[0]


def _secret_name(text: Column) -> Column:
    return F.regexp_extract(text, r"^(AKIA|.*[=: \x22'])", 1)


def secret_digits(text: Column) -> Column:
    """The characters after the name of the secret; the name and an access key's prefix stay."""
    return _letters(F.substr(text, F.length(_secret_name(text)) + 1))


def secret_text(old: Column, new: Column) -> Column:
    return F.concat(_secret_name(old), _spelled(F.substr(old, F.length(_secret_name(old)) + 1), new))


#: Kind, pattern, check (None: the pattern says it all), digits and text, in the order they are tried.
KINDS = (
    ("mail", MAIL, None, mail_digits, mail_text),
    ("secret", SECRET, None, secret_digits, secret_text),
    ("date", DATE, date_check, date_digits, date_text),
    ("address", ADDRESS, address_check, address_digits, address_text),
    ("social", SOCIAL, social_check, social_digits, social_text),
    ("account", ACCOUNT, account_check, account_digits, account_text),
    ("card", CARD, card_check, card_digits, card_text),
    ("phone", PHONE, phone_check, phone_digits, phone_text),
)
ANY = "|".join(f"(?:{kind[1]})" for kind in KINDS)


def kind_of(value: Column) -> Column:
    """The first kind whose pattern and check ``value`` passes; NULL if none."""
    tests = []
    for name, pattern, check, _, _ in KINDS:
        test = value.rlike(f"^(?:{pattern})$")
        tests.append(F.when(test if check is None else test & F.coalesce(check(value), F.lit(False)), F.lit(name)))
    return F.coalesce(*tests)


def pseudonyms(values: Column, key: str) -> Column:
    """For an array of texts: structs of ``old``, ``kind`` and ``new``, the last two NULL where no check is passed."""

    def by_kind(kind: Column, pick: int, *arguments: Column) -> Column:
        return F.coalesce(*[F.when(kind == k[0], k[pick](*arguments)) for k in KINDS])

    kinds = F.transform(values, lambda v: F.struct(v.alias("old"), kind_of(v).alias("kind")))
    plans = F.transform(
        kinds, lambda v: F.struct(v["old"].alias("old"), v["kind"].alias("kind"), by_kind(v["kind"], 3, v["old"]).alias("plan"))
    )
    mixed = F.transform(
        plans,
        lambda v: F.struct(
            v["old"].alias("old"),
            v["kind"].alias("kind"),
            permute(
                v["plan"]["values"], v["plan"]["radices"], key, F.concat(v["kind"], F.lit(" "), v["plan"]["tweak"])
            ).alias("digits"),
        ),
    )
    return F.transform(
        mixed,
        lambda v: F.struct(
            v["old"].alias("old"), v["kind"].alias("kind"), by_kind(v["kind"], 4, v["old"], v["digits"]).alias("new")
        ),
    )


def pseudonymise(df: DataFrame, key: str, text: str = "text", found: str = "found") -> DataFrame:
    """``df`` with the personal data in ``text`` replaced, and their number in the column ``found``.

    A column that already has this name is replaced.  Nothing is shuffled.
    """
    column, values = F.col(f"`{text}`"), fresh("values", df.columns)
    matches = F.regexp_extract_all(column, F.lit(ANY), F.lit(0))
    split = df.withColumn(values, F.when(column.rlike(HINT), pseudonyms(matches, key)))
    written = F.transform(F.col(values), lambda v: F.coalesce(v["new"], v["old"]))
    between = F.split(column, ANY, -1)
    joined = F.array_join(F.zip_with(between, written, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    hits = F.size(F.filter(F.col(values), lambda v: v["new"].isNotNull()))
    some = F.coalesce(F.size(values) > 0, F.lit(False))
    return split.withColumns(
        {
            text: F.when(some, joined).otherwise(column),
            found: F.when(some, hits).otherwise(0).cast("bigint"),
        }
    ).drop(values)
