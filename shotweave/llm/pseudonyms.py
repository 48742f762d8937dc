"""Format-preserving pseudonyms: a keyed Feistel network over the symbols of validated numbers, dates and addresses.

All of it is built from DataFrame functions. A text is split at its personal items. An item becomes an array of symbols,
each with a base and a radix (a digit is 48 + one of 10), without the separators of its layout, and eight rounds add a keyed
digest of one half to the other half, position by position, modulo the radix. That is a permutation of all values of one
kind, so equal values stay equal in every document and in every layout, different ones stay different, and lengths and
separators do not change. Numbers are permuted within their valid values: parts by their own radix, check digits anew. The
work is one pass without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
# 400 Gregorian years always have 146097 = 189 * 773 days, so days from FIRST_DAY form an exact two-digit number.
FIRST_DAY, DAY_RADIX = "1800-01-01", (189, 773)
# Social security numbers have areas 001-899 without 666, groups 01-99 and serials 0001-9999.
SSN_RADIX = (898, 99, 9999)
# Ranges of letters and digits without gaps, as first and last code point.
SCRIPTS = [
    (0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xDE), (0xDF, 0xF6), (0xF8, 0xFF), (0x100, 0x17F), (0x391, 0x3A1), (0x3A3, 0x3A9),
    (0x3B1, 0x3C9), (0x400, 0x40F), (0x410, 0x42F), (0x430, 0x44F), (0x450, 0x45F), (0x531, 0x556), (0x561, 0x586), (0x5D0, 0x5EA), (0x621, 0x63A), (0x641, 0x64A),
    (0x660, 0x669), (0x904, 0x939), (0x966, 0x96F), (0xE01, 0xE30), (0x10D0, 0x10F0), (0x1E00, 0x1E95), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3),
]
DATES = {"yyyy-MM-dd": r"\d{4}-\d{2}-\d{2}", "yyyy/MM/dd": r"\d{4}/\d{2}/\d{2}", "dd.MM.yyyy": r"\d{2}\.\d{2}\.\d{4}", "MM/dd/yyyy": r"\d{2}/\d{2}/\d{4}"}
EMAIL = r"[\p{L}\p{N}._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"
HEX = r"(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})"
ADDRESS = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
PHONE = r"(?:\+\d{1,3}[ .\-]?)?\(?\d{3}\)?[ .\-]\d{3}[ .\-]\d{4}"
SSN = r"\d{3}-\d{2}-\d{4}"
CARD = r"(?:\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{4}|\d{13,19})"
IBAN = r"[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)"
ITEM = "|".join(
    [
        rf"(?<![\p{{L}}\p{{N}}._%+\-]){EMAIL}",
        rf"(?<![0-9A-Za-z]){HEX}(?![0-9A-Za-z])",
        rf"(?<![0-9A-Za-z]){IBAN}(?![0-9A-Za-z])",
        rf"(?<![\d./\-])(?:{'|'.join(DATES.values())})(?![\d/\-]|\.\d)",
        rf"(?<![\d.]){ADDRESS}(?!\d|\.\d)",
        rf"(?<![\d\-]){SSN}(?![\d\-])",
        rf"(?<![\d+\-])(?:{PHONE})(?![\d\-])",
        rf"(?<!\d){CARD}(?!\d)",
    ]
)


def bound(value: Column, then) -> Column:
    """then(value), with the value computed once."""
    return F.transform(F.array(value), then)[0]


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string, mod 10; 0 for a valid number."""
    value = lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int"))
    return F.aggregate(F.transform(characters(F.reverse(digits)), value), F.lit(0), lambda a, x: a + x) % 10


def mod97(text: Column) -> Column:
    """The number that digits and capitals (A is 10) spell, mod 97."""
    step = lambda a, c: F.when(c.between("0", "9"), a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(characters(text), F.lit(0), lambda a, c: step(a, c))


def permute(codes: Column, radix: Column, key: str, tweak: Column) -> Column:
    """The Feistel permutation of an array of codes below the given radices."""
    half = F.floor(F.size(codes) / 2).cast("int")

    def turn(state: Column, r: Column) -> Column:
        left = r % 2 == 0  # which half changes
        other = F.filter(state, lambda _, i: (i < half) != left)
        digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, r.cast("string"), F.array_join(F.transform(other, lambda x: x.cast("string")), ",")), 256)
        add = lambda d, i: F.conv(F.substring(d, (i % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int")
        return bound(digest, lambda d: F.transform(state, lambda c, i: F.when((i < half) == left, (c + add(d, i)) % F.get(radix, i)).otherwise(c)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), codes, turn)


def character(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def _range(code: Column, which: int) -> Column:
    """First code point, or number of code points, of the range that holds `code`; the code itself, or 1, outside all."""
    out = F.lit(1) if which else code
    for a, b in reversed(SCRIPTS):
        out = F.when(code.between(a, b), b - a + 1 if which else a).otherwise(out)
    return out


def permuted_text(text: Column, key: str, tweak: Column) -> Column:
    """`text` with each letter and digit replaced by one of its own range; other characters stay."""

    def moved(s: Column) -> Column:
        codes, radix = F.transform(s, lambda x: x["c"] - x["a"]), F.transform(s, lambda x: x["n"])
        out = bound(codes, lambda c: bound(radix, lambda r: permute(c, r, key, tweak)))
        return F.array_join(F.zip_with(s, out, lambda x, c: F.when(x["n"] > 1, character(x["a"] + c)).otherwise(x["t"])), "")

    symbols = F.transform(characters(text), lambda t: bound(F.ascii(t), lambda c: F.struct(t.alias("t"), c.alias("c"), _range(c, 0).alias("a"), _range(c, 1).alias("n"))))
    return bound(symbols, moved)


def laid_out(layout: Column, symbols: Column, taken: str) -> Column:
    """`layout` with its characters of the class `taken` replaced, in order, by those of `symbols`."""
    start = F.struct(F.lit("").alias("done"), F.lit(1).alias("next"))
    step = lambda s, c: F.when(c.rlike(taken), F.struct(F.concat(s["done"], F.substring(symbols, s["next"], F.lit(1))).alias("done"), (s["next"] + 1).alias("next"))).otherwise(F.struct(F.concat(s["done"], c).alias("done"), s["next"].alias("next")))
    return F.aggregate(characters(layout), start, step, lambda s: s["done"])


def _number(parts: list[Column], radix: tuple[int, ...], key: str, tweak: str) -> Column:
    return permute(F.array(*[p.cast("int") for p in parts]), F.array(*map(F.lit, radix)), key, F.lit(tweak))


def _ssn(digits: Column, key: str) -> Column:
    area = F.substring(digits, 1, 3).cast("int")
    moved = _number([area - F.when(area > 666, 2).otherwise(1), F.substring(digits, 4, 2).cast("int") - 1, F.substring(digits, 6, 4).cast("int") - 1], SSN_RADIX, key, "ssn")
    return bound(moved, lambda m: F.concat(F.lpad((m[0] + F.when(m[0] >= 665, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((m[1] + 1).cast("string"), 2, "0"), F.lpad((m[2] + 1).cast("string"), 4, "0")))


def pseudonym(item: Column, key: str) -> Column:
    """The pseudonym of one item, or the item itself where it is not valid."""
    whole = lambda p: item.rlike(f"^(?:{p})$")
    digits = F.regexp_replace(item, "[^0-9]", "")
    of_length = lambda kind, text: F.concat(F.lit(kind), F.length(text).cast("string"))
    in_place = lambda new: laid_out(item, new, "[0-9]")
    at = F.locate("@", item)
    local = F.substring(item, F.lit(1), at - 1)
    email = F.concat(permuted_text(local, key, of_length("email", local)), F.substring(item, at, F.length(item)))
    figures = F.when(item.rlike("[a-f]"), F.lit("0123456789abcdef")).when(item.rlike("[A-F]"), F.lit("0123456789ABCDEF"))
    values = F.transform(characters(item), lambda c: F.position(c, figures) - 1)
    hexes = F.array_join(F.transform(permute(values, F.transform(values, lambda _: F.lit(16)), key, of_length("hex", item)), lambda c: F.substring(figures, c + 1, F.lit(1))), "")
    octets = F.transform(F.split(item, r"\."), lambda x: x.cast("int"))
    least = lambda x: F.when(x < 10, 0).when(x < 100, 10).otherwise(100)  # noqa: E731  an octet keeps its number of digits
    span = F.transform(octets, lambda x: F.when(x < 10, 10).when(x < 100, 90).otherwise(156))
    moved = permute(F.transform(octets, lambda x: x - least(x)), span, key, F.concat_ws(".", F.lit("ip"), F.transform(octets, lambda x: F.length(x.cast("string")).cast("string"))))
    address = F.array_join(F.zip_with(octets, moved, lambda x, c: (c + least(x)).cast("string")), ".")
    local_digits = F.substring(digits, -10, 10)  # the country code stays
    phone = in_place(F.concat(F.substring(digits, F.lit(1), F.length(digits) - 10), permuted_text(local_digits, key, F.lit("phone"))))
    body = permuted_text(F.substring(digits, F.lit(1), F.length(digits) - 1), key, of_length("card", digits))
    card = in_place(bound(body, lambda b: F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0")))) % 10).cast("string"))))
    plain = F.replace(item, F.lit(" "), F.lit(""))
    country = F.substring(plain, 1, 2)
    account = permuted_text(F.substring(plain, F.lit(5), F.length(plain)), key, F.concat(F.lit("iban"), country, F.length(plain).cast("string")))
    iban = bound(account, lambda a: laid_out(item, F.concat(country, F.lpad((98 - mod97(F.concat(a, country, F.lit("00")))).cast("string"), 2, "0"), a), "[A-Z0-9]"))
    out = F.when(whole(EMAIL), email).when(whole(HEX) & item.rlike("[A-Fa-f]"), hexes)
    out = out.when(whole(IBAN), F.when(mod97(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))) == 1, iban).otherwise(item))
    for form, pattern in DATES.items():
        day = F.try_to_timestamp(item, F.lit(form)).cast("date")
        n = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
        pair = _number([n / F.lit(DAY_RADIX[1]), n % DAY_RADIX[1]], DAY_RADIX, key, "date")
        moved_day = bound(pair, lambda p: F.date_add(F.lit(FIRST_DAY).cast("date"), p[0] * DAY_RADIX[1] + p[1]))
        out = out.when(whole(pattern), F.when(n.between(0, DAY_RADIX[0] * DAY_RADIX[1] - 1), F.date_format(moved_day, form)).otherwise(item))
    out = out.when(whole(ADDRESS), F.when(F.forall(octets, lambda x: x <= 255) & ~item.rlike(r"(^|\.)0\d"), address).otherwise(item))
    out = out.when(whole(SSN), F.when(item.rlike("^(?!000|666|9)...-(?!00)..-(?!0000)...."), in_place(_ssn(digits, key))).otherwise(item))
    out = out.when(whole(PHONE), phone)
    return out.when(whole(CARD), F.when((luhn_sum(digits) == 0), card).otherwise(item)).otherwise(item)


def _fresh(name: str, used: list[str]) -> str:
    while name.lower() in {c.lower() for c in used}:
        name += "_"
    return name


def pseudonymize(df: DataFrame, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """`df` with every valid personal item in `text` replaced by its pseudonym under `key`.

    Items: e-mail addresses (the part before @), dates, IPv4 addresses, social security and phone numbers, card numbers
    that pass the Luhn check and IBANs that pass theirs (their pseudonyms pass it too), and secrets of 32 to 64 hexadecimal
    digits. A value has one pseudonym in all its layouts: spaces, dots, dashes, brackets, country codes and the order of a
    date's parts are not part of it. Numbers that fail their validation stay. Letters stay within their script's range
    (`SCRIPTS`); a letter of none of them stays. A permutation has fixed points, so an item can, rarely, keep its value.

    Null and empty texts stay as they are, very long ones are treated whole; rows, repeated ones included, other columns
    whatever their names, and lengths do not change. `count` names an optional column for the number of items that changed;
    a column of that name is replaced. The domain of an e-mail address is not personal and stays.
    """
    t = F.col(f"`{text}`")
    old, new = _fresh("found", df.columns), _fresh("new", df.columns)
    joined = F.array_join(F.zip_with(F.split(t, ITEM, -1), F.col(new), lambda gap, item: F.concat(gap, F.coalesce(item, F.lit("")))), "")
    out = df.withColumn(old, F.when(t.rlike("[0-9@]"), F.regexp_extract_all(t, F.lit(ITEM), F.lit(0))))
    out = out.withColumn(new, F.when(F.size(old) > 0, F.transform(F.col(old), lambda x: pseudonym(x, key))))
    columns = []
    for c in df.columns:
        columns.append(F.when(F.col(new).isNotNull(), joined).otherwise(t).alias(text) if c == text else F.col(f"`{c}`"))
    if count:
        columns = [c for c, name in zip(columns, df.columns, strict=True) if name != count]
        changed = F.zip_with(old, new, lambda a, b: a != b)
        columns.append(F.when(F.col(new).isNull(), 0).otherwise(F.size(F.filter(changed, lambda x: x))).cast("bigint").alias(count))
    return out.select(*columns)
