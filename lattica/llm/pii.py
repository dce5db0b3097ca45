"""Format-preserving pseudonyms for personal data, by keyed Feistel networks. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name

ROUNDS = 8
KEY = "lattica-demo-key"  # give your own; equal values have equal pseudonyms under one key

_EDGE, _END = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_YEAR, _MONTH, _DAY = r"(?:1[7-9]|20)[0-9]{2}", r"(?:1[0-2]|0?[1-9])", r"(?:3[01]|[12][0-9]|0?[1-9])"
#: Phones of 3-3-4 digits, and those with a country code (none begins another), a trunk 0 in brackets, and digits with single separators.
_PHONE_334 = rf"(?:\+[0-9]{{1,3}}[ .\-]?)?(?:\([0-9]{{3}}\) ?|[0-9]{{3}}[.\-])[0-9]{{3}}[.\-][0-9]{{4}}"
_COUNTRY = r"(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"
#: What after a blank is no part of a phone number: dates, social security numbers, IPv4 addresses and cards.
_OTHER = rf"(?!(?:[0-9]{{4}}[.\-/]{_MONTH}[.\-/]{_DAY}|[0-9]{{1,2}}[.\-/][0-9]{{1,2}}[.\-/]{_YEAR}|[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}|(?:{_OCTET}\.){{3}}{_OCTET}|[0-9]{{4}}(?:[ \-][0-9]{{4}}){{3}})(?![0-9A-Za-z]|\.[0-9]))"
_GAP = rf"(?:[.\-/]| {_OTHER})?"
_TRUNK = r"(?:[ .\-/]?\(0\))?"
_PHONE_ABROAD = rf"(?:\+{_COUNTRY}|00 ?{_COUNTRY}(?= )){_TRUNK}{_GAP}(?:\([0-9]{{2,5}}\){_GAP}[0-9](?:{_GAP}[0-9]){{3,9}}|[0-9](?:{_GAP}[0-9]){{5,12}})"


def _dates() -> str:
    """Year first, or last with the day before the month or after it, of one or two digits; not within longer runs of such numbers."""
    forms = []
    for sep in (r"\-", "/", r"\."):
        first = rf"{_YEAR}[.](?:0[1-9]|1[0-2])[.](?:0[1-9]|[12][0-9]|3[01])" if sep == r"\." else rf"{_YEAR}{sep}{_MONTH}{sep}{_DAY}"
        forms.append(rf"(?<![0-9]{sep})(?:{first}|{_DAY}{sep}{_MONTH}{sep}{_YEAR}|{_MONTH}{sep}{_DAY}{sep}{_YEAR})(?!{sep}[0-9]|[0-9])")
    return "|".join(forms)


_DATE_PADDED = rf"(?:1[7-9]|20)[0-9]{{2}}([\-/])(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12][0-9]|3[01])|(?:0[1-9]|[12][0-9]|3[01])\.(?:0[1-9]|1[0-2])\.(?:1[7-9]|20)[0-9]{{2}}|(?:0[1-9]|1[0-2])/(?:0[1-9]|[12][0-9]|3[01])/(?:1[7-9]|20)[0-9]{{2}}"
#: What may be personal data. Numbers that a check digit or the calendar refutes are left alone.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "phone": rf"(?<![0-9A-Za-z+])(?:{_PHONE_334}|{_PHONE_ABROAD}){_END}",
    "ssn": rf"{_EDGE}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{_END}",
    "date": rf"{_EDGE}(?:{_DATE_PADDED}|{_dates()}){_END}",
    "ip": rf"(?<![0-9A-Za-z.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9A-Za-z]|\.[0-9])",
    "card": rf"{_EDGE}(?:[0-9]{{13,19}}|[0-9]{{4}}([ \-])[0-9]{{4}}\2[0-9]{{4}}\2[0-9]{{4}}){_END}",
}
_ANY = "|".join(PATTERNS.values())

#: 400 years of the calendar from here are a whole number of cycles: 146097 = 189 * 773 days.
_EPOCH, _WEEKS, _DAYS = "1700-01-01", 189, 773
#: Steps in which a permuted day and month that no calendar has (at most 3 of 100) are permuted again.
_WALK = 24


def _prf(key: str, kind: str, *parts):
    """60 bits of SHA-256 of the key, the kind and the parts."""
    text = F.concat_ws("|", F.lit(key), F.lit(kind), *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("long")


def _feistel(key: str, kind: str, x, y, a, b, rounds: int = ROUNDS):
    """struct(x, y) after an even number of rounds that permute the pairs 0 <= x < a, 0 <= y < b."""
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), a.cast("long").alias("a"), b.cast("long").alias("b"))
    step = lambda s, i: F.struct(s["y"].alias("x"), F.pmod(s["x"] + _prf(key, kind, i, s["a"], s["b"], s["y"]), s["a"]).alias("y"), s["b"].alias("a"), s["a"].alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)


def _power(n):
    return F.pow(F.lit(10), n).cast("long")


def _pad(number, width):
    """number as decimal text, zeros in front, width digits."""
    text = number.cast("string")
    return F.concat(F.repeat(F.lit("0"), width - F.length(text)), text)


def _permuted_digits(key: str, kind: str, digits):
    """Digits (2 to 18) of the same number, permuted among all of that number."""
    n = F.length(digits)
    h = F.floor(n / 2).cast("int")
    out = _feistel(key, kind, F.substring(digits, F.lit(1), h), F.substring(digits, h + 1, n), _power(h), _power(n - h))
    return F.transform(F.array(out), lambda s: F.concat(_pad(s["x"], h), _pad(s["y"], n - h)))[0]


def _luhn_sum(digits, odd):
    """Sum of the digits, those doubled whose place from the right (1 is the last) is odd (or else even)."""
    places = F.sequence(F.lit(1), F.length(digits))
    value = lambda i: F.substring(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == (1 if odd else 0), 2).otherwise(1)
    return F.aggregate(F.transform(places, value), F.lit(0), lambda s, d: s + d - F.when(d > 9, 9).otherwise(0))


def _card(key: str, m):
    digits = F.regexp_replace(m, "[^0-9]", "")

    def renewed(d):
        body = _permuted_digits(key, "card", F.substring(d, F.lit(1), F.length(d) - 1))
        return F.transform(F.array(body), lambda p: F.concat(p, F.pmod(10 - F.pmod(_luhn_sum(p, True), F.lit(10)), F.lit(10)).cast("string")))[0]

    def laid_out(new):
        sep = F.regexp_extract(m, "[ -]", 0)
        parts = [F.substring(new, 1 + 4 * k, 4) for k in range(4)]
        return F.when(sep == "", new).otherwise(F.concat(parts[0], sep, parts[1], sep, parts[2], sep, parts[3]))

    whole = F.transform(F.array(digits), lambda d: F.when(F.pmod(_luhn_sum(d, False), F.lit(10)) == 0, F.transform(F.array(renewed(d)), laid_out)[0]))
    return whole[0]


def _phone(key: str, m):
    national = F.substring(F.regexp_replace(m, "[^0-9]", ""), -10, 10)
    new = F.transform(F.array(_permuted_digits(key, "phone", national)), lambda d: F.regexp_replace(m, F.lit("[0-9]{3}([^0-9]+)[0-9]{3}([^0-9]+)[0-9]{4}$"), F.concat(F.substring(d, 1, 3), F.lit("$1"), F.substring(d, 4, 3), F.lit("$2"), F.substring(d, 7, 4))))
    return F.when(m.rlike(f"^(?:{_PHONE_334})$"), new[0]).otherwise(_phone_abroad(key, m))


def _phone_abroad(key: str, m):
    """The country code and a trunk 0 stay; the other digits are permuted, each in its place."""
    head = F.regexp_extract(m, rf"^(?:\+|00 ?){_COUNTRY}{_TRUNK}", 0)
    rest = F.substring(m, F.length(head) + 1, F.length(m))
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")

    def laid_out(new):
        place = lambda c, i: F.when(c.between("0", "9"), F.substring(new, F.length(digits(F.substring(rest, F.lit(1), i + 1))), F.lit(1))).otherwise(c)
        return F.concat(head, F.array_join(F.transform(F.split(rest, ""), place), ""))

    return F.transform(F.array(_permuted_digits(key, "phone", digits(rest))), laid_out)[0]


def _ip(key: str, m):
    octet = lambda k: F.split_part(m, F.lit("."), F.lit(k)).cast("int")
    out = _feistel(key, "ip", octet(1) * 256 + octet(2), octet(3) * 256 + octet(4), F.lit(65536), F.lit(65536))
    return F.transform(F.array(out), lambda s: F.concat_ws(".", *(F.shiftright(s[c], 8).cast("string") if high else F.pmod(s[c], F.lit(256)).cast("string") for c in ("x", "y") for high in (True, False))))[0]


def _ssn(key: str, m):
    area, group, serial = (F.split_part(m, F.lit("-"), F.lit(k)).cast("int") for k in (1, 2, 3))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    index = area - 1 - F.when(area > 666, 1).otherwise(0)  # of 898 areas
    out = _feistel(key, "ssn", index * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999))

    def text(s):
        k = F.floor(s["x"] / 99)
        return F.concat_ws("-", _pad(k + 1 + F.when(k >= 665, 1).otherwise(0), F.lit(3)), _pad(F.pmod(s["x"], F.lit(99)) + 1, F.lit(2)), _pad(s["y"] + 1, F.lit(4)))

    return F.when(valid, F.transform(F.array(out), text)[0])


def _date(key: str, m):
    iso, german = m.rlike("^[0-9]{4}"), m.contains(".")
    year = F.when(iso, F.substring(m, 1, 4)).otherwise(F.substring(m, -4, 4)).cast("int")
    month = F.when(iso, F.substring(m, 6, 2)).when(german, F.substring(m, 4, 2)).otherwise(F.substring(m, 1, 2)).cast("int")
    day = F.when(iso, F.substring(m, 9, 2)).when(german, F.substring(m, 1, 2)).otherwise(F.substring(m, 4, 2)).cast("int")
    first = F.make_date(year, month, F.lit(1))
    number = F.date_diff(first, F.lit(_EPOCH).cast("date")) + day - 1
    out = _feistel(key, "date", F.floor(number / _DAYS), F.pmod(number, F.lit(_DAYS)), F.lit(_WEEKS), F.lit(_DAYS))

    def text(s):
        new = F.date_add(F.lit(_EPOCH).cast("date"), (s["x"] * _DAYS + s["y"]).cast("int"))
        return F.when(iso & m.contains("-"), F.date_format(new, "yyyy-MM-dd")).when(iso, F.date_format(new, "yyyy/MM/dd")).when(german, F.date_format(new, "dd.MM.yyyy")).otherwise(F.date_format(new, "MM/dd/yyyy"))

    padded = F.when(day <= F.dayofmonth(F.last_day(first)), F.transform(F.array(out), text)[0])
    return F.when(m.rlike(f"^(?:{_DATE_PADDED})$"), padded).otherwise(_date_as_written(key, m))


def _date_as_written(key: str, m):
    """Dates with as many digits of day and month, in the same order, permuted among themselves.

    With a slash the month comes first and else the day, unless that number is over 12: such days (13 to 31) are permuted among such days.
    """
    form = r"^([0-9]+)([\-/.])([0-9]+)[\-/.]([0-9]+)$"
    p, sep, q, r = (F.regexp_extract(m, form, k) for k in (1, 2, 3, 4))
    iso, slash = F.length(p) == 4, sep == "/"
    one, two = F.when(iso, q).otherwise(p), F.when(iso, r).otherwise(q)
    year = F.when(iso, p).otherwise(r).cast("int")
    late = ~iso & (F.when(slash, one).otherwise(two).cast("int") > 12)
    month_first = iso | (slash != late)
    day, month = F.when(month_first, two).otherwise(one), F.when(month_first, one).otherwise(two)
    low = F.when(late, 13).otherwise(1)
    days = F.when(F.length(day) == 1, 9).when(late, 19).otherwise(31)
    months = F.when(F.length(month) == 1, 9).otherwise(12)

    def exists(y, mo, d):
        return d <= F.dayofmonth(F.last_day(F.make_date(y.cast("int"), mo.cast("int"), F.lit(1))))

    def state(x, y, ok):
        return F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), ok.alias("ok"))

    def step(s, _):
        again = F.transform(F.array(_feistel(key, "date", s["x"], s["y"], F.lit(400), days * months)), lambda t: state(t["x"], t["y"], exists(t["x"] + 1700, F.floor(t["y"] / days) + 1, F.pmod(t["y"], days.cast("long")) + low)))
        return F.when(s["ok"], s).otherwise(again[0])

    def text(s):
        d, mo = _pad(F.pmod(s["y"], days.cast("long")) + low, F.length(day)), _pad(F.floor(s["y"] / days) + 1, F.length(month))
        first, second = F.when(month_first, mo).otherwise(d), F.when(month_first, d).otherwise(mo)
        y = (s["x"] + 1700).cast("string")
        return F.when(s["ok"], F.when(iso, F.concat(y, sep, first, sep, second)).otherwise(F.concat(first, sep, second, sep, y)))

    start = state(year - 1700, (month.cast("int") - 1) * days + day.cast("int") - low, F.lit(False))
    out = F.aggregate(F.sequence(F.lit(1), F.lit(_WALK)), start, step)
    return F.when(exists(year, month.cast("int"), day.cast("int")), F.transform(F.array(out), text)[0])


def _email(key: str, m):
    """The part before @, each small letter, capital and digit of it moved within its class; the two halves key each other."""
    local = F.split_part(m, F.lit("@"), F.lit(1))
    h = F.ceil(F.length(local) / 2).cast("int")
    start = F.struct(F.substring(local, F.lit(1), h).alias("x"), F.substring(local, h + 1, F.length(local)).alias("y"))

    def moved(text, other, i):
        def letter(c, k):
            code, by = F.ascii(c), _prf(key, "email", i, F.length(text), k, other)
            turn = lambda low, n: F.chr((low + F.pmod(code - low + by, F.lit(n))).cast("long"))
            return F.when(c.between("a", "z"), turn(97, 26)).when(c.between("A", "Z"), turn(65, 26)).when(c.between("0", "9"), turn(48, 10)).otherwise(c)

        return F.when(text == "", text).otherwise(F.array_join(F.transform(F.split(text, ""), letter), ""))

    out = F.aggregate(F.sequence(F.lit(1), F.lit(4)), start, lambda s, i: F.struct(s["y"].alias("x"), moved(s["x"], s["y"], i).alias("y")))
    return F.transform(F.array(out), lambda s: F.concat(s["x"], s["y"], F.substring(m, F.length(local) + 1, F.length(m))))[0]


def _pseudonym(key: str, m):
    """struct(kind, value): null for what is not valid."""
    of = {"email": _email, "phone": _phone, "ssn": _ssn, "date": _date, "ip": _ip, "card": _card}
    value = kind = None
    # a match of several patterns is what the first of them says, as in the search
    for name, test in (("email", "@"), ("phone", rf"^\+|^\(|^[0-9]{{3}}[.\-][0-9]{{3}}[.\-][0-9]{{4}}$|^(?:{_PHONE_ABROAD})$"), ("ssn", r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), ("date", r"^[0-9]{4}([\-/.])[0-9]{1,2}\1[0-9]{1,2}$|^[0-9]{1,2}([\-/.])[0-9]{1,2}\2[0-9]{4}$"), ("ip", r"\."), ("card", "")):
        new = of[name](key, m)
        hit = m.rlike(test)
        value = F.when(hit, new) if value is None else value.when(hit, new)
        kind = F.when(hit, F.lit(name)) if kind is None else kind.when(hit, F.lit(name))
    return F.struct(kind.alias("kind"), value.alias("value"))


def pseudonymised(docs: DataFrame, key: str = KEY) -> DataFrame:
    """docs with `text` where personal data has pseudonyms of its format, and n_<kind> for each kind: how many were replaced.

    Kinds: email, phone, ssn, date, ip, card (see PATTERNS). Phones are of 3-3-4 digits with a bracket, dot or hyphen, or have a country
    code after + or 00; dates are numbers with a year of four digits, first or last. Phones of other forms without a country code,
    two-digit years and names of months are not covered. Card numbers need a right check digit and get one; dates must exist
    and stay within 1700 to 2099; social security numbers must be in use. Each is permuted by a Feistel network under the key,
    so equal values have equal pseudonyms in all documents, different values of a format different ones, and whoever has the
    key can go back. Everything else in the text stays as it is. Null and blank texts stay; repeated rows
    are treated alike; columns of docs called n_<kind> are replaced; others pass through; an empty table gives none.
    """
    text = F.col("text").cast("string")
    kinds = list(PATTERNS)
    names = [f"n_{k}" for k in kinds]
    rest = [c for c in docs.columns if c not in names]
    found, made = free_name(docs, "found"), free_name(docs, "made")
    df = docs.select(*(f"`{c}`" for c in rest), F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(_ANY), F.lit(0))).alias(found))
    df = df.withColumn(made, F.when(F.size(found) > 0, F.transform(found, lambda m: _pseudonym(key, m))))
    values = F.concat(F.zip_with(found, made, lambda m, s: F.coalesce(s["value"], m)), F.array(F.lit("")))
    new = F.when(F.col(made).isNotNull(), F.array_join(F.zip_with(F.split("text", _ANY, -1), values, lambda a, b: F.concat(a, b)), "")).otherwise(F.col("text"))

    def replaced(kind):
        return F.filter(made, lambda s: (s["kind"] == kind) & s["value"].isNotNull())

    counts = [F.coalesce(F.size(replaced(k)), F.lit(0)).cast("long").alias(f"n_{k}") for k in kinds]
    return df.select(*(new.alias("text") if c == "text" else f"`{c}`" for c in rest), *counts)
