"""Format-preserving pseudonyms for personal data, in DataFrame operations only.

Values are found by pattern, validated by kind, and permuted within their format by a keyed Feistel network; so equal
values have equal pseudonyms in all documents, different values different ones, and who has the key can go back.

Numbers with arithmetic of their own (IP addresses, dates, social security numbers) are two numbers L and R with moduli
of their own; rounds add a keyed hash of the one to the other. Everything else is two halves of a string: a round shifts
each letter or digit of one half, within its alphabet, by numbers from a keyed hash of the other half, then the halves
change places. Punctuation stays where it is. Check digits (Luhn, IBAN) are those of the new number.

The keyed hash is HMAC-SHA-256 over the parts, each with its length before it. Its key is derived from the caller's
secret on the driver and handed to the executors in a table of one row that the query reads; neither secret nor key is
in any plan, so none is in explain(), the event log or the UI.
"""

from __future__ import annotations

import hashlib
import hmac as python_hmac
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.sources import scratch_dir

ROUNDS = 8
CONTEXT = b"tarn pseudonyms 2"

# what values look like

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_AFTER = r"(?![0-9A-Za-z_])"
_SSN, _IP = r"[0-9]{3}-[0-9]{2}-[0-9]{4}", rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_ISO = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
_DATE = rf"{_ISO}|[0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}}|[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}|[0-9]{{1,2}}\.[0-9]{{1,2}}\.[0-9]{{4}}|[0-9]{{1,2}}-[0-9]{{1,2}}-[0-9]{{4}}"
#: Card numbers with back references spelled out, as groups of the whole pattern would be numbered anew.
_CARD = r"[0-9]{13,19}|[0-9]{4}(?:(?: [0-9]{4}){2} [0-9]{1,7}|(?:-[0-9]{4}){2}-[0-9]{1,7}|[ -][0-9]{6}[ -][0-9]{5})"
#: How long account numbers of a country are (ISO 13616).
IBAN_LENGTHS = {15: "NO", 16: "BE", 18: "DK|FI|NL", 20: "AT|EE|LT|LU", 21: "CH|HR|LI|LV", 22: "BG|DE|GB|IE|ME|RS", 23: "GI|IL", 24: "AD|CZ|ES|RO|SE|SK", 25: "PT", 26: "IS|TR", 27: "FR|GR|IT|MC|SM", 28: "CY|HU|PL"}


def _iban() -> str:
    group = lambda n: rf" ?[0-9A-Z]{{{n}}}"
    one = lambda n: group(4) * ((n - 4) // 4) + (group(n % 4) if n % 4 else "")
    return "|".join(rf"(?:{names})[0-9]{{2}}{one(n)}" for n, names in IBAN_LENGTHS.items())


def _ipv6(digit: str) -> str:
    """All eight groups, or fewer around a double colon, after a first group with a digit. That first group stays."""
    group = rf"{digit}{{1,4}}"
    return rf"(?:{group}:){{7}}{group}|(?={digit}{{0,3}}[0-9]){group}(?::{group}){{0,5}}::(?:{group}(?::{group}){{0,5}})?"


def _phones() -> str:
    """American numbers (of +1, its code may be missing), any with + or 00 and a country code (8 to 15 digits, or as few as
    were always taken in short groups), and national ones as French, German and Spanish texts write them."""
    code, area = r"\+1[ .-]?", r"\([0-9]{3}\)[ .-]?"
    american = rf"{code}(?:{area}|[0-9]{{3}}[ .-]?)[0-9]{{3}}[ .-]?[0-9]{{4}}|{area}[0-9]{{3}}[ .-]?[0-9]{{4}}"
    bare = r"[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}"
    spaced = r"(?<![0-9] )[0-9]{3} [0-9]{3} [0-9]{4}(?! [0-9])"
    whole = r"[2-9][0-9]{9}"
    # a group is not the beginning of a value of its own
    group = rf"(?![ .-](?:{_IP}|{_DATE}|{_SSN}|{_CARD}|{bare}){_AFTER})[ .-]"
    before = "[0-9][ .()-]{0,2}"  # written out, as a lookbehind has no repeated groups
    digits = rf"(?<={before * 7}[0-9])(?<!{before * 15}[0-9])"
    grouped = rf"\+(?!1[ .(-])[0-9]{{1,3}}(?:[ .-]?\([0-9]{{1,5}}\)[ .-]?[0-9]{{1,8}}|{group}[0-9]{{1,8}})(?:{group}[0-9]{{2,8}}){{0,4}}{digits}{_AFTER}"
    short = r"\+(?!1[ .(-])[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,4}"
    dialled = r"00[1-9][0-9]{8,12}|00[1-9][0-9]{0,2}(?:[ .-][0-9]{1,4}){3,6}"
    pairs = r"0[1-9](?:[0-9]{8}|(?: [0-9]{2}){4}|(?:\.[0-9]{2}){4}|(?:-[0-9]{2}){4})"
    german = r"(?:0[1-9][0-9]{1,4}[ /-]|\(0[1-9][0-9]{1,4}\) ?)[0-9]{3,8}(?:[ -][0-9]{2,6})?"
    spanish = r"(?<![0-9] )[6-9][0-9]{2}(?: [0-9]{3} [0-9]{3}|(?: [0-9]{2}){3})(?! [0-9])"
    national = rf"{dialled}|{pairs}|{german}|{spanish}"
    return rf"{american}|{bare}|{spaced}|\+[1-9][0-9]{{7,14}}{_AFTER}|{grouped}|{short}|(?:{national}|{whole}){_AFTER}"


_LETTER = r"\p{L}\p{N}"
_NAMED = r"[\"']? {0,2}[=:] {0,2}[\"']?"
_PASSWORD = rf"(?i:password|passwd|passphrase|pwd){_NAMED}"
_TOKEN = rf"(?i:(?:api|secret|access|private)[_-]?key|client[_-]?secret|(?:auth|access|api|bearer)[_-]?token|secret|token){_NAMED}"
_ISSUED = r"AKIA|ASIA|[spr]k_(?:live|test)_|gh[pousr]_|xox[abprs]-"

#: What each kind looks like, in the order in which a value's kind is settled. No length is limited where the form has none.
KINDS = {
    "email": rf"[{_LETTER}._%+-]++@(?:[{_LETTER}-]++\.)+\p{{L}}{{2,}}(?![{_LETTER}-])",
    "password": rf"{_PASSWORD}[^\s\"'<>,;]{{6,}}",
    "token": rf"{_TOKEN}(?=[^\s\"'<>,;]*[0-9])[^\s\"'<>,;]{{8,}}",
    "issued": r"(?:AKIA|ASIA)[0-9A-Z]{16}|[spr]k_(?:live|test)_[0-9A-Za-z]{10,}|gh[pousr]_[0-9A-Za-z]{20,}|xox[abprs]-[0-9A-Za-z-]{10,}",
    "iban": _iban(),
    "phone": _phones(),
    "ssn": _SSN,
    "date": _DATE,
    "ip": _IP,
    "ipv6": f"{_ipv6('[0-9a-f]')}|{_ipv6('[0-9A-F]')}",
    "card": r"[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}",
    "hex": r"[0-9a-f]{32,}|[0-9A-F]{32,}",
}
#: A text without any of these has no value of any kind.
HINT = r"[0-9@]|(?:AKIA|ASIA)[A-Z]|(?i:passw|passphrase|pwd)|_(?:live|test)_|gh[pousr]_|xox[abprs]-|[a-f]{32}|[A-F]{32}"
#: Codes of countries; whatever else stands after a plus counts as a code up to the first mark.
_CODE = r"(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{1,3})"


def _pattern() -> str:
    """All kinds in one pattern. A dot may stand before a value, but not a digit and a dot."""
    email = rf"(?<![{_LETTER}._%+-]){KINDS['email']}"
    ip = rf"(?<![0-9A-Za-z_]|[0-9]\.){_IP}(?![0-9A-Za-z_]|\.[0-9])"
    ipv6 = rf"(?<![0-9A-Za-z_:.])(?:{KINDS['ipv6']})(?![0-9A-Za-z_:])"
    iso = rf"(?<![0-9A-Za-z_+]|[0-9]\.){_ISO}(?=T[0-9]{{2}})"
    rest = "|".join(_CARD if k == "card" else KINDS[k] for k in ("issued", "iban", "phone", "ssn", "date", "card", "hex"))
    return rf"{email}|{KINDS['password']}|{KINDS['token']}|{ip}|{ipv6}|{iso}|(?<![0-9A-Za-z_+]|[0-9]\.)(?:{rest}){_AFTER}"


PATTERN = _pattern()

# keyed hashes


@dataclass(frozen=True)
class Key:
    """Columns that hold the key's two pads, as HMAC wants them."""

    inner: Column
    outer: Column

    def hash(self, *parts: Column) -> Column:
        """HMAC-SHA-256 of the parts, each after its length, in hexadecimal."""
        said = F.concat(*[x for p in parts for x in (F.octet_length(p).cast("string"), F.lit(":"), p)])
        first = F.unhex(F.sha2(F.concat(self.inner, F.encode(said, "UTF-8")), 256))
        return F.sha2(F.concat(self.outer, first), 256)


def key_bytes(secret: str | bytes) -> bytes:
    return python_hmac.new(secret.encode() if isinstance(secret, str) else secret, CONTEXT, hashlib.sha256).digest()


def key_table(spark: SparkSession, secret: str | bytes) -> DataFrame:
    """One row: the pads of the key that is derived from the secret. It lies in the shared folder, for its owner only."""
    padded = key_bytes(secret).ljust(64, b"\0")
    row = [(bytearray(b ^ 0x36 for b in padded), bytearray(b ^ 0x5C for b in padded))]
    path = scratch_dir(spark, "key")
    frame = spark.createDataFrame(row, "inner binary, outer binary").coalesce(1)
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.setPermission(at, hadoop.permission.FsPermission("700"))
    frame.write.mode("append").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


# permutations


def _let(value: Column, body) -> Column:
    """body(value), evaluated once: value is bound by a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _turns(back: bool) -> Column:
    return F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if back else F.sequence(F.lit(1), F.lit(ROUNDS))


#: Alphabets beyond ASCII, as first code point and number of letters that follow each other. The last two
#: are digits that keep their class (zero and one, two to nine).
ALPHABETS = (
    (0xE0, 23), (0xF8, 8), (0xC0, 23), (0xD8, 7), (0x3B1, 17), (0x3C3, 7), (0x391, 17), (0x3A3, 7), (0x430, 32), (0x410, 32), (0x5D0, 27), (0x621, 26), (0x641, 10),
    (0x904, 54), (0xE01, 48), (0x3041, 86), (0x30A1, 90), (0x4E00, 20976), (0xAC00, 11172), (0xE000, 2), (0xE002, 8),
)


def _shift(half: Column, hashes: Column, hexadecimal: bool, back: bool) -> Column:
    """Each letter or digit moved within its alphabet, by two bytes of the hashes (16 characters each)."""
    chars = F.split(half, "")
    step = lambda c, i: F.conv(F.substring(F.element_at(hashes, (F.floor(i / 16) + 1).cast("int")), (i % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int") * (-1 if back else 1)
    alphabets = F.array(*[F.struct(F.lit(first).alias("first"), F.lit(n).alias("n")) for first, n in ALPHABETS])

    def moved(c: Column, by: Column) -> Column:
        if hexadecimal:
            place = F.call_function("locate", c, F.lit("0123456789abcdef"))
            return F.when((c != "") & (place > 0), F.substring(F.lit("0123456789abcdef"), F.pmod(place - 1 + by, F.lit(16)) + 1, F.lit(1))).otherwise(c)
        point = F.ascii(c)
        within = lambda first, n: F.lit(first) + F.pmod(point - first + by, n)
        out = F.when(c.between("0", "9"), F.char(within(48, F.lit(10)))).when(c.between("a", "z"), F.char(within(97, F.lit(26)))).when(c.between("A", "Z"), F.char(within(65, F.lit(26)))).when(point < 128, c)
        own = F.try_element_at(F.filter(alphabets, lambda a: (point >= a["first"]) & (point < a["first"] + a["n"])), F.lit(1))
        far = _let(own, lambda a: F.decode(F.unhex(F.lpad(F.hex(a["first"] + F.pmod(point - a["first"] + by, a["n"])), 4, "0")), "UTF-16BE"))
        return out.otherwise(F.coalesce(far, c))

    return F.array_join(F.zip_with(chars, F.transform(chars, step), moved), "")


def scramble(value: Column, key: Key, tweak: Column, hexadecimal: bool = False, back: bool = False) -> Column:
    """The string Feistel network; of values of any length."""

    def network(value: Column, tweak: Column) -> Column:
        def shifted(half: Column, other: Column, r: Column) -> Column:
            blocks = F.sequence(F.lit(0), F.floor((F.length(half) - 1) / 16).cast("int"))
            hashes = F.transform(blocks, lambda b: key.hash(tweak, r.cast("string"), b.cast("string"), other))
            return _let(hashes, lambda h: _shift(half, h, hexadecimal, back))

        def turn(state: Column, r: Column) -> Column:
            left, right = state["l"], state["r"]
            if back:
                return F.struct(shifted(right, left, r).alias("l"), left.alias("r"))
            return F.struct(right.alias("l"), shifted(left, right, r).alias("r"))

        cut = F.floor(F.length(value) / 2).cast("int")
        start = F.struct(F.substring(value, F.lit(1), cut).alias("l"), F.substring(value, cut + 1, F.length(value)).alias("r"))
        return F.aggregate(_turns(back), start, turn, lambda s: F.concat(s["l"], s["r"]))

    return _let(F.struct(value.alias("value"), tweak.alias("tweak")), lambda x: network(x["value"], x["tweak"]))


def permute(left: Column, right: Column, of_left: int, of_right: int | Column, key: Key, tweak: Column, back: bool = False) -> Column:
    """The numeric Feistel network: struct l, r of the pair's image, l below of_left and r below of_right."""
    of_right = F.lit(of_right) if isinstance(of_right, int) else of_right

    def network(x: Column) -> Column:
        def turn(state: Column, r: Column) -> Column:
            odd = r % 2 == 1
            noise = F.conv(F.substring(key.hash(x["tweak"], r.cast("string"), F.when(odd, state["r"]).otherwise(state["l"]).cast("string")), 1, 12), 16, 10).cast("long") * (-1 if back else 1)
            return F.when(odd, F.struct(F.pmod(state["l"] + noise, F.lit(of_left)).alias("l"), state["r"].alias("r"))).otherwise(F.struct(state["l"].alias("l"), F.pmod(state["r"] + noise, x["of"]).alias("r")))

        return F.aggregate(_turns(back), F.struct(x["l"].alias("l"), x["r"].alias("r")), turn)

    return _let(F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"), of_right.cast("long").alias("of"), tweak.alias("tweak")), network)


# kinds


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _refill(value: Column, chars: Column, taken: str = "^[0-9]$") -> Column:
    """value with its digits (or whatever is taken) replaced one by one, so that a number is the same whatever stands
    between them."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(state: Column, c: Column) -> Column:
        own = c.rlike(taken)
        return F.struct(F.concat(state["out"], F.when(own, F.substring(chars, state["at"], F.lit(1))).otherwise(c)).alias("out"), (state["at"] + own.cast("int")).alias("at"))

    return F.aggregate(F.split(value, ""), start, step, lambda s: s["out"])


def _after(value: Column, prefix: Column) -> Column:
    return F.substring(value, F.length(prefix) + 1, F.length(value))


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits whose last one has weight one."""
    weighted = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, F.ascii(c) - 48).otherwise(F.pmod((F.ascii(c) - 48) * 2, F.lit(10)) + F.floor((F.ascii(c) - 48) / 5).cast("int")))
    return F.aggregate(weighted, F.lit(0), lambda a, b: a + b.cast("int"))


def _card(v: Column, key: Key, back: bool) -> Column:
    """The first digit stays."""

    def new(d: Column) -> Column:
        first = F.substring(d, F.lit(1), F.lit(1))
        return F.concat(first, scramble(F.substring(d, F.lit(2), F.length(d) - 2), key, F.concat(F.lit("card"), first), back=back))

    check = lambda x: F.pmod(F.lit(10) - F.pmod(_luhn(F.concat(x, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
    valid = F.pmod(_luhn(_digits(v)), F.lit(10)) == 0
    return F.when(valid, _let(_let(_let(_digits(v), new), lambda x: F.concat(x, check(x))), lambda d: _refill(v, d))).otherwise(v)


def _mod_97(text: Column) -> Column:
    """Of the number that digits, and letters as 10 to 35, make."""

    def step(rest: Column, c: Column) -> Column:
        n = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.pmod(rest * F.when(n > 9, 100).otherwise(10) + n, F.lit(97))

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _account(v: Column, key: Key, back: bool) -> Column:
    """An IBAN: the country stays, and the check digits are those of the new account."""

    def new(plain: Column) -> Column:
        country, own = F.substring(plain, F.lit(1), F.lit(2)), F.substring(plain, F.lit(5), F.length(plain))
        other = scramble(own, key, F.concat(F.lit("iban"), country), back=back)
        check = lambda o: F.lpad((F.lit(98) - _mod_97(F.concat(o, country, F.lit("00")))).cast("string"), 2, "0")
        valid = _mod_97(F.concat(own, country, F.substring(plain, F.lit(3), F.lit(2)))) == 1
        return F.when(valid, _let(other, lambda o: F.concat(country, check(o), o))).otherwise(plain)

    return _let(_let(F.replace(v, F.lit(" ")), new), lambda x: _refill(v, x, "^[^ ]$"))


def _ip(v: Column, key: Key, back: bool) -> Column:
    o = F.transform(F.split(v, r"\."), lambda x: x.cast("long"))
    out = permute(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, F.lit("ip"), back)
    parts = lambda p: F.concat_ws(".", *[x.cast("string") for x in (F.floor(p["l"] / 256), p["l"] % 256, F.floor(p["r"] / 256), p["r"] % 256)])
    return _let(out, parts)


def _hexadecimal(v: Column, key: Key, tweak: str, back: bool) -> Column:
    """Of one case throughout."""
    lower = scramble(F.lower(v), key, F.lit(tweak), True, back)
    return F.when(v == F.lower(v), lower).otherwise(F.upper(lower))


def _wide_ip(v: Column, key: Key, back: bool) -> Column:
    """IPv6: the first group stays. Eight groups, or seven at most beside a double colon."""
    first = F.substring_index(v, ":", 1)
    groups = F.size(F.filter(F.split(v, ":"), lambda x: x != ""))
    return F.when((groups <= 7) | ~v.contains("::"), F.concat(first, _hexadecimal(_after(v, first), key, "ipv6", back))).otherwise(v)


def _ssn(v: Column, key: Key, back: bool) -> Column:
    area, group, serial = (F.substring(v, F.lit(a), F.lit(n)).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    out = permute(area - 1 - (area > 666).cast("long"), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, F.lit("ssn"), back)

    def written(p: Column) -> Column:
        a = p["l"] + 1 + (p["l"] >= 665).cast("long")
        return F.concat(F.lpad(a.cast("string"), 3, "0"), F.lit("-"), F.lpad((F.floor(p["r"] / 9999) + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((p["r"] % 9999 + 1).cast("string"), 4, "0"))

    return F.when(valid, _let(out, written)).otherwise(v)


def day_class(month, day):
    """Months of one digit or two; days of one digit, of two up to the twelfth, later ones."""
    return 3 * (month >= 10) + (day >= 10) + (day > 12)


#: Month and day of all days of a common year, by class.
_YEAR = sorted((date(1901, 1, 1) + timedelta(n) for n in range(365)), key=lambda d: (day_class(d.month, d.day), d))
_DAYS = "".join(f"{d:%m-%d}" for d in _YEAR)
_OF_CLASS = [sum(day_class(d.month, d.day) == c for d in _YEAR) for c in range(6)]


def _date(v: Column, key: Key, back: bool) -> Column:
    """Days of 1900 to 2099, year and day of year; 29 February stays one, of another leap year.

    With slashes the month comes first, or the day where that is no date; with hyphens and the year last it is the other
    way round. A day keeps its class, so it has as many digits as before and the order is read as it was; and a day is the
    same one in all formats.
    """

    padded = lambda x: F.lpad(x, 2, "0")
    as_day = lambda y, m, d: F.concat_ws("-", y, padded(m), padded(d)).try_cast("date")

    def ordered(p: Column) -> Column:
        led = F.length(p[0]) == 4
        months_lead, days_lead = as_day(p[2], p[0], p[1]).isNotNull(), as_day(p[2], p[1], p[0]).isNotNull()
        month_first = ~led & ((v.contains("/") & months_lead) | (v.contains("-") & months_lead & ~days_lead))
        year, month = F.when(led, p[0]).otherwise(p[2]), F.when(led | ~month_first, p[1]).otherwise(p[0])
        day = F.when(led, p[2]).when(month_first, p[1]).otherwise(p[0])
        return F.struct(led.alias("led"), month_first.alias("month_first"), month.alias("month"), day.alias("day"), as_day(year, month, day).alias("found"), F.substring(v, F.length(p[0]) + 1, F.lit(1)).alias("mark"))

    def new(p: Column) -> Column:
        def written(y: Column, md: Column) -> Column:
            fit = lambda x, old: F.when(F.length(old) == 1, F.substring(x, F.lit(2), F.lit(1))).otherwise(x)
            parts = F.struct(F.lpad(y.cast("string"), 4, "0").alias("y"), fit(F.substring(md, 1, 2), p["month"]).alias("m"), fit(F.substring(md, 4, 2), p["day"]).alias("d"))
            order = lambda x: F.when(p["led"], F.array(x["y"], x["m"], x["d"])).when(p["month_first"], F.array(x["m"], x["d"], x["y"])).otherwise(F.array(x["d"], x["m"], x["y"]))
            return F.array_join(F.flatten(F.transform(_let(parts, order), lambda x: F.array(p["mark"], x))), "")

        found = p["found"]
        year, m, d = F.year(found), F.month(found), F.dayofmonth(found)
        kind = F.lit(3) * (m >= 10).cast("int") + (d >= 10).cast("int") + (d > 12).cast("int")
        place = F.floor((F.call_function("locate", F.date_format(found, "MM-dd"), F.lit(_DAYS)) - 1) / 5)

        def usual(c: Column) -> Column:
            of = F.element_at(F.array(*map(F.lit, _OF_CLASS)), c["kind"] + 1)
            pair = permute(year - 1900, c["place"] - c["first"], 200, of, key, F.concat(F.lit("date"), c["kind"].cast("string")), back)
            return _let(pair, lambda x: written(x["l"] + 1900, F.substring(F.lit(_DAYS), ((x["r"] + c["first"]) * 5 + 1).cast("int"), F.lit(5))))

        first = F.element_at(F.array(*[F.lit(sum(_OF_CLASS[:c])) for c in range(6)]), kind + 1)
        # the 49 leap years from 1904 on
        leap = permute(F.floor((year - 1904) / 28), F.pmod(F.floor((year - 1904) / 4), F.lit(7)), 7, 7, key, F.lit("leap"), back)
        rare = _let(leap, lambda x: written(F.lit(1904) + x["l"] * 28 + x["r"] * 4, F.lit("02-29")))
        return F.when((m == 2) & (d == 29), rare).otherwise(_let(F.struct(kind.alias("kind"), first.alias("first"), place.alias("place")), usual))

    valid = lambda p: F.coalesce(F.year(p["found"]).between(1900, 2099), F.lit(False))
    # the mark before the first part is cut off
    return _let(_let(F.split(v, "[-/.]"), ordered), lambda p: F.when(valid(p), F.substring(new(p), F.lit(2), F.lit(10))).otherwise(v))


def _email(v: Column, key: Key, back: bool) -> Column:
    local, host = F.substring_index(v, "@", 1), F.substring_index(v, "@", -1)
    return F.concat(scramble(local, key, F.concat(F.lit("email"), F.lower(host)), back=back), F.lit("@"), host)


def _phone(v: Column, key: Key, back: bool) -> Column:
    """The country code stays, or the first digits of a national number; one without either is of +1. American numbers keep
    the class of the digits that begin area and exchange, so they are found in any form."""
    dialled = F.regexp_extract(v, rf"^00{_CODE}", 0)
    begun = F.coalesce(F.nullif(F.regexp_extract(v, rf"^(?:\+{_CODE}|\(?0[1-9])", 0), F.lit("")), F.when(F.length(_digits(v)) == 9, F.substring(v, F.lit(1), F.lit(1))), F.lit(""))
    private = "".join(map(chr, range(0xE000, 0xE00A)))
    hidden, shown = (lambda x: F.translate(x, "0123456789", private)), (lambda x: F.translate(x, private, "0123456789"))

    def new(p: Column) -> Column:
        rest = _after(v, p["prefix"])

        def digits_of(d: Column) -> Column:
            at = lambda a, n: F.substring(d, F.lit(a), F.lit(n))
            return F.when((p["country"] == "+1") & (F.length(d) == 10), F.concat(hidden(at(1, 1)), at(2, 2), hidden(at(4, 1)), at(5, 6))).otherwise(d)

        digits = shown(scramble(_let(_digits(rest), digits_of), key, F.concat(F.lit("phone"), p["country"]), back=back))
        return F.concat(p["prefix"], _let(digits, lambda d: _refill(rest, d)))

    prefix = F.when(dialled != "", dialled).otherwise(begun)
    country = F.when(dialled != "", F.concat(F.lit("+"), F.substring(dialled, F.lit(3), F.lit(3)))).when(prefix == "", F.lit("+1")).when(prefix.startswith("+"), prefix).otherwise(_digits(prefix))
    return _let(F.struct(prefix.alias("prefix"), country.alias("country")), new)


def _named(v: Column, name: str, key: Key, back: bool) -> Column:
    """What stands after a name is the secret, whatever the name; one that has a kind of its own is one of that kind."""
    prefix = F.regexp_extract(v, rf"^(?:{name})", 0)

    def new(secret: Column) -> Column:
        issued = F.regexp_extract(secret, rf"^(?:{_ISSUED})", 0)
        other = F.concat(issued, scramble(_after(secret, issued), key, F.lit("secret"), back=back))
        return F.when(secret.rlike(rf"\A(?:{KINDS['hex']})\z"), _hexadecimal(secret, key, "hex", back)).otherwise(other)

    return F.concat(prefix, _let(_after(v, prefix), new))


def pseudonym(v: Column, key: Key, back: bool = False) -> Column:
    """The pseudonym of one found value, or the value itself where its kind finds it invalid."""
    whole = lambda kind: v.rlike(rf"\A(?:{KINDS[kind]})\z")
    return (
        F.when(whole("email"), _email(v, key, back))
        .when(whole("password"), _named(v, _PASSWORD, key, back))
        .when(whole("token"), _named(v, _TOKEN, key, back))
        .when(whole("issued"), _named(v, _ISSUED, key, back))
        .when(whole("iban"), _account(v, key, back))
        .when(whole("phone"), _phone(v, key, back))
        .when(whole("ssn"), _ssn(v, key, back))
        .when(whole("date"), _date(v, key, back))
        .when(whole("ip"), _ip(v, key, back))
        .when(whole("ipv6"), _wide_ip(v, key, back))
        .when(whole("card"), _card(v, key, back))
        .when(whole("hex"), _hexadecimal(v, key, "hex", back))
        .otherwise(v)
    )


def pseudonymize(docs: DataFrame, secret: str | bytes, text: str = "text", count: str | None = None, back: bool = False) -> DataFrame:
    """docs with the personal data in text replaced by pseudonyms, all other columns as they are.

    secret: whoever has it can go back, with back. count names a column to add: how many values were replaced. Values of
    no valid form (a number that fails its check digit, a date that no calendar has, years outside 1900 to 2099) stay.
    Defined cases: a null text stays null with count 0; an empty one stays empty; values and texts may be of any length;
    repeated rows give repeated rows; an empty table gives none; any other columns pass through.
    """
    table = key_table(docs.sparkSession, secret)
    held = docs.select(F.struct("*").alias("_row"), F.col(f"`{text}`").alias("_body"), table.select("inner").scalar().alias("_inner"), table.select("outer").scalar().alias("_outer"))
    body, key = F.col("_body"), Key(F.col("_inner"), F.col("_outer"))
    found = F.regexp_extract_all(body, F.lit(PATTERN), F.lit(0))
    new = F.transform(found, lambda v: pseudonym(v, key, back))
    held = held.withColumn("_new", F.when(body.rlike(HINT) & body.rlike(PATTERN), new))
    gaps = F.split(body, PATTERN, -1)
    joined = F.array_join(F.flatten(F.zip_with(gaps, F.array_append(F.col("_new"), F.lit("")), lambda g, m: F.array(g, m))), "")
    changed = F.when(F.col("_new").isNull(), body).otherwise(joined)
    out = [changed.alias(text) if c == text else F.col("_row").getField(c).alias(c) for c in docs.columns]
    if count:
        differs = F.filter(F.zip_with(found, F.col("_new"), lambda a, b: a != b), lambda x: x)
        out.append(F.when(F.col("_new").isNull(), 0).otherwise(F.size(differs)).cast("long").alias(count))
    return held.select(*out)
