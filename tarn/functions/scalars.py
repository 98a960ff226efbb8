"""Column functions of the engine, all built in (no Python on the executors)."""

from __future__ import annotations

import re
import unicodedata

from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column
from pyspark.sql import functions as F

from tarn.types import FieldType

#: Doubles beyond this size, or below a ten thousandth, are written with an exponent.
LARGEST_PLAIN = float(1 << 53)


def epoch_millis(ts: Column) -> Column:
    """Milliseconds since 1970, rounded; Spark's own function floors."""
    return F.round(F.unix_micros(ts.cast("timestamp")) / 1000).cast("long")


def _plain(c: Column, kind: FieldType) -> Column:
    match kind.label:
        case "double":
            return double_text(c)
        case "timestamp":
            return epoch_millis(c).cast("string")
        case "bytes":
            return F.base64(c)
        case _:
            return c.cast("string")


def double_text(c: Column) -> Column:
    """The shortest decimal that reads back as the double: 0.0001, 1e-05, 12345678.9, 1e+16; always with a point or an
    exponent. Spark's own cast writes other forms."""
    x = c.cast("double")
    # 15 digits read back where any shorter decimal does; 17 always do
    scientific = [F.format_string(f"%.{n}e", x) for n in (14, 15, 16)]
    text = F.when(F.abs(x) < float("inf"), F.coalesce(*[F.when(s.try_cast("double") == x, s) for s in scientific[:2]], scientific[2]))

    def written(s: Column) -> Column:
        sign = F.when(s.startswith("-"), F.lit("-")).otherwise(F.lit(""))
        digits = F.rtrim(F.regexp_replace(F.substring_index(s, "e", 1), "[-.]", ""), F.lit("0"))
        digits = F.when(digits == "", F.lit("0")).otherwise(digits)
        power = F.substring_index(s, "e", -1).cast("int")
        rest = F.substring(digits, F.lit(2), F.length(digits))
        exponent = F.concat(F.lit("e"), F.when(power < 0, F.lit("-")).otherwise(F.lit("+")), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
        large = F.concat(F.substring(digits, F.lit(1), F.lit(1)), F.when(rest == "", F.lit("")).otherwise(F.concat(F.lit("."), rest)), exponent)
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
        whole = F.rpad(F.substring(digits, F.lit(1), power + 1), power + 1, F.lit("0"))
        part = F.substring(digits, power + 2, F.length(digits))
        plain = F.concat(whole, F.lit("."), F.when(part == "", F.lit("0")).otherwise(part))
        return F.concat(sign, F.when((power < -4) | (F.abs(x) > LARGEST_PLAIN), large).when(power < 0, small).otherwise(plain))

    odd = F.when(F.isnan(x), F.lit("nan")).when(x == float("inf"), F.lit("inf")).when(x == -float("inf"), F.lit("-inf"))
    return F.coalesce(odd, F.element_at(F.transform(F.array(text), written), 1))


#: What a canonical key begins with, by type.
PREFIX = {"int": "i", "double": "d", "timestamp": "t", "bytes": "b", "reference": "r"}


def canonical(c: Column, kind: FieldType) -> Column:
    """The key of a group: text as it is, other types with a letter before them; null stays null."""
    if kind.is_list:
        inner = kind.element
        joined = F.array_join(F.transform(c, lambda x: _plain(x, inner)), ",")
        return joined if inner.label == "string" else F.concat(F.lit(PREFIX[inner.label] + "["), joined, F.lit("]"))
    return F.concat(F.lit(PREFIX.get(kind.label, "")), _plain(c, kind))


def hour_of(ts: Column) -> Column:
    return F.date_trunc("hour", ts.cast("timestamp"))


def week_of(ts: Column) -> Column:
    """Monday, 00:00 UTC."""
    return F.date_trunc("week", ts.cast("timestamp"))


def hour_of_week(ts: Column) -> Column:
    return F.floor((F.unix_micros(ts.cast("timestamp")) - F.unix_micros(week_of(ts))) / 3_600_000_000).cast("int")


def bucket(value: Column, bounds: list[float]) -> Column:
    """How many bounds are not above value: the first bucket is below all of them."""
    return F.aggregate(F.array(*[F.lit(float(b)) for b in bounds]), F.lit(0), lambda n, b: n + (b <= value).cast("int"))


def search_tokens(c: Column) -> Column:
    """Lower-cased words; whatever is neither letter nor number parts them."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def words_of(text: str) -> list[str]:
    """search_tokens() of a literal, each once: categories L and N are what the pattern calls letters and numbers."""
    apart = "".join(x if unicodedata.category(x)[0] in "LN" else " " for x in text.lower())
    return list(dict.fromkeys(apart.split(" "))) if apart.strip(" ") else []


def has_tokens(c: Column, needle: str) -> Column:
    """Every word of needle is a word of c; of no words, all c that are not null.

    A word is looked for where it stands, up to its first place, so no text is cut into all of its words.
    """
    low = F.lower(c)
    found = F.when(c.isNotNull(), F.lit(True))
    for word in (w for w in words_of(needle) if w):
        found = found & low.contains(word) & low.rlike(rf"(?<![\p{{L}}\p{{N}}]){re.escape(word)}(?![\p{{L}}\p{{N}}])")
    return found


def compiles(pattern: str) -> bool:
    """Whether the engine that will run the pattern takes it: Java's, or Python's where there is no session yet."""
    context = SparkContext._active_spark_context
    try:
        context._jvm.java.util.regex.Pattern.compile(pattern) if context else re.compile(pattern)
    except (re.error, IllegalArgumentException):
        return False
    return True


def whole_match(c: Column, pattern: str) -> Column:
    return c.rlike(rf"\A(?:{pattern})\z")


def salted(c: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")


#: The name under which a value of each type stands in its JSON object.
JSON_KEYS = {
    "string": "string", "text": "string", "int": "int", "double": "double", "timestamp": "date", "bytes": "bytes", "reference": "reference",
    "stringList": "strings", "intList": "ints", "doubleList": "doubles", "timestampList": "dates", "referenceList": "references", "bytesList": "blobs",
}


def value_json(c: Column, kind: FieldType) -> Column:
    """A value as a JSON object of one key; dates are milliseconds, bytes base64."""
    if kind is FieldType.TIMESTAMP:
        c = epoch_millis(c)
    elif kind is FieldType.TIMESTAMP_LIST:
        c = F.transform(c, epoch_millis)
    return F.when(c.isNotNull(), F.to_json(F.struct(c.alias(JSON_KEYS[kind.label]))))


def from_value_json(c: Column, kind: FieldType) -> Column:
    """The value of such an object; null where it holds a value of another type."""
    key = JSON_KEYS[kind.label]
    stored = {"timestamp": "bigint", "timestampList": "array<bigint>"}.get(kind.label, kind.spark.simpleString())
    value = F.from_json(c, f"`{key}` {stored}")[key]
    if kind is FieldType.TIMESTAMP:
        return F.timestamp_millis(value)
    if kind is FieldType.TIMESTAMP_LIST:
        return F.transform(value, F.timestamp_millis)
    return value


def digest(*parts: Column) -> Column:
    """SHA-256, in hexadecimal, of the parts joined by |, with | and \\ escaped in each."""
    escaped = [F.replace(F.replace(p, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")) for p in parts]
    return F.sha2(F.concat_ws("|", *escaped).cast("binary"), 256)
