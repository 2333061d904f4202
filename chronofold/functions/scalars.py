"""Scalar functions over columns, all without Python workers; 32-bit arithmetic wraps in folds over 64 bits."""

from __future__ import annotations

import re
import uuid
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


def event_type_alias(name: Column) -> Column:
    """PascalCase to snake_case, as event types are named."""
    spaced = F.regexp_replace(F.regexp_replace(name, r"(\P{Ll})(\P{Ll}\p{Ll})", "$1 $2"), r"(\p{Ll})(\P{Ll})", "$1 $2")
    return F.replace(F.lower(spaced), F.lit(" "), F.lit("_"))


def schema_version(name: Column, version: int) -> Column:
    return F.concat(name, F.lit(f"_v{version}")) if version > 1 else name


def capitalise(text: Column) -> Column:
    """First letters of words in upper case, the rest unchanged."""
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")


def camel_case(text: Column) -> Column:
    """Lowers the leading run of upper-case letters, keeping the last one if a lower-case letter follows."""
    run = F.regexp_extract(text, r"^(\p{Lu}+?)(?=$|\p{Lu}\p{Ll}|[^\p{Lu}])", 1)
    return F.concat(F.lower(run), F.substring(text, F.length(run) + 1, F.length(text)))


def elide(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def equals_ignore_case(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def contains_ignore_case(a: Column, b: Column) -> Column:
    return F.contains(F.lower(a), F.lower(b))


def starts_with_ignore_case(a: Column, b: Column) -> Column:
    return F.startswith(F.lower(a), F.lower(b))


def ends_with_ignore_case(a: Column, b: Column) -> Column:
    return F.endswith(F.lower(a), F.lower(b))


def replace_first(text: Column, find: str, put: str) -> Column:
    at = F.locate(find, text)
    return F.when(at > 0, F.overlay(text, F.lit(put), at, F.lit(len(find)))).otherwise(text)


def delimited(text: Column, mark: str = ",") -> Column:
    """Entries between marks, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, re.escape(mark)), lambda e: F.trim(e)), lambda e: e != "")


def lines(text: Column) -> Column:
    return F.split(text, "\r?\n")


def join(parts: Column, mark: str = ", ") -> Column:
    return F.array_join(parts, mark)


def text_hash(text: Column) -> Column:
    """MD5 of the UTF-8 bytes in lower-case hex."""
    return F.md5(text.cast("binary"))


def _wrap(n: int) -> int:
    n &= 0xFFFFFFFF
    return n - (1 << 32) if n >= 1 << 31 else n


def _utf16(text: str) -> list[int]:
    raw = text.encode("utf-16-le", "surrogatepass")
    return [raw[i] | raw[i + 1] << 8 for i in range(0, len(raw), 2)]


#: Start and factor of the paired hash.
PAIR_SEED, PAIR_FACTOR = 5381, 1566083941


def paired_hash(text: str, seed: int, stop_at_nul: bool) -> int:
    """Two interleaved times-33 hashes over UTF-16 units, combined by a fixed factor, in 32 bits."""
    units, seed = _utf16(text), seed % (1 << 32)
    if stop_at_nul and 0 in units:
        units = units[: units.index(0)]
    one = two = seed
    for i, unit in enumerate(units):
        if i % 2 == 0:
            one = (one << 5) + one & 0xFFFFFFFF ^ unit
        else:
            two = (two << 5) + two & 0xFFFFFFFF ^ unit
    return _wrap(one + two * PAIR_FACTOR)


def byte_hash(text: str) -> int:
    """31 h + b over the UTF-8 bytes, in 32 bits; the empty text gives 0."""
    h = 0
    for b in text.encode():
        h = 31 * h + b & 0xFFFFFFFF
    return _wrap(h)


def _paired(text: Column, seed: int, stop_at_nul: bool) -> Column:
    """``paired_hash`` without Python: a fold over the UTF-16 units, wrapped at every step."""
    digits = F.hex(F.encode(text, "UTF-16BE"))
    units = F.transform(F.sequence(F.lit(0), (F.length(digits) / 4).cast("int") - 1), lambda i: F.conv(F.substring(digits, i * 4 + 1, F.lit(4)), 16, 10).cast("long"))
    start = F.lit(seed % (1 << 32)).cast("long")
    zero = F.struct(start.alias("one"), start.alias("two"), F.lit(True).alias("even"), F.lit(True).alias("on"))

    def step(x: Column, unit: Column) -> Column:
        on = x["on"] & (unit != 0) if stop_at_nul else F.lit(True)
        turned = lambda h: F.pmod(h * 33, F.lit(1 << 32)).bitwiseXOR(unit)
        one, two = F.when(on & x["even"], turned(x["one"])).otherwise(x["one"]), F.when(on & ~x["even"], turned(x["two"])).otherwise(x["two"])
        return F.struct(one.alias("one"), two.alias("two"), (~x["even"]).alias("even"), on.alias("on"))

    def whole(x: Column) -> Column:
        n = F.pmod(x["one"] + F.pmod(x["two"] * PAIR_FACTOR, F.lit(1 << 32)), F.lit(1 << 32))
        return F.when(n >= 1 << 31, n - (1 << 32)).otherwise(n).cast("int")

    none = F.array().cast("array<bigint>")
    return F.when(text.isNotNull(), F.aggregate(F.when(F.length(text) > 0, units).otherwise(none), zero, step, whole))


def stable_hash(text: Column) -> Column:
    return _paired(text, PAIR_SEED, True)


def deterministic_hash(text: Column) -> Column:
    return _paired(text, (PAIR_SEED << 16) + PAIR_SEED, False)


def utf8_byte_hash(text: Column) -> Column:
    """``byte_hash`` without Python: a fold over the hex digits of the bytes, wrapped at every step."""
    digits = F.hex(text.cast("binary"))
    bytes_ = F.transform(F.sequence(F.lit(0), F.octet_length(text) - 1), lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))
    folded = F.aggregate(bytes_, F.lit(0).cast("long"), lambda h, b: F.pmod(h * 31 + b, F.lit(1 << 32)))
    return F.when(F.octet_length(text) == 0, F.lit(0)).otherwise(F.when(folded >= 1 << 31, folded - (1 << 32)).otherwise(folded).cast("int"))


def comb_guid(at: datetime, tail: uuid.UUID | None = None) -> str:
    """A guid whose first six bytes are the milliseconds since 1970, so ids sort by time."""
    ms = int(at.timestamp() * 1000)
    return str(uuid.UUID(bytes=ms.to_bytes(6, "big") + (tail or uuid.uuid4()).bytes[6:]))


def comb_timestamp(guid: Column) -> Column:
    """The time inside a comb guid."""
    ms = F.conv(F.substring(F.replace(guid, F.lit("-"), F.lit("")), 1, 12), 16, 10).cast("long")
    return F.timestamp_millis(ms)


def time_range_compare(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    """Before, After or Overlap; a null bound is open; ranges that only touch do not overlap."""
    return F.when(F.coalesce(a_to <= b_from, F.lit(False)), "Before").when(F.coalesce(a_from >= b_to, F.lit(False)), "After").otherwise("Overlap")


def time_range_merge(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> tuple[Column, Column]:
    """The hull of two ranges; open where either is."""
    return F.when(a_from.isNotNull() & b_from.isNotNull(), F.least(a_from, b_from)), F.when(a_to.isNotNull() & b_to.isNotNull(), F.greatest(a_to, b_to))


def longer_than(start: Column, end: Column, span: timedelta) -> Column:
    return F.coalesce(end - start > F.lit(span), F.lit(True))


#: Spellings of units and their seconds.
UNITS = {"s": 1, "sec": 1, "secs": 1, "second": 1, "seconds": 1, "m": 60, "min": 60, "mins": 60, "minute": 60, "minutes": 60, "h": 3600, "hour": 3600, "hours": 3600, "d": 86400, "day": 86400, "days": 86400, "ms": 0.001, "millisecond": 0.001, "milliseconds": 0.001}


def duration_seconds(text: Column) -> Column:
    """Seconds of ``30s``, ``5 minutes``, ``1:30`` or ``0130`` (hours and minutes); null if unreadable."""
    trimmed = F.trim(text)
    number = F.regexp_extract(trimmed, r"^(-?\d+(?:\.\d+)?)\s*([A-Za-z]+)$", 1)
    unit = F.lower(F.regexp_extract(trimmed, r"^(-?\d+(?:\.\d+)?)\s*([A-Za-z]+)$", 2))
    factor = F.element_at(F.create_map(*[F.lit(x) for pair in UNITS.items() for x in (pair[0], float(pair[1]))]), unit)
    clock = F.regexp_extract(trimmed, r"^(\d{1,2}):?(\d{2})$", 1).try_cast("int") * 3600 + F.regexp_extract(trimmed, r"^(\d{1,2}):?(\d{2})$", 2).try_cast("int") * 60
    return F.when(number != "", number.try_cast("double") * factor).otherwise(clock.cast("double"))


def relative_date(text: str, now: datetime | None = None) -> datetime:
    """``TODAY``, ``TODAY-3``, ``MONDAY 08:30`` (the next one), or an ISO 8601 time."""
    now = now or datetime.now(timezone.utc)
    upper = text.strip().upper()
    if m := re.fullmatch(r"TODAY(?:([+-])(\d+))?", upper):
        return datetime(now.year, now.month, now.day, tzinfo=now.tzinfo) + timedelta(days=int(m[2] or 0) * (-1 if m[1] == "-" else 1))
    days = ["MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY", "SUNDAY"]
    if (m := re.fullmatch(r"([A-Z]+)\s+(\d{1,2}):(\d{2})", upper)) and m[1] in days:
        start = datetime(now.year, now.month, now.day, tzinfo=now.tzinfo) + timedelta(days=(days.index(m[1]) - now.weekday()) % 7)
        return start + timedelta(hours=int(m[2]), minutes=int(m[3]))
    return datetime.fromisoformat(text)


def converted(text: Column, kind: str) -> Column:
    """A text as another type, null where it is none."""
    return text.try_cast(kind)


def first_index(values: Column, fits) -> Column:
    """Position from 0 of the first element that fits, else -1."""
    return F.coalesce(F.array_position(F.transform(values, lambda v: F.coalesce(fits(v), F.lit(False))), True), F.lit(0)).cast("int") - 1


def last_index(values: Column, fits) -> Column:
    back = first_index(F.reverse(values), fits)
    return F.when(back < 0, -1).otherwise(F.size(values) - 1 - back)


def tenant_style(tenant: Column, style: str, default: str = "*DEFAULT*") -> Column:
    """Tenant ids as they are, lower- or upper-cased; the default tenant never changes."""
    made = {"as_is": lambda c: c, "lower": F.lower, "upper": F.upper}[style](tenant)
    return F.when(tenant == default, tenant).otherwise(made)


def uri_matches(uri: Column, pattern: str) -> Column:
    """Same scheme and host (an empty host matches all), and the pattern's segments, of which ``*`` is any, begin the path's."""
    scheme, _, rest = pattern.partition("://")
    host, _, path = rest.partition("/")
    ok = F.lower(F.regexp_extract(uri, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)) == scheme.lower()
    if host:
        ok &= F.lower(F.regexp_extract(uri, r"^[^:]+://([^/?#]*)", 1)) == host.lower()
    segments = F.filter(F.split(F.regexp_extract(uri, r"^[^:]+://[^/?#]*([^?#]*)", 1), "/"), lambda s: s != "")
    for i, part in enumerate(p for p in path.split("/") if p):
        here = F.get(segments, F.lit(i))
        ok &= here.isNotNull() if part == "*" else F.coalesce(here == part, F.lit(False))
    return ok


def fill(values: Column, value: Column) -> Column:
    """Appends a value that is missing; what is repeated already stays."""
    return F.when(F.array_contains(values, value), values).otherwise(F.array_append(values, value))


def shared_types(types: Column, wanted: list[str]) -> Column:
    """The event types of an array that are among those wanted, sorted."""
    return F.array_sort(F.array_intersect(types, F.array(*map(F.lit, wanted)).cast("array<string>")))
