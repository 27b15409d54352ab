"""Numbers, prices, areas, floors and times out of text."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from riverbed.functions.text import DEFAULT, _text, numeral

_NUMERAL_CLASS = "[一二三四五六七八九十]"


def _plain(c) -> Column:
    wide = "０１２３４５６７８９，．"
    return F.replace(F.translate(_text(c), wide, "0123456789,."), F.lit(","), F.lit(""))


def first_number(c, signed: bool = False, zero_is_null: bool = False) -> Column:
    value = F.regexp_extract(_plain(c), ("-?" if signed else "") + r"\d+(?:\.\d+)?", 0).try_cast("double")
    return F.nullif(value, F.lit(0.0)) if zero_is_null else value


def compact(x: Column, digits: int = 6) -> Column:
    """A number with so many significant digits and no trailing zeros."""
    magnitude = F.floor(F.log10(F.greatest(F.abs(x), F.lit(1e-9)))).cast("int")
    scaled = F.round(x / F.pow(F.lit(10.0), magnitude - (digits - 1)), 0) * F.pow(F.lit(10.0), magnitude - (digits - 1))
    text = F.format_number(scaled, 6)
    return F.when(x.isNotNull(), F.regexp_replace(F.replace(text, F.lit(","), F.lit("")), r"\.?0+$", "")) if digits else text


def price_text(c, unit: str = "萬") -> Column:
    """Keeps a suffixed price; a bare number of 100000 or more is divided by 10000."""
    text, value = F.trim(_text(c)), first_number(c)
    kept = F.regexp_extract(text, rf"([0-9][0-9,]*(?:\.[0-9]+)?)\s*{unit}", 1)
    whole = F.when(value == F.floor(value), F.regexp_replace(F.format_number(value, 0), ",", ""))
    scaled = F.when(value >= 100000, compact(value / 10000)).otherwise(F.coalesce(whole, compact(value)))
    return F.when(kept != "", F.concat(kept, F.lit(unit))).when(value.isNotNull(), F.concat(scaled, F.lit(unit)))


def area_value(c, unit: str = "坪") -> Column:
    found = F.regexp_extract(_text(c), rf"([1-9]\d{{0,2}}(?:\.\d+)?)\s*{unit}", 1)
    return F.coalesce(F.nullif(found, F.lit("")).try_cast("double"), F.trim(_plain(c)).try_cast("double"))


def area_text(c, unit: str = "坪") -> Column:
    """An area as it is shown: the number before the unit as it stands, or the whole text as a number; else null."""
    text = _text(c)
    found = F.regexp_extract(text, rf"([1-9]\d{{0,2}}(?:\.\d+)?)\s*{unit}", 1)
    value = F.trim(text).try_cast("double")
    plain = F.when(value == 0, "0").otherwise(compact(value))
    return F.when(found != "", F.concat(found, F.lit(unit))).when(value.isNotNull(), F.concat(plain, F.lit(unit)))


def first_known(*columns: str) -> Column:
    """The first of the columns that has a value, as where a field goes by several names."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit(0)) for c in columns])


def card_price(c, low: float = 300, high: float = 100000, unit: str = "萬") -> Column:
    """The last price in range; digits before it that belong to no group are skipped, decimals dropped."""
    raw = F.regexp_extract_all(_text(c), F.lit(rf"([0-9]{{1,3}}(?:,[0-9]{{3}})+|[0-9]{{3,5}})(?:\.[0-9]+)?\s*{unit}"), F.lit(1))
    values = F.filter(F.transform(raw, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double")), lambda v: v.between(low, high))
    return F.try_element_at(values, F.lit(-1))


def card_area(c, unit: str = "坪") -> Column:
    return F.regexp_extract(_text(c), rf"([0-9]+(?:\.[0-9]+)?)\s*{unit}", 1).try_cast("double")


def effective_price(own: Column, members: Column) -> Column:
    """The smallest positive price among the members, else the own one."""
    return F.coalesce(F.array_min(F.filter(members, lambda p: p > 0)), own)


def first_present(own: Column, members: Column) -> Column:
    return F.coalesce(own, F.try_element_at(F.array_compact(members), F.lit(1)))


def delta(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def tolerance(a: Column, b: Column, least: float = 30.0, share: float = 0.02) -> Column:
    return F.greatest(F.lit(least), F.least(a, b) * share)


def banded(x: Column, bands, beyond=0, missing=0) -> Column:
    """Points of the first band ``(limit, points)`` with ``x <= limit``."""
    out = None
    for limit, points in bands:
        out = F.when(x <= limit, F.lit(points)) if out is None else out.when(x <= limit, F.lit(points))
    return F.coalesce(out.when(x.isNotNull(), F.lit(beyond)), F.lit(missing))


def floor_of(c) -> Column:
    """``N/M樓`` or ``a~b/M樓`` of a text: the first one whose floors don't exceed the total.

    Where the digits before it are glued to those of an area, as in ``20.241/5``, leading digits go until it fits.
    """
    text = F.translate(_text(c), "～－", "~-")
    raw = F.regexp_extract_all(text, F.lit(r"\d{1,3}(?:[~-]\d{1,2})?\s*/\s*\d{1,2}\s*樓"), F.lit(0))

    def fit(x: Column) -> Column:
        total = F.regexp_extract(x, r"/\s*(\d{1,2})", 1).try_cast("int")
        high = F.regexp_extract(x, r"[~-](\d{1,2})", 1)
        options = []
        for keep in (3, 2, 1):
            low = F.regexp_extract(x, rf"(\d{{1,{keep}}})(?=[~/\-\s])", 1)
            top = F.coalesce(F.nullif(high, F.lit("")), low).try_cast("int")
            good = (low.try_cast("int") >= 1) & (low.try_cast("int") <= total) & (top <= total)
            options.append(F.when(good, F.concat(low.try_cast("int").cast("string"), F.when(high != "", F.concat(F.lit("~"), high)).otherwise(""), F.lit("/"), total.cast("string"), F.lit("樓"))))
        return F.coalesce(*options)

    return F.try_element_at(F.array_compact(F.transform(raw, fit)), F.lit(1))


def floors_in(c, widest: int = 5) -> Column:
    """Floors that a text names: ``N/M樓`` (the total doesn't count), ranges up to ``widest``, ``N樓`` and Chinese numerals."""
    text = F.translate(_text(c), "～", "~")
    ints = lambda xs: F.filter(F.transform(xs, lambda x: x.try_cast("int")), lambda v: v.between(1, 99))
    of_total = ints(F.regexp_extract_all(text, F.lit(r"(\d{1,2})\s*/\s*\d{1,2}\s*樓"), F.lit(1)))
    ranges = F.regexp_extract_all(text, F.lit(r"(\d{1,2}~\d{1,2})\s*/"), F.lit(1))

    def expand(r: Column) -> Column:
        low, high = F.substring_index(r, "~", 1).try_cast("int"), F.substring_index(r, "~", -1).try_cast("int")
        return F.when((high >= low) & (high - low <= widest), F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    masked = F.regexp_replace(text, r"\d{1,2}\s*/\s*\d{1,2}\s*樓", " ")
    single = ints(F.regexp_extract_all(masked, F.lit(r"(?<!\d)(\d{1,2})\s*樓"), F.lit(1)))
    spelled = F.filter(F.transform(F.regexp_extract_all(masked, F.lit(f"({_NUMERAL_CLASS}{{1,3}})樓"), F.lit(1)), lambda x: numeral(x)), lambda v: v.isNotNull())
    return F.array_sort(F.array_distinct(F.concat(of_total, F.flatten(F.transform(ranges, expand)), single, spelled)))


def title_floors(c) -> Column:
    """Floors named by one numeral or number right before the word, as titles give them."""
    raw = F.regexp_extract_all(_text(c), F.lit(rf"({_NUMERAL_CLASS}|\d{{1,2}})樓"), F.lit(1))
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(raw, lambda x: F.coalesce(x.try_cast("int"), numeral(x))))))


def thousands(x: Column) -> Column:
    return F.format_number(x, 0)


def shortened(x: Column) -> Column:
    """A whole number without decimals, any other with one."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(F.round(x, 1).cast("string"))


def own_price(effective: Column, shown: Column) -> Column:
    """The effective price where there is one, else the number in the price shown (0 counts as none)."""
    return F.coalesce(effective.cast("double"), first_number(shown, zero_is_null=True))


def floor_relation(a: Column, b: Column) -> Column:
    known = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(known & F.arrays_overlap(a, b), F.lit("match")).when(known, F.lit("conflict")).otherwise(F.lit("unknown"))


def labelled_floor(c) -> Column:
    """Floor of a detail text: behind a label if there is one, else from separate labels of floor and total, else unlabelled."""
    text = _text(c)
    behind = floor_of(F.regexp_extract(text, r"(?:樓層|樓別)[^0-9]{0,8}(\d{1,2}(?:[~-]\d{1,2})?\s*/\s*\d{1,2}\s*樓)", 1))
    low, total = (F.regexp_extract(text, rf"{label}[^0-9]{{0,8}}(\d{{1,2}})", 1).try_cast("int") for label in ("所在樓", "總樓"))
    apart = F.when(low <= total, F.concat_ws("", low.cast("string"), F.lit("/"), total.cast("string"), F.lit("樓")))
    return F.coalesce(behind, apart, floor_of(text))


def room_hint(c) -> Column:
    raw = F.regexp_extract(_text(c), r"([1-9一二三四五六七八九])\s*房", 1)
    return F.coalesce(raw.try_cast("int"), F.try_element_at(F.create_map(*[F.lit(x) for p in DEFAULT.numerals.items() for x in p]), raw))


def floor_hint(c) -> Column:
    return F.regexp_extract(_text(c), r"(?<!\d)(\d{1,2})\s*樓", 1).try_cast("int")


# times


def to_unix(c) -> Column:
    """Seconds of an integer (milliseconds above 10^12), a decimal or an ISO text; else null. Without an offset ISO texts are UTC."""
    text = F.trim(_text(c))
    value = text.try_cast("double")
    seconds = F.when(value > 1e12, F.floor(value / 1000)).otherwise(F.floor(value))
    dated = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(text, F.lit("T00:00:00"))).when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:"), text)
    iso = F.unix_timestamp(F.try_to_timestamp(F.when(dated.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), dated).otherwise(F.concat(dated, F.lit("Z")))))
    return F.coalesce(seconds.cast("long"), iso)


def local_to_unix(c, zone: str) -> Column:
    return F.unix_timestamp(F.to_utc_timestamp(F.try_to_timestamp(_text(c), F.lit("yyyy-MM-dd HH:mm:ss")), zone))


def unix_to_iso(seconds: Column, zone: str) -> Column:
    return F.date_format(F.from_utc_timestamp(F.timestamp_seconds(seconds), zone), "yyyy-MM-dd'T'HH:mm:ss")


def age_minutes(captured: Column, as_of: Column) -> Column:
    return (F.unix_timestamp(as_of) - F.unix_timestamp(captured)) / 60


def recency(active: Column, new_at: Column, as_of: Column, days: int = 14) -> Column:
    fresh = (as_of >= new_at) & (as_of <= new_at + F.expr(f"interval {days} days"))
    return F.when(~F.coalesce(active, F.lit(True)), "removed").when(fresh, "new").otherwise("listed")


def published_rank(c) -> Column:
    return F.coalesce(c.try_cast("bigint"), F.lit(10**18))


def trusted_time(value: Column, kind: Column, source: Column, strict_sources, wanted: str = "publishTime") -> Column:
    """The time, unless its source only tells the truth for one kind of time and this is another."""
    return F.when(~source.isin(*strict_sources) | (kind == wanted), value)


# codes and addresses of pages


def derived_key(password: str, salt: bytes, rounds: int) -> tuple[bytes, bytes]:
    """A 256-bit key and an initial vector out of a password: its SHA-256, then PBKDF2 with SHA-1."""
    made = hashlib.pbkdf2_hmac("sha1", hashlib.sha256(password.encode()).digest(), salt, rounds, dklen=48)
    return made[:32], made[32:]


def encrypt_cbc(text: Column, key: Column, vector: Column | None = None) -> Column:
    """Base64 of the initial vector and the ciphertext; of the ciphertext alone if the vector is given."""
    if vector is None:
        return F.base64(F.aes_encrypt(text, key, F.lit("CBC"), F.lit("PKCS")))
    made = F.aes_encrypt(text, key, F.lit("CBC"), F.lit("PKCS"), vector)
    return F.base64(F.substring(made, 17, F.length(made)))


def decrypt_cbc(code: Column, key: Column, vector: Column | None = None) -> Column:
    """Of base64 of the initial vector and the ciphertext, or of the ciphertext alone; null where that can't be."""
    raw = F.try_to_binary(code, F.lit("base64"))
    raw = raw if vector is None else F.concat(vector, raw)
    return F.try_aes_decrypt(raw, key, F.lit("CBC"), F.lit("PKCS")).cast("string")


def is_cipher_text(code: Column) -> Column:
    raw = F.try_to_binary(code, F.lit("base64"))
    return F.coalesce((F.length(raw) > 0) & (F.length(raw) % 16 == 0), F.lit(False))


def absolute_url(c, base: str) -> Column:
    return F.when(F.startswith(_text(c), F.lit("/")), F.concat(F.lit(base.rstrip("/")), c)).otherwise(_text(c))


def merge_query(url: Column, changes: dict) -> Column:
    """The address with these parameters set, parameters in order of name."""
    query = F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit(""))
    old = F.when(query == "", F.create_map().cast("map<string,string>")).otherwise(F.str_to_map(query, F.lit("&"), F.lit("=")))
    kept = F.map_filter(old, lambda k, _: ~k.isin(*changes))
    new = F.map_concat(kept, F.create_map(*[x for k, v in changes.items() for x in (F.lit(k), F.url_encode(F.lit(str(v))))]))
    parts = F.array_sort(F.transform(F.map_entries(new), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return F.concat(F.substring_index(url, "?", 1), F.lit("?"), F.array_join(parts, "&"))


def id_of_url(c, pattern: str = r"/house/(\d+)") -> Column:
    return F.nullif(F.regexp_extract(_text(c), pattern, 1), F.lit(""))
