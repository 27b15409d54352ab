"""Text normalization, keys, tokens and dictionary features as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from riverbed.lexicon import Lexicon

DEFAULT = Lexicon()
#: White space as Unicode has it; Java's plain \s is ASCII only.
SPACES = r"[\s\x1c-\x1f\x85\xa0  -     　]+"
_HAN = r"一-鿿"
# Names of characters in HTML.
_ENTITIES = (
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&hellip;", "…"), ("&middot;", "·"), ("&bull;", "•"), ("&ndash;", "–"),
    ("&mdash;", "—"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&laquo;", "«"), ("&raquo;", "»"), ("&copy;", "©"), ("&reg;", "®"),
    ("&trade;", "™"), ("&deg;", "°"), ("&times;", "×"), ("&euro;", "€"), ("&pound;", "£"), ("&yen;", "¥"),
)


def _text(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit(""))


def replace_in_order(c, pairs) -> Column:
    """Each replacement works on what the one before it left."""
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, _text(c))


def collapse_spaces(c) -> Column:
    return F.trim(F.regexp_replace(_text(c), SPACES, " "))


def _numeric_entity(piece: Column) -> Column:
    """What stands behind ``&#`` with the number at its head resolved, in either base; as it was if there is none."""
    code = F.regexp_extract(piece, "^([xX][0-9a-fA-F]{1,6}|[0-9]{1,7});", 1)
    value = F.when(code.rlike("^[xX]"), F.conv(F.substring(code, 2, 6), 16, 10)).otherwise(code).try_cast("int")
    known = (value > 0) & (value < 0x110000) & ~value.between(0xD800, 0xDFFF)
    letter = F.when(value == 38, "&amp;").otherwise(F.decode(F.unhex(F.lpad(F.hex(value), 8, "0")), "UTF-32"))
    return F.when(known, F.concat(letter, F.substring(piece, F.length(code) + 2, F.length(piece)))).otherwise(F.concat(F.lit("&#"), piece))


def unescaped(c) -> Column:
    """HTML entities resolved: the usual names and all numbers. Ampersands come last, as what they make isn't read again."""
    pieces = F.split(replace_in_order(c, _ENTITIES), "&#")
    rest = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), _numeric_entity)
    return F.replace(F.concat(pieces[0], F.array_join(rest, "")), F.lit("&amp;"), F.lit("&"))


def normalize_text(c) -> Column:
    """Null to empty, HTML entities resolved, white space collapsed and trimmed."""
    return collapse_spaces(unescaped(c))


def fold_variants(c, aliases=DEFAULT.aliases) -> Column:
    return replace_in_order(F.translate(normalize_text(c), "臺", "台"), aliases)


def text_key(c) -> Column:
    """Lower case; only digits, a to z and Han characters stay."""
    return F.regexp_replace(F.lower(F.translate(_text(c), "臺", "台")), f"[^0-9a-z{_HAN}]+", "")


def han_key(c) -> Column:
    return F.regexp_replace(_text(c), f"[^0-9{_HAN}]+", "")


def match_key(c, aliases=DEFAULT.aliases) -> Column:
    folded = replace_in_order(F.translate(_text(c), "臺", "台"), aliases)
    return F.lower(F.regexp_replace(folded, f"[^0-9A-Za-z{_HAN}]", ""))


def canonical_terms(c, synonyms=DEFAULT.synonyms) -> Column:
    return replace_in_order(F.lower(F.translate(_text(c), "臺", "台")), synonyms)


def strip_badges(c, badges=DEFAULT.badges, repeatedly: bool = True) -> Column:
    pattern = "^(?:" + "|".join(map(re.escape, badges)) + ")" + "+" * repeatedly
    return F.trim(F.regexp_replace(_text(c), pattern, ""))


def prefix_name(c, lexicon: Lexicon = DEFAULT) -> Column:
    """What stands before the district, unless it is short or generic."""
    prefix = F.replace(F.substring_index(F.translate(F.lower(_text(c)), "臺", "台"), lexicon.district, 1), F.lit(lexicon.city), F.lit(""))
    key = han_key(prefix)
    return F.when((F.length(key) >= 2) & (~key.isin(*lexicon.generic) if lexicon.generic else F.lit(True)), key)


def numbered_address(c) -> Column:
    folded = F.translate(_text(c), "臺", "台")
    return F.when(F.contains(folded, F.lit("號")), han_key(folded))


def lane_address(c) -> Column:
    found = F.regexp_extract(F.translate(_text(c), "臺", "台"), rf"([{_HAN}]+路(?:[一二三四五六七八九十]|\d+)?段\d+巷(?:\d+弄)?)", 1)
    return F.nullif(han_key(found), F.lit(""))


def is_specific_address(c, lexicon: Lexicon = DEFAULT) -> Column:
    """A digit or a lane, alley or number; else four characters beyond the names of city, district and roads."""
    key = text_key(c)
    roads = [g for g in lexicon.generic if g.endswith(("路", "段", "街"))]
    rest = replace_in_order(key, [(name, "") for name in (lexicon.city, lexicon.district, *roads)])
    return key.rlike("[0-9巷弄號]") | (F.length(rest) >= 4)


def ngram_tokens(c, stopwords=DEFAULT.stopwords, sizes=(3, 4, 5)) -> Column:
    """Of each run of two Han characters or more: the run itself from three on, and its n-grams, without stopwords."""
    stop = F.array(*map(F.lit, stopwords)) if stopwords else F.array().cast("array<string>")
    runs = F.filter(F.regexp_extract_all(_text(c), F.lit(f"[{_HAN}]{{2,}}"), F.lit(0)), lambda r: ~F.array_contains(stop, r))
    none = F.array().cast("array<string>")

    def grams(run: Column, n: int) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.length(run) - (n - 1)), lambda i: F.substring(run, i, F.lit(n)))
        return F.when(F.length(run) >= n, cut).otherwise(none)

    whole = F.filter(runs, lambda r: F.length(r) >= 3)
    parts = F.flatten(F.transform(runs, lambda r: F.concat(*[grams(r, n) for n in sizes])))
    return F.array_distinct(F.concat(whole, F.array_except(parts, stop)))


def shared_tokens(a: Column, b: Column) -> Column:
    return F.array_intersect(a, b)


def longest(tokens: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(tokens, lambda t: F.length(t))), F.lit(0))


def top_tokens(tokens: Column, k: int = 6) -> Column:
    """The k longest, ties by text."""
    keyed = F.transform(tokens, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda s: s["t"])


def dictionary_features(c, lexicon: Lexicon = DEFAULT) -> Column:
    """Names of which any alias stands in the text. Aliases match inside longer words, as substrings do."""
    def of(text: Column) -> Column:
        tests = [F.when(reduce(lambda x, y: x | y, [F.contains(text, F.lit(a)) for a in aliases]), F.lit(name)) for name, aliases in lexicon.features.items()]
        return F.array_compact(F.array(*tests))

    return F.transform(F.array(canonical_terms(c, lexicon.synonyms)), of)[0]  # the text is made once, not for every alias


def shared_keywords(a, b, words) -> Column:
    return F.array_compact(F.array(*[F.when(F.contains(_text(a), F.lit(w)) & F.contains(_text(b), F.lit(w)), F.lit(w)) for w in words]))


def plausible_title(candidates: Column, reject: str = "[萬坪]", boilerplate=DEFAULT.buttons) -> Column:
    """Of a list of texts the one with the most Han characters (then the longest, then the last) that can be a title."""
    rich = lambda t: F.size(F.regexp_extract_all(t, F.lit(f"[{_HAN}]"), F.lit(0)))
    good = F.filter(candidates, lambda t: F.length(t).between(2, 60) & ~t.rlike(reject) & ~t.isin(*boilerplate) & (rich(t) >= 2))
    return F.array_max(F.transform(good, lambda t: F.struct(rich(t).alias("rich"), F.length(t).alias("n"), t.alias("t"))))["t"]


def title_before(c, place: str, otherwise: Column, longest: int = 60) -> Column:
    """What stands before the place's name in a card's text, without badges; ``otherwise`` if nothing does."""
    text = _text(c)
    head = F.when(F.instr(text, place) > 1, F.substring_index(text, place, 1))
    return F.coalesce(F.nullif(F.substring(strip_badges(F.trim(head)), 1, longest), F.lit("")), otherwise)


def numeral(c, numerals=None) -> Column:
    """A Chinese numeral up to 99 (with ten as a place) as an integer."""
    digits = F.create_map(*[F.lit(x) for p in (numerals or DEFAULT.numerals).items() for x in p])
    text = _text(c)
    tens, ones = F.substring_index(text, "十", 1), F.substring_index(text, "十", -1)
    at = lambda x: F.try_element_at(digits, x)
    place = F.when(tens == "", F.lit(1)).otherwise(at(tens)) * 10 + F.when(ones == "", F.lit(0)).otherwise(at(ones))
    return F.when(F.contains(text, F.lit("十")), place).otherwise(at(text))


def snippets(c, pattern: str, radius: int = 40) -> Column:
    """The matches of a pattern with up to ``radius`` characters on both sides."""
    return F.transform(F.regexp_extract_all(_text(c), F.lit(f"(?s).{{0,{radius}}}(?:{pattern}).{{0,{radius}}}"), F.lit(0)), lambda s: collapse_spaces(s))


def harvest(c, pattern: str, cap: int = 300) -> Column:
    """Distinct matches in order of first appearance, at most ``cap`` (a report's length)."""
    return F.slice(F.array_distinct(F.regexp_extract_all(_text(c), F.lit(pattern), F.lit(0))), 1, cap)


def truncated(c, n: int) -> Column:
    return F.substring(_text(c), 1, n)
