"""Text expressions: missing tokens, match keys, place queries, administrative names."""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Callable, Iterable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import tokens as T

# \s in Java is ASCII unless (?U); the control separators complete the Unicode set.
_WS = r"(?U)[\s\x1c-\x1f]+"
_EDGE_WS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value written and evaluated once, however often body uses it.

    Filters on a computed column are pushed below the projection by inlining it; without
    this, nested expressions that repeat their input grow exponentially.
    """
    return F.get(F.transform(F.array(value), body), 0)


def once(df: DataFrame, out: str, value: Column) -> DataFrame:
    """df with the column `out`, evaluated once per row whatever later steps make of it.

    A column of a projection is inlined into filters, and each field that is read of a parsed
    text becomes a parse of its own; neither passes a generator.
    """
    return df.select("*", F.explode(F.array(value)).alias(out))


def strip(c: Column | str) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(_col(c), _EDGE_WS, "")


def squash(c: Column | str) -> Column:
    """Trim and collapse white space to single blanks."""
    return F.btrim(F.regexp_replace(_col(c), _WS, " "))


def null_tokens(
    c: Column | str,
    tokens: Iterable[str],
    keep: Iterable[str] = (),
    fold: bool = True,
    collapse: bool = False,
) -> Column:
    """Null for cells whose trimmed text is a missing token, else the trimmed text."""
    words = [t for t in tokens if t not in set(keep)]

    def kept(text: Column) -> Column:
        probe = F.lower(text) if fold else text
        return F.when(~probe.isin(words), text)

    # collapsing scans the whole text, so its result is bound once
    return let(squash(c), kept) if collapse else kept(strip(c))


def has_text(c: Column | str, tokens: Iterable[str], keep: Iterable[str] = ()) -> Column:
    return null_tokens(c, tokens, keep).isNotNull()


def match_text(c: Column | str) -> Column:
    """Join key: missing becomes empty, white space collapsed, lower case."""
    return F.lower(squash(F.coalesce(_col(c), F.lit(""))))


@cache
def _letter_maps() -> tuple[dict[str, str], dict[str, str]]:
    """What single characters become, other than themselves: (ASCII look, folded key text).

    Both follow from the Unicode tables character by character. The first map has characters
    whose compatibility form is ASCII; the second has case, accents, ligatures and compatibility
    forms resolved, with combining marks deleted and everything but [a-z0-9&] as blanks.
    """
    look, fold = {}, {}
    for cp in (*range(0xD800), *range(0xE000, sys.maxunicode + 1)):
        c = chr(cp)
        whole = unicodedata.normalize("NFKD", c)
        plain = "".join(x for x in whole if not unicodedata.combining(x)).casefold()
        words = re.sub("[^a-z0-9&]+", " ", plain)
        if words != c and (not plain or words.strip()):
            fold[c] = words
        if cp > 127 and (form := unicodedata.normalize("NFKC", c)).isascii():
            look[c] = form
    return look, fold


def _rewrite(text: Column, chars: dict[str, str]) -> Column:
    """Text with characters replaced: by one character or none, or by several."""
    many = {c: to for c, to in chars.items() if len(to) > 1}
    one = {c: to for c, to in chars.items() if len(to) == 1}
    gone = [c for c, to in chars.items() if not to]
    table = F.from_json(F.lit(json.dumps(many)), "map<string,string>")  # a constant
    spelled = F.array_join(
        F.transform(
            F.split(text, ""),
            lambda c: F.when(F.ascii(c) < 128, c).otherwise(F.coalesce(F.try_element_at(table, c), c)),
        ), "",
    )
    # translate looks characters up in a hash table, a large character class tries them in turn
    opened = F.when(F.translate(text, "".join(many), "") != text, spelled).otherwise(text)
    return F.translate(opened, "".join(one) + "".join(gone), "".join(one.values()))


def _beyond_ascii(text: Column, there: Column, else_: Column) -> Column:
    return F.when(text.rlike(r"[^\x00-\x7f]"), there).otherwise(else_)


def on_distinct(df: DataFrame, col: str, out: str, fn: Callable[[str], Column]) -> DataFrame:
    """Add fn(col), worked out once per distinct text and joined back.

    Worth it for costly expressions over texts that repeat a lot; fn never sees nulls.
    """
    texts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    return df.join(texts.select(col, fn(col).alias(out)), col, "left")


def fold_key(
    df: DataFrame, col: str, out: str, tokens: Iterable[str] = T.ADMIN
) -> DataFrame:
    """Accent-insensitive key of a name column, empty for missing tokens in any width.

    Built-in expressions only: characters are replaced by tables, in texts that need it.
    """
    look, fold = _letter_maps()
    usual = let(F.col(col), lambda t: _beyond_ascii(t, _rewrite(t, look), t))

    def key(text: Column) -> Column:
        letters = _beyond_ascii(text, _rewrite(text, fold), F.lower(text))
        words = F.regexp_replace(F.replace(letters, F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " ")
        return F.btrim(words)

    folded = let(null_tokens(usual, tokens, collapse=True), key)
    return df.withColumn(out, F.coalesce(folded, F.lit("")))


def relaxed_key(
    c: Column | str,
    prefixes: Iterable[str] = T.ADMIN_PREFIXES,
    suffixes: Iterable[str] = T.ADMIN_SUFFIXES,
) -> Column:
    """Folded administrative name without leading or trailing type words, never empty.

    Compound suffixes ("autonomous region") lose only their last word, because the
    single word is matched first.
    """
    lead = "|".join(prefixes)
    tail = "|".join(suffixes)
    without_lead = F.regexp_replace(_col(c), f"^(?:(?:{lead}) )+(?=.)", "")
    return F.regexp_replace(without_lead, f"(?<=.)(?: (?:{tail}))+$", "")


def place_query(*cols: Column | str, tokens: Iterable[str] = T.QUERY) -> Column:
    """Comma-joined non-missing place parts, most precise first."""
    return F.concat_ws(", ", *[null_tokens(c, tokens) for c in cols])


# Abbreviations and the words written out for them.
ABBREVIATIONS = (
    ("Mt", "Mount"), ("Mtn", "Mountain"), ("Ck", "Creek"), ("Cr", "Creek"),
    ("Lk", "Lake"), ("R", "River"), ("Jct", "Junction"), ("Hwy", "Highway"),
    ("Rd", "Road"), ("Ft", "Fort"), ("Gt", "Great"), ("Nat", "National"),
    ("Parq", "Parque"), ("Prov", "Provincial"),
)

# Phrases that carry no place name, removed in this order.
_UNITS = r"\d+(\.\d+)?\s*(km|kilometres?|kilometers?|miles?|mile|mi)"
_COMPASS = "north|south|east|west|northeast|northwest|southeast|southwest"
_COMPASS_SHORT = "n|s|e|w|ne|nw|se|sw"
NOISE_PATTERNS = (
    r"\b(approx|approximately|ca\.?|circa|about)\b",
    rf"\b{_UNITS}\s*({_COMPASS}|{_COMPASS_SHORT})\s*(of|from)?\b",
    rf"\b{_UNITS}\b",
    rf"\b({_COMPASS})\s+(of|from|side of|side|towards|toward)\b",
    rf"\b({_COMPASS_SHORT})\s+(of|from)\b",
    r"\b(near|around|vicinity of|close to|along|beside|opposite|towards|toward|"
    r"upstream of|downstream of|mouth of|entrance|gate|parking area|car park|"
    r"visitor centre|visitor center|campground|campsite)\b",
    r"\b(light trap|malaise trap|bait trap|trap|transect|quadrat|subplot|"
    r"sampling site|sample site|sample|sampling|collection site)\b",
    r"\b(site|plot|station)\s*[A-Za-z]?\d+[A-Za-z\-]*\b",
)


def expand_abbreviations(c: Column | str) -> Column:
    out = _col(c)
    for short, full in ABBREVIATIONS:
        out = F.regexp_replace(out, rf"(?iU)\b{short}\.?\b", full)
    return out


def clean_place_query(c: Column | str) -> Column:
    """Place query with abbreviations expanded and collecting notes removed."""
    out = expand_abbreviations(F.coalesce(_col(c), F.lit("")))
    for pattern in NOISE_PATTERNS:
        out = F.regexp_replace(out, f"(?iU){pattern}", " ")
    out = F.regexp_replace(out, r"[;:/()\[\]{}]", " ")
    out = F.regexp_replace(out, r"(?U)\s*,\s*", ", ")
    out = F.regexp_replace(out, _WS, " ")
    out = F.regexp_replace(out, r"(?U)(,\s*)+", ", ")
    return F.btrim(out, F.lit(" ,.-"))


def audit_clean(df: DataFrame, raw: str, clean: str) -> DataFrame:
    """Lengths and flags of a cleaning step; an emptied query falls back to the raw text.

    A missing raw query reads as the text "nan" in the length column, as it does when a
    table of text is written out and measured.
    """
    empty = strip(clean) == ""
    return (
        df.withColumn("raw_query_length", F.length(F.coalesce(F.col(raw), F.lit("nan"))))
        .withColumn("clean_query_length", F.length(clean))
        .withColumn("clean_query_empty", empty)
        .withColumn("clean_query_changed", F.coalesce(F.col(raw) != F.col(clean), F.lit(True)))
        .withColumn(clean, F.when(empty, F.col(raw)).otherwise(F.col(clean)))
    )


def is_abbreviation(c: Column | str, max_len: int = 3) -> Column:
    return F.replace(_col(c), F.lit(" ")).rlike(f"^[A-Za-z]{{1,{max_len}}}$")


def admin_match_key(code: Column | str, name: Column | str) -> Column:
    return F.concat_ws(
        "|", F.coalesce(_col(code), F.lit("")), F.coalesce(_col(name), F.lit(""))
    )


def first_code(*cols: Column | str, pattern: str = "^[A-Z]{3}$") -> Column:
    """First column holding a code of the given shape, else empty."""
    codes = [F.upper(strip(c)) for c in cols]
    return F.coalesce(*[F.when(code.rlike(pattern), code) for code in codes], F.lit(""))


def map_values(c: Column | str, mapping: dict[str, str], default: str) -> Column:
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _col(c)), F.lit(default))


def parse_bool(
    c: Column | str, true_set: Iterable[str], false_set: Iterable[str] | None = None
) -> Column:
    """True for words of true_set. With a false_set, other words become null."""
    word = F.lower(strip(_col(c).cast("string")))
    yes = word.isin(list(true_set))
    if false_set is None:
        return F.coalesce(yes, F.lit(False))
    return F.when(yes, True).when(word.isin(list(false_set)), False)


def strict_bool(c: Column | str, true_set: Iterable[str], false_set: Iterable[str]) -> Column:
    """True or false by word, missing counts as false; any other word fails the job."""
    word = F.lower(strip(_col(c).cast("string")))
    unknown = F.raise_error(F.format_string("not a flag: '%s'", word)).cast("boolean")
    return (
        F.when(word.isNull(), False).when(word.isin(list(true_set)), True)
        .when(word.isin(list(false_set)), False).otherwise(unknown)
    )


# Region-label synonyms and labels that are not terrestrial regions.
LABEL_SYNONYMS = {
    "afrotropic": "Afrotropical", "afrotropical": "Afrotropical",
    "afrotropics": "Afrotropical", "australasia": "Australasian",
    "australasian": "Australasian", "indo malayan": "Indomalayan",
    "indo malaya": "Indomalayan", "indomalaya": "Indomalayan",
    "indomalayan": "Indomalayan", "nearctic": "Nearctic", "neotropic": "Neotropical",
    "neotropical": "Neotropical", "oceania": "Oceanian", "oceanian": "Oceanian",
    "palearctic": "Palearctic", "palaearctic": "Palearctic", "panamanian": "Panamanian",
}
NOT_TERRESTRIAL = (
    "marine", "ocean", "oceanic", "sea", "water", "freshwater", "unassigned",
    "unknown", "outside",
)


def canonical_label(
    c: Column | str,
    synonyms: dict[str, str] = LABEL_SYNONYMS,
    drop: Iterable[str] = NOT_TERRESTRIAL,
) -> Column:
    """Canonical region label; labels that are not terrestrial become null."""
    pairs = [F.lit(x) for item in synonyms.items() for x in item]

    def named(text: Column) -> Column:
        key = squash(F.regexp_replace(F.lower(text), r"[_\-]+", " "))
        # every letter that follows a non-letter starts a word
        words = F.regexp_replace(F.lower(text), r"(?U)(?<=[^\p{L}])(?=\p{L})", "\x00")
        titled = F.array_join(F.transform(F.split(words, "\x00"), lambda w: F.initcap(w)), "")
        known = F.try_element_at(F.create_map(*pairs), key)
        return F.when(~key.isin(list(drop)), F.coalesce(known, titled))

    return let(null_tokens(c, T.TRUTH, collapse=True), named)


def canonical_band(c: Column | str) -> Column:
    text = null_tokens(c, T.TRUTH, collapse=True)
    low = F.lower(text)
    return (
        F.when(low.startswith("high"), "High")
        .when(low.startswith("med"), "Medium")
        .when(low.startswith("low"), "Low")
        .otherwise(text)
    )
