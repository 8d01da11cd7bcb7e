"""Text scalars: normalisers, keys, amounts, percentages, durations, labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number words that durations may be written with.
NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6,
    "seven": 7, "eight": 8, "nine": 9, "ten": 10, "twelve": 12,
}
# Names of loan purposes by family.
PURPOSE_FAMILIES = {
    "business": ["business", "self employment", "selfemployment", "agriculture", "enterprise", "micro", "term loan", "micro finance"],
    "education": ["education", "educational", "educational loan", "study", "studies"],
}
# Cues inside longer purpose texts, the first family that has one wins.
PURPOSE_CUES = {
    "education": ["education", "educational", "study"],
    "business": ["business", "self employment", "agriculture", "enterprise", "micro", "term loan"],
}
KEY_LENGTH = 480


# First digits of scripts that the pages are written in; a number in any of them counts.
DIGIT_ZEROS = [0x0660, 0x06F0, 0x0966, 0x09E6, 0x0A66, 0x0AE6, 0x0B66, 0x0BE6, 0x0C66, 0x0CE6, 0x0D66, 0xFF10]


def ascii_digits(text: Column) -> Column:
    """Decimal digits of other scripts as 0 to 9."""
    return F.translate(text, "".join(chr(z + i) for z in DIGIT_ZEROS for i in range(10)), "0123456789" * len(DIGIT_ZEROS))


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null where nothing matches."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def first_of(text: Column, patterns: list[str]) -> Column:
    """The first pattern with a match decides."""
    return F.coalesce(*(extract(text, p) for p in patterns))


def any_of(text: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(n) for n in needles))


def squeezed(text: Column) -> Column:
    """All white space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def canonical_key(name: Column) -> Column:
    dashed = F.regexp_replace(F.lower(squeezed(name)), r"[^a-z0-9ऀ-ॿ]+", "-")
    return F.substring(F.btrim(dashed, F.lit("-")), 1, KEY_LENGTH)


def entity_key(key: Column) -> Column:
    """Stable key without the gender words that titles gain and lose.

    One pass takes every other neighbouring word, and what it joins can make a new one ("for" and "women"), so the pass
    is made as often as keys of this kind can need.
    """
    out = F.lower(F.trim(F.coalesce(key, F.lit(""))))
    for _ in range(4):
        out = F.regexp_replace(out, r"(?:^|-)(?:men|women|male|female|for-women|for-men)(?:-|$)", "-")
    return F.btrim(F.regexp_replace(out, "-+", "-"), F.lit("-"))


def purpose_family(value: Column) -> Column:
    """business, education, or the cleaned text itself."""
    text = squeezed(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[_-]", " "))
    compact = F.replace(text, F.lit(" "))
    out = F.when(F.lit(False), "")
    for family, names in PURPOSE_FAMILIES.items():
        out = out.when(text.isin(names) | compact.isin([n.replace(" ", "") for n in names]), family)
    for family, cues in PURPOSE_CUES.items():
        out = out.when(any_of(text, cues), family)
    return out.otherwise(text)


def indian_amount(text: Column) -> Column:
    """Rupees of the first number: lakh and crore count, commas and currency signs don't."""
    t = F.lower(ascii_digits(squeezed(text)))
    for sign in (",", "₹", "rs.", "rs", "inr"):
        t = F.replace(t, F.lit(sign))
    number = r"([0-9.]+)"

    def scaled(pattern: str, by: int) -> Column:
        return extract(t, pattern).try_cast("double") * by

    return F.coalesce(
        scaled(number + r"\s*(?:lakh|lac|lakhs|लाख)", 100_000), scaled(number + r"\s*(?:crore|करोड़)", 10_000_000), scaled(number, 1)
    )


def percent(text: Column) -> Column:
    t = ascii_digits(squeezed(text))
    return first_of(t, [r"([0-9.]+)\s*%", r"(?i)([0-9.]+)\s*percent"]).try_cast("double")


def months(text: Column) -> Column:
    """Months of a duration; number words go first, a bare number counts months."""
    t = F.lower(ascii_digits(squeezed(text)))
    out = F.when(F.lit(False), 0)
    for word, n in NUMBER_WORDS.items():
        out = out.when(t.rlike(rf"\b{word}\s*years?\b"), n * 12).when(t.rlike(rf"\b{word}\s*months?\b"), n)
    years, some = extract(t, r"([0-9]+)\s*(?:years?|वर्ष|साल)"), extract(t, r"([0-9]+)\s*(?:months?|महीने|माह)")
    digits = F.coalesce(years.try_cast("int") * 12, some.try_cast("int"), extract(t, r"([0-9]+)").try_cast("int"))
    return out.otherwise(digits)


def field_after(text: Column, label: str) -> Column:
    """The rest of the line after `label:`, else the next line after the label."""
    return F.coalesce(
        F.nullif(squeezed(extract(text, rf"(?i){label}\s*:\s*([^\n]+)")), F.lit("")),
        F.nullif(squeezed(extract(text, rf"(?i){label}\s*\n\s*([^\n]+)")), F.lit("")),
    )


def has_word(text: Column, original: Column, word: str) -> Column:
    """Short ASCII words only between other characters, so `st` isn't found in `start`; longer ones anywhere."""
    if len(word) <= 3 and word.isascii():
        return text.rlike(rf"(?i)(?<![a-z0-9]){word}(?![a-z0-9])")
    return text.contains(word) | original.contains(word)


def first_label(text: Column, original: Column, labels: dict[str, list[str]]) -> Column:
    """The first label of which some word occurs."""
    out = F.when(F.lit(False), "")
    for label, found in labels.items():
        out = out.when(reduce(lambda a, b: a | b, (has_word(text, original, w) for w in found)), label)
    return out


def rupees(amount: Column) -> Column:
    """₹1,234 with half-even rounding."""
    return F.concat(F.lit("₹"), F.format_number(amount, 0))


def rupees_whole(amount: Column) -> Column:
    """₹1,234 with the fraction cut off."""
    return F.concat(F.lit("₹"), F.format_number(amount.cast("bigint"), 0))


def indian_grouping(amount: Column) -> Column:
    """12,34,567: three digits, then pairs."""
    digits = F.floor(amount).cast("string")
    front = F.substr(digits, F.lit(1), F.length(digits) - 3)
    pairs = F.regexp_replace(front, r"(?<=\d)(?=(?:\d\d)+$)", ",")
    return F.when(F.length(digits) <= 3, digits).otherwise(F.concat(pairs, F.lit(","), F.substr(digits, F.length(digits) - 2)))


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def path(url: Column) -> Column:
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))


def language(code: Column) -> Column:
    return F.when(F.lower(F.coalesce(code, F.lit(""))).startswith("hi"), "hi").otherwise("en")


def filled(template: str, **values: Column) -> Column:
    """A template with every {name} replaced."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out
