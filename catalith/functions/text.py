"""Column functions over names and free text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as scripts understand it: ASCII, no-break, ogham, the U+2000 range, separators, ideographic, byte-order mark.
SPACES = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"

# fixed values: characters folded to plain ones when text is cleaned, by group
SINGLE_QUOTES = "\u2018\u2019\u201A\u201B\u2032"
DOUBLE_QUOTES = "\u201C\u201D\u201E\u201F\u2033\u00AB\u00BB"
LONG_DASHES = "\u2014\u2015"
DASHES = "\u2010\u2011\u2013\u2212"
ELLIPSIS = "\u2026"
LINE_ENDS = "\u2028\u2029"
WIDE_SPACES = "\u00A0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200A\u202F\u205F\u3000"
NO_WIDTH = "\u200B\u200C\u200D\uFEFF\u00AD\u200E\u200F"
#: A backslash before one of the signs that markdown gives a meaning.
ESCAPED = r"\\([*_~`\[\]()#+\-!.>])"
#: Letters that canonical decomposition turns into one plain character and marks, and that character; made by rule.
_LETTERS = [(chr(c), base) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)] if len(base := "".join(x for x in unicodedata.normalize("NFD", chr(c)) if not unicodedata.combining(x))) == 1 and base != chr(c)]
ACCENTED, PLAIN = "".join(a for a, _ in _LETTERS), "".join(b for _, b in _LETTERS)
MARKS = "[\u0300-\u036F]"

# fixed values: marketing terms of product names; some count anywhere, the others at the end only
SIZE_TERMS = ["27-inch", "32-inch", "34-inch", "39-inch", "49-inch", "55-inch"]
YEAR_TERMS = ["2020", "2021", "2022", "2023", "2024", "2025"]
PANEL_WORDS = ["Panel"]
PANEL_TERMS = ["QD-OLED", "QDOLED", "WOLED", "OLED", "IPS", "VA", "TN", "Mini-LED", "MiniLED", "Micro-LED", "MicroLED"]
FEATURE_TERMS = ["HDR", "HDR10", "HDR400", "HDR600", "HDR1000", "Dolby Vision", "FreeSync", "G-Sync", "NVIDIA G-Sync", "AMD FreeSync"]
GENERATION_TERMS = ["EVO", "Gen 2", "Gen2", "V2", "Edition"]
DESCRIPTOR_TERMS = ["Gaming", "Ultra", "Pro", "Plus"]


def _any_of(terms: list[str]) -> str:
    """A pattern of the terms, longer ones first."""
    return "|".join(sorted(terms, key=lambda t: (-len(t), t)))


ANYWHERE, AT_END = SIZE_TERMS + YEAR_TERMS + PANEL_WORDS, PANEL_TERMS + FEATURE_TERMS + GENERATION_TERMS + DESCRIPTOR_TERMS
#: What is replaced in a name, in this order: pattern and replacement.
NAME_STEPS = [
    (r"[()\[\]]", " "), (r"\s+", " "), (r"^ | $", ""),
    (rf"(?i)\b({_any_of(ANYWHERE)})\b", " "), (r"\s+", " "), (r"^ | $", ""),
    (rf"(?i)(\s+({_any_of(AT_END + ANYWHERE)}))+$", ""),
    (rf"(?i)-\s*({_any_of([t for t in AT_END if '-' in t])})$", ""), (rf"(?i)(-\s*({_any_of([t for t in AT_END if '-' not in t])}))+$", ""),
    (r"^-+|-+$", ""), (r"^_+|_+$", ""), (r"--+", "-"), (r"\s+", " "), (r"^ | $", ""),
]
#: Words that a spec value may have without their meaning anything for a comparison.
SPEC_UNITS = r"(?i)\b(variant|version|model|inch|mm|gb|hz|nits?)\b"


@F.pandas_udf(StringType())
def nfc(x: pd.Series) -> pd.Series:
    """Canonical composition, for which Spark has no function of its own."""
    return x.str.normalize("NFC")


def clean_name(x: Column) -> Column:
    """A product name without brackets and marketing terms: sizes and years anywhere, panels, features and the like at the end. Null is empty."""
    x = F.coalesce(x, F.lit(""))
    for pattern, new in NAME_STEPS:
        x = F.regexp_replace(x, pattern, new)
    return x


def tidy_name(x: Column) -> Column:
    """Brackets become blanks, runs of white space one blank, none at the ends. Null is empty."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"[()\[\]]", " "), r"\s+", " "))


def substantive(quote: Column) -> Column:
    """Whether a quote has at least ten characters without the white space around it."""
    return F.coalesce(F.length(trimmed(quote)) >= 10, F.lit(False))


def spec_value(x: Column) -> Column:
    """A spec value for comparison: lower case, without unit words and inch marks, hyphens as blanks."""
    x = F.translate(F.regexp_replace(F.lower(x), SPEC_UNITS, ""), '-"', " ")
    return F.regexp_replace(F.trim(x), r"\s+", " ")


def numeric_only(x: Column) -> Column:
    """Whether a text is a number with signs and grouping, which needs no translation."""
    return F.coalesce(x.rlike(r"^[-+]?[\d\s.,]+$") & x.rlike(r"\d"), F.lit(False))


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, f"^{SPACES}+|{SPACES}+$", "")


def normalised(x: Column) -> Column:
    """Lower case, one space for each run of white space, trimmed."""
    return trimmed(F.regexp_replace(F.lower(x), f"{SPACES}+", " "))


def sanitised(x: Column) -> Column:
    """Plain characters for typographic ones: quotes and short dashes to one character, long dashes to two hyphens, the ellipsis to three dots, separators of lines and paragraphs to line ends, wide spaces to
    spaces; characters without width go, and so does one backslash before a sign of markdown. Outer white space and everything else stay; null gives an empty text.

    Expects composed text, see nfc().
    """
    x = F.translate(F.coalesce(x, F.lit("")), SINGLE_QUOTES + DASHES + LINE_ENDS + WIDE_SPACES, "'" * len(SINGLE_QUOTES) + "-" * len(DASHES) + "\n" * len(LINE_ENDS) + " " * len(WIDE_SPACES))
    x = F.translate(F.translate(x, DOUBLE_QUOTES, '"' * len(DOUBLE_QUOTES)), NO_WIDTH, "")
    x = F.regexp_replace(F.regexp_replace(x, f"[{LONG_DASHES}]", "--"), ELLIPSIS, "...")
    return F.regexp_replace(x, ESCAPED, "$1")


def model_name(x: Column) -> Column:
    """Joins letters and digits that a space parts: `MPG 341` and `341 Q` lose it."""
    joined = F.regexp_replace(x, rf"([A-Za-z]){SPACES}+(?=[0-9])", "$1")
    return F.regexp_replace(joined, rf"([0-9]){SPACES}+(?=[A-Za-z])", "$1")


def slug(x: Column, fallback: Column | None = None) -> Column:
    """Lower case without accents, words joined by hyphens; empty ones take the last six characters of fallback."""
    s = F.regexp_replace(F.lower(F.translate(F.regexp_replace(x, MARKS, ""), ACCENTED, PLAIN)), "[^a-z0-9]+", "-")
    s = F.regexp_replace(s, "^-+|-+$", "")
    return s if fallback is None else F.when(s == "", F.right(fallback, F.lit(6))).otherwise(s)


def digit_words(name: Column, brand: Column) -> Column:
    """Normal form for identity: without the brand before it, the words that hold a digit; without any, the longest word."""
    rest = F.when(F.lower(name).startswith(F.concat(F.lower(brand), F.lit(" "))), F.substring(name, F.length(brand) + 2, F.length(name))).otherwise(name)
    words = F.filter(F.split(trimmed(rest), f"{SPACES}+"), lambda w: w != "")
    plain = lambda w: F.regexp_replace(F.lower(w), "[^a-z0-9]", "")
    digits = F.filter(F.transform(words, plain), lambda w: w.rlike("[0-9]"))
    longest = F.aggregate(words, F.lit(""), lambda best, w: F.when(F.length(w) > F.length(best), w).otherwise(best))
    return F.when(F.size(digits) > 0, F.array_join(digits, " ")).otherwise(plain(longest))


def basic(x: Column) -> Column:
    """Keeps a-z, digits, spaces and hyphens, and joins letter and digit groups that a space parts."""
    kept = F.regexp_replace(F.lower(x), r"[^a-z0-9 -]+", " ")
    return F.trim(model_name(F.regexp_replace(kept, " +", " ")))


def without_brand(x: Column, brand: Column) -> Column:
    """x without the brand at its start, whatever the case."""
    return F.when(F.lower(x).startswith(F.lower(brand)), F.trim(F.substring(x, F.length(brand) + 1, F.length(x)))).otherwise(x)


def tokens(x: Column) -> Column:
    """Runs of letters or of digits."""
    return F.regexp_extract_all(F.lower(x), F.lit("([a-z]+|[0-9]+)"), F.lit(1))


def critical_alphas(x: Column) -> Column:
    """Letter tokens right before a digit token."""
    return F.transform(F.filter(F.transform(tokens(x), lambda t, i: F.struct(t.alias("t"), F.get(tokens(x), i + 1).alias("n"))), lambda s: s["t"].rlike("^[a-z]+$") & s["n"].rlike("^[0-9]+$")), lambda s: s["t"])


def suffix_alphas(x: Column) -> Column:
    """Letter tokens after the first digit token."""
    first = F.aggregate(F.transform(tokens(x), lambda t, i: F.when(t.rlike("^[0-9]+$"), i)), F.lit(None).cast("int"), lambda a, i: F.coalesce(a, i))
    return F.filter(F.transform(tokens(x), lambda t, i: F.when((i > first) & t.rlike("^[a-z]+$"), t)), lambda t: t.isNotNull())


def token_weight(token: Column, rules: list[tuple[str, float]]) -> Column:
    """The greatest weight of the rules whose pattern is in the token; 1 without any."""
    hits = [F.when(token.rlike(p), F.lit(float(w))).otherwise(0.0) for p, w in rules]
    return F.coalesce(F.nullif(F.greatest(F.lit(0.0), F.lit(0.0), *hits), F.lit(0.0)), F.lit(1.0))


def edit_ratio(a: Column, b: Column) -> Column:
    """1 for equal strings, 0 if every character differs."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def word_jaccard(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(F.split(normalised(a), " ")), F.array_distinct(F.split(normalised(b), " "))
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def without_links(x: Column) -> Column:
    """[label](target) becomes label; images go."""
    return F.regexp_replace(F.regexp_replace(x, r"!\[[^\]]*\]\([^)]*\)", ""), r"\[([^\]]*)\]\([^)]*\)", "$1")


def without_punctuation(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))


def in_source(quote: Column, source: Column) -> Column:
    """Whether the source bears the quote out: as it stands, for up to three words by each word, for more without punctuation."""
    q, s = normalised(quote), normalised(source)
    words = F.split(q, " ")
    loose = F.contains(without_punctuation(s), without_punctuation(q))
    return F.contains(s, q) | ((F.size(words) <= 3) & F.forall(words, lambda w: F.contains(s, w))) | ((F.size(words) >= 4) & loose)


def domain(url: Column) -> Column:
    """Host of a URL without a leading www."""
    return F.regexp_replace(F.lower(F.parse_url(url, F.lit("HOST"))), r"^www\.", "")


def url_key(url: Column) -> Column:
    """How URLs are compared: lower case, no slashes at the end."""
    return F.regexp_replace(F.lower(url), "/+$", "")


def numbers(x: Column) -> Column:
    """The numbers in a text, as strings."""
    return F.regexp_extract_all(x, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))


def numbers_meet(a: Column, b: Column) -> Column:
    """Whether the texts share a run of digits, or neither has one."""
    x, y = (F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1)) for c in (a, b))
    return F.arrays_overlap(x, y) | ((F.size(x) == 0) & (F.size(y) == 0))


def first_number(x: Column) -> Column:
    return F.get(numbers(x), F.lit(0)).try_cast("double")


def standalone_number(x: Column) -> Column:
    """The number of a text that holds exactly one run of digits, else null."""
    return F.when(F.size(numbers(x)) == 1, first_number(x))


def within_tolerance(a: Column, b: Column, share: float = 0.05) -> Column:
    """Equal, or apart by at most that share of the greater."""
    return (a == b) | (F.abs(a - b) <= share * F.greatest(F.abs(a), F.abs(b)))


def start_case(key: Column) -> Column:
    """Label of an undeclared key: camel case, snake case and kebab case become words with capitals."""
    return F.initcap(F.trim(F.regexp_replace(F.regexp_replace(key, "([a-z0-9])([A-Z])", "$1 $2"), r"[_\-\s]+", " ")))


def to_boolean(x: Column) -> Column:
    low = F.lower(F.trim(x))
    return F.when(low.isin("true", "yes", "y", "1"), True).when(low.isin("false", "no", "n", "0"), False)


def affiliate(url: Column, key: str, tag: str) -> Column:
    """url with key=tag added, unless it has the key."""
    return F.when(F.contains(url, F.lit(f"{key}=")), url).otherwise(F.concat(url, F.when(F.contains(url, F.lit("?")), "&").otherwise("?"), F.lit(f"{key}={tag}")))


def backoff_minutes(attempts: Column) -> Column:
    return F.least(F.pow(F.lit(2), attempts), F.lit(60.0))
