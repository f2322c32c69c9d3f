"""Scalar text and number functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word characters as Unicode has them; two or more make a token, from its first to its last one.
TOKEN = r"(?U)\w{2,}"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def spaced(text: Column) -> Column:
    """The words of a lower-case text with one space between them: those of tokens, and words of one letter."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\W+", " ")


def bigrams(words: Column) -> Column:
    """Neighbouring pairs. zip_with over two slices: an index lambda would tokenise again for every element."""
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(n > 1, pairs).otherwise(F.array().cast("array<string>"))


def parse_amount(text: Column) -> Column:
    """Decimal comma, blanks inside, blank is 0, what is no number is null."""
    bare = F.regexp_replace(text.cast("string"), "[  ]", "")
    return F.when(F.coalesce(bare, F.lit("")) == "", 0.0).otherwise(F.replace(bare, F.lit(","), F.lit(".")).try_cast("double"))


def parse_cell(text: Column, decimal: bool) -> Column:
    """A table cell: thousands dots and blanks go; with decimal a comma is the decimal mark, else it goes too."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), "[.  ]" if decimal else "[,.  ]", "")
    if decimal:
        return F.when(bare == "", 0.0).otherwise(F.replace(bare, F.lit(","), F.lit(".")).try_cast("double"))
    return F.when(bare == "", 0).otherwise(bare.try_cast("int"))


def whole_number(text: Column) -> Column:
    """An integer where the text is digits only, else null."""
    return F.when(text.cast("string").rlike(r"^\d+$"), text.try_cast("int"))


def title_tail(name: Column) -> Column:
    """All words but the first in title case; any non-letter starts a new word, as inside brackets."""
    first = F.substring_index(name, " ", 1)
    rest = F.lower(F.substr(name, F.length(first) + 1))
    letters = F.split(rest, "")
    turn = F.aggregate(
        letters,
        F.struct(F.lit("").alias("out"), F.lit(False).alias("inside")),
        lambda s, c: F.struct(
            F.concat(s["out"], F.when(s["inside"], c).otherwise(F.upper(c))).alias("out"), c.rlike(r"\p{L}").alias("inside")
        ),
    )
    return F.concat(first, F.when(F.length(rest) > 0, turn["out"]).otherwise(F.lit("")))


ROMAN = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]


def to_roman(n: Column) -> Column:
    parts, left = [], n
    for value, letters in ROMAN:
        parts.append(F.repeat(F.lit(letters), F.floor(left / value).cast("int")))
        left = left % value
    return F.concat(*parts)


def from_roman(text: Column) -> Column:
    """Each letter adds its value, or takes it away before a larger one."""
    value = F.create_map(*[F.lit(x) for v, s in ROMAN if len(s) == 1 for x in (s, v)])
    values = F.transform(F.filter(F.split(F.upper(text), ""), lambda c: c != ""), lambda c: value[c])
    after = F.concat(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.array(F.lit(0)))
    return F.aggregate(F.zip_with(values, after, lambda a, b: F.when(a < b, -a).otherwise(a)), F.lit(0), lambda s, x: s + x)


def roman_to_arabic_id(path: Column) -> Column:
    """A dotted id whose first part is Roman, with that part in digits."""
    head = F.substring_index(path, ".", 1)
    number = F.when(head.rlike("^[IVXLCDM]+$"), from_roman(head).cast("string")).otherwise(head)
    return F.concat(number, F.substr(path, F.length(head) + 1))


def page_title(page: Column) -> Column:
    """The lines of a title page without the first and the last; of two lines the first; of one that one."""
    lines = F.filter(F.transform(F.split(F.trim(page), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    n = F.size(lines)
    return F.when(n >= 3, F.array_join(F.slice(lines, F.lit(2), F.greatest(n - 2, F.lit(0))), " ")).when(n >= 1, lines[0]).otherwise("")


def safe_name(name: Column, style: str = "words") -> Column:
    """A file name. words: marks and runs of blanks become _; paths: only what paths forbid; chapters: that, blanks, and no _ at the ends."""
    forbidden = r'[<>:"/\\|?*]'
    if style == "words":
        return F.regexp_replace(F.regexp_replace(name, r"(?U)[^\w\s-]", "_"), r"\s+", "_")
    if style == "paths":
        return F.regexp_replace(name, forbidden, "_")
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, '"', ""), forbidden, "_"), r"\s+", "_")
    return F.regexp_replace(bare, "^_+|_+$", "")


def clean_name(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit("\n"), F.lit(" ")), F.lit("  "), F.lit(" "))


def clean_code(code: Column) -> Column:
    return F.trim(F.coalesce(F.regexp_replace(code, "^:+|:+$", ""), F.lit("")))


def bracketed(name: Column) -> Column:
    """What stands in the first brackets; null without."""
    found = F.regexp_extract(name, r"\((.*?)\)", 1)
    return F.when(name.rlike(r"\(.*?\)"), found)


def similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance / longer length; two empty texts are alike."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longer)


def even_round(x: Column, places: int = 0) -> Column:
    return F.bround(x, places)


def thousands(x: Column) -> Column:
    return F.format_number(x, 0)
