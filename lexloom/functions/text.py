"""Scalar text functions as Columns (TXT). All run inside code generation but those named ``*_exact``.

The plain ones fold, strip and count ASCII and the listed marks; the ``exact``
ones are Arrow UDFs with Unicode normalisation and classes.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Marks that are folded, stripped or allowed.
APOSTROPHES = "’‘ʼ′＇ʹ"
DASHES = "–—"
TRAILING_MARKS = ",.;:!?)]}»”"
ALLOWED_MARKS = "&/’'-–"
PLURAL_SUFFIXES = ("’s", "'s", "s")
VOWELS = "aeiou"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold_marks(c: Column | str) -> Column:
    """TXT-01 without compatibility normalisation: apostrophe and dash variants become ' and -."""
    return F.translate(_col(c), APOSTROPHES + DASHES, "'" * len(APOSTROPHES) + "-" * len(DASHES))


@F.pandas_udf(T.StringType())
def canonicalize_exact(s: pd.Series) -> pd.Series:
    """TXT-01: NFKC, then the folds."""
    table = str.maketrans(APOSTROPHES + DASHES, "'" * len(APOSTROPHES) + "-" * len(DASHES))
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).translate(table))


def collapse_spaces(c: Column | str) -> Column:
    """TXT-02: every run of white space is one space, none at the ends."""
    return F.btrim(F.regexp_replace(_col(c), "(?U)\\s+", " "))


def strip_trailing_marks(c: Column | str) -> Column:
    """TXT-03."""
    return F.regexp_replace(_col(c), "(?U)[,.;:!?)\\]}»”\\s]+$", "")


def acronym_key(c: Column | str, strip_dots: bool = True) -> Column:
    """TXT-04: folded, without dots, without spaces around connecting marks; case stays."""
    out = fold_marks(c)
    if strip_dots:
        out = F.replace(out, F.lit("."), F.lit(""))
    return F.regexp_replace(out, "(?U)\\s*([&/'’–-])\\s*", "$1")


def strip_plural(c: Column | str) -> Column:
    """TXT-05: a plural or possessive ending goes if the stem is upper case and has no dot."""
    c = _col(c)
    out = c
    for suffix in reversed(PLURAL_SUFFIXES):
        stem = F.substring(c, F.lit(1), F.greatest(F.length(c) - len(suffix), F.lit(0)))
        upper = stem.rlike("\\p{Lu}") & ~stem.rlike("[\\p{Ll}\\p{Lt}]")
        out = F.when(c.endswith(suffix), F.when(~stem.contains(".") & upper, stem).when(stem.contains("."), c).otherwise(out)).otherwise(out)
    return out


def surface_for_key(c: Column | str) -> Column:
    """TXT-06."""
    return strip_trailing_marks(strip_plural(c))


def normal_definition(c: Column | str) -> Column:
    """TXT-07 on text that needs no compatibility normalisation."""
    return strip_trailing_marks(collapse_spaces(fold_marks(c)))


def tighten_label(c: Column | str) -> Column:
    """TXT-08: a definition without leading connectors; its closing run of proper words if it has one, else what follows a copula."""
    base = normal_definition(c)
    connector = "(?i)^(?:while|whereas|and|or|but|that|which|who|as|for|to)\\b[\\s,:-]*"
    base = F.regexp_replace(F.regexp_replace(base, connector, ""), connector, "")
    proper = F.regexp_extract(base, "((?:[A-Z][A-Za-z0-9'’&-]*)(?:\\s+(?:of|and|the|for|to|in|on|with|&|[A-Z][A-Za-z0-9'’&-]*))*\\s+[A-Z][A-Za-z0-9'’&-]*)$", 1)
    plain = F.regexp_replace(base, "(?i)^(?:the|an|a)\\s+", "")
    rest = F.regexp_extract(plain, "(?i)^.*?\\s(?:stands for|means|is|are)\\s(.+)$", 1)
    return F.when(proper != "", proper).when(rest != "", F.btrim(rest)).otherwise(plain)


def term_key(c: Column | str) -> Column:
    """TXT-11: folded, unquoted, without marks, lower case, words joined by _."""
    out = F.btrim(F.btrim(fold_marks(c)), F.lit("\"'"))
    out = F.regexp_replace(out, "(?U)[^\\w\\s-]", "")
    out = F.replace(F.lower(collapse_spaces(out)), F.lit("-"), F.lit(" "))
    return F.regexp_replace(out, "(?U)\\s+", "_")


def structure_key(kind: Column | str, label: Column | str) -> Column:
    """TXT-12."""
    return F.concat_ws("_", F.lower(_col(kind)), F.replace(F.lower(F.btrim(_col(label))), F.lit("."), F.lit("_")))


def structure_kind(c: Column | str) -> Column:
    """TXT-13: the canonical kind, null for none of the seven."""
    kind = F.initcap(F.lower(F.btrim(_col(c))))
    return F.when(kind.isin("Schedule", "Section", "Clause", "Article", "Appendix", "Annex", "Exhibit"), kind)


_ROMAN = "(?i)^M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"


def is_roman(c: Column | str) -> Column:
    """TXT-14: a well-formed Roman number from 1 to 3999."""
    c = _col(c)
    return (F.length(c) > 0) & c.rlike(_ROMAN)


def roman_value(c: Column | str) -> Column:
    """TXT-14: a smaller numeral before a greater one counts against it."""
    digits = F.transform(F.filter(F.split(F.upper(_col(c)), ""), lambda x: x != ""), lambda x: F.element_at(F.create_map(*[F.lit(v) for pair in {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}.items() for v in pair]), x))
    state = F.struct(F.lit(0).alias("total"), F.lit(0).alias("right"))
    return F.aggregate(F.reverse(digits), state, lambda s, d: F.struct((s["total"] + F.when(d < s["right"], -d).otherwise(d)).alias("total"), F.greatest(s["right"], d).alias("right")), lambda s: s["total"])


def slug(c: Column | str, empty: str = "") -> Column:
    """TXT-15."""
    out = F.btrim(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(out == "", F.lit(empty)).otherwise(out) if empty else out


def letters(c: Column | str) -> Column:
    """TXT-16."""
    return F.regexp_replace(_col(c), "\\P{L}", "")


def caps_ratio(c: Column | str) -> Column:
    """TXT-16: upper-case letters by letters, 0 without letters."""
    only = letters(c)
    return F.when(F.length(only) == 0, F.lit(0.0)).otherwise(F.length(F.regexp_replace(only, "\\P{Lu}", "")) / F.length(only))


def core_length(c: Column | str) -> Column:
    """TXT-16: letters and digits."""
    return F.length(F.regexp_replace(_col(c), "[^\\p{L}\\p{Nd}]", ""))


def threshold_length(c: Column | str) -> Column:
    """TXT-16: at least 3 where a connecting mark or a dot is inside."""
    n = core_length(c)
    return F.when(_col(c).rlike("[&/’'–.-]"), F.greatest(F.lit(3), n)).otherwise(n)


def has_letter(c: Column | str) -> Column:
    """TXT-17."""
    return _col(c).rlike("\\p{L}")


def is_mixed_case(c: Column | str) -> Column:
    """TXT-17: a lower-case and an upper-case letter."""
    return _col(c).rlike("\\p{Ll}") & _col(c).rlike("\\p{Lu}")


def word_set(c: Column | str) -> Column:
    """TXT-19: distinct lower-case ASCII words, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(_col(c)), F.lit("[a-z0-9]+"), F.lit(0))))


def letter_led_words(c: Column | str) -> Column:
    """TXT-19: distinct lower-case words that begin with a letter, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(_col(c)), F.lit("[a-z][a-z0-9'-]*"), F.lit(0))))


def round_significant(c: Column | str, digits: int = 3) -> Column:
    """TXT-20: half up."""
    c = _col(c).cast("double")
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(c))))
    return F.when(c == 0, F.lit(0.0)).otherwise(F.signum(c) * F.floor(F.abs(c) * scale + 0.5) / scale)


def term_variants(c: Column | str) -> Column:
    """TXT-23: the term and its plural."""
    c = _col(c)
    before_y = F.lower(F.substring(c, -2, 1))
    plural = (
        F.when(c.endswith("y") & (F.length(c) > 1) & ~before_y.isin(*VOWELS), F.concat(F.substring(c, F.lit(1), F.length(c) - 1), F.lit("ies")))
        .when(c.rlike("(s|x|z|ch|sh)$"), F.concat(c, F.lit("es")))
        .otherwise(F.concat(c, F.lit("s")))
    )
    return F.array(c, plural)


def policy_definition(c: Column | str) -> Column:
    """TXT-25: stripped, lower case, without closing marks."""
    return F.lower(F.regexp_replace(F.btrim(_col(c)), "[ .;,:]+\\z", ""))


def fingerprint(c: Column | str) -> Column:
    """TXT-26: 12 hex digits of the SHA-256 of a JSON text."""
    return F.substring(F.sha2(_col(c), 256), 1, 12)


def initials_match(acronym: Column | str, phrase: Column | str) -> Column:
    """TXT-27: the acronym's letters and digits are an ordered part of the phrase's initials; an upper-case word gives all its letters."""
    words = F.regexp_extract_all(_col(phrase), F.lit("[A-Za-z0-9]+"), F.lit(0))
    stream = F.upper(F.array_join(F.transform(words, lambda w: F.when((F.length(w) > 1) & w.rlike("^[A-Z0-9]+$") & w.rlike("[A-Z]"), w).otherwise(F.substring(w, 1, 1))), ""))
    wanted = F.filter(F.split(F.upper(F.regexp_replace(_col(acronym), "[^A-Za-z0-9]", "")), ""), lambda x: x != "")
    left = F.aggregate(
        wanted,
        stream,
        lambda rest, x: F.when(F.coalesce(F.instr(rest, x), F.lit(0)) > 0, F.substring(rest, F.instr(rest, x) + 1, F.length(rest))),
    )
    return (F.size(wanted) > 0) & left.isNotNull()
