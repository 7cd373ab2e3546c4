"""Text expressions. All stay inside generated JVM code."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelweave import fixed

# Accented Latin letters and their base letter, derived from the canonical
# decomposition; letters that become two characters are listed apart.
_ACCENTED, _PLAIN = "", ""
for _code in range(0xC0, 0x250):
    _base = unicodedata.normalize("NFD", chr(_code))[0]
    if _base.isascii() and _base.isalpha():
        _ACCENTED += chr(_code)
        _PLAIN += _base
_ACCENTED += "øØđĐłŁħĦıðÐ"
_PLAIN += "oOdDlLhHidD"
_PAIRS = (("ß", "ss"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"),
          ("þ", "th"), ("Þ", "Th"))

# Curly quotes and dashes have plain forms too.
_ACCENTED += "‘’“”–—"
_PLAIN += "''\"\"--"

_WORD = r"[\p{L}\p{Nl}\p{No}_]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold_accents(col) -> Column:
    """Replace accented Latin letters by their plain form."""
    out = F.translate(_col(col), _ACCENTED, _PLAIN)
    for letter, plain in _PAIRS:
        out = F.replace(out, F.lit(letter), F.lit(plain))
    return out


def fold_words(words) -> list[str]:
    """The same folding for a driver-side word list (stop words)."""
    table = str.maketrans({**dict(zip(_ACCENTED, _PLAIN)), **dict(_PAIRS)})
    return sorted({w.translate(table) for w in words})


def extract_urls(col, pattern=fixed.URL_PATTERN) -> Column:
    """All links of a text, in order."""
    return F.regexp_extract_all(_col(col), F.lit(f"({pattern})"), F.lit(1))


def extract_tags(col, kind="hashtag", keywords=fixed.TAG_KEYWORDS) -> Column:
    """Lower-case the text, delete the keywords, list the #tags or @mentions."""
    pattern = {"hashtag": fixed.HASHTAG_PATTERN, "mention": fixed.MENTION_PATTERN}[kind]
    text = F.lower(_col(col))
    if keywords:
        text = F.regexp_replace(text, "(" + "|".join(keywords) + ")", "")
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def _without(words: Column, stop_words) -> Column:
    if not stop_words:
        return words
    return F.filter(words, lambda w: ~w.isin(list(stop_words)))


def normalize_bow(col, stop_words=(), stem=None, emoji=None) -> Column:
    """Normalise a text for bag-of-words features.

    Lower-case, fold accents, drop ``#`` and ``@``, links and punctuation,
    drop stop words. ``emoji`` and ``stem`` are optional Column -> Column
    stages (emoji to text, word to stem).
    """
    text = F.lower(_col(col))
    if emoji is not None:
        text = emoji(text)
    text = fold_accents(text)
    text = F.regexp_replace(text, "[#@]", "")
    text = F.regexp_replace(
        text, rf"http[^{fixed.SPACE}]+|[^\p{{L}}\p{{N}}_{fixed.SPACE}]", "")
    words = F.filter(F.split(text, f"[{fixed.SPACE}]+"), lambda w: w != "")
    words = _without(words, stop_words)
    if stem is not None:
        words = F.transform(words, stem)
    return F.array_join(words, " ")


def remove_users(col) -> Column:
    """Delete ``RT @name`` and ``@name``."""
    text = F.regexp_replace(_col(col), r"RT\s" + fixed.MENTION_PATTERN, "")
    return F.regexp_replace(text, fixed.MENTION_PATTERN, "")


def remove_links(col, strip="charset") -> Column:
    """Delete links. ``strip='charset'`` trims the characters of ``[link]``
    from both ends; ``'literal'`` deletes the marker itself."""
    text = F.regexp_replace(_col(col), rf"http[^{fixed.SPACE}]+", "")
    text = F.regexp_replace(text, rf"bit.ly/[^{fixed.SPACE}]+", "")
    if strip == "charset":
        text = F.btrim(text, F.lit("[link]"))
    else:
        text = F.replace(text, F.lit("[link]"), F.lit(""))
    return F.regexp_replace(text, rf"pic.twitter[^{fixed.SPACE}]+", "")


def remove_keywords(col, keywords=fixed.TEXT_KEYWORDS, rewrites=fixed.TEXT_REWRITES) -> Column:
    text = _col(col)
    if keywords:
        text = F.regexp_replace(text, "(" + "|".join(keywords) + ")", "")
    for old, new in rewrites:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def clean_post(col, strip="charset") -> Column:
    """The ordered cleaning steps ahead of tokenising."""
    text = remove_links(remove_users(col), strip)
    text = F.regexp_replace(text, "#+", "")
    text = F.regexp_replace(text, "VIDEO:|AUDIO:", "")
    text = remove_keywords(F.lower(text))
    text = F.regexp_replace(text, fixed.PUNCTUATION_CLASS, " ")
    text = F.regexp_replace(text, rf"[{fixed.SPACE}]+", " ")
    text = F.regexp_replace(text, "[0-9]+", "")
    return fold_accents(text)


def tokenize(col, stop_words=(), min_len=fixed.TOKEN_MIN, max_len=fixed.TOKEN_MAX,
             stem=None) -> Column:
    """Runs of letters between ``min_len`` and ``max_len`` characters that are
    no stop words; ``stem`` is an optional Column -> Column stage."""
    words = F.regexp_extract_all(F.lower(_col(col)), F.lit(f"({_WORD})"), F.lit(1))
    words = F.filter(
        words,
        lambda w: (F.length(w) >= min_len) & (F.length(w) <= max_len) & ~w.startswith("_"))
    words = _without(words, stop_words)
    return words if stem is None else F.transform(words, stem)


def split_words(col) -> Column:
    """Pieces between single non-word characters, empty pieces kept except a
    last empty one."""
    pieces = F.split(_col(col), r"[^\p{L}\p{N}_]")
    return F.when(F.element_at(pieces, -1) == "",
                  F.slice(pieces, F.lit(1), F.size(pieces) - 1)).otherwise(pieces)


def parse_params(col, patterns: dict[str, str]) -> dict[str, Column]:
    """One column per name: the first group of its pattern, null if absent."""
    text = _col(col)
    return {name: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
            for name, p in patterns.items()}


def join_list(col, sep=", ", prefix="", suffix="") -> Column:
    """A list as one string with optional prefix and suffix."""
    return F.concat(F.lit(prefix), F.array_join(_col(col), sep), F.lit(suffix))


def relabel(col, pattern, replacement) -> Column:
    """Rename parts of a label, as in ``topic_3`` to ``Topic 3``."""
    return F.regexp_replace(_col(col), pattern, replacement)
