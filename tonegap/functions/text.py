"""Text functions as native column expressions (Java regular expressions).

Character classes are written out because the Java shorthands differ from the intended
Unicode ones: ``\\w`` is ASCII only there, and ``\\s`` misses the Unicode spaces.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tonegap import constants as K

WS = r"\t-\r\x1c-\x20\x85\p{Z}"
WORD = r"\p{L}\p{N}_"
LETTER = r"\p{L}\p{Nl}\p{No}"
# Latin and basic Arabic-script text without combining marks is already in composed form, so
# only rows outside these ranges are worth a trip to a Python worker.
_COMPOSED = (
    r"^[\x{0000}-\x{02FF}\x{0400}-\x{045F}\x{0600}-\x{060F}\x{061B}-\x{064A}"
    r"\x{0660}-\x{066F}\x{0671}-\x{06D5}\x{06EE}-\x{06FF}"
    r"\x{2002}-\x{2027}\x{2030}-\x{203B}\x{1F300}-\x{1FAFF}]*+$"
)


@F.pandas_udf(StringType())
def _nfc_udf(values: pd.Series) -> pd.Series:
    return values.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")


def nfc(text: Column) -> Column:
    """Unicode composed form. Spark has no built-in; the Python side sees only rows that need it."""
    pending = F.when(~text.rlike(_COMPOSED), text)
    return F.coalesce(_nfc_udf(pending), text)


def normalize_persian(text: Column) -> Column:
    """Composed form, then one translation of Arabic letter forms and both digit families."""
    source = K.ARABIC_FORMS_FROM + K.ARABIC_INDIC_DIGITS + K.PERSIAN_DIGITS
    target = K.ARABIC_FORMS_TO + K.ASCII_DIGITS + K.ASCII_DIGITS
    return F.translate(F.coalesce(nfc(text), F.lit("")), source, target)


def strip_urls(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?iu)https?://[^{WS}]+|www\.[^{WS}]+", " ")


def strip_mentions(text: Column) -> Column:
    """Mentions become a space; the look-behind only runs where an @ was found."""
    return F.regexp_replace(text, rf"@(?<![{WORD}]@)[{WORD}]+", " ")


def strip_ws(text: Column) -> Column:
    """Trim every kind of whitespace, not only spaces."""
    return F.regexp_replace(text, rf"^[{WS}]+|[{WS}]++$", "")


def collapse_ws(text: Column) -> Column:
    """One space for every run of whitespace; runs that already are one space are not touched."""
    return F.trim(F.regexp_replace(text, rf"[{WS}&&[^ ]][{WS}]*+| [{WS}]++", " "))


def strip_noise(text: Column) -> Column:
    return collapse_ws(strip_mentions(strip_urls(text)))


def preprocess_caption(text: Column) -> Column:
    return strip_noise(normalize_persian(text))


def script_ratio(text: Column, block: str = r"\x{0600}-\x{06FF}") -> Column:
    """Share of letters inside ``block``; 0.0 when there is no letter at all.

    Written without a branch, so that the letters are filtered out once and shared.
    """
    letters = F.regexp_replace(text, rf"[^{LETTER}]++", "")
    inside = F.length(F.regexp_replace(letters, rf"[^{block}]++", ""))
    return F.coalesce(F.try_divide(inside.cast("double"), F.length(letters)), F.lit(0.0))


def is_script_enough(text: Column, min_ratio: float = K.MIN_SCRIPT_RATIO) -> Column:
    return script_ratio(text) >= F.lit(min_ratio)


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    """Plain byte searches, several times faster here than one alternation pattern.

    A word that contains another word of the list cannot change the outcome and is left out.
    """
    needed = [w for w in words if not any(o != w and o in w for o in words)]
    return reduce(lambda a, b: a | b, [text.contains(w) for w in needed])


def is_spam_caption(text: Column, lowered: Column | None = None) -> Column:
    """``lowered``: the text in lower case, where that is a stored column already."""
    hit = (
        contains_any(F.lower(text) if lowered is None else lowered, K.SPAM_SUBSTRINGS_LATIN)
        | contains_any(text, K.SPAM_SUBSTRINGS_FA)
        | ((F.length(text) > K.SPAM_LONG_TEXT) & contains_any(text, K.SPAM_LONG_WORDS))
    )
    return F.coalesce(hit, F.lit(False))


def fold_case(text: Column) -> Column:
    """Lower case, with the three letters whose case pairs leave the ASCII range."""
    for letter, plain in (("İ", "i"), ("ı", "i"), ("ſ", "s")):
        text = F.replace(text, F.lit(letter), F.lit(plain))
    return F.lower(text)


def is_sarcasm_candidate(text: Column, *, preprocessed: bool = False, folded: Column | None = None) -> Column:
    """Text cues of irony. Pass ``preprocessed=True`` when the caption is already normalised, and ``folded`` when its case is too.

    The branches are ordered so that every word list is searched at most once per text.
    """
    t = text if preprocessed else preprocess_caption(text)
    folded = fold_case(t) if folded is None else folded
    has = lambda words: contains_any(folded, words)
    quotes = (F.length(t) - F.length(F.replace(t, F.lit('"'), F.lit("")))) >= 2
    turn = has(K.CONTRAST_WORDS) | has(K.RHETORICAL_WORDS)
    cues = (
        F.when(has(K.IRONY_WORDS) | quotes | t.contains("«"), True)
        .when(has(K.NEG_WORDS), turn | t.rlike(K.HAPPY_EMOJI) | has(K.POS_WORDS))
        .when(has(K.POS_WORDS), turn | t.rlike(K.SAD_EMOJI))
        .otherwise(False)
    )
    return F.coalesce((F.length(t) >= K.SARCASM_MIN_LENGTH) & cues, F.lit(False))


def keyword_counts(text: Column) -> tuple[Column, Column]:
    """How many distinct positive and negative keywords the text contains."""
    count = lambda words: reduce(
        lambda a, b: a + b, [text.contains(w).cast("int") for w in words]
    )
    return count(K.WEAK_POSITIVE_WORDS), count(K.WEAK_NEGATIVE_WORDS)


def keyword_weak_label(text: Column) -> Column:
    """The more frequent side, neutral on a tie; the sign of the difference picks the name."""
    pos, neg = keyword_counts(text)
    names = F.array(F.lit("negative"), F.lit("neutral"), F.lit("positive"))
    return F.element_at(names, (F.signum((pos - neg).cast("double")) + 2).cast("int"))


def clean_generated_text(text: Column) -> Column:
    """Text after the last ``Assistant:`` turn; blank becomes a single dot."""
    answer = strip_ws(F.substring_index(F.coalesce(text, F.lit("")), "Assistant:", -1))
    return F.coalesce(F.nullif(answer, F.lit("")), F.lit("."))


def polarity_phrase(score: Column) -> Column:
    band = K.POLARITY_PHRASE_BAND
    return (
        F.when(score.isNull(), "ambiguous")
        .when(score > band, "positive")
        .when(score < -band, "negative")
        .otherwise("neutral")
    )


def label_display(label: Column) -> Column:
    pairs = [F.lit(x) for item in K.LABEL_DISPLAY.items() for x in item]
    return F.coalesce(F.create_map(*pairs)[label], label)


def min_text_len(text: Column, n: int) -> Column:
    return F.length(strip_ws(F.coalesce(text, F.lit("")))) >= n


def hashtags(text: Column) -> Column:
    """All tags of one text, in order; explode it for a tag catalogue."""
    return F.regexp_extract_all(text, F.lit(rf"#([{WORD}]+)"), F.lit(1))


def event_timestamp(stamp: Column) -> Column:
    """Parsed instant of an ISO-8601 string; order by the string itself."""
    return F.try_to_timestamp(stamp)
