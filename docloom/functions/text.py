"""Text normalisation, tokens and redaction as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Words that are no keywords.
STOPWORDS = ("a", "an", "and", "are", "do", "does", "for", "how", "i", "if", "in", "is", "my", "of", "on", "or", "the", "to", "what", "when", "where")
#: Words that bring their other number along.
COUPLED = (("return", "returns"), ("refund", "refunds"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated and planned once, however often it is used."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def collapse(text: Column) -> Column:
    """Every run of white space is one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def fold(text: Column) -> Column:
    """Case folding; sharp s is the one letter of the corpus where it differs from lower."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def question_key(text: Column) -> Column:
    """A question in lower case, collapsed, without blanks, ``?`` and ``.`` at its ends."""
    return F.regexp_replace(collapse(fold(text)), r"^[ ?.\n\t]+|[ ?.\n\t]+$", "")


def tokens(text: Column) -> Column:
    """All runs of ASCII letters and digits, in order."""
    return F.regexp_extract_all(fold(text), F.lit("([a-z0-9]+)"), F.lit(1))


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(F.coalesce(text, F.lit(""))))


def keywords(text: Column) -> Column:
    """Distinct tokens but stop words, with both numbers of coupled words."""
    def with_coupled(words: Column) -> Column:
        both = F.array(*[F.when(F.array_contains(words, a), F.lit(b)) for x, y in COUPLED for a, b in ((x, y), (y, x))])
        return F.array_union(words, F.array_compact(both))

    return let(F.array_except(token_set(text), F.array(*[F.lit(w) for w in STOPWORDS])), with_coupled)


def clean_summary(text: Column) -> Column:
    """Collapsed; bullets before and stops after are cut."""
    return F.regexp_replace(F.regexp_replace(collapse(text), r"^[•\- ]+", ""), r"[.;:]+$", "")


def content_id(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-1 of the collapsed parts; null parts are skipped."""
    return F.substring(F.sha1(F.concat_ws("|", *[collapse(p) for p in parts])), 1, 16)


def has_personal_data(text: Column) -> Column:
    return text.rlike(r"\b[0-9]{2}-[0-9]{2}-[0-9]{4}\b|\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b|\b[0-9]{4}\b")


def redact(text: Column) -> Column:
    """Dates first, then what is left of four digits."""
    dated = F.regexp_replace(F.regexp_replace(text, r"\b[0-9]{2}-[0-9]{2}-[0-9]{4}\b", "[REDACTED_DATE]"), r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b", "[REDACTED_DATE]")
    return F.regexp_replace(dated, r"\b[0-9]{4}\b", "[REDACTED_4_DIGITS]")


def first_sentence(text: Column, most: int = 220) -> Column:
    """Up to the first sentence end; beyond ``most`` characters cut with an ellipsis."""
    sentence = F.split(text, r"(?<=[.!?])\s+", 2)[0]
    return F.when(F.length(sentence) <= most, sentence).otherwise(F.concat(F.rtrim(F.left(sentence, F.lit(most - 3))), F.lit("...")))


def number(raw: Column) -> Column:
    """``(1,234)`` is -1234; dashes and anything else that is no number are null."""
    digits = F.regexp_replace(F.trim(raw), r"[,$()]", "")
    sign = F.when(F.trim(raw).rlike(r"^\(.*\)$"), F.lit(-1.0)).otherwise(F.lit(1.0))
    return sign * digits.try_cast("double")


def sound_vector(vector: Column, least: int = 8) -> Column:
    """The vector as doubles if it has at least ``least`` components, all numbers."""
    cells = F.transform(vector, lambda x: x.try_cast("double"))
    return F.when((F.size(vector) >= least) & F.forall(cells, lambda x: x.isNotNull()), cells)
