"""Scalar text, date and list functions as Column expressions (all JVM side)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode whitespace characters as a Java pattern, as a class that RE2 reads, and as plain characters.
WHITESPACE = r"(?U)[\s\x1c-\x1f]"
WHITESPACE_RE2 = (
    r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
WHITESPACE_CHARS = "".join(
    chr(c)
    for lo, hi in (
        (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
        (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
    )
    for c in range(lo, hi + 1)
)

# Words dropped from a question, punctuation stripped from the rest, and the routing words.
STOP_WORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "shall", "can", "need", "dare", "of", "in",
    "on", "at", "to", "for", "with", "by", "from", "about", "into", "and",
    "or", "but", "if", "as", "that", "this", "it", "its", "what", "which",
    "who", "whom", "how", "when", "where", "why", "there", "their",
)
PUNCTUATION = ".,;:?!()"
TRIAL_WORDS = ("trial", "trials", "rct", "randomised", "randomized", "clinical", "nct")
ARTICLE_WORDS = ("article", "articles", "paper", "publication", "study", "research", "pubmed")

# Length limits of embedded text and snippets.
SNIPPET_CHARS = 500

# Fixed value: the RFC 4122 DNS namespace.
DNS_NAMESPACE_HEX = "6ba7b8109dad11d180b400c04fd430c8"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove Unicode whitespace from both ends (Spark's ``trim`` removes blanks only)."""
    return F.btrim(_col(c), F.lit(WHITESPACE_CHARS))


def is_blank(c: Column | str) -> Column:
    """Null, empty or whitespace only; never null itself."""
    return F.coalesce(strip(_col(c).cast("string")), F.lit("")) == ""


def words(c: Column | str) -> Column:
    """Whitespace-separated words, an empty array for blank or null text."""
    body = F.coalesce(strip(_col(c)), F.lit(""))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, WHITESPACE + "+"))


def word_count(c: Column | str) -> Column:
    body = F.coalesce(strip(_col(c)), F.lit(""))
    return F.when(body == "", F.lit(0)).otherwise(F.size(F.split(body, WHITESPACE + "+"))).cast("long")


def presence_flag(c: Column | str) -> Column:
    return (~is_blank(c)).cast("long")


def publication_year(c: Column | str) -> Column:
    """Four digits before the first hyphen, else 0."""
    year = F.regexp_extract(strip(_col(c)), r"^([0-9]{4})(-|\z)", 1)
    return F.coalesce(year.try_cast("long"), F.lit(0).cast("long"))


def list_item_count(c: Column | str, is_array: bool = False) -> Column:
    """Non-blank items of an array column, or of comma-separated text."""
    items = _col(c) if is_array else F.split(_col(c), ",")
    return F.coalesce(F.size(F.filter(items, lambda x: ~is_blank(x))), F.lit(0)).cast("long")


def null_to_zero_int(c: Column | str) -> Column:
    return F.coalesce(_col(c).try_cast("long"), F.lit(0).cast("long"))


_DATE_FORM = r"^[0-9]{4}(-[0-9]{1,2}(-[0-9]{1,2})?)?\z"
_MONTH_FORM = r"^[0-9]{4}(-(0?[1-9]|1[0-2]))?\z"


def partial_iso_date(c: Column | str) -> Column:
    """``YYYY-MM-DD``, ``YYYY-MM`` or ``YYYY`` (stripped, otherwise unchanged); null when it is no such date."""
    v = strip(_col(c))
    shaped = v.rlike(_DATE_FORM) & ~v.startswith("0000")
    valid = v.rlike(_MONTH_FORM) | F.try_to_date(v, "yyyy-M-d").isNotNull()
    return F.when(shaped & valid, v)


def date_lower(c: Column | str) -> Column:
    """First day a valid partial date can mean."""
    parts = F.split(_col(c), "-")
    month = F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("1"))
    day = F.coalesce(F.try_element_at(parts, F.lit(3)), F.lit("1"))
    return F.try_to_date(F.concat_ws("-", F.try_element_at(parts, F.lit(1)), month, day), "yyyy-M-d")


def date_upper(c: Column | str) -> Column:
    """Last day a valid partial date can mean."""
    lower = date_lower(c)
    size = F.size(F.split(_col(c), "-"))
    return (
        F.when(size == 3, lower)
        .when(size == 2, F.last_day(lower))
        .otherwise(F.last_day(F.add_months(lower, 11)))
    )


def safe_int(c: Column | str, variant: bool = False) -> Column:
    """An integer or null. ``variant=True`` keeps JSON typing: number 12.0 is 12, text "12.0" is null."""
    if variant:
        return F.try_variant_get(_col(c), "$", "int")
    return strip(_col(c)).try_cast("int")


def json_list(c: Column | str) -> Column:
    return F.to_json(_col(c))


def list_from_json(c: Column | str) -> Column:
    return F.from_json(_col(c), "array<string>")


def join_nonempty(*cols: Column | str) -> Column:
    """The non-empty values joined by one blank."""
    return F.concat_ws(" ", *[F.nullif(_col(c), F.lit("")) for c in cols])


def article_text(title: Column | str, abstract: Column | str) -> Column:
    """Text of an article as it is embedded: all of it."""
    both = F.concat(F.coalesce(_col(title), F.lit("")), F.lit(" "), F.coalesce(_col(abstract), F.lit("")))
    return strip(both)


def trial_text(title: Column | str, conditions: Column | str, interventions: Column | str) -> Column:
    """Text of a trial as it is embedded: all of it."""
    return join_nonempty(title, conditions, interventions)


def snippet(c: Column | str) -> Column:
    return F.substring(F.coalesce(_col(c), F.lit("")), 1, SNIPPET_CHARS)


def doc_key(prefix: str, c: Column | str) -> Column:
    return F.concat(F.lit(prefix + ":"), _col(c))


def bare_id(c: Column | str) -> Column:
    """The part after the last colon."""
    return F.substring_index(_col(c), ":", -1)


def uuid5(name: Column | str, namespace_hex: str = DNS_NAMESPACE_HEX) -> Column:
    """Name-based UUID, version 5."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(_col(name), "UTF-8")))
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3)
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), nibble + 1)
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def _constant_words(words_: Iterable[str]) -> Column:
    """A word list as one literal that the optimizer folds into an array."""
    return F.split(F.lit(" ".join(words_)), " ")


def search_terms(question: Column | str) -> Column:
    """The question without stop words and edge punctuation; the question itself if nothing is left.

    Stop words are tested before punctuation is stripped, so ``"is,"`` stays as ``"is"``.
    """
    q = _col(question)
    stop = _constant_words(STOP_WORDS)
    kept = F.filter(words(F.lower(q)), lambda t: ~F.array_contains(stop, t))
    stripped = F.transform(kept, lambda t: F.btrim(t, F.lit(PUNCTUATION)))
    joined = F.array_join(F.filter(stripped, lambda t: t != ""), " ")
    return F.when(F.coalesce(joined, F.lit("")) == "", q).otherwise(joined)


def implied_source_type(
    question: Column | str,
    given: Column | str | None = None,
    trial_words: Iterable[str] = TRIAL_WORDS,
    article_words: Iterable[str] = ARTICLE_WORDS,
) -> Column:
    """The given source type, else the one whose routing words occur (trial first), else null."""
    tokens = words(F.lower(_col(question)))
    routed = F.when(F.arrays_overlap(tokens, _constant_words(trial_words)), F.lit("trial")).when(
        F.arrays_overlap(tokens, _constant_words(article_words)), F.lit("article")
    )
    return routed if given is None else F.coalesce(_col(given), routed)


def is_placeholder(content: Column | str, source_type: Column | str) -> Column:
    """Content that is no real text: empty, a short "Abstract …" stub, or a trial text below 100 characters."""
    body = F.coalesce(_col(content), F.lit(""))
    return (
        (body == "")
        | (body.startswith("Abstract ") & (F.length(body) < 20))
        | (F.coalesce(_col(source_type) == "trial", F.lit(False)) & (F.length(body) < 100))
    )
