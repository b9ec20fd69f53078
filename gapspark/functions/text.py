"""Column functions on text: cleaning, headline titles, sentences, quotes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gapspark import fixed


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only the blank."""
    return F.btrim(c, F.lit(fixed.WHITESPACE))


def blank_to_null(c: Column) -> Column:
    """Trimmed text, NULL when nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def capitalised(c: Column) -> Column:
    """First letter upper, all others lower (``initcap`` would treat every word)."""
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substring(c, 2, 2147483647)))


def normalised_type(c: Column) -> Column:
    return capitalised(strip(c))


def is_type(c: Column, name: str) -> Column:
    """Whether a review type is ``name`` once trimmed and capitalised."""
    return F.lower(strip(c)) == name.lower()


def words(c: Column) -> Column:
    return F.split(strip(c), fixed.SPACE_CLASS + "+")


def clip_words(c: Column, n: int | None) -> Column:
    """The first ``n`` words joined by one blank; the text itself when ``n`` is None."""
    if n is None:
        return c
    return F.array_join(F.slice(words(c), 1, n), " ")


def within_words(c: Column, n: int) -> Column:
    """Whether a text has at most n words; short texts are known by their length."""
    return (F.length(c) < 2 * n) | (F.size(words(c)) <= n)


def sentences(c: Column) -> Column:
    return F.split(strip(c), fixed.SENTENCE_BREAK)


def long_sentences(c: Column, longer_than: int = fixed.ASPECT_SENTENCE_MIN) -> Column:
    """Trimmed sentences of more than ``longer_than`` characters."""
    return F.filter(F.transform(sentences(c), strip), lambda s: F.length(s) > longer_than)


def first_quote(c: Column) -> Column:
    """The first sentence of quotable length that is not a "read more" teaser."""
    cleaned = F.transform(sentences(c), lambda s: F.btrim(strip(s), F.lit("\"'")))
    fits = F.filter(
        cleaned,
        lambda s: F.length(s).between(fixed.QUOTE_MIN, fixed.QUOTE_MAX)
        & ~F.startswith(F.lower(s), F.lit("read")),
    )
    return F.get(fits, F.lit(0))


def clip_chars(c: Column, n: int | None) -> Column:
    """The first ``n`` characters; the text itself when ``n`` is None."""
    return c if n is None else F.left(c, F.lit(n))


def headline_title(headline: Column, strict: bool = False, max_chars: int | None = None) -> Column:
    """Film title inside a review headline.

    First the "Review: 'Title' is ..." form, then the text before the first of a
    row of separators found after the third character, else the headline, cut to
    ``max_chars`` if given. ``strict`` makes the verbs whole words in any letter case.
    """
    lead = f"(?i){fixed.HEADLINE_LEAD}\\b" if strict else fixed.HEADLINE_LEAD
    lowered = F.lower(headline)
    title = F.when(headline.rlike(lead), strip(F.regexp_extract(headline, lead, 1)))
    for separator in fixed.HEADLINE_SEPARATORS:
        at = F.instr(lowered, separator)
        before = F.left(headline, at - 1)
        title = title.when(at > 3, F.btrim(strip(before), F.lit(fixed.HEADLINE_QUOTES)))
    title = title.otherwise(strip(clip_chars(headline, max_chars)))
    return F.coalesce(title, F.lit(""))


def main_title(title: Column) -> Column:
    """The part before the first colon; NULL for a title without one."""
    return F.when(title.contains(":"), strip(F.substring_index(title, ":", 1)))


def byline_name(byline: Column, default: str) -> Column:
    """Critic name without a leading "By", or the source's default."""
    name = strip(F.regexp_replace(byline, rf"^(?i)By{fixed.SPACE_CLASS}+", ""))
    return F.coalesce(empty_to_null(name), F.lit(default))


def content_id(
    link: Column, critic: Column, day: Column, content: Column, prefix: int | None = None
) -> Column:
    """Stable id of a review without one: a digest over its parts.

    ``prefix`` takes the first characters of the content only, as older ids did.
    """
    def part(c: Column) -> Column:
        return F.coalesce(c, F.lit(""))

    raw = F.concat_ws("|", part(link), part(critic), part(day), clip_chars(part(content), prefix))
    return F.left(F.sha1(raw), F.lit(20))


def list_items(c: Column) -> Column:
    """Trimmed items of a comma separated text, repeats kept."""
    return F.transform(F.split(c, ","), strip)


def tokens(c: Column) -> Column:
    """Lower-case word tokens of two or more characters."""
    return F.regexp_extract_all(F.lower(c), F.lit(fixed.WORD_TOKEN), F.lit(0))
