"""Text expressions. All of them are built-in Spark functions and see whole strings."""

from __future__ import annotations

from collections.abc import Sequence
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats and defaults that downstream files and prompts depend on.
REVIEW_JOINER = ". "
REVIEW_TITLE_LABEL = "Review title: "
REVIEW_TEXT_LABEL = "Review text: "
NO_REVIEWS = "(no reviews)"
QUERY_PREFIX = "query: "
PASSAGE_PREFIX = "passage: "
RAW_QUERY_PREFIXES = ("query:", "search query:", "output:")
META_FIELDS = ("author", "categories", "features", "description", "details")
CARD_TITLE_CHARS, CARD_TEXT_CHARS = 80, 400
QUERY_TITLE_CHARS, QUERY_TEXT_CHARS = 200, 800
PIECE_CHARS, META_CHARS, FLAT_CHARS = 500, 500, 800

# Unicode white space plus the four ASCII separators that the Unicode property leaves out.
_SPACE = r"[\s\x1c-\x1f]"
_EDGES = rf"(?U)^{_SPACE}+|{_SPACE}+\z"
_LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def strip(text: Column) -> Column:
    """Remove white space (any Unicode kind) at both ends."""
    return F.regexp_replace(text, _EDGES, "")


def is_blank(text: Column) -> Column:
    return text.isNull() | (F.length(strip(text)) == 0)


def normalise(text: Column) -> Column:
    """Lower case, inner white space collapsed to one blank, ends stripped."""
    return F.trim(F.regexp_replace(F.lower(text), rf"(?U){_SPACE}+", " "))


def sha1_16(text: Column) -> Column:
    return F.substring(F.sha1(text), 1, 16)


def review_body(title: Column, text: Column) -> Column:
    return F.concat(or_empty(title), F.lit(REVIEW_JOINER), or_empty(text))


def review_hash(title: Column, text: Column) -> Column:
    """Content key of a review: 16 hex digits over its normalised title and text."""
    return sha1_16(normalise(review_body(title, text)))


def single_line(text: Column) -> Column:
    """Line breaks become blanks, ends stripped, null becomes empty."""
    return strip(F.translate(or_empty(text), "\n\r", "  "))


def stripped(text: Column) -> Column:
    """Ends stripped, null becomes empty."""
    return strip(or_empty(text))


def truncate(text: Column, chars: int) -> Column:
    """The first ``chars`` code points; null becomes empty."""
    return F.substring(or_empty(text), 1, chars)


def clean_query(raw: Column, fallback: str) -> Column:
    """The first line of a raw generation, without quotes and answer prefix, or ``fallback``."""
    whole = stripped(raw)
    line = strip(F.split(whole, _LINE_BREAK, 2)[0])
    line = F.btrim(F.btrim(line, F.lit('"')), F.lit("'"))
    prefix = "(?i)^(?:" + "|".join(RAW_QUERY_PREFIXES) + ")"
    line = F.when(line.rlike(prefix), strip(F.regexp_replace(line, prefix, ""))).otherwise(line)
    return F.when((whole == "") | (line == ""), F.lit(fallback)).otherwise(line)


def is_fallback(query: Column, fallback: str) -> Column:
    return normalise(query) == F.lit(fallback)


def clean_card(raw: Column, fallback: str | Column) -> Column:
    default = F.lit(fallback) if isinstance(fallback, str) else fallback
    return F.coalesce(F.nullif(stripped(raw), F.lit("")), default)


def general_request(domain: str) -> str:
    """The text that stands for an item or query nothing is known about."""
    return f"general {domain} recommendation"


def review_line(rating: Column, title: Column, text: Column) -> Column:
    return F.concat(
        F.lit("("), F.coalesce(rating.cast("double"), F.lit(0.0)).cast("string"), F.lit("/5) "), or_empty(title), F.lit(" — "), or_empty(text)
    )


def meta_block(
    columns: Sequence[str], fields: Sequence[str] = META_FIELDS, rating: str = "average_rating", count: str = "rating_number"
) -> Column:
    """``Field: value`` lines for the fields present in ``columns``, then the rating line."""
    lines = []
    for name in fields:
        if name in columns:
            value = F.col(name).cast("string")
            line = F.concat(F.lit(f"{name.capitalize()}: "), F.substring(value, 1, META_CHARS))
            lines.append(F.when(F.length(value) > 2, line))
    if rating in columns:
        n = F.coalesce(F.col(count).cast("string"), F.lit("?")) if count in columns else F.lit("?")
        shown = F.concat(F.lit("AvgRating: "), F.col(rating).cast("string"), F.lit(" ("), n, F.lit(" ratings)"))
        lines.append(F.when(F.col(rating).isNotNull(), shown))
    return F.concat_ws("\n", *lines) if lines else F.lit("")


def fill_template(template: str, **slots: Column) -> Column:
    """``template`` with its ``{slot}`` places taken by columns.

    The template is cut into pieces once on the driver, so braces inside the values are safe.
    """
    parts: list[Column] = []
    for literal, slot, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if slot is not None:
            parts.append(or_empty(slots[slot]))
    return F.concat(*parts) if parts else F.lit("")


def review_piece(title: Column, text: Column, chars: int = PIECE_CHARS) -> Column:
    """One labelled review, or null when it has neither title nor text."""
    title, text = stripped(title), stripped(text)
    labelled = F.concat(
        F.when(title != "", F.concat(F.lit(REVIEW_TITLE_LABEL), title, F.lit("\n"))).otherwise(F.lit("")),
        F.when(text != "", F.concat(F.lit(REVIEW_TEXT_LABEL), F.substring(text, 1, chars))).otherwise(F.lit("")),
    )
    return F.when((title != "") | (text != ""), strip(labelled))


def as_list(value: Column, is_array: bool) -> Column:
    """A list column whatever came in: null and blank text become empty, text becomes one entry."""
    empty = F.array().cast("array<string>")
    value = value if is_array else value.cast("string")
    return F.coalesce(value, empty) if is_array else F.when(is_blank(value), empty).otherwise(F.array(value))


def pool_text(titles: Column, texts: Column, reviews: int = 5, chars: int = PIECE_CHARS, lists: tuple[bool, bool] = (True, True)) -> Column:
    """The first ``reviews`` entries of two parallel lists as pieces; empty when none has content.

    ``lists`` says which of the two columns are lists; one text instead counts as a list of it.
    """
    titles, texts = (as_list(c, is_array) for c, is_array in zip((titles, texts), lists, strict=True))
    pieces = F.transform(F.slice(texts, 1, reviews), lambda text, i: review_piece(F.get(titles, i), text, chars))
    return F.array_join(F.filter(pieces, lambda p: p.isNotNull()), "\n\n")


def item_text(instruction: str, body: Column, domain: str) -> Column:
    """What the encoder sees for an item: instruction and body, or the general request."""
    return F.when(
        F.coalesce(body, F.lit("")) != "", F.concat(F.lit(instruction + "\n\n"), body)
    ).otherwise(F.lit(general_request(domain)))
