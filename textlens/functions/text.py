"""Text normalisation as column expressions.

Each function takes a string column and returns a column, so that a chain of them stays one
projection over the scan. `normalise` applies the whole chain in its fixed order.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlens.functions.contractions import CONTRACTIONS

# The character classes and patterns that define the normalisation.
SPACES = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE_CHARACTERS = "".join(
    chr(c) for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
WORD = r"[\p{L}\p{N}_]"
PUNCTUATION = "!\"$%&'()*+,-./:;<=>?@[\\]^`{|}~"
LINK = (
    r"(?i)(https?:\/\/(?:www\.|(?!www))[a-zA-Z0-9][a-zA-Z0-9-]+[a-zA-Z0-9]\.[^%(s)s]{2,}"
    r"|www\.[a-zA-Z0-9][a-zA-Z0-9-]+[a-zA-Z0-9]\.[^%(s)s]{2,}"
    r"|https?:\/\/(?:www\.|(?!www))[a-zA-Z0-9]+\.[^%(s)s]{2,}"
    r"|www\.[a-zA-Z0-9]+\.[^%(s)s]{2,})"
) % {"s": SPACES}
HANDLE = f"@[^{SPACES}]+"
LONG_RUN = r"(([^\n])\2{2})\2+"
# The hyphen is looked for first; \G rules out one whose left word the previous match has taken.
HYPHENATED = rf"(?!\G)-(?<={WORD}-)({WORD}+)"
PUNCTUATION_CLASS = r"[!\"$%&'()*+,\-./:;<=>?@\[\\\]^`{|}~]+"
NON_ASCII = r"[^\x00-\x7F]"
CONTRACTION_PIECES = r"[A-Za-z]+(?:'[A-Za-z]+)*|[^A-Za-z]+"


def replace_newlines(text: Column) -> Column:
    """Line feeds become spaces, carriage returns go."""
    return F.replace(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(""))


def drop_non_ascii(text: Column) -> Column:
    return F.regexp_replace(text, NON_ASCII, "")


def drop_links(text: Column) -> Column:
    possible = F.contains(text, F.lit("://")) | F.contains(F.lower(text), F.lit("www."))
    return F.when(possible, F.regexp_replace(text, LINK, "")).otherwise(text)


def phrase_pattern(phrases: Sequence[str]) -> str:
    """Case-insensitive alternation of the phrases, earlier phrases first."""
    return "(?iu)" + "|".join(f"(?:{_escaped(phrase)})" for phrase in phrases)


def _escaped(phrase: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", phrase)


def join_phrases(text: Column, phrases: Sequence[str]) -> Column:
    """Spaces inside a matched phrase become underscores; the letter case is kept."""
    if not phrases:
        return text
    pattern = phrase_pattern(phrases)
    between = F.split(text, pattern, -1)
    matched = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    joined = F.zip_with(
        between, matched, lambda b, m: F.concat(b, F.coalesce(F.replace(m, F.lit(" "), F.lit("_")), F.lit("")))
    )
    return F.when(F.rlike(text, F.lit(pattern)), F.array_join(joined, "")).otherwise(text)


def drop_handles(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, HANDLE, "")).otherwise(text)


def shorten_runs(text: Column) -> Column:
    """Four or more of one character become three."""
    return F.regexp_replace(text, LONG_RUN, "$1")


def expand_contractions(text: Column, expansions: Mapping[str, str] = CONTRACTIONS) -> Column:
    """Write contractions out, keeping a leading capital; other pieces pass through."""
    table = F.create_map(*[F.lit(part) for pair in expansions.items() for part in pair])

    def expand(piece: Column) -> Column:
        full = F.element_at(table, F.lower(piece))
        capital = F.substring(piece, 1, 1) != F.lower(F.substring(piece, 1, 1))
        head, tail = F.upper(F.left(full, F.lit(1))), F.substr(full, F.lit(2))
        written = F.when(capital, F.concat(head, tail)).otherwise(full)
        return F.when(F.contains(piece, F.lit("'")), F.coalesce(written, piece)).otherwise(piece)

    pieces = F.regexp_extract_all(text, F.lit(CONTRACTION_PIECES), F.lit(0))
    return F.when(F.contains(text, F.lit("'")), F.array_join(F.transform(pieces, expand), "")).otherwise(text)


def join_hyphens(text: Column) -> Column:
    """One left-to-right pass: the hyphen between two words becomes an underscore."""
    return F.regexp_replace(text, HYPHENATED, "_$1")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARACTERS))


def drop_punctuation(text: Column) -> Column:
    """All ASCII punctuation but ``#`` and ``_`` is deleted."""
    return F.regexp_replace(text, PUNCTUATION_CLASS, "")


def tokenize(text: Column) -> Column:
    """Array of lower-case words without punctuation."""
    words = F.split(F.lower(drop_punctuation(text)), f"[{SPACES}]+")
    return F.filter(words, lambda word: word != "")


def normalise(
    df: DataFrame,
    column: str = "text",
    *,
    newlines: bool = True,
    non_ascii: bool = True,
    links: bool = True,
    phrases: Sequence[str] = (),
    handles: bool = True,
    runs: bool = True,
    contractions: bool = True,
    hyphens: bool = True,
    outer_spaces: bool = True,
) -> DataFrame:
    """Rewrite ``column`` by the chosen steps. Each step is its own projection: Catalyst merges those
    that use their input once and keeps the others apart, so no step is computed twice.
    """
    steps = [
        (newlines, replace_newlines),
        (non_ascii, drop_non_ascii),
        (links, drop_links),
        (bool(phrases), lambda text: join_phrases(text, phrases)),
        (handles, drop_handles),
        (runs, shorten_runs),
        (contractions, expand_contractions),
        (hyphens, join_hyphens),
        (outer_spaces, strip),
    ]
    for wanted, step in steps:
        if wanted:
            df = df.withColumn(column, step(F.col(column)))
    return df
