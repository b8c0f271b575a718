"""Text functions as Column expressions: folding, tokens, query terms, paths, excerpts."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spanish and English words that are no query terms.
STOPWORDS = (
    "como para por que con del las los una uno unos unas esta este esto estos estas donde cuando cual cuales sobre entre desde "
    "hasta hace hacer ser son era fue muy mas pero porque sus nos les the and for with from that this what when where which how "
    "are was were has have its"
).split()
MARKDOWN = r"(?i)\.(md|mdx|markdown)$"


def _fold_table() -> tuple[str, str]:
    """Letters that lose a diacritic when decomposed, and the ASCII letter that is left of them; and
    what the full-text index does in its own way."""
    # Other forms of a letter, and a letter that keeps its diacritics.
    pairs, kept = [("\u00b5", "\u03bc"), ("\u017f", "s"), ("\u1e9b", "s")], "\u01e1"
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain.isascii() and chr(code) not in kept:
            pairs.append((chr(code), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FOLD = _fold_table()
#: Combining marks.
MARKS = "".join(map(chr, range(0x300, 0x370)))


def fold(text: Column) -> Column:
    """Lower case without diacritics, whether they are part of a letter or marks behind it."""
    return F.translate(F.lower(text), _FOLD[0] + MARKS, _FOLD[1])


def tokens(text: Column) -> Column:
    """Runs of letters and digits, folded: the words of the keyword index."""
    return F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_terms(query: Column) -> Column:
    """Distinct lower-case terms of a query in order of appearance, of three letters or more and no
    stopwords; accents stay, so a stopword with an accent is a term. Null or no term: empty."""
    words = F.split(F.lower(F.coalesce(query, F.lit(""))), r"[^\p{L}\p{N}]+")
    stop = F.array(*(F.lit(w) for w in STOPWORDS))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w)))


def squeeze_ends(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^[\s ﻿  ]+|[\s ﻿  ]+$", "")


def is_markdown(path: Column) -> Column:
    return path.rlike(MARKDOWN)


def is_glob(pattern: Column) -> Column:
    return (pattern == "**") | (pattern == "*.md") | pattern.endswith("/**")


def matches_pattern(path: Column, pattern: Column) -> Column:
    """`**`: any markdown; `*.md`: markdown at the root; `X/**`: markdown below X; else equality."""
    below = pattern.substr(F.lit(1), F.length(pattern) - 2)
    return (
        F.when(pattern == "**", is_markdown(path))
        .when(pattern == "*.md", is_markdown(path) & ~F.contains(path, F.lit("/")))
        .when(pattern.endswith("/**"), F.startswith(path, below) & is_markdown(path))
        .otherwise(path == pattern)
    )


def clean_path(path: Column) -> Column:
    """Trimmed, without leading slashes; null if empty or with a `..` segment."""
    plain = F.regexp_replace(squeeze_ends(path), "^/+", "")
    return F.when((plain != "") & ~F.array_contains(F.split(plain, "/"), ".."), plain)


def first_line(text: Column) -> Column:
    return squeeze_ends(F.split_part(text, F.lit("\n"), F.lit(1)))


def days_since(then: Column, now: Column) -> Column:
    """Whole days from then to now, not below 0; null if either is null."""
    return F.when(then.isNotNull() & now.isNotNull(), F.greatest(F.lit(0), F.timestamp_diff("DAY", then, now)).cast("long"))


def branch_order(name: Column) -> Column:
    """Sort key: main, master, dev, develop, then the others by name."""
    place = F.array_position(F.array(*map(F.lit, ("main", "master", "dev", "develop"))), name).cast("int")
    return F.struct(F.when(place == 0, F.lit(5)).otherwise(place).alias("place"), name.alias("name"))


def ordered_branches(branch: Column) -> Column:
    """Aggregate: the distinct branches of a group in branch order."""
    return F.transform(F.array_sort(F.collect_set(branch_order(branch))), lambda b: b["name"])


def in_branch_order(branches: Column) -> Column:
    """The distinct branches of an array in branch order."""
    return F.transform(F.array_sort(F.array_distinct(F.transform(branches, branch_order))), lambda b: b["name"])
