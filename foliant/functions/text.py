"""Text analysis as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes from which on a word is not indexed.
WORD_LIMIT = 48
FRAGMENT = 240


def words(text: Column) -> Column:
    """Lower-case words in order: runs of letters and digits of under 48 UTF-8 bytes."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.transform(F.filter(found, lambda w: F.octet_length(w) < WORD_LIMIT), F.lower)


def script_of_word(word: Column) -> Column:
    return F.when(word.rlike(r"[\x{0400}-\x{04FF}]"), "cyrillic").when(word.rlike("[A-Za-z]"), "latin").otherwise("other")


def script_of_text(text: Column) -> Column:
    """The script of most words; as many Cyrillic ones as Latin ones make it Cyrillic."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    cyrillic = F.size(F.filter(found, lambda w: w.rlike(r"[\x{0400}-\x{04FF}]")))
    latin = F.size(F.filter(found, lambda w: ~w.rlike(r"[\x{0400}-\x{04FF}]") & w.rlike("[A-Za-z]")))
    return F.when((cyrillic == 0) & (latin == 0), "other").when(cyrillic >= latin, "cyrillic").otherwise("latin")


def opening_fragment(text: Column) -> Column:
    return F.when(F.length(text) > FRAGMENT, F.concat(F.rtrim(F.left(text, F.lit(FRAGMENT))), F.lit("…"))).otherwise(text)


def link_key(target: Column) -> Column:
    """The last path segment, without .md, in lower case."""
    last = F.element_at(F.split(target, r"[/\\]"), -1)
    return F.lower(F.trim(F.regexp_replace(last, r"(\.md|\.MD)$", "")))


def link_target(target: Column) -> Column:
    """A link as compared with relative names: forward slashes, no leading ./, lower case, no .md."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace(target, r"\\", "/"), r"^(\./)+", "")), r"\.md$", "")


def wikilinks(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"\[\[((?:(?!\]\]).)*)\]\]"), F.lit(1))
    plain = F.transform(found, lambda x: F.trim(F.split(F.split(x, r"\|")[0], "#")[0]))
    return F.array_distinct(F.filter(plain, lambda x: (x != "") & ~F.contains(x, F.lit("["))))


def relative_name(path: Column, kind: Column) -> Column:
    plain = F.lower(F.regexp_replace(path, r"\\", "/"))
    return F.when(kind == "markdown", F.regexp_replace(plain, r"\.[^./]*$", "")).otherwise(plain)


def names_a_document(title: Column, stem: Column) -> Column:
    """Whether a title from metadata says more than the file name does."""
    like_file = title.rlike(r"^.+\.[A-Za-z0-9]{1,5}$")
    return title.rlike(r"\p{L}") & (F.lower(title) != F.lower(stem)) & ~like_file


def freshness(modified: Column, now: Column) -> Column:
    """1.1 for what changed just now, half the bonus every 30 days; times in epoch seconds."""
    days = F.greatest(now - modified, F.lit(0)) / 86400.0
    return 1 + 0.1 * F.pow(F.lit(2.0), -days / 30.0)


def backlink_boost(score: Column, links: Column) -> Column:
    return score * (1 + 0.1 * F.log1p(links))


def embedding_passage(title: Column, headings: Column, body: Column) -> Column:
    """Title, headings (without one that repeats the title in front) and body, a line each."""
    rest = F.when(F.get(headings, F.lit(0)) == title, F.slice(headings, 2, F.greatest(F.size(headings), F.lit(1)))).otherwise(headings)
    return F.concat_ws("\n", title, F.nullif(F.array_join(rest, " › "), F.lit("")), F.nullif(body, F.lit("")))


def found_by(words_rank: Column, all_words: Column, meaning: Column, across: Column) -> Column:
    return F.concat_ws(
        " + ",
        F.when(words_rank.isNotNull(), F.when(all_words, "words").otherwise("some words")),
        F.when(meaning.isNotNull(), F.format_string("meaning %.2f", meaning)),
        F.when(across, "another language"),
    )


def commit_text(summary: Column, body: Column) -> Column:
    return F.concat_ws("\n\n", summary, F.nullif(body, F.lit("")))


def is_passage(text: Column) -> Column:
    """Pasted text, as against a question."""
    return F.contains(text, F.lit("\n")) | (F.length(text) >= 140)


def human_size(n: Column) -> Column:
    """Decimal units: whole KB rounded up, whole MB, GB with one digit."""
    mb = n / 1_000_000.0
    return F.when(mb >= 1000, F.format_string("%.1f GB", mb / 1000.0)).when(mb >= 1, F.format_string("%d MB", F.bround(mb, 0).cast("long"))).otherwise(F.format_string("%d KB", F.ceil(n / 1000.0).cast("long")))


def human_duration(seconds: Column) -> Column:
    """Whole seconds under a minute, minutes rounded up under an hour, then hours and minutes."""
    s = F.round(seconds, 0).cast("long")
    hours = F.format_string("%d h %d min", F.floor(s / 3600), F.floor(s % 3600 / 60))
    return F.when(s < 60, F.format_string("%d s", s)).when(s < 3600, F.format_string("%d min", F.ceil(s / 60))).otherwise(hours)


#: How comments begin that speak to a tool and describe nothing.
DIRECTIVES = (
    "@", "go:", "+build", "eslint", "prettier", "biome-ignore", "oxlint", "stylelint", "jshint", "jslint", "global ",
    "type: ignore", "mypy:", "pyright:", "ruff:", "noqa", "-*-", "!/",
)
LONE_URL = r"^https?://\S*$"


def is_directive(comment: Column) -> Column:
    """A comment addressed to a tool, or a lone URL, as against a description."""
    text = F.trim(comment)
    heads = F.exists(F.array(*map(F.lit, DIRECTIVES)), lambda d: text.startswith(d))
    return heads | text.rlike(LONE_URL)


def clean_letters(text: Column) -> Column:
    """Letters of a reading in words that look like words: no digit, all letters of one alphabet, that in which most such letters are.

    Alphabets are told apart as Cyrillic, Latin and other.
    """
    tokens = F.transform(F.regexp_extract_all(text, F.lit(r"(\S+)"), F.lit(1)), lambda t: F.regexp_replace(t, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    plain = F.filter(tokens, lambda t: ~t.rlike(r"\p{N}"))
    letters = F.transform(plain, lambda t: F.regexp_replace(t, r"\P{L}", ""))

    def total(pattern: str) -> Column:
        return F.aggregate(F.filter(letters, lambda t: t.rlike(pattern)), F.lit(0), lambda n, t: n + F.length(t))

    return F.greatest(total(r"^\p{IsLatin}+$"), total(r"^\p{IsCyrillic}+$"), total(r"^[^\p{IsLatin}\p{IsCyrillic}]+$"))


def line_of_offset(text: Column, at: Column) -> Column:
    """1-based line of a character offset."""
    return F.length(F.regexp_replace(F.left(text, at), "[^\n]", "")) + 1
