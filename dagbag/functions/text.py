"""String and date functions, as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def replace(text: Column, patterns: Mapping[str, str]) -> Column:
    """Replace regular expressions one after the other, the last entry first."""
    for pattern, by in reversed(list(patterns.items())):
        text = F.regexp_replace(text, pattern, by)
    return text


def keep_letters(text: Column) -> Column:
    """Everything but ASCII letters becomes a space."""
    return F.regexp_replace(text, "[^A-Za-z]", " ")


def split_camel_case(text: Column) -> Column:
    """Spaces between a small and a capital letter, and before the last capital
    of a run that goes on in small letters."""
    humps = F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")
    return F.regexp_replace(humps, "([A-Z])([A-Z][a-z])", "$1 $2")


def to_lower(text: Column) -> Column:
    return F.lower(text)


def tokenize(text: Column) -> Column:
    """Array of the pieces between single spaces, without empty ones."""
    return F.filter(F.split(text, " "), lambda t: t != "")


def insert(text: Column, pattern: str, content: str, offset: int) -> Column:
    """Put ``content`` into every match of ``pattern``, ``offset`` characters after
    its start.  ``pattern`` must match at least that many characters."""
    quoted = content.replace("\\", "\\\\").replace("$", "\\$")
    parts = F.regexp_extract_all(text, F.lit(f"({pattern})"), 0)
    rest = F.split(text, pattern)
    changed = F.transform(parts, lambda m: F.concat(m.substr(F.lit(1), F.lit(offset)), F.lit(quoted.replace("\\\\", "\\").replace("\\$", "$")), m.substr(F.lit(offset + 1), F.length(m))))
    woven = F.zip_with(rest, changed, lambda r, m: F.concat(F.coalesce(r, F.lit("")), F.coalesce(m, F.lit(""))))
    return F.array_join(woven, "")


def epoch_to_timestamp(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def iso_instant(seconds: Column) -> Column:
    """``2024-01-31T12:00:00Z`` in the session's time zone."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def message_tokens(message: Column) -> Column:
    """Lower-case words of a commit message: letters only, camel case split."""
    return tokenize(F.lower(split_camel_case(keep_letters(message))))


def is_fix(message: Column) -> Column:
    """Whether a word contains "fix" and neither "prefix" nor "postfix"."""
    hit = lambda t: t.contains("fix") & ~t.contains("prefix") & ~t.contains("postfix")
    return F.exists(message_tokens(message), hit)


def mentions_issue(message: Column) -> Column:
    """Whether one of the words is "issue" or "issues"."""
    return F.exists(message_tokens(message), lambda t: t.isin("issue", "issues"))


def lines(text: Column) -> Column:
    """Array of lines; a line feed at the end doesn't start another one."""
    return F.split(F.regexp_replace(text, "\\r?\\n\\z", ""), "\\r?\\n")


def java_complexity(source: Column) -> Column:
    """Decision points of Java source text, an approximation without a parser.

    Comments, strings and characters are blanked, then ``while``, ``case``,
    ``catch``, ``try``, ``for``, ``do``, ``if`` and the conditional operator are
    counted; the ``while`` that ends a do-loop is counted with its ``do`` only.
    """
    plain = F.regexp_replace(source, r'(?s)/\*.*?\*/|//[^\n]*|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'', " ")
    plain = F.regexp_replace(plain, r"<\s*\?|\?\s*(?:>|,|extends\b|super\b)", " ")  # wildcards of generics
    words = F.regexp_count(plain, F.lit(r"\b(?:while|case|catch|try|for|do|if)\b|\?"))
    closing = F.regexp_count(plain, F.lit(r"\bdo\b"))
    return (words - closing).cast("bigint")
