"""Pieces of SQL that several comparison queries share. They are read by an engine whose regular expressions are RE2."""

from __future__ import annotations

from scanloom.functions.patterns import LINE_END, SPACE, WORD  # noqa: F401


def q(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("'", "''") + "'"


def strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, {q(f'^[{SPACE}]+')}, ''), {q(f'[{SPACE}]+$')}, '')"


def lines(c: str) -> str:
    return f"(CASE WHEN {c} = '' THEN CAST([] AS VARCHAR[]) ELSE regexp_split_to_array(regexp_replace({c}, {q(f'(?:{LINE_END})$')}, ''), {q(LINE_END)}) END)"


def words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, {q(f'[{SPACE}]+')}), lambda w: w <> '')"


def replace_all(c: str, pattern: str, by: str) -> str:
    return f"regexp_replace({c}, {q(pattern)}, {q(by)}, 'g')"
