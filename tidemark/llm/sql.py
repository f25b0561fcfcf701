"""Pieces of DuckDB SQL that the equivalents of the word operators share."""

from __future__ import annotations

# Words between blanks, and words of letters, digits and what isn't ASCII.
BLANK_WORDS = r"[^\x20\x09-\x0D]+"
ALNUM_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: str) -> str:
    """A-Z as a-z, nothing else; null as empty."""
    return f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def words(table: str, text: str, pattern: str, keep: str, name: str) -> str:
    """CTEs: {name}_rows with a rid for each row of the table and its list of words, and {name} with
    a row for each word."""
    return f"""{name}_rows AS (SELECT row_number() OVER () AS rid, {keep}, regexp_extract_all({text}, '{pattern}') AS ws FROM {table}),
{name} AS (SELECT rid, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM {name}_rows)"""


def windows(name: str, lengths: list[int], keep: str = "rid, i") -> str:
    """A select of each run of so many words: length n, first word's place and the words as key."""
    of = lambda n: ", ".join(["word", *(f"lead(word, {k}) OVER w" for k in range(1, n))])
    end = lambda n: f" WINDOW w AS (PARTITION BY rid ORDER BY i) QUALIFY lead(word, {n - 1}) OVER w IS NOT NULL" if n > 1 else ""
    return "\nUNION ALL ".join(f"SELECT {keep}, {n} AS n, concat_ws(' ', {of(n)}) AS key FROM {name}{end(n)}" for n in lengths)
