"""Quality rules: repetition coverage by rolling hashes of several n-gram lengths.

Over all texts of a chunk at once, numpy finds the words, rolls a 64-bit hash over each n-gram
length, sorts the hashes together with the text number and marks the words inside n-grams that a
text holds twice or more. The share of a text's word characters under those marks, and inside
repeated lines, is held against a limit for each length. Memory is bounded by the chunk; nothing is
shuffled.

Defined results: a null or empty text has no words and fails the base; a text of fewer words than
an n-gram has no such n-gram; of lines that are equal the first counts as the original; shares that
tie with a limit pass; repeated rows are judged each; an empty table gives an empty result; further
columns are ignored. Very long texts are handled whole, one at a time, so a text's words must fit a
worker. Words, lines and n-grams are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import sql
from tidemark.llm.batches import map_chunks
from tidemark.llm.textbytes import BLANK_WORDS, TextBytes, byte_class, covered, mix, window_hashes
from tidemark.runtime import ship

#: Largest share of word characters inside repeated n-grams, by n-gram length.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of word characters inside lines equal to an earlier line, and of such lines.
LINE_CHAR_LIMIT = 0.20
LINE_LIMIT = 0.30
SYMBOLS = byte_class(*((ord(c),) * 2 for c in "#*$%&|<>"))
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, dup_line_share double, dup_line_char_share double, dup_ngram_shares map<int,double>"
)


def repeated_words(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """True for each word inside an n-gram that its text holds twice or more, first ones included."""
    w = window_hashes(h, n)
    if not len(w):
        return np.zeros(len(h), bool)
    whole = np.flatnonzero(doc[: len(w)] == doc[n - 1 :])
    key = mix(w[whole] + doc[whole].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    order = np.argsort(key)
    sorted_key = key[order]
    same = sorted_key[1:] == sorted_key[:-1]
    # Direct comparison of the words of neighbours, so that a chance collision doesn't count.
    a, b = whole[order[1:][same]], whole[order[:-1][same]]
    equal = doc[a] == doc[b]
    for i in range(n):
        equal &= h[a + i] == h[b + i]
    starts = np.concatenate([a[equal], b[equal]])
    return covered(len(h), starts, starts + n)


def shares(total: np.ndarray, part: np.ndarray) -> np.ndarray:
    return part / np.maximum(total, 1)


def repetition(texts: TextBytes, lengths: tuple[int, ...]) -> dict:
    """All counts of the texts; see SCHEMA. ngram_chars: by length, characters in repeated n-grams."""
    n_docs = len(texts)
    per_doc = lambda doc, weight=None: np.bincount(doc, weight, n_docs).astype(np.int64)
    starts, ends, doc = texts.words(BLANK_WORDS)
    h = texts.hashes(starts, ends)
    begins_char = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
    chars = begins_char[ends] - begins_char[starts]
    out = {"n_words": per_doc(doc), "word_chars": per_doc(doc, chars)}
    symbols = np.flatnonzero(SYMBOLS[texts.data])
    out["n_symbols"] = per_doc(np.searchsorted(texts.ends, symbols, side="right"))
    out["n_repeat_words"] = per_doc(doc[repeated_words(h, doc, 3)])
    out["ngram_chars"] = {n: per_doc(doc[r], chars[r]) for n in lengths for r in [repeated_words(h, doc, n)]}
    # Lines with a word: ranges between line ends, each with its number of words and characters.
    breaks = np.flatnonzero(texts.data == 10)
    a = np.sort(np.concatenate([texts.starts, breaks + 1]))
    b = np.sort(np.concatenate([texts.ends, breaks]))
    upto = np.concatenate([[0], np.cumsum(chars)])
    first, last = np.searchsorted(starts, a), np.searchsorted(starts, b)
    keep = last > first
    a, b, held = a[keep], b[keep], (upto[last] - upto[first])[keep]
    of = np.searchsorted(texts.ends, a, side="right")
    key = mix(texts.hashes(a, b) + of.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    out["n_lines"], out["n_dup_lines"], out["dup_line_chars"] = per_doc(of), per_doc(of[again]), per_doc(of[again], held[again])
    return out


def quality_rules(
    df: DataFrame, ngram_limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT, line_char_limit: float = LINE_CHAR_LIMIT,
    min_words: int = 50, max_repeat_percent: int = 50, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Base counts, shares of repeated lines and n-grams, and the verdict for every text of df."""
    ship(df.sparkSession)
    limits = dict(sorted((NGRAM_LIMITS if ngram_limits is None else ngram_limits).items()))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        r = repetition(TextBytes(batch.column(1)), tuple(limits))
        base_failed = (r["n_words"] < min_words) | (100 * r["n_repeat_words"] > max_repeat_percent * r["n_words"])
        of_ngrams = {n: shares(r["word_chars"], x) for n, x in r["ngram_chars"].items()}
        of_lines, of_line_chars = shares(r["n_lines"], r["n_dup_lines"]), shares(r["word_chars"], r["dup_line_chars"])
        kept = ~base_failed & (of_lines <= line_limit) & (of_line_chars <= line_char_limit)
        for n, most in limits.items():
            kept &= of_ngrams[n] <= most
        k = len(limits)
        maps = pa.MapArray.from_arrays(
            pa.array(np.arange(0, k * (len(kept) + 1), max(k, 1), dtype=np.int32)[: len(kept) + 1] if k else np.zeros(len(kept) + 1, np.int32)),
            pa.array(np.tile(np.array(list(limits), np.int32), len(kept))),
            pa.array(np.stack(list(of_ngrams.values()), 1).ravel() if k else np.zeros(0)),
        )
        columns = [r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        arrays = [batch.column(0), *map(pa.array, [*columns, base_failed, kept, of_lines, of_line_chars]), maps]
        return pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in SCHEMA.split(", ")])

    return map_chunks(df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")), one, SCHEMA)


def quality_report(df: DataFrame) -> DataFrame:
    """quality_rules with a column for the share of each n-gram length."""
    out = quality_rules(df)
    return out.select("*", *[F.element_at("dup_ngram_shares", F.lit(n)).alias(f"dup_{n}gram_share") for n in NGRAM_LIMITS]).drop("dup_ngram_shares")


def oracle_sql() -> str:
    blank = sql.BLANK_WORDS
    sums = ", ".join(f"sum(chars) FILTER (n = {n}) AS c{n}" for n in NGRAM_LIMITS)
    share = lambda part, whole: f"coalesce({part}, 0) / greatest({whole}, 1)"
    of_ngrams = ", ".join(f"{share(f'c{n}', 'word_chars')} AS dup_{n}gram_share" for n in NGRAM_LIMITS)
    within = " AND ".join(f"dup_{n}gram_share <= CAST({most} AS DOUBLE)" for n, most in NGRAM_LIMITS.items())
    return rf"""
WITH {sql.words("documents", "coalesce(text, '')", blank, "doc_id, coalesce(text, '') AS text", "d")},
repeats AS (SELECT rid, n, i FROM ({sql.windows("d", [3, *NGRAM_LIMITS])}) QUALIFY count(*) OVER (PARTITION BY rid, n, key) > 1),
marked AS (SELECT DISTINCT rid, n, unnest(range(i, i + n)) AS i FROM repeats),
of_words AS (SELECT rid, count(*) FILTER (n = 3) AS n_repeat_words, {sums} FROM (SELECT m.rid, m.n, length(word) AS chars FROM marked m JOIN d USING (rid, i)) GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM d_rows),
held AS (SELECT rid, list_sum(list_transform(regexp_extract_all(line, '{blank}'), lambda x: length(x))) AS chars, row_number() OVER (PARTITION BY rid, line ORDER BY place) > 1 AS again FROM lines WHERE regexp_matches(line, '{blank}')),
of_lines AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (again) AS n_dup_lines, coalesce(sum(chars) FILTER (again), 0) AS line_chars FROM held GROUP BY rid),
base AS (SELECT *, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols FROM d_rows LEFT JOIN of_words USING (rid) LEFT JOIN of_lines USING (rid)),
judged AS (
  SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed, {share("n_dup_lines", "coalesce(n_lines, 0)")} AS dup_line_share, {share("line_chars", "word_chars")} AS dup_line_char_share, {of_ngrams}
  FROM base
)
SELECT *, NOT base_failed AND dup_line_share <= CAST({LINE_LIMIT} AS DOUBLE) AND dup_line_char_share <= CAST({LINE_CHAR_LIMIT} AS DOUBLE) AND {within} AS kept FROM judged
"""
