"""Token counts by heap-and-linked-list byte-pair merging.

Each pretoken starts as a linked list of byte symbols. A heap holds the rank of every adjacent
pair; the lowest rank is popped, the pair is merged in the list, and the two new neighbours enter
the heap. The count is the number of initial symbols less the number of merges, so that no list of
identifiers is made. A pretoken of n bytes takes O(n log n), however long it is.

Defined results: a null or empty text has 0 bytes and 0 tokens; a special string inside a text is
one token, as by the tokenizer's default; very long texts are counted whole; pairs of one rank tie and
merge from the left; rows that repeat are counted each; an empty table gives an empty result; further
columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterable
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidemark.llm.batches import map_chunks
from tidemark.runtime import ship

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Pretokens whose counts a worker remembers; it forgets them all when there are more.
MEMO = 1_000_000
#: Texts longer than this are pretokenised piece by piece, without a list of all pretokens.
LONG_TEXT = 4 << 20
#: The first code point that Unicode leaves unassigned.
NARROW = 0x378
#: Of a heap entry: all but the position.
KEEP = ~(0xFFFFF << 20)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: printable Latin-1 bytes
    stand for themselves, the others get the code points from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranges(points: Iterable[int]) -> str:
    """The body of a character class for these ascending code points."""
    runs: list[list[int]] = []
    for c in points:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in runs)


@lru_cache(1)
def unsettled() -> frozenset[str]:
    """Code points that this Python's Unicode tables leave unassigned: pattern libraries with newer
    tables disagree about their classes."""
    return frozenset(chr(c) for c in range(NARROW, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cn")


def narrowed(pattern: str) -> re.Pattern:
    """The same pattern for texts of code points below NARROW, whose classes are settled, with the
    classes spelt out for the standard library's faster engine."""
    import regex

    out, inside = [], False
    for part in re.findall(r"\\p\{\w+\}|\\.|.", pattern):
        if re.fullmatch(r"\\p\{\w+\}|\\[sS]", part):
            test = regex.compile(part)
            body = ranges(c for c in range(NARROW) if test.match(chr(c)))
            part = body if inside else f"[{body}]"
        elif part in "[]":
            inside = part == "["
        out.append(part)
    return re.compile("".join(out))


class Merger:
    """Pair ranks of a byte-level vocabulary, over symbol numbers."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        stand_in = byte_alphabet()
        self.specials = [t["content"] for t in spec["added_tokens"]]
        number = {bytes([b]): b for b in range(256)}
        # left << 20 | right -> rank << 40 | merged symbol
        self.pairs: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = (bytes(stand_in[c] for c in x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            merged = number.setdefault(left + right, len(number))
            self.pairs.setdefault(number[left] << 20 | number[right], rank << 40 | merged)
        self.of_bytes = [self.pairs.get(a << 20 | b, -1) for a in range(256) for b in range(256)]

    def count(self, word: bytes) -> int:
        """Initial symbols minus merges. A heap entry is rank, position and merged symbol in one
        number; an entry that no longer fits the list is skipped."""
        n = len(word)
        if n < 2:
            return n
        if n >= 1 << 20:
            return self.count_long(word)
        of_bytes, pairs, symbol = self.of_bytes, self.pairs.get, [*word, -1]
        heap = [r | i << 20 for i, (a, b) in enumerate(zip(word, word[1:], strict=False)) if (r := of_bytes[a << 8 | b]) >= 0]
        if not heap:
            return n
        heapify(heap)
        ahead, back, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
        while heap:
            top = heappop(heap)
            i = (top >> 20) & 0xFFFFF
            a, j = symbol[i], ahead[i]
            if a < 0 or (b := symbol[j]) < 0 or pairs(a << 20 | b) != top & KEEP:
                continue
            merged = top & 0xFFFFF
            symbol[i], symbol[j] = merged, -1
            k = ahead[i] = ahead[j]
            left -= 1
            if k < n:
                back[k] = i
                if (r := pairs(merged << 20 | symbol[k])) is not None:
                    heappush(heap, r | i << 20)
            h = back[i]
            if h >= 0 and (r := pairs(symbol[h] << 20 | merged)) is not None:
                heappush(heap, r | h << 20)
        return left

    def count_long(self, word: bytes) -> int:
        """count for positions that don't fit 20 bits: entries are tuples."""
        pairs, n, symbol = self.pairs.get, len(word), [*word, -1]
        heap = [(r, i) for i, (a, b) in enumerate(zip(word, word[1:], strict=False)) if (r := self.of_bytes[a << 8 | b]) >= 0]
        heapify(heap)
        ahead, back, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
        while heap:
            top, i = heappop(heap)
            a, j = symbol[i], ahead[i]
            if a < 0 or (b := symbol[j]) < 0 or pairs(a << 20 | b) != top:
                continue
            merged = top & 0xFFFFF
            symbol[i], symbol[j] = merged, -1
            k = ahead[i] = ahead[j]
            left -= 1
            if k < n:
                back[k] = i
                if (r := pairs(merged << 20 | symbol[k])) is not None:
                    heappush(heap, (r, i))
            h = back[i]
            if h >= 0 and (r := pairs(symbol[h] << 20 | merged)) is not None:
                heappush(heap, (r, h))
        return left


class Counter(dict):
    """Token counts of pretokens and texts; a dictionary of the pretokens met so far."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.merger = merger(path)
        self.split, self.split_narrow = regex.compile(pattern), narrowed(pattern)
        self.wide = re.compile(f"[{chr(NARROW)}-{chr(sys.maxunicode)}]")
        self.special = re.compile("|".join(map(re.escape, self.merger.specials))) if self.merger.specials else None
        self.path = path

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        n = self[word] = self.merger.count(word.encode())
        return n

    def plain(self, text: str) -> int:
        split = self.split_narrow
        if self.wide.search(text):
            split = self.split
            if not unsettled().isdisjoint(self.wide.findall(text)):
                return sum(self[text[a:b]] for _, (a, b) in library(self.path).pre_tokenizer.pre_tokenize_str(text))
        if len(text) > LONG_TEXT:
            return sum(self[m.group()] for m in split.finditer(text))
        return sum(map(self.__getitem__, split.findall(text)))

    def text(self, text: str) -> int:
        if not self.special or not self.special.search(text):
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self.plain(x) for x in parts if x)


@lru_cache(4)
def merger(path: str) -> Merger:
    return Merger(path)


@lru_cache(4)
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(4)
def counter(path: str, pattern: str) -> Counter:
    return Counter(path, pattern)


def count_tokens(df: DataFrame, path: str, pattern: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than limit tokens) of every text of df."""
    ship(df.sparkSession)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        count = counter(path, pattern)
        text = pc.fill_null(batch.column(1), "")
        n = [count.text(x) for x in text.to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pc.cast(pc.binary_length(text), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"))
    return map_chunks(rows, one, SCHEMA)
