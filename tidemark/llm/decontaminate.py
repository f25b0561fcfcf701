"""Benchmark decontamination by Wu-Manber search over words.

Texts and items become sequences of lower-cased words with 64-bit hashes. The test strings are the
windows of an item. For each length m of window, a shift table over blocks of two words (one, where m
is 1) tells how far a search position can move: m - 1 when the block is in no window, less when it ends
earlier in one. Positions are cut into lanes that move together in numpy. Where the shift is 0, the
hash of the window's last words picks a bucket of test strings, and a direct comparison of the words,
byte by byte, confirms an occurrence.

Items are taken in blocks of at most BLOCK_BYTES of text (one item is never cut). The tables of a block
are sorted arrays of about 12 bytes for a byte of text; they are built once, on the driver, and sent to
each Python worker once. A larger benchmark takes more searches, one after another: the documents and
their hits so far are written to the shared folder between two, so only one block's tables are in
memory at any time.

Defined results: null or empty texts have no words and are never hit; very long texts are searched
whole, one at a time; items without words or with a null text have no windows; items with a null
item_id count in n_hit and contaminated and drop documents, but are in no list or number of items (the
SQL, and benchmark_hits without unnamed, leave them out); items of fewer words than a window are one
window; items tie by item_id, so repeated ones count once; repeated documents are searched each; an
empty documents or benchmark table gives no hits; further columns are ignored, or kept as they are
where documents themselves are returned (benchmark_hits replaces columns with the names of its results).
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import sql
from tidemark.llm.batches import map_chunks
from tidemark.llm.names import keeping
from tidemark.llm.textbytes import ALNUM_WORDS, TextBytes, covered, equal_ranges, mix
from tidemark.runtime import settle, ship

WINDOW = 10
#: Text of the items whose tables are on the executors at once.
BLOCK_BYTES = 4 << 20
#: Search positions of a lane.
LANE = 256


def suffix_hashes(h: np.ndarray, first: np.ndarray, m: int) -> np.ndarray:
    """A hash of the last four of the m words from each place on."""
    out = np.zeros(len(first), np.uint64)
    for i in range(max(0, m - 4), m):
        out = mix(out * np.uint64(0x9E3779B97F4A7C17) + h[first + i])
    return out


class Tables:
    """Shift table and suffix buckets of the windows of one length, given as places of first words."""

    def __init__(self, m: int, h: np.ndarray, windows: np.ndarray):
        self.m, self.block = m, min(2, m)
        self.most = m - self.block + 1
        # The shift of a block: from the last place where it ends in any window to the window's end.
        keys, shifts = np.zeros(0, np.uint64), np.zeros(0, np.int16)
        for far in range(self.most):
            found = np.setdiff1d(self.blocks(h, windows + m - 1 - far), keys)
            keys, shifts = np.concatenate([keys, found]), np.concatenate([shifts, np.full(len(found), far, np.int16)])
            order = np.argsort(keys)
            keys, shifts = keys[order], shifts[order]
        self.keys, self.shifts = keys, shifts
        # A first look by 16 bits of the block spares most searches of the sorted keys.
        self.near = np.full(1 << 16, False)
        self.near[(keys >> np.uint64(48)).astype(np.int64)] = True
        suffix = suffix_hashes(h, windows, m)
        order = np.argsort(suffix, kind="stable")
        self.suffix, self.windows = suffix[order], windows[order]

    def blocks(self, h: np.ndarray, last: np.ndarray) -> np.ndarray:
        """A hash of the block that ends at each word."""
        return mix(h[last - 1] + np.uint64(0x632BE59BD9B4E019) * h[last]) if self.block > 1 else mix(h[last])

    def shift(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How far each position (of a window's last word) can move on; 0 where a window may end."""
        block = self.blocks(h, at)
        out = np.full(len(at), self.most, np.int64)
        maybe = np.flatnonzero(self.near[(block >> np.uint64(48)).astype(np.int64)])
        if len(maybe):
            where = np.minimum(np.searchsorted(self.keys, block[maybe]), len(self.keys) - 1)
            found = self.keys[where] == block[maybe]
            out[maybe[found]] = self.shifts[where[found]]
        return out

    def candidates(self, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words of places inside one text, and of test strings in the bucket of each."""
        m, none = self.m, np.zeros(0, np.int64)
        if len(h) < m:
            return none, none
        at = np.arange(m - 1, len(h), LANE)
        stop = np.minimum(at + LANE, len(h))
        ends = []
        while len(at):
            s = self.shift(h, at)
            ends.append(at[s == 0])
            at = at + np.maximum(s, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        ends = np.concatenate(ends)
        first = ends - m + 1
        first = first[doc[first] == doc[ends]]
        suffix = suffix_hashes(h, first, m)
        low, high = np.searchsorted(self.suffix, suffix), np.searchsorted(self.suffix, suffix, side="right")
        n = high - low
        return np.repeat(first, n), self.windows[np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]


class Block:
    """The words of some items, the item of each, and the tables of their windows by length."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        texts = TextBytes(pa.array([t for _, t in items], pa.string()), lower=True)
        self.data, self.ids = texts.data, [i for i, _ in items]
        self.starts, self.ends, self.item = texts.words(ALNUM_WORDS)
        h = texts.hashes(self.starts, self.ends)
        n_words = np.bincount(self.item, minlength=len(items))
        first = np.cumsum(n_words) - n_words
        m = np.minimum(n_words, window)
        place = np.arange(len(h)) - first[self.item]
        starts_window = place <= (n_words - m)[self.item]
        self.tables = [Tables(int(k), h, np.flatnonzero(starts_window & (m[self.item] == k))) for k in np.unique(m[m > 0])]
        self.nbytes = sum(x.nbytes for x in (self.data, self.starts, self.ends, self.item)) + sum(x.nbytes for t in self.tables for x in (t.keys, t.shifts, t.near, t.suffix, t.windows))

    def search(self, texts: TextBytes, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, doc: np.ndarray):
        """Length, first words and items' numbers of the occurrences, by length of window."""
        for t in self.tables:
            at, window = t.candidates(h, doc)
            for i in range(t.m):
                same = equal_ranges(texts.data, starts[at + i], ends[at + i], self.data, self.starts[window + i], self.ends[window + i])
                at, window = at[same], window[same]
            yield t.m, at, self.item[window]


def search_block(docs: DataFrame, block: Block, text_col: str) -> DataFrame:
    """docs with what this block of items hits added to its columns hits and items; n_words is set."""
    sent = docs.sparkSession.sparkContext.broadcast(block)
    names = docs.columns

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        block, texts = sent.value, TextBytes(batch.column(text_col), lower=True)
        starts, ends, doc = texts.words(ALNUM_WORDS)
        first_word = np.searchsorted(doc, np.arange(len(texts) + 1))
        hits, held = batch.column("hits").to_pylist(), batch.column("items").to_pylist()
        spans: dict[int, list[np.ndarray]] = defaultdict(list)
        owners: dict[int, set] = defaultdict(set)
        for m, at, item in block.search(texts, starts, ends, texts.hashes(starts, ends), doc):
            pairs = np.unique(np.stack([doc[at], item], 1), axis=0)
            for d, i in pairs.tolist():
                owners[d] |= set() if block.ids[i] is None else {block.ids[i]}
            at = np.unique(at)
            of, start = np.unique(doc[at], return_index=True)
            for d, part in zip(of.tolist(), np.split(at, start[1:]), strict=True) if len(at) else ():
                spans[d].append(np.stack([part, part + m], 1) - first_word[d])
        for d, found in spans.items():
            at = np.concatenate(found)
            more = np.flatnonzero(covered(int(first_word[d + 1] - first_word[d]), at[:, 0], at[:, 1])).tolist()
            hits[d], held[d] = sorted({*hits[d], *more}), sorted({*held[d], *owners[d]})
        new = {"hits": pa.array(hits, pa.list_(pa.int32())), "items": pa.array(held, pa.list_(pa.string())), "n_words": pa.array(np.diff(first_word).astype(np.int64))}
        return pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in names], names)

    return map_chunks(docs, one, docs.schema, text=text_col)


def benchmark_hits(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", block_bytes: int = BLOCK_BYTES, unnamed: bool = False) -> DataFrame:
    """documents with hits (numbers of the words inside occurrences, ascending), items (ids of the
    items with occurring windows, sorted as strings) and n_words. With unnamed, items without an
    item_id are searched too, and add to the hits alone."""
    ship(documents.sparkSession)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").dropna(subset=["text"] if unnamed else None)
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = -(-size // block_bytes) or 1
    out = documents.withColumns({"hits": F.expr("cast(array() as array<int>)"), "items": F.expr("cast(array() as array<string>)"), "n_words": F.lit(0).cast("long")})
    for k in range(n_blocks):
        part = items if n_blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k)
        # A block of bounded size, one at a time.
        out = search_block(out, Block([tuple(r) for r in part.collect()], window), text_col)
        if k < n_blocks - 1:
            out = settle(out, "searched")
    return out


def clean_documents(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any occurrence of a benchmark window, with their own columns."""
    return keeping(documents, ("hits", "items", "n_words"), lambda d: benchmark_hits(d, benchmark, window, unnamed=True).filter(F.size("hits") == 0))


def decontamination_report(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """benchmark_hits as counts and a digest."""
    found = benchmark_hits(documents.select("doc_id", "text"), benchmark, window, unnamed=True)
    return found.select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


def oracle_sql(window: int = WINDOW) -> str:
    lengths = list(range(1, window + 1))
    return f"""
WITH {sql.words("documents", sql.lowered("text"), sql.ALNUM_WORDS, "doc_id", "d")},
{sql.words("(SELECT * FROM benchmark WHERE item_id IS NOT NULL)", sql.lowered("text"), sql.ALNUM_WORDS, "CAST(item_id AS VARCHAR) AS item_id", "b")},
tests AS (SELECT DISTINCT item_id, n, key FROM ({sql.windows("b", lengths)}) JOIN b_rows USING (rid) WHERE n = least(len(ws), {window})),
found AS (SELECT x.rid, x.i, x.n, t.item_id FROM ({sql.windows("d", lengths)}) x JOIN tests t USING (n, key)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM found)) GROUP BY rid),
owned AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT rid, item_id FROM found) GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d_rows LEFT JOIN hit USING (rid) LEFT JOIN owned USING (rid)
"""
