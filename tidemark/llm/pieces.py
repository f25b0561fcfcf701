"""SentencePiece encoding and decoding over a distinct-chunk table.

In a vocabulary where no piece has a whitespace marker after another character, merges never cross
the start of a run of markers. So a text is cut into marked words (a run of markers and what
follows). The marked words of a batch are dictionary-encoded by their bytes: its table of distinct
words is segmented once by the library, but for words that the worker knows from earlier batches, and
the ids are joined back by position with array indexing. What a worker knows is bounded: it is emptied
when full, so that memory doesn't grow with the corpus.

Defined results: a null or empty text has the begin and end ids alone and decodes to the empty
text; very long texts are encoded whole, one at a time; rows that repeat are encoded each; an empty
table gives an empty result; further columns are ignored. A vocabulary with crossing pieces is
refused, and so is one whose normaliser changes more than the marker before a text (PROBES).
"""

from __future__ import annotations

import hashlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidemark.llm.batches import map_chunks
from tidemark.runtime import ship

MARK = "▁"
SPACE = 0x20
DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
CODES_SCHEMA = "doc_id long, ids array<int>, n_tokens long, decoded string"
#: Marked words that a worker knows.
MEMO = 400_000
#: Texts that a normaliser would change: blanks in a row and at the ends, tabs, compatibility forms,
#: full-width and combining characters, control characters.
PROBES = ("a", " a", "a ", "  a  b   c ", "a\tb\n c", "ﬁ ① Ａ ｶﾞ", "e\u0301 é", "a\u00a0b\u3000c", "\u200b x\ufeff", "\x01 b\x00", "字 😀")


class ChunkTable(dict):
    """Marked word -> its ids as unsigned 32-bit integers."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece of this vocabulary crosses a whitespace marker")
        self.begin, self.end = self.model.bos_id(), self.model.eos_id()
        self.alone = array("I", [self.model.piece_to_id(MARK)]).tobytes()
        ids, offsets = self.encode(pa.array(PROBES))
        for i, text in enumerate(PROBES):
            if ids[offsets[i] : offsets[i + 1]].tolist() != self.model.encode(text, add_bos=True, add_eos=True):
                raise ValueError("the normaliser of this vocabulary changes texts before they are cut")

    def learn(self, words: list[str]) -> None:
        """Segment those words that aren't known, in one call of the library."""
        new = [w for w in words if w not in self]
        if len(self) + len(new) > MEMO:
            self.clear()
            new = words
        # The library puts one marker before what it is given, so it gets a word without its first.
        found = self.model.encode([w[1:].replace(" ", MARK) for w in new], num_threads=1) if new else []
        self.update((w, array("I", ids).tobytes() if len(w) > 1 else self.alone) for w, ids in zip(new, found, strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch of texts, with begin and end, and where each text's ids begin."""
        texts = pc.replace_substring(pc.fill_null(texts, "").cast(pa.large_string()), MARK, " ")
        first, n = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1 + texts.offset)[texts.offset :], len(texts)
        size = np.diff(first)
        # Each text that isn't empty gets a marker before it; blanks stand for markers.
        starts = np.cumsum(size + (size > 0)) - size - (size > 0)
        data = np.full(int(first[-1] - first[0]) + int((size > 0).sum()), SPACE, np.uint8)
        inside = np.ones(len(data), bool)
        inside[starts[size > 0]] = False
        if texts.buffers()[2] is not None:
            data[inside] = np.frombuffer(texts.buffers()[2], np.uint8)[first[0] : first[-1]]
        blank = data == SPACE
        begins = blank.copy()
        begins[1:] &= ~blank[:-1]
        begins[starts[size > 0]] = True
        begins = np.flatnonzero(begins)
        words = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(np.append(begins, len(data)).astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
        # The table of distinct words, and the ids of each by its number.
        distinct = words.dictionary.to_pylist()
        self.learn(distinct)
        known = [self[w] for w in distinct]
        lengths = np.array([len(x) for x in known], np.int64) // 4
        ids = np.frombuffer(b"".join(known), np.uint32)
        number = words.indices.to_numpy()
        n_ids = lengths[number]
        total = int(n_ids.sum())
        of_text = np.searchsorted(starts, begins, side="right") - 1
        offsets = np.concatenate([[0], np.cumsum(np.bincount(of_text, n_ids, n).astype(np.int64) + 2)])
        out = np.empty(int(offsets[-1]), "<u4")
        out[offsets[:-1]], out[offsets[1:] - 1] = self.begin, self.end
        from_ = (np.cumsum(lengths) - lengths)[number]
        step = np.arange(total)
        out[step + np.repeat(2 * of_text + 1, n_ids)] = ids[step + np.repeat(from_ - np.cumsum(n_ids) + n_ids, n_ids)]
        return out, offsets

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        return [self.model.decode(ids[a:b].tolist()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


@lru_cache(2)
def chunk_table(path: str) -> ChunkTable:
    return ChunkTable(path)


def encode_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the number of ids, the digest of the ids and that of the decoded text."""
    ship(df.sparkSession)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = chunk_table(path)
        ids, offsets = table.encode(batch.column(1))
        sha = lambda x: hashlib.sha256(x).hexdigest()
        of_ids = [sha(ids[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        of_text = [sha(x.encode()) for x in table.decode(ids, offsets)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_chunks(df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")), one, DIGEST_SCHEMA, done=lambda: chunk_table(path).clear())


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the ids themselves and the text decoded from them."""
    ship(df.sparkSession)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = chunk_table(path)
        ids, offsets = table.encode(batch.column(1))
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
        return pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(np.diff(offsets)), pa.array(table.decode(ids, offsets), pa.string())], ["doc_id", "ids", "n_tokens", "decoded"])

    return map_chunks(df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")), one, CODES_SCHEMA, done=lambda: chunk_table(path).clear())
