"""Language identification by error-correcting output codes.

Each language has a codeword of +1 and -1. For each bit a binary n-gram classifier tells languages
with +1 from those with -1: its weight of an n-gram is the logarithm of the ratio of the n-gram's
mean frequencies in the two groups. A text's bit value is the mean weight of its byte n-grams; the
codeword with the least sum of logistic losses over the bits is chosen, and a text whose two nearest
codewords lie close is flagged as ambiguous.

The classifiers learn from a bounded sample of labelled rows: about max_docs_per_lang rows of each
language (parameter), chosen by a hash of doc_id among the rows with a label whose crc32 isn't held
out. Language, source and doc_id are never inputs of a prediction. Prediction covers every whole
text.

Defined results: `und` with score 0 for a null text, a text without a letter, or when nothing could
be learned; a null doc_id counts as the empty text for the fold; repeated rows are predicted each;
rows with a null language or text teach nothing; codewords at equal loss tie, which flags the text as
ambiguous and gives it the first language in the order of names; very long texts are counted whole, in
blocks; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import chunks, map_chunks, release
from tidemark.llm.textbytes import TextBytes
from tidemark.runtime import ship

UNDETERMINED = "und"
#: Rows of a language that are learned from, about.
MAX_DOCS_PER_LANG = 1500
#: Lengths of byte n-grams, and the number of buckets that they are hashed to.
ORDERS = (2, 3, 4)
BUCKETS = 1 << 12
#: Bytes whose n-grams are counted at once.
BLOCK = 1 << 19
#: Texts whose counts are held at once.
ROWS = 256
#: The steepness of the loss for a mean weight, and the margin of loss below which a text is
#: ambiguous.
SCALE = 12.0
AMBIGUOUS = 0.05
LETTER = re.compile(r"[^\W\d_]")
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"


def has_letter(text: str | None) -> bool:
    """Whether a text has a character of a letter category. The pattern finds letters and some
    numbers; those are told apart one by one."""
    return text is not None and any(m.group().isalpha() for m in LETTER.finditer(text))


def ngram_counts(texts: TextBytes) -> np.ndarray:
    """Counts of hashed byte n-grams, a row for each text and BUCKETS columns for each order. The
    bytes are handled in blocks, so that a long text takes no more memory than short ones; an n-gram
    belongs to the block of its first byte."""
    out = np.zeros((len(texts), BUCKETS * len(ORDERS)))
    total = len(texts.data)
    for start in range(0, total, BLOCK):
        stop = min(start + BLOCK, total)
        a, b = np.searchsorted(texts.ends, start, side="right"), np.searchsorted(texts.ends, stop - 1, side="right") + 1
        inside = np.minimum(texts.ends[a:b], stop) - np.maximum(texts.starts[a:b], start)
        doc = np.repeat(np.arange(b - a), inside)
        left = np.repeat(texts.ends[a:b], inside) - np.arange(start, stop)
        d = texts.data[start : min(stop + max(ORDERS) - 1, total)].astype(np.uint32)
        code = d
        for k, order in enumerate(ORDERS):
            m = len(d) - order + 1
            if m <= 0:
                break
            code = (code[:m] << np.uint32(8)) | d[order - 1 :]
            m = min(m, stop - start)
            bucket = ((code[:m] * np.uint32(0x9E3779B1)) >> np.uint32(32 - 12)).astype(np.int64)
            counts = np.bincount((doc[:m] * BUCKETS + bucket)[left[:m] >= order], minlength=(b - a) * BUCKETS)
            out[a:b, k * BUCKETS : (k + 1) * BUCKETS] += counts.reshape(b - a, BUCKETS)
    return out


def codewords(k: int) -> np.ndarray:
    """k rows of +1 and -1. Up to five languages get every split of them in two; more get the best
    of some random codes, by their least distance."""
    if k == 1:
        return np.ones((1, 1))
    if k <= 5:
        splits = range(1, 1 << (k - 1))
        return np.array([[1 if (s >> i) & 1 else -1 for s in splits] for i in range(k)], float)
    rng, n_bits, best, best_d = np.random.default_rng(7), int(np.ceil(15 * np.log2(k))), None, -1
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (k, n_bits))
        code[:, np.abs(code.sum(0)) == k] *= np.where(np.arange(k) % 2, 1, -1)[:, None]
        near = np.where(np.eye(k, dtype=bool), -n_bits, code @ code.T).max()
        if n_bits - near > best_d:
            best, best_d = code, n_bits - near
    return best


class Model:
    """langs: the learned values; code: their codewords; weights: of each n-gram for each bit."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        self.code = codewords(len(langs)) if langs else np.zeros((0, 0))
        rates = np.concatenate([(p := c + 0.5) / p.sum(1, keepdims=True) for c in np.split(counts, len(ORDERS), axis=1)], 1)
        bits = []
        for b in self.code.T:
            ones, others = rates[b > 0], rates[b < 0]
            bits.append(np.log(ones.mean(0)) - np.log(others.mean(0)) if len(ones) and len(others) else np.zeros(rates.shape[1]))
        self.weights = np.stack(bits, 1) if bits else np.zeros((counts.shape[1], 0))

    def decode(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest language of each row, its score and whether the two nearest lie close."""
        value = SCALE * (counts @ self.weights) / np.maximum(counts.sum(1, keepdims=True), 1)
        loss = np.logaddexp(0, -value[:, None, :] * self.code[None]).sum(2)
        best = loss.argmin(1)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        score = 1 / p.sum(1)
        if len(self.langs) < 2:
            return best, score, np.zeros(len(best), bool)
        two = np.partition(loss, 1, axis=1)[:, :2]
        return best, score, (two[:, 1] - two[:, 0]) < AMBIGUOUS


def learn(df: DataFrame, max_docs_per_lang: int = MAX_DOCS_PER_LANG) -> Model:
    """The model of a bounded sample of df(doc_id, text, lang), held-out rows left out."""
    from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

    rows = df.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id"))
    totals = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not totals:
        return Model([], np.zeros((0, BUCKETS * len(ORDERS))))
    share = F.create_map(*[F.lit(x) for lang, n in totals.items() for x in (lang, min(1.0, max_docs_per_lang / n))])
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.filter(place < share[F.col("lang")]).select("lang", "text")

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in chunks(batch, rows=ROWS):
                langs = np.array(part.column(0).to_pylist(), object)
                counts = ngram_counts(TextBytes(part.column(1), lower=True))
                counts /= np.maximum(counts.sum(1, keepdims=True), 1)
                for lang in set(langs):
                    held[lang] = held.get(lang, 0) + counts[langs == lang].sum(0)
        for lang, c in held.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], ["lang", "bucket", "n"])
        release()

    schema = StructType([StructField("lang", StringType()), StructField("bucket", IntegerType()), StructField("n", DoubleType())])
    # At most (number of languages) x (number of buckets) rows, whatever the input.
    summed = sample.mapInArrow(count, schema).groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(summed["lang"].unique())
    counts = np.zeros((len(langs), BUCKETS * len(ORDERS)))
    counts[np.searchsorted(np.array(langs, object), summed["lang"].to_numpy(object)), summed["bucket"]] = summed["n"]
    return Model(langs, counts * 1000)


def held_out(id_col: str):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def identify(df: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous of every row of df(doc_id, text, lang)."""
    spark = df.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(learn(df) if model is None else model)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, n = sent.value, batch.num_rows
        known = np.array([has_letter(x) for x in batch.column(2).to_pylist()], bool)
        lang, score, unclear = [UNDETERMINED] * n, np.zeros(n), np.zeros(n, bool)
        if m.langs and known.any():
            at = np.flatnonzero(known)
            best, s, u = m.decode(ngram_counts(TextBytes(batch.column(2).take(pa.array(at)), lower=True)))
            score[at], unclear[at] = s, u
            for i, b in zip(at.tolist(), best.tolist(), strict=True):
                lang[i] = m.langs[b]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score), pa.array(unclear)], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return map_chunks(df.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), "text"), one, SCHEMA, rows=ROWS)


def keep_identified(df: DataFrame, model: Model | None = None, least_score: float = 0.5) -> DataFrame:
    """The rows of df(doc_id, text, lang, ...) whose language is clear: not und, not ambiguous and
    with at least this score; their columns stay as they are."""
    spark = df.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(learn(df) if model is None else model)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, text = sent.value, batch.column("text")
        clear = np.array([has_letter(x) for x in text.to_pylist()], bool)
        at = np.flatnonzero(clear)
        if not m.langs:
            clear[:] = False
        elif len(at):
            _, score, unclear = m.decode(ngram_counts(TextBytes(text.take(pa.array(at)), lower=True)))
            clear[at] = (score >= least_score) & ~unclear
        return batch.filter(pa.array(clear))

    return map_chunks(df, one, df.schema, rows=ROWS)
