"""What the corpus operators send, hold and repeat, as tables and settings grow."""

import random
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import documents, grams
from tidemark.llm import line_dedup, ngram_jaccard

SF = "/root/testdata/sf0.001"


class Sent:
    def __init__(self, value):
        self.value = value


def test_jaccard_sends_about_as_much_to_many_places_as_to_few():
    import numpy as np

    texts = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).combine_chunks().to_batches()
    size = sum(b.column(1).nbytes for b in texts)
    sent = {}
    for ranges in (12, 76, 300, 1500, 20000):
        rows = list(ngram_jaccard.cut_into_segments(5, ranges, Sent(np.zeros(0, np.uint64)))(iter(texts)))
        assert all(0 <= p < ranges for r in rows for p in r.column(0).to_pylist())
        sent[ranges] = sum(len(x or b"") for r in rows for c in range(3, 8) for x in r.column(c).to_pylist()) / size
    assert sent[12] < 1.4 and max(sent.values()) < 2.7, sent


def test_jaccard_packs_and_unpacks():
    import numpy as np

    x = ngram_jaccard.kept_bits(np.random.default_rng(1).integers(0, 1 << 64, 5000, dtype=np.uint64))
    for n in (8, 9, 76, 4096, 20000):
        r = ngram_jaccard.range_of(x, n)
        for k in set(r[:50].tolist()):
            assert (ngram_jaccard.unpack(ngram_jaccard.pack(x[r == k], k, n), k, n) == x[r == k]).all()
    docs, counts = ngram_jaccard.entries(np.repeat([3, 5, 9], [700, 1, 255]))
    assert docs.tolist() == [3, 3, 3, 5, 9] and counts.tolist() == [255, 255, 190, 1, 255]
    df = np.arange(2, 10**6, 7)
    rare = ngram_jaccard.rarity(df)
    assert (np.diff(rare.astype(int)) >= 0).all() and rare.max() < ngram_jaccard.HOT_RARITY


def test_jaccard_of_hot_ngrams(spark, monkeypatch):
    """The same groups, whether n-grams are told as hot or not."""
    monkeypatch.setattr(ngram_jaccard, "HOT_LEAST", 2)
    rng = random.Random(9)
    footer = " ".join(f"f{k}" for k in range(40))
    texts = [f"{footer} {' '.join(f'w{rng.randrange(9)}' for _ in range(rng.randrange(9)))}" for _ in range(60)] + [footer] * 5 + [" ".join(f"a{i}x{k}" for k in range(300)) + f" {footer}" for i in range(9)]
    docs = documents(spark, texts)
    assert len(ngram_jaccard.hot_grams(docs.select("doc_id", "text"), 4)) >= 37
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.near_duplicate_components(docs, 4, 85, 100).collect()}
    sets, first = [grams(t, 4) for t in texts], list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((first[a], first[b]))
                first = [x if f == y else f for f in first]
    assert got == {i: (len(sets[i]), first[i]) for i in range(len(texts))}


def test_line_stage_is_linear_in_shared_lines(spark):
    import corpus_pipeline

    footers = [f"footer line {k} that all of them share" for k in range(300)]
    docs = documents(spark, ["\n".join([f"own line {i}", *footers]) for i in range(60)])
    stage = dict(corpus_pipeline.STAGES)["line dedup"]
    line_dedup.line_report(docs).collect()
    took = []
    for f in (line_dedup.line_report, lambda d: stage(spark, d, SF)):
        began = time.perf_counter()
        rows = f(docs).collect()
        took.append(time.perf_counter() - began)
        assert len(rows) == 60
    assert {r.text for r in rows[1:]} | {rows[0].text} == {"\n".join(["own line 0", *footers]), *(f"own line {i}" for i in range(1, 60))}
    assert took[1] < 3 * took[0] + 3


@pytest.mark.parametrize("n", [7, 8, 9])
def test_sites_at_the_threshold(spark, n):
    """A line on so many sites goes from 8 on, whether its sketch or an exact count says so."""
    rows = [(i, f"own {i}\nshared by {n}", f"site{i}") for i in range(n)] + [(100 + i, f"other {i}\nfar beyond", f"s{i}") for i in range(40)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    removed = {r.doc_id: r.n_removed for r in out.collect()}
    assert sum(removed[i] for i in range(n)) == (n - 1 if n >= 8 else 0)
    assert sum(removed[100 + i] for i in range(40)) == 39 and removed[100] == 0


def test_estimates_beyond_the_band_need_no_exact_count(spark):
    """Lines on 16 sites or more, which the sketch alone decides, really are on 8 or more."""
    rows = [(1000 * n + i, f"line on {n}", f"site{i}") for n in range(1, 65) for i in range(n)]
    found = line_dedup.boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    want = {r[0] for r in spark.createDataFrame([(f"line on {n}",) for n in range(8, 65)], "line string").select(F.xxhash64("line")).collect()}
    assert {r.line for r in found.collect()} == want


def test_table_rows_have_all_columns():
    batch = ngram_jaccard.table([{"place": 1, "source": 1, "sigs": b"x"}])
    assert batch.schema.names == ngram_jaccard.NAMES and pa.types.is_int32(batch.schema.field("source").type)
