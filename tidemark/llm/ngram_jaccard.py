"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams is that of their 64-bit hashes; it is cut into fragments. Each fragment
gets the segments of all documents that fall into it, as arrays. There the number of documents of
every n-gram is counted exactly, and n-grams of one document alone, which can't be shared, go. What
is left is sent back to its document. A document can only have a partner if the n-grams it shares
with anyone reach the threshold alone; most documents end here.

For the others, rarest n-grams first, a prefix must hold an n-gram in common with any partner. The
documents are compared in two rounds. The first is a quick one, to put most of a group together:
documents that agree in a band of their least n-grams are compared with one among them. The second is
exact: documents that meet in a prefix n-gram and are in different components so far are compared, as
far as sizes, shared counts, places in the prefix and bitmaps allow a link. Of a pair that links, the
document with fewer n-grams of its own is light (see light), and one isn't in the list's largest
component, so neither the others nor that component's members are paired among themselves.
Comparison counts the overlap of each fragment separately and sums per pair. A large group of near
copies isn't expanded into its pairs, but every link between components is found.

Documents with equal n-gram sets are one node from the first step on, however many there are. N-grams
that a large share of all documents hold (hot_grams) aren't sent to a fragment, where each would make
one list of all of these documents: they are known to be shared, come last in the order of rarity and
go straight to their documents. Which n-grams count as hot changes the work, never the result.

Defined results: null texts and texts without words have no n-grams, n_shingles 0 and are alone; a
text of fewer than n words has its whole sequence as its one n-gram; very long texts are taken whole,
one at a time; repeated rows are copies of each other, and equal sets tie: the smallest doc_id names
the group; a null doc_id takes part and is never the smallest unless all are null; an empty table
gives an empty result; further columns are ignored. Equality of n-grams is that of 52 bits of a hash,
equality of sets that of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import sql
from tidemark.llm.batches import chunks, release
from tidemark.llm.components import components
from tidemark.llm.textbytes import BLANK_WORDS, TextBytes, mix, window_hashes
from tidemark.runtime import settle, ship

#: Fragments of the global order in which a pair's overlaps are counted separately.
FRAGMENTS = 4
#: Parts of a range whose n-grams are counted one after another.
PARTS = 4
U64 = np.uint64
#: Keys that the rows of one set are spread over.
SALTS = 8
#: Bits of a hash that n-grams are told apart by from the first step on.
BITS_KEPT = 52
#: n-grams of one in so many documents are hot, and of so many at least; the list has a bounded length.
HOT_SHARE, HOT_LEAST, HOT_MOST = 256, 1000, 1 << 16
#: Rarity is one byte, that of hot n-grams the last one.
HOT_RARITY = 255
#: Rows between steps. source: the place whose range the n-grams lie in, HOT for numbers of hot ones,
#: SIZES for the sizes of sets; null for ids, which may be at any place.
SEGMENTS = "place int, source int, members array<bigint>, sigs binary, sizes binary, counts binary, grams binary, rarity binary"
NAMES = [x.split()[0] for x in SEGMENTS.split(", ")]
KINDS = [pa.int32(), pa.int32(), pa.list_(pa.int64()), *[pa.binary()] * 5]
HOT, SIZES = -1, -2
#: Signatures that a task remembers, so that it sends a set once.
REMEMBERED = 1 << 20
#: 64-bit words of a node's bitmap, which holds the parity of its shared n-grams in each of 64 bins
#: a word. Two bitmaps differ in at most as many bits as the sets differ in n-grams.
BITMAP_WORDS = 4
BITS = [f"bits{i}" for i in range(BITMAP_WORDS)]
#: Each node gets BANDS keys, one of so many parts of its shared n-grams: the least n-gram in each of
#: BAND_BINS bins. Nodes that share much agree in some.
BANDS, BAND_BINS = 16, 8
NODES = f"doc_id long, sig long, size long, shared long, prefix array<bigint>, bands array<bigint>, fragments array<array<bigint>>, {', '.join(f'{b} long' for b in BITS)}"


def gram_sets(texts: TextBytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and n-gram hash of each distinct n-gram of each text, ascending by both."""
    starts, ends, doc = texts.words(BLANK_WORDS)
    h = texts.hashes(starts, ends)
    of, grams = [], []
    first = np.searchsorted(doc, np.arange(len(texts)))
    n_words = np.bincount(doc, minlength=len(texts))
    w = window_hashes(h, n)
    whole = np.flatnonzero(doc[: len(w)] == doc[n - 1 :]) if len(w) else np.zeros(0, np.int64)
    of.append(doc[whole])
    grams.append(w[whole])
    for k in range(1, n):
        short = np.flatnonzero(n_words == k)
        if len(short):
            of.append(short)
            grams.append(mix(window_hashes(h, k)[first[short]] + U64(k)))
    of, grams = np.concatenate(of), np.concatenate(grams)
    order = np.lexsort((grams, of))
    of, grams = of[order], grams[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (grams[1:] != grams[:-1])
    return of[new], grams[new]


def range_of(x: np.ndarray, n: int) -> np.ndarray:
    """The one of n equal ranges of 64-bit numbers that holds x."""
    return (((x >> U64(32)) * U64(n)) >> U64(32)).astype(np.int64)


def start_of(r: int, n: int) -> int:
    """The least number of range r."""
    return -(-(r << 32) // n) << 32


def width(n: int) -> int:
    """Bytes that tell the n-grams of one of n ranges apart."""
    span = (-(-(1 << 32) // n) << 32) - 1
    return -(-(span.bit_length() - 64 + BITS_KEPT) // 8)


def pack(grams: np.ndarray, r: int, n: int) -> bytes:
    """The upper BITS_KEPT bits of hashes in range r, as distances from the start of the range."""
    short = (grams - U64(start_of(r, n))) >> U64(64 - BITS_KEPT)
    return np.ascontiguousarray(short.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width(n) :]).tobytes()


def unpack(data: bytes, r: int, n: int) -> np.ndarray:
    """What pack wrote, as 64-bit numbers with zeros after the kept bits, as the start of a range has."""
    w = width(n)
    out = np.zeros((len(data) // w, 8), np.uint8)
    out[:, 8 - w :] = np.frombuffer(data, np.uint8).reshape(-1, w)
    return (out.view(">u8").ravel().astype(np.uint64) << U64(64 - BITS_KEPT)) + U64(start_of(r, n))


def rarity(df: np.ndarray) -> np.ndarray:
    """A byte that never falls as df grows: df itself, then eight steps for each doubling."""
    steps = 128 + 8 * np.log2(np.maximum(df, 128) / 128)
    return np.where(df < 128, df, np.minimum(steps, HOT_RARITY - 1)).astype(np.uint8)


def entries(docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of equal numbers, as number and length; no run is longer than a byte can say."""
    new = np.ones(len(docs), bool)
    new[1:] = docs[1:] != docs[:-1]
    starts = np.flatnonzero(new)
    at = np.arange(len(docs)) - np.repeat(starts, np.diff(np.append(starts, len(docs))))
    starts = np.flatnonzero(at % 255 == 0)
    return docs[starts], np.diff(np.append(starts, len(docs))).astype(np.uint8)


def table(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in zip(NAMES, KINDS, strict=True)], NAMES)


def distinct_sets(texts: TextBytes, n: int, sent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signature and size of each text's n-gram set, and text number and n-gram of one text for each
    set whose signature isn't among those sent."""
    of, grams = gram_sets(texts, n)
    sizes = np.bincount(of, minlength=len(texts))
    sums = np.concatenate([[U64(0)], np.cumsum(mix(grams ^ U64(0xA0761D6478BD642F)))])
    ends = np.cumsum(sizes)
    sigs = mix(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64))
    first = np.zeros(len(texts), bool)
    first[np.unique(sigs, return_index=True)[1]] = True
    first[np.isin(sigs, sent)] = False
    kept = first[of]
    return sigs, sizes.astype(np.int64), of[kept], grams[kept]


def kept_bits(grams: np.ndarray) -> np.ndarray:
    return grams & U64((1 << 64) - (1 << (64 - BITS_KEPT)))


def hot_grams(docs: DataFrame, n: int) -> np.ndarray:
    """The n-grams of more than one in HOT_SHARE documents, ascending: at most HOT_MOST, the most
    frequent ones. A chunk tells of those that are frequent in it alone, so counts are lower bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                texts = TextBytes(part.column(1), lower=True)
                grams = np.sort(kept_bits(distinct_sets(texts, n, np.zeros(0, np.uint64))[3]))
                starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(grams)), bool), grams[1:] != grams[:-1]]))
                counts = np.diff(np.append(starts, len(grams)))
                many = counts * HOT_SHARE > max(len(texts), HOT_SHARE)
                yield pa.RecordBatch.from_arrays([pa.array([None, *grams[starts[many]].view(np.int64).tolist()], pa.int64()), pa.array([len(texts), *counts[many].tolist()], pa.int64())], ["gram", "n"])
        release()

    # The row without an n-gram counts documents; it is the one with most.
    counts = docs.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).filter(f"n >= {HOT_LEAST}")
    found = counts.orderBy(F.desc("n"), "gram").limit(HOT_MOST + 1).collect()
    total = sum(r["n"] for r in found if r["gram"] is None)
    return np.sort(np.array([r["gram"] for r in found if r["gram"] is not None and r["n"] * HOT_SHARE > total], np.int64).view(np.uint64))


def cut_into_segments(n: int, ranges: int, hot):
    """Step 1: texts to the segments of their n-gram sets, by range of the global order. Sizes and the
    numbers of hot n-grams go to the range of the set's signature."""

    def by_range(x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        place = range_of(x, ranges)
        order = np.argsort(place, kind="stable")
        bounds = np.searchsorted(place[order], np.arange(ranges + 1))
        for r in np.flatnonzero(np.diff(bounds)).tolist():
            yield r, order[bounds[r] : bounds[r + 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = np.zeros(0, np.uint64)
        for batch in batches:
            for part in chunks(batch):
                texts = TextBytes(part.column(1), lower=True)
                sigs, sizes, of, grams = distinct_sets(texts, n, sent)
                rows = [{"place": int(sigs[0] % U64(ranges)), "members": part.column(0).to_pylist(), "sigs": sigs.tobytes(), "sizes": sizes.tobytes()}]
                sets = np.unique(of)
                sent = np.concatenate([sent, sigs[sets]])[-REMEMBERED:]
                for r, at in by_range(sigs[sets]):
                    rows.append({"place": r, "source": SIZES, "sigs": sigs[sets[at]].tobytes(), "sizes": sizes[sets[at]].tobytes()})
                grams = kept_bits(grams)
                number = np.minimum(np.searchsorted(hot.value, grams), max(len(hot.value) - 1, 0))
                is_hot = hot.value[number] == grams if len(hot.value) else np.zeros(len(grams), bool)
                who, number = of[is_hot], number[is_hot].astype(np.uint16)
                for r, at in by_range(sigs[who]):
                    docs, counts = entries(who[at])
                    rows.append({"place": r, "source": HOT, "sigs": sigs[docs].tobytes(), "counts": counts.tobytes(), "grams": number[at].tobytes()})
                of, grams = of[~is_hot], grams[~is_hot]
                for r, at in by_range(grams):
                    docs, counts = entries(of[at])
                    rows.append({"place": r, "source": r, "sigs": sigs[docs].tobytes(), "counts": counts.tobytes(), "grams": pack(grams[at], r, ranges)})
                yield table(rows)
        release()

    return run


def by_place(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict], list[dict]]]:
    """Other rows and rows of n-grams of a place's range, place by place; the input comes sorted."""
    now, others, segments = None, [], []
    for batch in batches:
        for row in batch.to_pylist():
            if row["place"] != now and now is not None:
                yield now, others, segments
                others, segments = [], []
            now = row["place"]
            (others if row["source"] is None or row["source"] < 0 else segments).append(row)
    if now is not None:
        yield now, others, segments


def joined(rows: list[dict], name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(r[name] for r in rows), kind)


def shared_grams(grams: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-gram, node and number of nodes of each n-gram that two nodes or more hold."""
    order = np.lexsort((node, grams))
    grams, node = grams[order], node[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (node[1:] != node[:-1])
    grams, node = grams[new], node[new]
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(grams)), bool), grams[1:] != grams[:-1]]))
    df = np.diff(np.append(starts, len(grams)))
    df = np.repeat(df, df)
    return grams[df > 1], node[df > 1], df[df > 1]


def count_documents(ranges: int):
    """Step 2: in each range, the number of nodes of each n-gram; shared n-grams go back to their
    nodes, by range of the node's signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, rows, segments in by_place(batches):
            if segments:
                nodes, inverse = np.unique(joined(segments, "sigs", np.uint64), return_inverse=True)
                node = np.repeat(inverse.astype(np.int32), joined(segments, "counts", np.uint8))
                grams = unpack(b"".join(r["grams"] for r in segments), place, ranges)
                segments.clear()
                # Part by part of the range, so that the sorting needs little memory.
                part = (range_of(grams, ranges * PARTS) - place * PARTS).astype(np.int8)
                found = [shared_grams(grams[part == k], node[part == k]) for k in range(PARTS)]
                grams, node, df = map(np.concatenate, zip(*found, strict=True))
                order = np.argsort(node, kind="stable")
                grams, node, df = grams[order], node[order], rarity(df[order])
                # Nodes are ascending by signature, so those of a home are neighbours.
                bounds = np.searchsorted(range_of(nodes, ranges)[node], np.arange(ranges + 1))
                for r in np.flatnonzero(np.diff(bounds)).tolist():
                    a, b = bounds[r], bounds[r + 1]
                    who, counts = entries(node[a:b])
                    rows.append({"place": r, "source": place, "sigs": nodes[who].tobytes(), "counts": counts.tobytes(), "grams": pack(grams[a:b], place, ranges), "rarity": df[a:b].tobytes()})
            if rows:
                yield table(rows)
        release()

    return run


def ragged(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def band_keys(node: np.ndarray, grams: np.ndarray, n: int) -> np.ndarray:
    """BANDS numbers for each of n nodes; node and grams come ascending by both."""
    bins = BANDS * BAND_BINS
    cell = node * bins + ((grams >> U64(64 - BITS_KEPT)) % U64(bins)).astype(np.int64)
    cells, first = np.unique(cell, return_index=True)
    least = np.zeros(n * bins, np.uint64)
    least[cells] = mix(grams[first])
    weight = mix(np.arange(1, BAND_BINS + 1, dtype=np.uint64)) | U64(1)
    return (mix((least.reshape(n, BANDS, BAND_BINS) * weight).sum(2, dtype=np.uint64)) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def gather_nodes(num: int, den: int, ranges: int, hot):
    """Step 3: the shared n-grams of each node that can have a partner, with its prefix; and the
    node of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in NODES.split(", ")]
        for _, others, cold in by_place(batches):
            hots, known = [], []
            for row in others:
                if row["source"] is not None:
                    (hots if row["source"] == HOT else known).append(row)
                    continue
                k = len(row["members"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["members"], pa.int64()), pa.array(np.frombuffer(row["sigs"], np.int64)), pa.array(np.frombuffer(row["sizes"], np.int64)), pa.nulls(k, pa.int64()), *[pa.nulls(k, pa.list_(pa.int64()))] * 2, pa.nulls(k, pa.list_(pa.list_(pa.int64()))), *[pa.nulls(k, pa.int64()) for _ in BITS]],
                    names,
                )
            if not cold and not hots:
                continue
            sigs, of_hots = joined(cold, "sigs", np.uint64), joined(hots, "sigs", np.uint64)
            nodes, inverse = np.unique(np.concatenate([sigs, of_hots]), return_inverse=True)
            node = np.repeat(inverse[: len(sigs)], joined(cold, "counts", np.uint8))
            # Each task that holds a set tells of its hot n-grams.
            pairs = np.unique((np.repeat(inverse[len(sigs) :], joined(hots, "counts", np.uint8)) << 16) | joined(hots, "grams", np.uint16))
            node = np.concatenate([node, pairs >> 16])
            grams = np.concatenate([*[unpack(r["grams"], r["source"], ranges) for r in cold], hot.value[pairs & 0xFFFF]])
            dfs = np.concatenate([joined(cold, "rarity", np.uint8), np.full(len(pairs), HOT_RARITY, np.uint8)])
            shared = np.bincount(node, minlength=len(nodes)).astype(np.int64)
            known_sigs, at = np.unique(joined(known, "sigs", np.uint64), return_index=True)
            size = joined(known, "sizes", np.int64)[at][np.searchsorted(known_sigs, nodes)]
            can = den * shared >= num * size
            if not can.any():
                continue
            kept = can[node]
            node, grams, dfs = node[kept], grams[kept], dfs[kept]
            renumber = np.cumsum(can) - 1
            node, nodes, size, shared = renumber[node], nodes[can], size[can], shared[can]
            least = -(-num * size // den)  # the overlap that any link needs
            order = np.lexsort((grams, dfs, node))
            start = np.cumsum(shared) - shared
            rank = np.arange(len(node)) - start[node[order]]
            in_prefix = rank < (shared - least + 1)[node[order]]
            prefix = grams[order][in_prefix]
            order = np.lexsort((grams, node))
            cell = node[order] * FRAGMENTS + range_of(grams[order], FRAGMENTS)
            fragments = ragged(pa.array(grams[order].view(np.int64)), np.bincount(cell, minlength=len(nodes) * FRAGMENTS))
            bins, one = (grams[order] >> U64(64 - BITS_KEPT)) & U64(64 * BITMAP_WORDS - 1), U64(1)
            bit = one << (bins & U64(63))
            bits = [np.bitwise_xor.reduceat(np.where(bins >> U64(6) == U64(i), bit, U64(0)), start) for i in range(BITMAP_WORDS)]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(nodes), pa.int64()), pa.array(nodes.view(np.int64)), pa.array(size), pa.array(shared), ragged(pa.array(prefix.view(np.int64)), shared - least + 1), ragged(pa.array(band_keys(node[order], grams[order], len(nodes)).ravel()), np.full(len(nodes), BANDS)), ragged(fragments, np.full(len(nodes), FRAGMENTS)), *[pa.array(b.view(np.int64)) for b in bits]],
                names,
            )
        release()

    return run


def may_link(a: str, b: str, num: int, den: int, at: str | None = None):
    """Whether sizes, shared counts and bitmaps of two nodes allow a link: the overlap is at most
    the lesser shared count, and at most half of both shared counts less the bits that differ. With
    the column at, the nodes' first n-gram in common is at that place of their shared ones, or it is
    an earlier one, where they meet as well."""
    of = lambda side, name: F.col(f"{side}.{name}")
    differ = sum((F.bit_count(of(a, c).bitwiseXOR(of(b, c))) for c in BITS), F.lit(0))
    left = lambda side: of(side, "shared") - of(side, at) if at else of(side, "shared")
    most = F.least(left(a), left(b), F.floor((of(a, "shared") + of(b, "shared") - differ) / 2))
    return den * most >= num * (of(a, "size") + of(b, "size") - most)


def light(num: int, den: int):
    """Whether a node has few n-grams of its own. A link needs own_a + own_b <= size_a + size_b -
    2 * overlap <= (den - num) / num * overlap, and overlap is at most either shared count, so the one
    with fewer of its own has at most half of that."""
    return 2 * num * (F.col("size") - F.col("shared")) <= (den - num) * F.col("shared")


def links(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs(a, b) whose sets reach the threshold: overlaps by fragment, summed per pair."""
    segments = nodes.select("sig", "size", F.posexplode("fragments").alias("fragment", "grams"))
    left = pairs.join(segments.select(F.col("sig").alias("a"), F.col("size").alias("size_a"), "fragment", F.col("grams").alias("grams_a")), "a")
    both = left.join(segments.select(F.col("sig").alias("b"), F.col("size").alias("size_b"), "fragment", F.col("grams").alias("grams_b")), ["b", "fragment"])
    partial = both.select("a", "b", "size_a", "size_b", F.size(F.array_intersect("grams_a", "grams_b")).alias("overlap"))
    total = partial.groupBy("a", "b", "size_a", "size_b").agg(F.sum("overlap").alias("overlap"))
    return total.filter(den * F.col("overlap") >= num * (F.col("size_a") + F.col("size_b") - F.col("overlap"))).select("a", "b")


def near_duplicate_components(df: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row of
    df. Two texts link when den * overlap >= num * union of their sets of n-word shingles."""
    spark = df.sparkSession
    ship(spark)
    ranges = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"))
    hot = spark.sparkContext.broadcast(hot_grams(docs, n))
    step = docs.mapInArrow(cut_into_segments(n, ranges, hot), SEGMENTS).repartitionById(ranges, F.col("place")).sortWithinPartitions("place")
    step = step.mapInArrow(count_documents(ranges), SEGMENTS).repartitionById(ranges, F.col("place")).sortWithinPartitions("place")
    gathered = settle(step.mapInArrow(gather_nodes(num, den, ranges, hot), NODES), "gram-nodes")
    members = gathered.filter("prefix is null").select("doc_id", "sig", "size")
    nodes = gathered.filter("prefix is not null").select("sig", "size", "shared", "prefix", "bands", "fragments", *BITS)
    pair = lambda rows, x, y: rows.select(F.least(f"{x}.sig", f"{y}.sig").alias("a"), F.greatest(f"{x}.sig", f"{y}.sig").alias("b"))
    # Round 1: each node of a band with the one that has the fewest n-grams of its own.
    banded = nodes.select("sig", "size", "shared", *BITS, F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min(F.struct((F.col("size") - F.col("shared")).alias("own"), "sig", "size", "shared", *BITS)).alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("band", "hub.*")
    near = banded.alias("p").join(hubs.alias("h"), "band").filter((F.col("p.sig") != F.col("h.sig")) & may_link("p", "h", num, den))
    pairs = settle(pair(near, "p", "h").distinct(), "pairs")
    found = settle(links(pairs, nodes, num, den), "links")
    labels = components(found)
    # Round 2: nodes that meet in a list and are in different components so far.
    posts = nodes.select("sig", "size", "shared", *BITS, F.posexplode("prefix").alias("rank", "gram"))
    labelled = posts.join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    labelled = settle(labelled.withColumn("light", light(num, den)), "posts")
    by_component = labelled.groupBy("gram", "component").agg(F.count(F.lit(1)).alias("n"))
    lists = by_component.groupBy("gram").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram", "largest")
    open_posts = labelled.join(lists, "gram").withColumn("rest", F.col("component") != F.col("largest"))
    met = None
    for left, right in (("light and rest", "true"), ("light and not rest", "not light and rest")):
        both = open_posts.filter(left).alias("x").join(open_posts.filter(right).alias("y"), "gram")
        some = pair(both.filter((F.col("x.component") != F.col("y.component")) & may_link("x", "y", num, den, "rank")), "x", "y")
        met = some if met is None else met.unionByName(some)
    more = links(met.distinct().join(pairs, ["a", "b"], "left_anti"), nodes, num, den)
    labels = components(found.unionByName(more))
    # What a set's group is called, of sets with a copy or a link; the rows of a large group of copies are
    # spread over SALTS keys.
    sets = members.filter("size > 0").groupBy("sig").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    sets = settle(sets.join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig")), "sets")
    groups = sets.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("n").alias("n")).filter("n > 1").select("component", "component_id")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    named = sets.join(groups, "component").select("sig", "component_id", salts)
    salted = members.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    out = salted.join(named, (salted["size"] > 0) & (salted["sig"] == named["sig"]) & (salted["salt"] == named["salt"]), "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def oracle_sql(n: int, num: int, den: int) -> str:
    return f"""
WITH RECURSIVE {sql.words("documents", sql.lowered("text"), sql.BLANK_WORDS, "doc_id", "d")},
grams AS (SELECT DISTINCT rid, key FROM ({sql.windows("d", list(range(1, n + 1)))}) x JOIN d_rows USING (rid) WHERE x.n = least(len(ws), {n})),
sizes AS (SELECT rid, count(*) AS size FROM grams GROUP BY rid),
met AS (SELECT a.rid AS a, b.rid AS b, count(*) AS shared FROM grams a JOIN grams b ON a.key = b.key AND a.rid < b.rid GROUP BY 1, 2),
links AS (SELECT a, b FROM met JOIN sizes x ON x.rid = a JOIN sizes y ON y.rid = b WHERE {den} * shared >= {num} * (x.size + y.size - shared)),
sides AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT rid AS a, rid AS b FROM d_rows UNION SELECT reach.a, sides.b FROM reach JOIN sides ON reach.b = sides.a),
least_id AS (SELECT a AS rid, min(doc_id) AS component_id FROM reach JOIN d_rows ON d_rows.rid = b GROUP BY 1)
SELECT doc_id, coalesce(size, 0) AS n_shingles, component_id FROM d_rows JOIN least_id USING (rid) LEFT JOIN sizes USING (rid)
"""
