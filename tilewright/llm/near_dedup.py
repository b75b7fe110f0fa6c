"""Operator 3, MinHash near-dedup with fast similarity sketches.

A sketch has ``BANDS * ROWS`` bins. In each of the first rounds every shingle
is hashed to one bin; in as many later rounds every shingle goes to the bin of
the round, so each bin is filled in the end. A bin keeps the smallest (round,
hash). Rounds stop once all bins are full, so a set costs O(size + t log t).
Bins agree with the probability of the sets' similarity, concentrated as for
independent hashes; sets of similarity J share no band with probability
(1 - J**ROWS) ** BANDS, below 1e-10 for 0.85 and 2e-7 for 0.8.

Equal sets form one class, represented by its smallest doc_id. Documents that
share a band are confirmed on their full sets, in two passes without listing
all pairs of a bucket. First, each class x with the smallest class H of each of
its buckets, the hub. Second, only members of one hub that the first pass left
in different components; pairs within a component change nothing. If x and y
share no shingle outside H, they have at most min(|x & H|, |y & H|) in common,
and sizes alone tell whether that can be enough. If they do share some, the
usual prefix filter finds the pair in an order that puts shingles outside H
first: each x is listed under its first |x| - ceil(s |x|) + 1 shingles outside
H (all of them if it has fewer). A pair found so is a candidate only if enough
can be shared: inside H at most min(|x & H|, |y & H|) and at most |H| less the
bits that the 256-bit maps of H - x and H - y have set between them, and outside
it at most the common bits of two 256-bit maps plus the shingles that one map
merged into bits set already. So every link between members of a bucket is
in the first pass, within a component, or among the candidates of the second.
Members of one hub are compared in blocks of about ``BLOCK`` by ``BLOCK``, each under
a key of its own, so no task holds a whole hub.

Defined results: a document without words or text has an empty set, its own id
as component and is kept. Fewer words than a shingle count as one shingle of
the whole sequence. Rows that repeat a doc_id and its text repeat its result.
A row without an id is kept only if no document with an id has its set.
Texts of any length are compared whole. Further columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import discard, frugal, materialize, slices
from tilewright.llm.components import components
from tilewright.llm.words import mix, text_buffer, word_hashes

BANDS, ROWS = 40, 5
#: So many of the lowest shingles of a list travel with it, to name a pair once; more or fewer change no result.
LOWEST = 16
#: Members of a hub are compared in blocks of about so many; more or fewer change no result.
BLOCK = 512
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """The sorted set of a text's shingle hashes."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    width = min(size, n)
    h = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n - width + 1]
    return np.unique(mix(h))


def sketch(elements: np.ndarray, bins: int = BANDS * ROWS) -> np.ndarray:
    """Fast similarity sketch of a set that is not empty."""
    out = np.full(bins, _EMPTY, np.uint64)
    at = 0
    while at < 2 * bins:
        rounds = np.arange(at, min(2 * bins, at + max(1, bins // len(elements))), dtype=np.uint64)
        h = mix(elements[None, :] + (rounds[:, None] + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03))
        free = rounds < bins
        bin_of = np.where(free[:, None], h % np.uint64(bins), rounds[:, None] - np.uint64(bins) * (~free[:, None]).astype(np.uint64))
        np.minimum.at(out, bin_of.ravel().astype(np.int64), ((rounds[:, None] << np.uint64(52)) | (h >> np.uint64(12))).ravel())
        at += len(rounds)
        if (out != _EMPTY).all():
            break
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in values.reshape(BANDS, ROWS).T:
        h = h * np.uint64(0x9E3779B97F4A7C15) + row
    return mix(h).view(np.int64)


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, n, print, bands``: set size, 128-bit fingerprint of the set, and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1_000_000):
                words, at = word_hashes(*text_buffer(batch.column(1)))
                sizes, prints, bands = [], [], []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    own = shingles(words[a:b], shingle)
                    sizes.append(len(own))
                    prints.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                    bands.append(band_keys(sketch(own)) if len(own) else None)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n", "print", "bands"])

    return docs.mapInArrow(frugal(run), "doc_id long, n long, print binary, bands array<long>")


def full_sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, shingles`` (sorted, as bytes) of the documents in ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1_000_000):
                words, at = word_hashes(*text_buffer(batch.column(1)))
                sets = [shingles(words[a:b], shingle).tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["doc_id", "shingles"])

    # A merge join at every size, so that what is written grows in proportion.
    return docs.join(ids.hint("merge"), "doc_id", "left_semi").mapInArrow(frugal(run), "doc_id long, shingles binary")


def minus(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Elements of p that q lacks, both sorted and neither empty."""
    return p[q[np.minimum(np.searchsorted(q, p), len(q) - 1)] != p]


def bit_map(elements: np.ndarray) -> np.ndarray:
    bits = np.zeros(256, bool)
    bits[(elements >> np.uint64(56)).astype(np.int64)] = True
    return bits


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b, both, either, n, few, extra, bits, merged, gone`` for each pair, on the full sets: sizes of intersection
    and union, the size of b, b's prefix of shingles outside a (``few``: it has no more of them), the map of all of b's
    shingles outside a, how many of them set no bit of their own, and the map of a's shingles that b lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 4_000_000, 3):
                rows = []
                for x, y in zip(batch.column(2), batch.column(3), strict=True):
                    p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    outside, lacking = minus(q, p), minus(p, q)
                    n, prefix = len(q) - len(outside), len(q) - -(-percent * len(q) // 100) + 1
                    bits = bit_map(outside)
                    rows.append((n, len(p) + len(q) - n, len(q), len(outside) <= prefix, outside[:prefix].view(np.int64), np.packbits(bits).view(np.int64), len(outside) - int(bits.sum()), np.packbits(bit_map(lacking)).view(np.int64)))
                c = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c[i], pa.int64()) for i in range(3)), pa.array(c[3], pa.bool_()), pa.array(c[4], pa.list_(pa.int64())), pa.array(c[5], pa.list_(pa.int64())), pa.array(c[6], pa.int64()), pa.array(c[7], pa.list_(pa.int64()))], names=["a", "b", "both", "either", "n", "few", "extra", "bits", "merged", "gone"])

    left, right = (sets.select(F.col("doc_id").alias(c), F.col("shingles").alias("s" + c)) for c in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(frugal(run), "a long, b long, both long, either long, n long, few boolean, extra array<long>, bits array<long>, merged long, gone array<long>")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document; links have at least ``percent`` of 100 in common."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base = full = materialize(sketches(src, shingle), "sketches")
    classes = base.where("n > 0 AND doc_id IS NOT NULL").groupBy("print").agg(F.min("doc_id").alias("rep"))
    classes = materialize(classes, "classes")
    own = base.where("n > 0").select("doc_id", "bands").join(classes.select(F.col("rep").alias("doc_id")), "doc_id").dropDuplicates(["doc_id"])
    rows = own.select(F.col("doc_id").alias("rep"), F.explode("bands").alias("band"))
    buckets = rows.groupBy("band").agg(F.min("rep").alias("hub"), F.count("*").alias("members")).where("members > 1").select("band", "hub")
    member = materialize(rows.join(buckets, "band").select("rep", "hub").distinct(), "members")
    pairs = member.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    ids = member.select(F.col("rep").alias("doc_id")).distinct()
    sets = materialize(full_sets(src, ids, shingle).dropDuplicates(["doc_id"]), "sets")
    base = materialize(base.select("doc_id", "n", "print"), "sizes")
    discard(full)
    stars = materialize(confirm(pairs, sets, percent), "stars")
    linked = F.col("both") * 100 >= F.col("either") * percent
    links = materialize(stars.where(linked).select("a", "b"), "links")
    first = materialize(components(links), "components")

    # Second pass: members of a hub that are still in different components. Of each pair one is outside the hub's largest component.
    spread = materialize(stars.join(first.withColumnRenamed("id", "b"), "b", "left").select("a", "b", "both", "n", (F.col("either") + F.col("both") - F.col("n")).alias("hub"), "few", "extra", "bits", "merged", "gone", F.coalesce("component_id", "b").alias("c")), "spread")
    discard(stars)
    by = spread.groupBy("a", "c").agg(F.count("*").alias("k"), F.count_if("few").alias("f")).groupBy("a").agg(F.max(F.struct("k", "c")).alias("top"), F.count("*").alias("parts"), F.ceil(F.sum("f") / BLOCK).alias("blocks"))
    # Written by itself, so that the join that follows reads shuffles alone and large hubs can be split there.
    by = materialize(by.where("parts > 1").select("a", F.col("top.c").alias("lead"), F.greatest("blocks", F.lit(1).cast("long")).alias("blocks")), "leads")
    words = [F.col(name)[i].alias(f"{name}{i}") for name in ("bits", "gone") for i in range(4)]
    left = materialize(spread.join(by, "a").withColumn("led", F.col("c") == F.col("lead")).select("a", "b", "both", "n", "hub", "few", "extra", F.slice(F.sort_array("extra"), 1, LOWEST).alias("low"), "merged", "c", "led", "blocks", *words), "split")
    apart = (F.col("x.c") != F.col("y.c")) & (F.col("y.led") | (F.col("x.b") < F.col("y.b"))) & (F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent)
    ends = F.least("x.b", "y.b").alias("a"), F.greatest("x.b", "y.b").alias("b")
    needed = (F.col("x.n") + F.col("y.n")) * percent
    lacking = sum((F.bit_count(F.col(f"x.gone{i}").bitwiseOR(F.col(f"y.gone{i}"))) for i in range(4)), F.lit(0))
    within = F.least("x.both", "y.both", F.col("x.hub") - lacking)
    # Block i of the one side meets block j of the other under the key (a, i, j).
    own, every = F.pmod(F.xxhash64("b"), F.col("blocks")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    few = left.where("few").select("a", "b", "both", "n", "hub", "c", "led", "blocks", *[f"gone{i}" for i in range(4)])
    x, y = few.where("NOT led").select("*", own.alias("i"), every.alias("j")), few.select("*", every.alias("i"), own.alias("j"))
    inside = x.alias("x").join(y.alias("y"), (F.col("x.a") == F.col("y.a")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))).where(apart & (within * (100 + percent) >= needed)).select(*ends)
    listed = left.drop("few", "blocks").withColumn("s", F.explode("extra")).drop("extra")
    common = sum((F.bit_count(F.col(f"x.bits{i}").bitwiseAND(F.col(f"y.bits{i}"))) for i in range(4)), F.least("x.merged", "y.merged") + within)
    # A pair is named at the lowest shingle that both lists begin with, or wherever it meets if they begin with none in common.
    lowest = F.array_min(F.array_intersect("x.low", "y.low"))
    once = lowest.isNull() | (lowest == F.col("x.s"))
    outside = listed.where("NOT led").alias("x").join(listed.alias("y"), (F.col("x.a") == F.col("y.a")) & (F.col("x.s") == F.col("y.s"))).where(apart & (common * (100 + percent) >= needed) & once).select(*ends)
    more = materialize(inside.unionByName(outside).distinct().join(pairs, ["a", "b"], "left_anti"), "more")
    late = materialize(confirm(more, sets, percent).where(linked).select("a", "b"), "late")
    discard(left, spread, by, sets, more, member)
    if late.isEmpty():
        joined = first
    else:
        joined = materialize(components(links.unionByName(late)), "components")
    result = classes.join(joined.withColumnRenamed("id", "rep"), "rep", "left").select("print", F.coalesce("component_id", "rep").alias("component_id"))
    out = base.select("doc_id", "n", "print").join(result, "print", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))
