"""Operator 6, benchmark decontamination by spaced-seed hashing.

Fixed masks say which of the next words count; hashes of those words in the
benchmark are joined with those in the documents, so a substituted word at an
ignored place does not hide a copy. Each match fixes an alignment of document
and item, on which the overlap is verified word by word: some stretch of
``OVERLAP`` words (the whole item if it is shorter) must agree in at least
``AGREE`` of 100 words.

Neither table moves to the driver, and neither is taken to be small. Seeds of
the benchmark set bits of a map of at most ``MOST_BITS``, the only thing that is
sent to all executors; documents drop the seeds that it lacks before the join,
and documents without any left go no further. A fuller map lets more seeds pass
and changes no result. Matches are summed by diagonal (document, item, shift)
before words are compared, and only the words that face each other are joined.

Words are runs of ASCII letters, digits and bytes beyond ASCII, A-Z as a-z.
Items of fewer than ``OVERLAP`` words have masks of their own length, which keep
some mask free of any substitutions that ``AGREE`` accepts: items of up to 4
words must agree in all, those of 5 to 9 in all but one, others in all but two.
Defined results: null and empty texts and items without words match nothing, nor
do items without an id. Texts of any length are searched whole. Equal items are
reported one by one, and so are repeated document rows and rows without an id.
Further columns are ignored. An empty table on either side gives an empty result.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import discard, frugal, materialize, slices
from tilewright.llm.words import mix, text_buffer, word_hashes

OVERLAP = 13
AGREE = 80
#: The masks of items of ``OVERLAP`` words and more; 1 counts, 0 is ignored.
MASKS = ("111111", "11011011", "1110010101", "10110100111", "110100010101001")
#: Bits of the map of seeds: ``BITS_A_SEED`` for each, up to a fixed most (16 MB).
MOST_BITS, LEAST_BITS, BITS_A_SEED, PROBES = 1 << 27, 1 << 18, 32, 4
_BLOCK = 4096


def short_masks(n: int) -> tuple[str, ...]:
    """Masks over all ``n`` words of a short item: each ignores as many of its parts as words may differ, every choice of parts once."""
    differ = n - -(-AGREE * n // 100)
    parts = [k * (differ + 2) // n for k in range(n)]
    return tuple("".join("0" if p in ignored else "1" for p in parts) for ignored in itertools.combinations(range(differ + 2), differ))


def masks_for(n: int) -> tuple[str, ...]:
    """The masks of an item of ``n`` words."""
    return short_masks(n) if n < OVERLAP else MASKS


def mask_number(mask: str) -> int:
    return int("1" + mask, 2)


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash at every place where the mask fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, len(mask), np.uint64)
    for j, bit in enumerate(mask):
        if bit == "1":
            h = h * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
    return mix(h)


def places(h: np.ndarray, bits: int, probe: int) -> np.ndarray:
    """The bit of each seed for one of the probes."""
    return ((h + np.uint64(probe) * ((h >> np.uint64(32)) | np.uint64(1))) & np.uint64(bits - 1)).astype(np.int64)


def known(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Places of seeds that the map may hold."""
    own = np.arange(len(h))
    for probe in range(PROBES):
        bit = places(h[own], len(table) * 8, probe)
        own = own[(table[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1]
    return own


def benchmark_items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item, item_id, n, words``: a number of its own for each item, and its words as 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = random.SystemRandom().getrandbits(31) << 32
        for whole in batches:
            for batch in slices(whole, 1_000_000, 1):
                words, at = word_hashes(*text_buffer(batch.column(1)), "sign")
                parts = [words[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(range(item, item + len(parts)), pa.int64()), batch.column(0), pa.array(np.diff(at), pa.int64()), pa.array(parts, pa.binary())], names=["item", "item_id", "n", "words"])
                item += len(parts)

    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(frugal(run), "item long, item_id long, n long, words binary").where("n > 0")


def benchmark_seeds(items: DataFrame) -> DataFrame:
    """``mask, seed, item, n, at``: every place of every item under its masks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, n, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words = np.frombuffer(raw, np.uint64)
                for mask in masks_for(n):
                    h = seeds(words, mask)
                    size = len(h)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(size, mask_number(mask), np.int32)), pa.array(h.view(np.int64)), pa.array(np.full(size, item, np.int64)), pa.array(np.full(size, n, np.int64)), pa.array(np.arange(size, dtype=np.int64))], names=["mask", "seed", "item", "n", "at"])

    return items.select("item", "n", "words").mapInArrow(frugal(run), "mask int, seed long, item long, n long, at long")


def seed_map(held: DataFrame) -> np.ndarray:
    """The map of all seeds. Tasks set bits of maps of their own, whose blocks are then united; at most ``MOST_BITS`` reach the driver."""
    bits = LEAST_BITS
    need = BITS_A_SEED * held.count()
    while bits < min(need, MOST_BITS):
        bits *= 2

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            for probe in range(PROBES):
                bit = places(h, bits, probe)
                np.bitwise_or.at(table, bit >> 3, (1 << (bit & 7)).astype(np.uint8))
        blocks = table.reshape(-1, _BLOCK)
        own = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([blocks[i].tobytes() for i in own.tolist()], pa.binary())], names=["block", "bits"])

    def unite(table: pa.Table) -> pa.Table:
        parts = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint8).reshape(-1, _BLOCK)
        return pa.table({"block": table.column("block").slice(0, 1), "bits": pa.array([np.bitwise_or.reduce(parts, axis=0).tobytes()], pa.binary())})

    out = np.zeros(bits // 8, np.uint8)
    for block, own in held.select("seed").mapInArrow(frugal(mark), "block int, bits binary").groupBy("block").applyInArrow(unite, "block int, bits binary").collect():
        out[block * _BLOCK : (block + 1) * _BLOCK] = np.frombuffer(own, np.uint8)
    return out


def document_hits(docs: DataFrame, table: np.ndarray, masks: list[str]) -> DataFrame:
    """``row, doc_id, n_words, words, hits``: documents with seeds that the map may hold, and those seeds with their places."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_map, row = shared.value, random.SystemRandom().getrandbits(31) << 32
        for whole in batches:
            for batch in slices(whole, 1_000_000, 1):
                words, at = word_hashes(*text_buffer(batch.column(1)), "sign")
                doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
                parts = []
                for mask in masks:
                    h = seeds(words, mask)
                    own = known(h, own_map)
                    own = own[doc[own] == doc[own + len(mask) - 1]]
                    parts.append((doc[own], np.full(len(own), mask_number(mask), np.int32), h[own].view(np.int64), own - at[doc[own]]))
                of, mask_of, seed, place = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 4
                if len(of):
                    order = np.argsort(of, kind="stable")
                    hit = np.unique(of)
                    cuts = np.searchsorted(of[order], [*hit.tolist(), len(at)])
                    lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([pa.array(mask_of[order]), pa.array(seed[order]), pa.array(place[order])], names=["mask", "seed", "place"]))
                    yield pa.RecordBatch.from_arrays([pa.array(row + hit), batch.column(0).take(pa.array(hit)), pa.array((at[hit + 1] - at[hit]).astype(np.int64)), pa.array([words[at[i] : at[i + 1]].tobytes() for i in hit.tolist()], pa.binary()), lists], names=["row", "doc_id", "n_words", "words", "hits"])
                row += batch.num_rows

    return docs.mapInArrow(frugal(run), "row long, doc_id long, n_words long, words binary, hits array<struct<mask int, seed long, place long>>")


def verified(facing: DataFrame) -> DataFrame:
    """``row, doc_id, item, n_equal, first_word`` of the alignments that pass; ``dw`` and ``iw`` are the words that face each other from document word ``first`` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 4_000_000, "dw"):
                row, doc, item, n, first, dw, iw = (c.to_pylist() for c in batch.columns)
                out = []
                for i in range(len(row)):
                    equal, need = np.frombuffer(dw[i], np.uint64) == np.frombuffer(iw[i], np.uint64), min(OVERLAP, n[i])
                    total = np.concatenate([[0], np.cumsum(equal)])
                    if ((total[need:] - total[:-need]) * 100 >= AGREE * need).any():
                        out.append((row[i], doc[i], item[i], int(total[-1]), first[i] + int(np.argmax(equal))))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["row", "doc_id", "item", "n_equal", "first_word"])

    return facing.select("row", "doc_id", "item", "n", "first", "dw", "iw").mapInArrow(frugal(run), "row long, doc_id long, item long, n_equal long, first_word long")


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, n_item_words, n_equal, first_word``: the best alignment of each document with each item that it holds."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = materialize(benchmark_items(benchmark, item_col, item_text_col), "items")
    held = materialize(benchmark_seeds(items), "seeds")
    lengths = [r[0] for r in items.select(F.least("n", F.lit(OVERLAP)).alias("n")).distinct().collect()]
    masks = sorted({m for n in lengths for m in masks_for(n)})
    hits = materialize(document_hits(src, seed_map(held), masks), "hits")
    shift = F.col("place") - F.col("at")
    # One row for each diagonal, however many seeds it holds.
    met = hits.select("row", F.inline("hits")).join(held, ["mask", "seed"]).select("row", "item", "n", shift.alias("shift")).distinct()
    low, high = F.greatest(F.lit(0), -F.col("shift")), F.least("n", F.col("n_words") - F.col("shift"))
    part = lambda words, at: F.substring(F.col(words), (at * 8 + 1).cast("int"), ((F.col("high") - F.col("low")) * 8).cast("int"))
    own = met.join(hits.select("row", "doc_id", "n_words", "words"), "row").withColumns({"low": low, "high": high}).where(F.col("high") - F.col("low") >= F.least("n", F.lit(OVERLAP)))
    own = own.select("row", "doc_id", "item", "n", "low", "high", (F.col("low") + F.col("shift")).alias("first"), part("words", F.col("low") + F.col("shift")).alias("dw"))
    facing = own.join(items.select("item", F.col("words").alias("item_words")), "item").withColumn("iw", part("item_words", F.col("low")))
    best = verified(facing).groupBy("row", "doc_id", "item").agg(F.max(F.struct("n_equal", "first_word")).alias("b"))
    found = materialize(best.join(items.select("item", "item_id", "n"), "item").select("doc_id", "item_id", F.col("n").alias("n_item_words"), "b.*"), "overlaps")
    discard(hits, held, items)
    return found
