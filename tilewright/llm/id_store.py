"""Operator 8, token-id output: a content-addressed store of id streams.

Format: Parquet files below ``root/store``, sorted by doc_id within and across
parts. A document's row holds its recipe (``keys``: 16 bytes for each chunk;
``shared``: for each chunk 0 if no other place has it, 2 if it is stored here
for others as well, 1 if it is stored with another document; 4 and 3 stand for
2 and 1 if more than ``HOT`` places hold it), the chunks stored with it
(``own_keys``, ``own_lengths``, ``ids`` as little-endian unsigned values of
``wide`` bytes), its place ``start`` in its part, and its Merkle leaf. The last
row of a part is its manifest: documents, tokens and the Merkle root of its
leaves. ``root/manifest`` holds one row: parts, documents, tokens and the Merkle
root of the parts' roots, so that a lost or exchanged part is noticed.

A rolling hash over the last ids decides where a chunk ends, so equal passages
give equal chunks wherever they stand. Equal chunks are stored once, with one of
the documents that hold them. Only keys and chunks that several places share
move between tasks beside the one range exchange that sorts.

Defined results: a null or empty text is the end id alone. Texts of any length
are stored whole. Rows with the same doc_id stay rows of their own, in one part;
rows without one come first. An empty table gives an empty store. Further input
columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.llm.common import default_tokenizer, discard, forget_words, materialize, shared_dir, slices, word_tokenizer

END_ID = 2
KEY = 16
SPAN = 6
MEAN, LEAST, MOST = 256, 64, 2048
PART_BYTES = 32 << 20
#: Parts at most, so the manifest's rows are bounded.
MOST_PARTS = 100_000
#: A chunk held in more places than this is lent in ``SALTS`` copies, each for a share of the borrowers.
HOT, SALTS = 4096, 64
#: Ids hashed at once, so that they stay in a core's cache; more or fewer change no result.
STRETCH = 1 << 14


def candidates(ids: np.ndarray) -> np.ndarray:
    """Where a chunk may end: after ids where the hash of the last ``SPAN`` ids is 0 modulo ``MEAN``. Of several documents in a row, only places from ``SPAN`` ids on are theirs alone; chunks are longer."""
    out = [np.zeros(0, np.int64)]
    for a in range(0, len(ids), STRETCH):
        first = max(0, a - SPAN + 1)
        mixed = ((ids[first : a + STRETCH].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(17)
        h = mixed.copy()
        for j in range(1, min(SPAN, len(mixed))):
            h[j:] += mixed[: len(mixed) - j] * np.uint64(2 * j + 1)
        h *= np.uint64(0xD6E8FEB86659FD93)
        out.append(np.flatnonzero(h[a - first :] >> np.uint64(56) == 0) + a + 1)
    return np.concatenate(out)


def ends_of(n: int, places: list[int]) -> list[int]:
    """Ends of the chunks of ``n`` ids: candidates between ``LEAST`` and ``MOST`` ids after the end before, or ``MOST``."""
    ends, last = [], 0
    for c in places:
        while c - last > MOST:
            last += MOST
            ends.append(last)
        if c - last >= LEAST and c < n:
            ends.append(c)
            last = c
    while n - last > MOST:
        last += MOST
        ends.append(last)
    return [*ends, n]


def cuts(ids: np.ndarray) -> list[int]:
    return ends_of(len(ids), candidates(ids).tolist())


#: Flags of chunks that are stored with the document.
OWNED = (0, 2, 4)


def _dicts(batch: pa.RecordBatch) -> Iterator[dict]:
    names = batch.schema.names
    for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        yield dict(zip(names, row, strict=True))


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=KEY).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Pairs hashed level by level; an odd one rises as it is."""
    while len(leaves) > 1:
        leaves = [digest(b"".join(leaves[i : i + 2])) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else digest(b"")


class Merkle:
    """Root of a stream of leaves in memory of one hash a level."""

    def __init__(self):
        self.levels: list[bytes | None] = []

    def add(self, leaf: bytes) -> None:
        for i, other in enumerate(self.levels):
            if other is None:
                self.levels[i] = leaf
                return
            leaf, self.levels[i] = digest(other + leaf), None
        self.levels.append(leaf)

    def root(self) -> bytes:
        top = None
        for x in self.levels:
            if x is not None:
                top = x if top is None else digest(x + top)
        return top if top is not None else digest(b"")


def tokenized(docs: DataFrame, id_col: str, text_col: str, tokenizer: str | None) -> DataFrame:
    """``doc_id, row, keys, lengths, wide, ids``: every document's chunks in full. Chunk ``i`` of a document has the number ``row + i``, which no other has."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, row = word_tokenizer(path), random.SystemRandom().getrandbits(31) << 32
        wide = 2 if len(words.sizes) <= 1 << 16 else 4
        end, head = np.asarray([END_ID], "<u4").tobytes(), bytes([wide])
        for whole in batches:
            for batch in slices(whole, 8_000_000, 1):
                raw = words.encode(batch.column(1))
                sizes = [len(r) // 4 + 1 for r in raw]
                every = np.frombuffer(end.join([*raw, b""]), "<u4").astype(f"<u{wide}")
                firsts = np.cumsum([0, *sizes])
                places = candidates(every)
                of, body = np.searchsorted(places, firsts, "right").tolist(), every.tobytes()
                places = places.tolist()
                rows, keys, lengths, ids = [], [], [], []
                for n, first, a, b in zip(sizes, firsts.tolist(), of, of[1:], strict=False):
                    cut = ends_of(n, [p - first for p in places[a:b]]) if n > LEAST else [n]
                    own = body[first * wide : (first + n) * wide]
                    parts = [own[x * wide : y * wide] for x, y in zip([0, *cut], cut, strict=False)] if len(cut) > 1 else [own]
                    keys.append(b"".join([digest(head + p) for p in parts]))
                    lengths.append(np.diff([0, *cut]).astype("<i4").tobytes() if len(cut) > 1 else n.to_bytes(4, "little"))
                    ids.append(own)
                    rows.append(row)
                    row += len(cut)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.int64()), pa.array(keys, pa.binary()), pa.array(lengths, pa.binary()), pa.array([wide] * len(rows), pa.int32()), pa.array(ids, pa.binary())], names=["doc_id", "row", "keys", "lengths", "wide", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, row long, keys binary, lengths binary, wide int, ids binary")


def write(docs: DataFrame, root: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> str:
    """Writes the store below ``root`` and returns ``root``."""
    spark = docs.sparkSession
    full = materialize(tokenized(docs, id_col, text_col, tokenizer), "tokenized")
    places = full.select("doc_id", "row", F.posexplode(F.expr(f"transform(sequence(0, length(keys) div {KEY} - 1), i -> substring(keys, i * {KEY} + 1, {KEY}))")).alias("nth", "key"))
    # The first place of a key owns it. Nearly all chunks are their holder's own; only those met again are listed for the writer.
    again = places.groupBy("key").agg(F.min(F.col("row") + F.col("nth")).alias("owner"), F.count("*").alias("n")).where("n > 1")
    held = places.join(again, "key")
    own, hot = F.col("owner") == F.col("row") + F.col("nth"), F.col("n") > HOT
    flag = F.when(own, F.when(hot, 4).otherwise(2)).otherwise(F.when(hot, 3).otherwise(1))
    notes = materialize(held.groupBy("doc_id", "row").agg(F.collect_list(F.struct("nth", flag.alias("flag"))).alias("notes")), "notes")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("keys", "binary"), ("lengths", "binary"), ("wide", "int"), ("ids", "binary"))]
    kind = notes.schema["notes"].dataType
    both = notes.select("doc_id", "row", F.lit(0).alias("kind"), "notes", *none).unionByName(full.select("doc_id", "row", F.lit(1).alias("kind"), F.lit(None).cast(kind).alias("notes"), "keys", "lengths", "wide", "ids"))
    # A chunk has about MEAN ids of two bytes.
    total = full.agg(F.coalesce(F.sum(F.length("keys")) * (MEAN * 2 // KEY), F.lit(0))).first()[0]
    ordered = both.repartitionByRange(max(1, min(MOST_PARTS, -(-total // PART_BYTES)) if total > PART_BYTES else 2), "doc_id").sortWithinPartitions("doc_id", "row", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        forget_words()
        part, at, tree, listed, n_docs = TaskContext.get().partitionId(), 0, Merkle(), None, 0
        names = ["part", "doc_id", "row", "start", "n_tokens", "keys", "shared", "own_keys", "own_lengths", "wide", "ids", "leaf", "root"]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            rows, weight = [], 0
            for x in _dicts(batch):
                if x["kind"] == 0:
                    listed = (x["doc_id"], x["row"], {n["nth"]: n["flag"] for n in x["notes"]})
                    continue
                note = listed[2] if listed and listed[:2] == (x["doc_id"], x["row"]) else {}
                keys, sizes, wide, body = x["keys"], x["lengths"], x["wide"], x["ids"]
                n, flags, own_keys = len(body) // wide, bytes(len(keys) // KEY), keys
                if note:
                    lengths = np.frombuffer(sizes, "<i4")
                    ends, flags = [0, *np.cumsum(lengths).tolist()], bytes(note.get(i, 0) for i in range(len(lengths)))
                    own = [i for i, f in enumerate(flags) if f in OWNED]
                    own_keys, sizes = b"".join(keys[KEY * i : KEY * i + KEY] for i in own), lengths[own].tobytes()
                    body = b"".join(body[ends[i] * wide : ends[i + 1] * wide] for i in own)
                leaf = digest(str(x["doc_id"]).encode() + b":" + keys)
                tree.add(leaf)
                rows.append((part, x["doc_id"], x["row"], at, n, keys, flags, own_keys, sizes, wide, body, leaf, None))
                at, n_docs, weight = at + n, n_docs + 1, weight + len(body)
                if weight > 8 << 20:
                    yield batch_of(rows)
                    rows, weight = [], 0
            if rows:
                yield batch_of(rows)
        if n_docs:
            yield batch_of([(part, None, n_docs, None, at, None, None, None, None, None, None, None, tree.root())])

    out = ordered.mapInArrow(run, "part int, doc_id long, row long, start long, n_tokens long, keys binary, shared binary, own_keys binary, own_lengths binary, wide int, ids binary, leaf binary, root binary")
    out.write.option("compression", "zstd").parquet(f"{root}/store")
    discard(full, notes)
    spark.createDataFrame([top(spark, root)], "n_parts long, n_docs long, n_tokens long, root binary").coalesce(1).write.parquet(f"{root}/manifest")
    return root


def top(spark: SparkSession, root: str) -> tuple[int, int, int, bytes]:
    """Parts, documents, tokens and the Merkle root over all parts as they are stored; a part is one row."""
    rows = sorted(map(tuple, parts(spark, root).collect()))
    return len(rows), sum(r[1] for r in rows), sum(r[2] for r in rows), merkle_root([digest(f"{part}:{n}:{tokens}:".encode() + own) for part, n, tokens, own in rows])


def parts(spark: SparkSession, root: str) -> DataFrame:
    """The manifest: one row for each part."""
    return spark.read.parquet(f"{root}/store").where("root IS NOT NULL").select("part", F.col("row").alias("n_docs"), "n_tokens", "root")


def recipes(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/store").where("root IS NULL").select("part", "doc_id", "row", "start", "n_tokens", "keys", "shared", "leaf")


def _crc(rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int64()), pa.array(c[3], pa.int64()), pa.array([len(x) // 4 for x in c[4]], pa.int64()), pa.array(list(map(zlib.crc32, c[4])), pa.int64())], names=["part", "doc_id", "at", "n_tokens", "ids_crc32"])


def _whole(rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), *(pa.array(c[i], pa.int64()) for i in (1, 2, 3)), pa.array(c[4], pa.binary())], names=["part", "doc_id", "row", "start", "ids"])


def read(spark: SparkSession, root: str) -> DataFrame:
    """``part, doc_id, row, start, ids`` (little-endian 32-bit) of every document, put together by its recipe.

    ``start`` counts the ids before the document in its part; ``part_starts``
    has those of the parts before. Chunks are checked against their keys. Only
    documents that borrow chunks are joined with them.
    """
    return _rebuilt(spark, root, _whole, "part int, doc_id long, row long, start long, ids binary")


def _rebuilt(spark: SparkSession, root: str, give: Callable[[list[tuple]], pa.RecordBatch], schema: str) -> DataFrame:
    store = spark.read.parquet(f"{root}/store").where("root IS NULL")
    # One signed byte a flag, 0 to 4; two hexadecimal digits each.
    borrows, lends = (F.col("flags").rlike(f"^(..)*0[{kinds}]") for kinds in ("13", "24"))
    store = store.withColumn("flags", F.hex("shared"))
    cols = ["part", "doc_id", "row", "start", "keys", "own_keys", "own_lengths", "wide", "ids"]

    def lend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_words()
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                lent = {x["keys"][KEY * i : KEY * i + KEY]: SALTS if f == 4 else 1 for i, f in enumerate(x["shared"]) if f in (2, 4)}
                at = 0
                for i, n in enumerate(np.frombuffer(x["own_lengths"], "<i4").tolist()):
                    key = x["own_keys"][KEY * i : KEY * i + KEY]
                    body = x["ids"][at : at + n * x["wide"]]
                    out += [(key, salt, x["wide"], body) for salt in range(lent.get(key, 0))]
                    at += n * x["wide"]
            if out:
                a, b, c, d = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.int32()), pa.array(c, pa.int32()), pa.array(d, pa.binary())], names=["key", "salt", "w", "body"])

    lent = store.where(lends).select("keys", "shared", "own_keys", "own_lengths", "wide", "ids").mapInArrow(lend, "key binary, salt int, w int, body binary")
    asked = F.array_distinct(F.expr(f"transform(filter(sequence(0, length(shared) - 1), i -> hex(substring(shared, i + 1, 1)) IN ('01', '03')), i -> struct(substring(keys, i * {KEY} + 1, {KEY}) AS key, if(hex(substring(shared, i + 1, 1)) = '03', cast(pmod(xxhash64(row), {SALTS}) AS int), 0) AS salt))"))
    wanted = store.where(borrows).select("row", F.explode(asked).alias("q")).select("row", "q.key", "q.salt")
    borrowed = wanted.join(lent, ["key", "salt"]).groupBy("row").agg(F.collect_list(F.struct("key", "w", "body")).alias("others"))
    kind = borrowed.schema["others"].dataType
    whole = store.where(~borrows).select(*cols, F.lit(None).cast(kind).alias("others"))
    mixed = store.where(borrows).select(*cols).join(borrowed, "row").select(*cols, "others")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_words()
        for whole_batch in batches:
            for batch in slices(whole_batch, 4_000_000, "ids"):
                out = []
                for x in _dicts(batch):
                    bodies = {bytes(o["key"]): (o["w"], o["body"]) for o in x["others"] or ()}
                    at = 0
                    for i, n in enumerate(np.frombuffer(x["own_lengths"], "<i4").tolist()):
                        bodies[x["own_keys"][KEY * i : KEY * i + KEY]] = (x["wide"], x["ids"][at : at + n * x["wide"]])
                        at += n * x["wide"]
                    ids = []
                    for i in range(0, len(x["keys"]), KEY):
                        wide, body = bodies[x["keys"][i : i + KEY]]
                        if digest(bytes([wide]) + body) != x["keys"][i : i + KEY]:
                            raise ValueError(f"document {x['doc_id']}: a stored chunk differs from its key")
                        ids.append(body if wide == 4 else np.frombuffer(body, "<u2").astype("<u4").tobytes())
                    out.append((x["part"], x["doc_id"], x["row"], x["start"], b"".join(ids)))
                yield give(out)

    return whole.unionByName(mixed).mapInArrow(build, schema)


def part_starts(spark: SparkSession, root: str) -> DataFrame:
    """``part, before``: ids in all parts before it, from the manifest rows."""
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts(spark, root).select("part", F.coalesce(F.sum("n_tokens").over(every), F.lit(0)).alias("before"))


def verify(spark: SparkSession, root: str) -> DataFrame:
    """Parts whose leaves do not give their Merkle root, and -1 if the parts do not give the manifest's; empty if the store is sound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, bad, part, n = Merkle(), [], None, 0
        for batch in batches:
            for x in batch.to_pylist():
                if n and x["part"] != part:  # a part without its manifest row
                    bad.append(part)
                    tree, n = Merkle(), 0
                part = x["part"]
                if x["root"] is None:
                    if digest(str(x["doc_id"]).encode() + b":" + x["keys"]) != x["leaf"]:
                        bad.append(part)
                    tree.add(x["leaf"])
                    n += 1
                else:
                    if tree.root() != x["root"] or n != x["row"]:
                        bad.append(part)
                    tree, n = Merkle(), 0
        if n:
            bad.append(part)
        yield pa.RecordBatch.from_arrays([pa.array(bad, pa.int32())], names=["part"])

    rows = spark.read.parquet(f"{root}/store").select("part", "doc_id", "row", "keys", "leaf", "root")
    ordered = rows.repartition("part").sortWithinPartitions("part", F.col("root").isNotNull(), "doc_id", "row")
    kept = spark.read.parquet(f"{root}/manifest").first()
    lost = [] if kept and tuple(kept) == top(spark, root) else [(-1,)]
    return ordered.mapInArrow(run, "part int").unionByName(spark.createDataFrame(lost, "part int")).distinct()


def digest_rows(spark: SparkSession, root: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document as read back, once all Merkle roots have been found right."""
    bad = [r[0] for r in verify(spark, root).limit(10).collect()]
    if bad:
        raise ValueError(f"{root}: these parts differ from their Merkle roots: {bad}")
    rows = _rebuilt(spark, root, _crc, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(part_starts(spark, root), "part").select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def new_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/id-store-{uuid.uuid4().hex}"
