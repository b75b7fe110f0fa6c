"""Operator 1, suffix-array dedup: repeated 50-byte strings by a distributed merge sort of sparse suffixes.

Documents are packed into runs of a few megabytes. Only suffixes at anchors are
sorted: of the hashes of the 24-byte strings in a 50-byte window the smallest
(the leftmost of equals) marks the window's anchor, so equal windows have equal
anchors at equal places, and each window belongs to one anchor.

1. Each run sends the sorted hashes of its anchors, differences only. Hashes
   that are met in other runs or other documents mark shared anchors. Nothing
   else can be part of a repeat.
2. Each run sorts the suffixes at its shared anchors, each with the bytes left
   of it that its windows reach. Equal ones are sent once, with their smallest
   doc_id. A run travels front-coded: the length of the prefix shared with the
   suffix before, and the rest.
3. A loser tree merges the runs of a bucket of anchors. A player's shared prefix
   with the last winner is known from front coding or from an earlier match, so
   a match first compares those lengths and reads bytes only from there on. The
   merge gives the common prefixes of neighbours; windows of equal bytes are
   then neighbours on their right side and equal on their left side, and get the
   smallest doc_id that holds them.
4. Runs read their answers, mark windows that a smaller doc_id holds, and cut.

Only hashes, front-coded suffixes and answers move, never a list of a string's
holders: a run sends any string once, however many of its documents hold it.

Defined results: a null text is empty. Documents under 50 bytes lose nothing.
A document longer than a run is a run of its own, read in stretches.
Rows that repeat a doc_id are documents of their own: equal ids remove nothing
from each other. Documents without an id come after all others. Further columns are ignored. An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm.common import frugal, materialize, slices, text_bytes
from tilewright.llm.words import _tables, mix, text_buffer

SIZE = 50
GRAM = 24
REACH = SIZE - GRAM + 1
RUN_BYTES = 8 << 20
BUCKET_BYTES = 6 << 20
_CHUNK = 1 << 20


def _pack(a: np.ndarray) -> bytes:
    """Compressed, bytes of equal weight together."""
    raw = np.ascontiguousarray(a)
    planes = raw.view(np.uint8).reshape(len(raw), raw.itemsize).T if len(raw) else raw
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(data: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel() if len(raw) else np.zeros(0, dtype)


class Run:
    """Documents packed together: ids, where each starts, and all bytes."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray, data: np.ndarray):
        self.ids, self.offsets, self.data = ids, offsets, data

    def dumps(self) -> tuple[bytes, bytes, bytes]:
        return self.ids.tobytes(), self.offsets.tobytes(), zstandard.ZstdCompressor(3).compress(self.data.tobytes())

    @classmethod
    def loads(cls, ids: bytes, offsets: bytes, data: bytes) -> Run:
        return cls(np.frombuffer(ids, np.int64), np.frombuffer(offsets, np.int64), np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8))

    def anchors(self) -> tuple[np.ndarray, ...]:
        """For each anchor: place, first and last window start, 48-bit hash, document; by place."""
        parts, first = [], 0
        while first < len(self.ids):
            last = max(first + 1, int(np.searchsorted(self.offsets, self.offsets[first] + _CHUNK, "right")) - 1)
            a, b = int(self.offsets[first]), int(self.offsets[last])
            # A longer document is read in stretches; each window lies in the stretch of its start.
            for start in range(a, max(b, a + 1), _CHUNK) if last == first + 1 else (a,):
                parts.append(self._anchors(start, min(b, start + _CHUNK + SIZE - 1) if last == first + 1 else b, first, last))
            first = last
        return tuple(np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(5))

    def _anchors(self, a: int, b: int, first: int, last: int) -> tuple[np.ndarray, ...]:
        none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.int64))
        n = b - a
        if n < SIZE:
            return none
        h = _bytes_table()[self.data[a:b]]
        k1, k2, k4, k8, k16 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93))
        h = h[:-1] * k1 + h[1:]
        h = h[:-2] * k2 + h[2:]
        h8 = h[:-4] * k4 + h[4:]
        h16 = h8[:-8] * k8 + h8[8:]
        gram = mix(h16[:-8] * k16 + h8[16 : 16 + len(h16) - 8])  # of 24 bytes
        low = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
        m = low
        for step in (1, 2, 4, 8):
            m = np.minimum(m[:-step], m[step:])
        m = np.minimum(m[: len(m) - (REACH - 16)], m[REACH - 16 :])
        place = (m & np.uint64(0xFFFFFFFF)).astype(np.int64)  # of each window start
        ok = np.zeros(len(place), bool)
        for s, e in zip(np.maximum(self.offsets[first:last] - a, 0).tolist(), np.minimum(self.offsets[first + 1 : last + 1] - a, n).tolist(), strict=True):
            ok[s : max(s, e - SIZE + 1)] = True
        starts = np.flatnonzero(ok)
        if not len(starts):
            return none
        p = place[starts]
        new = np.append(True, (p[1:] != p[:-1]) | (np.diff(starts) > 1))
        lo = starts[new]
        hi = starts[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)]
        p = p[new]
        return p + a, lo + a, hi + a, gram[p] >> np.uint64(16), np.searchsorted(self.offsets, p + a, "right") - 1


def _bytes_table() -> np.ndarray:
    """Random values of bytes; unlike those for words, case counts."""
    global _BYTES
    if _BYTES is None:
        _BYTES = mix(_tables() + np.arange(256, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    return _BYTES


_BYTES: np.ndarray | None = None


# --- step 0 and 1


def pack_runs(docs: DataFrame, run_bytes: int = RUN_BYTES) -> DataFrame:
    """``run, ids, offsets, data, carried``: the documents of each task in runs; run numbers are drawn at random.

    Columns beyond id and text travel with the run as one compressed Arrow stream.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, datas, sizes, more, weight = [], [], [], [], 0

        def done() -> pa.RecordBatch:
            packed = Run(np.concatenate(ids).astype(np.int64), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64), np.concatenate(datas)).dumps()
            return pa.RecordBatch.from_arrays([pa.array([random.SystemRandom().getrandbits(62)], pa.int64()), *(pa.array([x], pa.binary()) for x in (*packed, _stream(more) if more else None))], names=["run", "ids", "offsets", "data", "carried"])

        for whole in batches:
            for batch in slices(whole, run_bytes // 4):
                data, offsets = text_buffer(batch.column(1))
                ids.append(batch.column(0).to_numpy(zero_copy_only=False))
                datas.append(data.copy())
                sizes.append(np.diff(offsets))
                if batch.num_columns > 2:
                    more.append(pa.RecordBatch.from_arrays([batch.column(2)], names=["row"]))
                weight += len(data)
                if weight >= run_bytes:
                    yield done()
                    ids, datas, sizes, more, weight = [], [], [], [], 0
        if ids:
            yield done()

    return docs.mapInArrow(frugal(run), "run long, ids binary, offsets binary, data binary, carried binary")


def _stream(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema) as out:
        for b in batches:
            out.write_batch(b)
    return zstandard.ZstdCompressor(3).compress(sink.getvalue())


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    """Even buckets. Anchors are minima, so their own hashes crowd at the low end and are mixed again."""
    even = mix(h)
    return ((even >> np.uint64(16)) * np.uint64(n) >> np.uint64(48)).astype(np.int64) if n < 1 << 16 else (even % np.uint64(n)).astype(np.int64)


def anchor_hashes(runs: DataFrame, n_buckets: int) -> DataFrame:
    """``run, bucket, hashes``: the sorted distinct anchor hashes of each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                number, *packed = (batch.column(k)[i].as_py() for k in range(4))
                h = np.unique(Run.loads(*packed).anchors()[3])
                out = [(number, int(b), _pack(np.diff(own, prepend=np.uint64(0)))) for b, own in _groups(_bucket(h, n_buckets), h)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["run", "bucket", "hashes"])

    return runs.mapInArrow(frugal(run), "run long, bucket int, hashes binary")


def _groups(key: np.ndarray, *values: np.ndarray):
    order = np.argsort(key, kind="stable")
    key = key[order]
    cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield (key[a], *(v[order[a:b]] for v in values))


def shared_hashes(hashes: DataFrame) -> DataFrame:
    """``run, bucket, shared``: of each run's sorted hashes in a bucket, a bit for those that other runs have too."""

    def mark(table: pa.Table) -> pa.Table:
        parts = [np.cumsum(_unpack(x, np.uint64), dtype=np.uint64) for x in table.column("hashes").to_pylist()]
        every = np.sort(np.concatenate(parts))
        again = every[1:][every[1:] == every[:-1]]
        bits = []
        for h in parts:
            at = np.minimum(np.searchsorted(again, h), max(0, len(again) - 1))
            bits.append(np.packbits(again[at] == h if len(again) else np.zeros(len(h), bool)).tobytes())
        return pa.table({"run": table.column("run"), "bucket": table.column("bucket"), "shared": pa.array(bits, pa.binary())})

    return hashes.groupBy("bucket").applyInArrow(mark, "run long, bucket int, shared binary")


# --- step 2


def _order(columns: list[np.ndarray]) -> np.ndarray:
    return np.lexsort(columns[::-1])


def _rows(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int, backwards: bool = False) -> np.ndarray:
    """Strings of ``data`` as rows filled with zeros; backwards: read from ``starts - 1`` towards the front."""
    out = np.zeros((len(starts), width), np.uint8)
    for a in range(0, len(starts), 65536):
        at = np.arange(width)[None, :]
        s, n = starts[a : a + 65536, None], lengths[a : a + 65536, None]
        index = s - 1 - at if backwards else s + at
        out[a : a + 65536] = np.where(at < n, data[np.clip(index, 0, len(data) - 1)], 0)
    return out


def _words(rows: np.ndarray) -> list[np.ndarray]:
    """Rows of a multiple of 8 bytes as columns of integers that sort alike."""
    return list(rows.view(">u8").astype(np.uint64).T)


def _shared_prefix(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """With the row before; 0 for the first."""
    if len(rows) < 2:
        return np.zeros(len(rows), np.int64)
    out = np.zeros(len(rows), np.int64)
    for a in range(1, len(rows), 65536):
        b = min(len(rows), a + 65536)
        differ = rows[a:b] != rows[a - 1 : b - 1]
        out[a:b] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    out[1:] = np.minimum(out[1:], np.minimum(lengths[1:], lengths[:-1]))
    return out


RIGHT, LEFT = 56, 32


def suffixes(run: Run, replies: dict[int, bytes], n_buckets: int):
    """Sorted distinct suffixes at shared anchors by bucket, and each anchor's place among them.

    Yields (bucket, right, right_n, left, left_n, doc, lo, hi, entry): rows of the distinct
    suffixes, then for each anchor its windows and the number of its suffix.
    """
    place, lo, hi, h, doc = run.anchors()
    distinct, inverse = np.unique(h, return_inverse=True)
    marked = np.zeros(len(distinct), bool)
    for b, own in _groups(_bucket(distinct, n_buckets), np.arange(len(distinct))):
        if int(b) in replies:
            marked[own] = np.unpackbits(np.frombuffer(replies[int(b)], np.uint8), count=len(own)).astype(bool)
    # Within the run, an anchor in two documents is shared as well.
    low, high = np.full(len(distinct), len(run.ids)), np.full(len(distinct), -1)
    np.minimum.at(low, inverse, doc)
    np.maximum.at(high, inverse, doc)
    keep = (marked | (low != high))[inverse]
    place, lo, hi, h, doc = (x[keep] for x in (place, lo, hi, h, doc))
    for b, p, first, last, d in _groups(_bucket(h, n_buckets), place, lo, hi, doc):
        right_n, left_n = last + SIZE - p, p - first
        right, left = _rows(run.data, p, right_n, RIGHT), _rows(run.data, p, left_n, LEFT, True)
        keys = [*_words(right), right_n, *_words(left), left_n]
        order = _order(keys)
        new = np.zeros(len(order), bool)
        new[0] = True
        for k in keys:
            k = k[order]
            new[1:] |= k[1:] != k[:-1]
        heads = order[new]
        entry = np.empty(len(order), np.int64)
        entry[order] = np.cumsum(new) - 1
        smallest = np.minimum.reduceat(run.ids[d][order], np.flatnonzero(new))
        yield int(b), right[heads], right_n[heads], left[heads], left_n[heads], smallest, first, last, entry


def encode_suffixes(right, right_n, left, left_n, docs) -> bytes:
    shared = _shared_prefix(right, right_n)
    at = np.arange(RIGHT)[None, :]
    rest = right[(at >= shared[:, None]) & (at < right_n[:, None])]
    sides = left[np.arange(LEFT)[None, :] < left_n[:, None]]
    parts = [_pack(x) for x in (shared.astype(np.uint8), right_n.astype(np.uint8), left_n.astype(np.uint8), rest, sides, np.asarray(docs, np.int64))]
    return _join(parts)


def _join(parts: list[bytes]) -> bytes:
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def _split(blob: bytes) -> list[bytes]:
    parts, at = [], 0
    while at < len(blob):
        n = int.from_bytes(blob[at : at + 4], "little")
        parts.append(blob[at + 4 : at + 4 + n])
        at += 4 + n
    return parts


def decode_suffixes(blob: bytes):
    parts = _split(blob)
    return (*(_unpack(p, np.uint8) for p in parts[:5]), _unpack(parts[5], np.int64))


def run_suffixes(joined: DataFrame, n_buckets: int) -> DataFrame:
    """``run, bucket, blob``: front-coded suffixes for the merge; and with a null bucket one row a run for itself, in
    ``blob`` the windows that hold each suffix, bucket by bucket in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                number, *packed = (batch.column(k)[i].as_py() for k in range(4))
                replies = {x["bucket"]: x["shared"] for x in batch.column(4)[i].as_py() or ()}
                held, schema = [], pa.schema([("run", pa.int64()), ("bucket", pa.int32()), ("blob", pa.binary())])
                for b, right, right_n, left, left_n, docs, lo, hi, entry in suffixes(Run.loads(*packed), replies, n_buckets):
                    order = np.argsort(entry, kind="stable")
                    held.append(_join([np.int32(b).tobytes(), *(_pack(x) for x in (entry[order].astype(np.uint32), lo[order].astype(np.int64), (hi - lo)[order].astype(np.uint8)))]))
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([b], pa.int32()), pa.array([encode_suffixes(right, right_n, left, left_n, docs)], pa.binary())], schema=schema)
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([None], pa.int32()), pa.array([_join(held)], pa.binary())], schema=schema)

    return joined.mapInArrow(frugal(run), "run long, bucket int, blob binary")


# --- step 3


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int]]:
    """Loser-tree merge of sorted strings with known common prefixes.

    ``runs`` has (strings, shared prefix of each with the one before). Gives, in
    merged order, the run of each string and its shared prefix with the string
    before it in the output.
    """
    k = 1
    while k < len(runs):
        k *= 2
    texts = [r[0] for r in runs]
    prefixes = [r[1] for r in runs]
    size = [len(t) for t in texts] + [0] * (k - len(runs))
    at = [0] * k
    head: list[bytes | None] = [t[0] if t else None for t in texts] + [None] * (k - len(runs))
    known = [0] * k  # prefix shared by a run's head with the last winner
    loser = [0] * k

    def match(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's known prefix becomes that with the winner."""
        x, y = head[a], head[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        p, q = known[a], known[b]
        if p > q:
            return a, b
        if q > p:
            return b, a
        if x == y:
            known[b if a < b else a] = len(x)
            return (a, b) if a < b else (b, a)
        n = min(len(x), len(y))
        u, v = x[p:n], y[p:n]
        differ = int.from_bytes(u, "big") ^ int.from_bytes(v, "big")
        shared = n - ((differ.bit_length() + 7) >> 3)
        if x < y:
            known[b] = shared
            return a, b
        known[a] = shared
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k
        win, lose = match(build(2 * node), build(2 * node + 1))
        loser[node] = lose
        return win

    winner = build(1) if k > 1 else 0
    order, shared = [], []
    while head[winner] is not None:
        order.append(winner)
        shared.append(known[winner])
        at[winner] += 1
        i = at[winner]
        if i < size[winner]:
            head[winner] = texts[winner][i]
            known[winner] = prefixes[winner][i]
        else:
            head[winner] = None
        node = (winner + k) >> 1
        while node:
            other = loser[node]
            y = head[other]
            if y is not None:
                x = head[winner]
                if x is None or known[other] > known[winner]:
                    loser[node], winner = winner, other
                elif known[other] == known[winner]:
                    winner, loser[node] = match(winner, other)
            node >>= 1
    return order, shared


def smallest_holders(right_shared: np.ndarray, right_n: np.ndarray, left: np.ndarray, left_n: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each suffix in sorted order and each window that reaches ``l`` bytes left: the smallest doc_id with the same window.

    A flat array by suffix, then ``l`` from the least (50 bytes minus the right side) to ``left_n``.
    """
    n = len(docs)
    least = SIZE - right_n.astype(np.int64)
    counts = left_n.astype(np.int64) - least + 1
    flat = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.int64)
    order = _order([*_words(left), left_n.astype(np.int64)])
    common = _shared_prefix(left[order], left_n[order].astype(np.int64))
    rank = np.empty(n, np.int64)
    for l in range(REACH):  # noqa: E741
        own = np.flatnonzero((least <= l) & (left_n >= l))
        if not len(own):
            continue
        rank[order] = np.cumsum(common < l)
        group = np.cumsum(right_shared < SIZE - l)[own] * np.int64(n + 1) + rank[own]
        by = np.argsort(group, kind="stable")
        heads = np.flatnonzero(np.append(True, np.diff(group[by]) != 0))
        low = np.minimum.reduceat(docs[own][by], heads)
        out[(flat[own] + l - least[own])[by]] = np.repeat(low, np.diff(np.append(heads, len(by))))
    return out


def answers(encoded: DataFrame) -> DataFrame:
    """``run, bucket, smallest``: for each run's suffixes in a bucket, the smallest holder of every window."""

    def merge(table: pa.Table) -> pa.Table:
        runs, cols = [], []
        for blob in table.column("blob").to_pylist():
            shared, right_n, left_n, rest, sides, docs = decode_suffixes(blob)
            tail, strings, last = rest.tobytes(), [], b""
            at = 0
            for p, n in zip(shared.tolist(), right_n.tolist(), strict=True):
                last = last[:p] + tail[at : at + n - p]
                at += n - p
                strings.append(last)
            left = np.zeros((len(docs), LEFT), np.uint8)
            left[np.arange(LEFT)[None, :] < left_n[:, None]] = sides
            runs.append((strings, shared.tolist()))
            cols.append((right_n, left, left_n, docs))
        order, shared = merge_runs(runs)
        source = np.asarray(order, np.int64)
        first = np.cumsum([0] + [len(c[3]) for c in cols])
        # A run's strings come out in their own order.
        by_run = np.argsort(source, kind="stable")
        place = np.empty(len(source), np.int64)
        place[by_run] = np.arange(len(source))
        right_n, left, left_n, docs = (np.concatenate([c[i] for c in cols])[place] for i in range(4))
        found = smallest_holders(np.asarray(shared, np.int64), right_n, left, left_n, docs)
        counts = left_n.astype(np.int64) + right_n.astype(np.int64) - SIZE + 1
        ends = np.cumsum(counts)
        out = []
        for i in range(len(cols)):
            own = by_run[first[i] : first[i + 1]]
            n = counts[own]
            index = np.repeat(ends[own] - n, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out.append(_pack(found[index]))
        return pa.table({"run": table.column("run"), "bucket": table.column("bucket"), "smallest": pa.array(out, pa.binary())})

    return encoded.groupBy("bucket").applyInArrow(merge, "run long, bucket int, smallest binary")


# --- step 4


def _spans(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(covered.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def cut(joined: DataFrame, with_text: bool = False, carried: T.StructType | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, if asked for, the text kept (a character cut in two goes) and the columns carried."""
    schema = T._parse_datatype_string("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text)
    if carried is not None:
        schema = schema.add("row", carried)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                packed = Run.loads(*(batch.column(k)[i].as_py() for k in range(1, 4)))
                window = np.zeros(len(packed.data) + 1, bool)
                found = {x["bucket"]: x["smallest"] for x in batch.column(4)[i].as_py() or ()}
                for held in _split(batch.column(5)[i].as_py() or b""):
                    number, *parts = _split(held)
                    entry, lo, more = _unpack(parts[0], np.uint32), _unpack(parts[1], np.int64), _unpack(parts[2], np.uint8).astype(np.int64)
                    smallest = _unpack(found.pop(int(np.frombuffer(number, np.int32)[0])), np.int64)
                    # All windows of a holder, from the last start (fewest bytes to the left) to the first.
                    heads = np.append(True, np.diff(entry) > 0)
                    first = np.cumsum((more + 1)[heads]) - (more + 1)[heads]
                    n = more + 1
                    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    own = packed.ids[np.searchsorted(packed.offsets, lo, "right") - 1]
                    hit = smallest[np.repeat(first[np.cumsum(heads) - 1], n) + step] < np.repeat(own, n)
                    window[(np.repeat(lo + more, n) - step)[hit]] = True
                delta = np.zeros(len(packed.data) + SIZE + 1, np.int32)
                at = np.flatnonzero(window[: len(packed.data)])
                delta[at] += 1
                delta[at + SIZE] -= 1
                covered = np.cumsum(delta)[: len(packed.data)] > 0
                more = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(batch.column(6)[i].as_py())).read_all().column(0) if carried is not None else None
                rows, first = [], 0
                for doc, a, b in zip(packed.ids.tolist(), packed.offsets[:-1].tolist(), packed.offsets[1:].tolist(), strict=True):
                    gone = covered[a:b]
                    removed = int(gone.sum())
                    kept = packed.data[a:b][~gone].tobytes() if removed else packed.data[a:b].tobytes()
                    row = (doc, b - a, removed, len(_spans(gone)[0]) if removed else 0, hashlib.sha256(kept).hexdigest())
                    rows.append((*row, kept.decode("utf-8", "ignore")) if with_text else row)
                    if len(rows) == 2048:
                        yield _batch(rows, names, more, first)
                        rows, first = [], first + len(rows)
                if rows:
                    yield _batch(rows, names, more, first)

    return joined.mapInArrow(frugal(run), schema)


def _batch(rows: list, names: list[str], more: pa.ChunkedArray | None, first: int) -> pa.RecordBatch:
    types = [pa.int64()] * 4 + [pa.string(), pa.string()]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)]
    if more is not None:
        own = more.slice(first, len(rows)).combine_chunks()
        columns.append(own.chunk(0) if isinstance(own, pa.ChunkedArray) else own)
        names = [*names, "row"]
    return pa.RecordBatch.from_arrays(columns, names=names)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, carry: list[str] | None = None, run_bytes: int = RUN_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Removes every byte covered by a 50-byte string that also starts in a document with a smaller id.

    Columns in ``carry`` come out in a struct ``row`` of their own, row by row, without a join.
    """
    last = F.lit((1 << 63) - 1)
    src = docs.select(F.coalesce(F.col(id_col).cast("long"), last).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *([F.struct(*carry).alias("row")] if carry else []))
    row = src.schema["row"].dataType if carry else None
    n_buckets = max(1, -(-text_bytes(src) // bucket_bytes))
    runs = materialize(pack_runs(src, run_bytes), "runs")
    replies = shared_hashes(anchor_hashes(runs, n_buckets)).groupBy("run").agg(F.collect_list(F.struct("bucket", "shared")).alias("replies"))
    encoded = materialize(run_suffixes(runs.join(replies, "run", "left").select("run", "ids", "offsets", "data", "replies"), n_buckets), "suffixes")
    found = answers(encoded.where("bucket IS NOT NULL")).groupBy("run").agg(F.collect_list(F.struct("bucket", "smallest")).alias("found"))
    held = encoded.where("bucket IS NULL").select("run", F.col("blob").alias("held"))
    return cut(runs.join(found, "run", "left").join(held, "run", "left").select("run", "ids", "offsets", "data", "found", "held", "carried"), with_text, row).withColumn("doc_id", F.nullif("doc_id", last))
