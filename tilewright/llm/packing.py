"""Operator 5, best-fit packing: bin completion over the histogram of piece lengths.

Packing needs only how many pieces have each length. Those counts are at most
``limit`` rows, whatever the size of the corpus, so the driver plans on them:
each step takes the largest length left and branches over the undominated
fillings of the remaining room and over how often to apply one. Best-fit
decreasing gives the incumbent; a lower bound on bins and the waste still
allowed prune the search, whose work is bounded. Pieces then find their place by
rank within their length, without any of them moving to the driver.

Defined results: a null or empty text is a document of the end id alone.
Repeated rows are packed as documents of their own. An empty table packs into
nothing. Further input columns are ignored.
"""

from __future__ import annotations

import bisect
import math
import random
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.common import default_tokenizer, forget_words, materialize, slices, word_tokenizer

LIMIT = 2048
END_ID = 0
#: The search may go on for so many times the work of its first descent; it changes how long the search goes on, not which pieces are packed.
SEARCH_STEPS = 64
#: The first descent counts as so much work at least: lengths and fillings looked at.
LEAST_WORK = 65536

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, block long, nth long"


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Tokenized documents cut into pieces; ``nth`` counts the pieces of one length within the task ``block``."""
    path = tokenizer or default_tokenizer()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("block", pa.int64()), ("nth", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, block, seen = word_tokenizer(path).encode, random.SystemRandom().getrandbits(62), Counter()
        end = np.asarray([END_ID], "<u4").tobytes()
        for whole in batches:
            for batch in slices(whole):
                rows = []
                for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                    ids += end
                    n = len(ids) // 4
                    first = n if n <= limit else n % limit or limit
                    for k, (a, b) in enumerate(zip([0, *range(first, n, limit)], [*range(first, n, limit), n], strict=True)):
                        rows.append((doc, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), block, seen[b - a]))
                        seen[b - a] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, PIECES)


Pattern = tuple[tuple[tuple[int, int], ...], int]  # ((length, copies), ...), times


def best_fit_decreasing(counts: dict[int, int], limit: int) -> list[Pattern]:
    """Incumbent: each length in falling order goes to the fullest open bins with room."""
    bins: dict[tuple[tuple[int, int], ...], int] = {}  # contents -> how many bins
    room = lambda key: limit - sum(a * b for a, b in key)
    by_room: dict[int, set] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            fits = min((r for r, keys in by_room.items() if r >= length and keys), default=None)
            key = next(iter(by_room[fits])) if fits is not None else ()
            copies = (fits if fits is not None else limit) // length
            if left < copies:
                copies, times = left, 1
            else:
                times = left // copies
                if key:
                    times = min(times, bins[key])
            if key:
                bins[key] -= times
                if not bins[key]:
                    del bins[key]
                    by_room[fits].discard(key)
            full = (*key, (length, copies))
            bins[full] = bins.get(full, 0) + times
            by_room.setdefault(room(full), set()).add(full)
            left -= copies * times
    return list(bins.items())


def lower_bound(counts: dict[int, int], limit: int) -> int:
    """Bins that any packing needs (Martello and Toth's L2): pieces over half a bin share none, and small ones fill what room they leave."""
    n = np.zeros(limit + 1, np.int64)
    for k, c in counts.items():
        n[k] = c
    number, total, half = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * np.arange(limit + 1))]), limit // 2
    best = -(-int(total[-1]) // limit)
    for k in range(half + 1):
        alone = int(number[-1] - number[limit - k + 1])
        middle, middle_sum = (int(x[limit - k + 1] - x[half + 1]) for x in (number, total))
        best = max(best, alone + middle + max(0, -(-(int(total[half + 1] - total[k]) - (middle * limit - middle_sum)) // limit)))
    return best


Filling = tuple[tuple[int, int], ...]  # ((length, copies), ...)


def fillings(counts: dict[int, int], room: int, most_waste: int, work: list[int]) -> Iterator[tuple[Filling, int]]:
    """Fillings of ``room`` by available lengths and their waste, the fullest first, large pieces first among equals.

    Bits of an integer are the sums that can be reached, so no branch is
    followed that ends without a filling. ``counts`` must stay as it is meanwhile.
    Lengths looked at are added to ``work[0]``.
    """
    if room and counts.get(room):
        yield ((room, 1),), 0  # it dominates all others
        return
    lengths, mask = sorted(k for k, n in counts.items() if n and k <= room), (1 << (room + 1)) - 1
    reach = [1]  # by the first i lengths
    for k in lengths:
        sums, left, power = reach[-1], min(counts[k], room // k), 1
        while left:
            take = min(power, left)
            sums |= sums << k * take & mask
            left -= take
            power *= 2
        reach.append(sums)

    def ways(upto: int, total: int, chosen: Filling) -> Iterator[Filling]:
        if not total:
            yield chosen
            return
        for j in range(bisect.bisect_right(lengths, total, 0, upto) - 1, -1, -1):
            work[0] += 1
            if not reach[j + 1] >> total & 1:
                return
            k = lengths[j]
            for copies in range(min(counts[k], total // k), 0, -1):
                if reach[j] >> (total - copies * k) & 1:
                    yield from ways(j, total - copies * k, (*chosen, (k, copies)))

    for waste in range(min(room, most_waste) + 1):
        if reach[-1] >> (room - waste) & 1:
            for found in ways(len(lengths), room - waste, ()):
                yield found, waste


def dominates(a: Filling, b: Filling) -> bool:
    """Whether the pieces of ``b`` fit into those of ``a``, so that a swap makes any packing with ``b`` one with ``a``. Long fillings are only tried greedily."""
    both = Counter(dict(a)) & Counter(dict(b))
    room, items = (sorted((Counter(dict(x)) - both).elements(), reverse=True) for x in (a, b))
    exact = len(items) <= 8

    def fits(i: int) -> bool:
        if i == len(items):
            return True
        for j in range(len(room)):
            if room[j] >= items[i]:
                room[j] -= items[i]
                if fits(i + 1):
                    return True
                room[j] += items[i]
                if not exact:
                    return False
        return False

    return fits(0)


def search(counts: dict[int, int], limit: int, best: list[Pattern], least: int, search_steps: int) -> list[Pattern]:
    """Branch and bound by bin completion, from an incumbent.

    Each step branches over the undominated fillings around the largest length
    left, and over how often one is applied (as often as the counts allow, half
    of that, and so on to once; the rest meets the branching again). Branches
    whose waste could not beat the incumbent, and counts met before with no more
    waste, are left. Rounds allow more and more departures from the first
    choices; a round that leaves out none has proven the optimum.
    """
    counts, total = {k: n for k, n in counts.items() if n}, sum(k * n for k, n in counts.items())
    rng = random.Random(1)
    mark = {k: rng.getrandbits(96) for k in counts}
    work, most_work, cut = [0], math.inf, False
    bins = sum(n for _, n in best)

    def options(departures: int, allowed: int) -> list[tuple[int, Filling, int, int]]:
        """(departures, contents, times, waste in a bin) for the largest length left, in the order to try them."""
        nonlocal cut
        largest, found = max(counts), []
        work[0] += len(counts)
        counts[largest] -= 1
        for fill, waste in fillings(counts, limit - largest, allowed, work):
            work[0] += 1 + 80 * len(found)  # comparing two fillings takes as long as looking at many lengths
            if len(found) > departures or work[0] > most_work:
                cut = True
                break
            if not any(dominates(f, fill) for f, _ in found):
                found.append((fill, waste))
        counts[largest] += 1
        out = []
        for i, (fill, waste) in enumerate(found):
            used = Counter({largest: 1})
            for k, n in fill:
                used[k] += n
            times = min(counts[k] // n for k, n in used.items())
            if waste:
                times = min(times, allowed // waste)
            contents = tuple(sorted(used.items(), reverse=True))
            halvings = range(times.bit_length())
            out += [(i + h, contents, times >> h, waste) for h in halvings if i + h <= departures]
            cut |= i + len(halvings) - 1 > departures
        return sorted(out, key=lambda x: x[0])  # stable: the fuller filling first

    def change(contents: Filling, by: int) -> None:
        for k, n in contents:
            left = counts.get(k, 0) + n * by
            if left:
                counts[k] = left
            else:
                del counts[k]

    departures = 0
    while bins > least:
        cut, met = False, {}
        path: list[tuple[Filling, int]] = []
        # Frames: options to try, departures left, waste so far, hash of the counts left.
        stack = [(iter(options(departures, (bins - 1) * limit - total)), departures, 0, sum(mark[k] * n for k, n in counts.items()))]
        while stack:
            if len(path) == len(stack):
                change(*path.pop())
            todo, left, waste, key = stack[-1]
            choice = next(todo, None)
            if choice is None or bins <= least or work[0] > most_work:
                stack.pop()
                continue
            cost, contents, times, own = choice
            waste += own * times
            if waste > (bins - 1) * limit - total:
                continue
            key -= sum(mark[k] * n for k, n in contents) * times
            before = met.get(key)
            if before and before[0] <= waste and before[1] >= left - cost:
                continue
            met[key] = (waste, left - cost)
            change(contents, -times)
            path.append((contents, times))
            if counts:
                stack.append((iter(options(left - cost, (bins - 1) * limit - total - waste)), left - cost, waste, key))
            else:
                best, bins = list(path), sum(n for _, n in path)
                change(*path.pop())
        if not cut or work[0] > most_work:
            break
        if not departures:
            most_work = work[0] + search_steps * max(work[0], LEAST_WORK)
        departures = 2 * departures or 1
    return best


def plan(counts: dict[int, int], limit: int = LIMIT, search_steps: int = SEARCH_STEPS) -> list[Pattern]:
    """Patterns that pack all pieces into few bins."""
    best, least = best_fit_decreasing(counts, limit), lower_bound(counts, limit)
    return search(counts, limit, best, least, search_steps) if sum(n for _, n in best) > least else best


def slots(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, copies in a bin, first bin, offset) in order of rank."""
    out: dict[int, list] = {}
    ranks, first_bin = Counter(), 0
    for contents, times in patterns:
        at = 0
        for k, n in contents:
            out.setdefault(k, []).append((ranks[k], n, first_bin, at))
            ranks[k] += n * times
            at += k * n
        first_bin += times
    return {k: np.asarray(v, np.int64) for k, v in out.items()}


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row for each piece with its sequence and place."""
    cut = materialize(pieces(docs, id_col, text_col, tokenizer, limit), "pieces")
    by_block = cut.groupBy("block", "length").agg(F.count("*").alias("n"))
    # At most `limit` rows reach the driver.
    counts = {r["length"]: r["n"] for r in by_block.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = slots(plan(counts, limit))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = cut.join(by_block.select("block", "length", before.alias("before")), ["block", "length"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_words()
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            seq, at = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                own, rows = table[int(k)], np.flatnonzero(length == k)
                hit = own[np.searchsorted(own[:, 0], rank[rows], "right") - 1]
                nth, copy = np.divmod(rank[rows] - hit[:, 0], hit[:, 1])
                seq[rows], at[rows] = hit[:, 2] + nth, hit[:, 3] + copy * k
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(at)], names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, (F.col("before") + F.col("nth")).alias("rank")).mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
