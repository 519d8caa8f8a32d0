"""Best-fit packing of token sequences by a configuration linear program.

Documents longer than a sequence are cut; the pieces' lengths make a histogram with at most as many bins as a sequence has tokens,
whatever the number of documents. Over that histogram:

1. Multiplicative weights solve the configuration program (least number of sequences such that each length is covered as often as it occurs).
   Each length has a weight, its price, that starts near its share of a sequence, a little higher for longer ones, which fit fewer sets. In a round a knapsack
   dynamic program prices: one table gives for every length with demand left the set of lengths, it among them, that fills one sequence with the highest weight. Of the
   sets worth nearly as much as the best, the best filled are asked for, each for half of what is left of its length; a set gets what its scarcest length
   allows. Then a length's weight is multiplied: up by how far its coverage lags behind the whole, down while more of it is asked for than is left, so that
   the next round's sets turn to other lengths. Rounds end when the program covers all but GAP of the tokens, or after ROUNDS.
2. Rounding: sets, most used first, are used a whole number of times, rounded up, never beyond what is left of their lengths.
3. What is left (tests have how little: under 15 % of the pieces and 6 % of the tokens) is packed best-fit, longest first, on the histogram as well.

The plan has a row for each set and place in it. A piece finds its place by its rank among the pieces of its length: its rank inside
the task that cut it plus the counts of the tasks before, from a table with a row for each task and length.

Defined cases: a null text is empty and is one piece that holds id 0 alone; repeated rows are packed each on their own (their pieces share
doc_id); an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.shared import stored
from plumbline.llm.wordids import word_ids

LIMIT = 2048
#: Rounds of the program at most, and the share of the tokens that it may leave.
ROUNDS, GAP = 400, 0.01
#: Of the weights: what the longest length has more by, how far a lag may raise or lower one (as a logarithm), and the rate for lengths that are asked for too often.
#: NEAR: how much less than the best set's worth is as good.
LONGER, LAG, RATE, NEAR = 0.05, 2.0, 0.25, 0.05

#: A set of lengths, ascending, and how many sequences hold it.
Pattern = tuple[tuple[int, ...], int]
#: A set as (length, times).
Set = tuple[tuple[int, int], ...]


def price(weights: np.ndarray, bound: np.ndarray, limit: int, first: np.ndarray) -> tuple[list[Set], np.ndarray]:
    """The knapsack. For each length in `first` the set that has it and fits into limit with the highest weight, besides it none oftener than bound
    says, and what room the set leaves."""
    items = []
    for size in np.flatnonzero(bound[: limit + 1]).tolist():
        n, k = min(int(bound[size]), limit // size), 1
        while n > 0:
            k = min(k, n)
            items.append((size, k))
            n, k = n - k, 2 * k
    best = np.zeros(limit + 1)
    taken = np.zeros((len(items), limit + 1), bool)
    for i, (size, k) in enumerate(items):
        total = size * k
        new = best[: limit + 1 - total] + k * weights[size]
        np.greater(new, best[total:], out=taken[i, total:])
        np.maximum(best[total:], new, out=best[total:])
    room = limit - first
    sets = [{size: 1} for size in first.tolist()]
    for i in range(len(items) - 1, -1, -1):
        hit = np.flatnonzero(taken[i, room])
        size, k = items[i]
        room[hit] -= size * k
        for p in hit.tolist():
            sets[p][size] = sets[p].get(size, 0) + k
    return [tuple(sorted(x.items())) for x in sets], room


def fractional(histogram: dict[int, int], limit: int, rounds: int) -> dict[Set, float]:
    """Sets with how many sequences of each the program uses. Coverage never passes a demand."""
    demand = np.zeros(limit + 1)
    for size, n in histogram.items():
        demand[size] = n
    tokens = np.arange(limit + 1.0)
    base = tokens / limit * (1 + LONGER * tokens / limit)
    covered, lag, over = np.zeros((3, limit + 1))
    used: dict[Set, float] = {}
    for _ in range(rounds):
        left = demand - covered
        open_ = np.flatnonzero(left > 1e-6 * demand)
        if tokens @ left <= GAP * (tokens @ demand):
            break
        share = np.divide(covered, demand, out=np.zeros(limit + 1), where=demand > 0)
        lag = np.clip(lag + (tokens @ covered) / (tokens @ demand) - share, -LAG, LAG)
        weights = base * np.exp(lag)
        bound = np.zeros(limit + 1)
        bound[open_] = np.maximum(1, np.floor(left[open_]))
        sets, room = price(weights * np.exp(-RATE * over), bound, limit, open_)
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        size, times = (np.array([y[i] for x in sets for y in x]) for i in (0, 1))
        worth = np.bincount(owner, times * weights[size], len(sets))
        fine = worth >= (1 - NEAR) * worth.max()
        asked = np.where(fine & (room == room[fine].min()), left[open_] / 2, 0)
        use = np.bincount(size, times * asked[owner], limit + 1)
        over = over / 2 + np.minimum(np.divide(use, left, out=np.zeros(limit + 1), where=left > 0), 4) / 4
        given = np.zeros(len(sets))
        for part in (1.0, 0.5, 0.5, 0.5):  # what the scarcest lengths held back is offered again
            held = np.divide(np.maximum(0, left - np.bincount(size, times * given[owner], limit + 1)), use, out=np.zeros(limit + 1), where=use > 0)
            least = np.ones(len(sets))
            np.minimum.at(least, owner, held[size])
            given += part * asked * least
        covered = np.minimum(demand, covered + np.bincount(size, times * given[owner], limit + 1))
        for k in np.flatnonzero(given > 1e-3).tolist():
            used[sets[k]] = used.get(sets[k], 0.0) + float(given[k])
    return used


def rounded(histogram: dict[int, int], used: dict[Set, float]) -> tuple[list[Pattern], dict[int, int]]:
    """The program's sets a whole number of times each, and what they leave of the histogram."""
    left, out = dict(histogram), []
    for key, times in sorted(used.items(), key=lambda x: (-x[1], x[0])):
        n = min([math.ceil(times - 1e-9), *(left[s] // k for s, k in key)])
        if n > 0:
            out.append((tuple(s for s, k in key for _ in range(k)), n))
            for s, k in key:
                left[s] -= n * k
    return out, {s: n for s, n in left.items() if n}


def best_fit(left: dict[int, int], limit: int) -> list[Pattern]:
    """Longest first, each into the fullest sequence that still holds it, for all pieces of a length at once."""
    groups: dict[int, list[list]] = {}  # room left: (set, number of sequences)
    rooms: list[int] = []

    def put(room: int, kind: tuple[int, ...], n: int) -> None:
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append([kind, n])

    for size in sorted(left, reverse=True):
        n = left[size]
        while n:
            i = bisect_left(rooms, size)
            if i == len(rooms):
                each = limit // size
                if n >= each:
                    put(limit - size * each, (size,) * each, n // each)
                    n %= each
                if n:
                    put(limit - size * n, (size,) * n, 1)
                    n = 0
                continue
            room = rooms[i]
            kind, m = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(i)
            # fill each as far as it goes: a sequence that still holds the length is the fullest one
            each = min(room // size, max(1, n // m))
            k = min(m, n // each)
            put(room - size * each, (*kind, *(size,) * each), k)
            if m > k:
                put(room, kind, m - k)
            n -= k * each
    return [(kind, n) for some in groups.values() for kind, n in some]


def solve(histogram: dict[int, int], limit: int = LIMIT, rounds: int = ROUNDS) -> list[Pattern]:
    """Sets of lengths and how many sequences hold each; together they hold exactly the histogram."""
    rest = dict(histogram)
    full = rest.pop(limit, 0)  # alone in any solution
    out, left = rounded(rest, fractional(rest, limit, rounds))
    return [((limit,), full)] * (full > 0) + out + best_fit(left, limit)


def places(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length its runs of places, in order of rank: the first rank, the sequence that it has, the offset in it."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for kind, n in patterns:
        at = 0
        for size in kind:
            rank = ranks.get(size, 0)
            runs.setdefault(size, []).append((rank, sequence, at))
            ranks[size] = rank + n
            at += size
        sequence += n
    return {s: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for s, r in runs.items()}


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, place long"


def cut(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """The pieces of docs, and for each its task and place: its number among that task's pieces of the same length."""
    end = end_id.to_bytes(4, "little")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, task = word_ids(tokenizer_path), TaskContext.get().partitionId()
        seen = np.zeros(limit + 1, np.int64)
        for batch in batches:
            out = []
            for k in range(0, batch.num_rows, 512):
                some = batch.slice(k, 512)
                for doc, ids in zip(some.column(0), model.encode([x.as_py() or "" for x in some.column(1)]), strict=True):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * limit)):
                        part = ids[at : at + 4 * limit]
                        size = len(part) // 4
                        out.append((doc.as_py(), piece, at // 4, size, zlib.crc32(part), task, int(seen[size])))
                        seen[size] += 1
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
            columns = zip(*out, strict=True) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(rows, PIECES)


def pack(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, rounds: int = ROUNDS, **columns) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = stored(cut(docs, tokenizer_path, limit, **columns), "pack-pieces")
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `limit` rows at most
    found = places(solve(histogram, limit, rounds))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    before = counts.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("rank"))
    # at most a run for each set and length in it: the sets are bounded by the lengths and the rounds, whatever the number of documents
    plan = docs.sparkSession.sparkContext.broadcast(found)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ranks = (batch.column(i).to_numpy() for i in (3, 5))
            sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            for size in np.unique(sizes):
                here = sizes == size
                first, base, at = plan.value[int(size)]
                run = np.searchsorted(first, ranks[here], "right") - 1
                sequence[here] = base[run] + ranks[here] - first[run]
                offset[here] = at[run]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
