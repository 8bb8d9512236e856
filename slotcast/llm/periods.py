"""Periodic runs of words: Lyndon arrays from suffix grouping, Lyndon roots extended to runs."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotcast.llm.common import ship, slices

MIN_WORDS = 24
MIN_PERIODS = 3
_BASE = np.uint64(0x9E3779B97F4A7C15)
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def grouped(ranks: list[int]) -> tuple[list[int], list[int]]:
    """Phase one of Baier's suffix sorting over a sequence of ranks 0, 1, 2, ...: group and context length of every suffix.

    Groups start as first ranks and are worked off from the highest. Each suffix of a group is charged to the nearest suffix before it
    that is in a lower group; suffixes charged equally often leave their group together for a new one just above it, whose context is longer by
    what charged them. At the end the context of a suffix is its longest Lyndon prefix, so the lengths are the Lyndon array, and two
    suffixes share a group only if these prefixes are equal.
    """
    n = len(ranks)
    top = max(ranks, default=-1)
    group = list(ranks)
    members: list[list[int]] = [[] for _ in range(top + 1)]
    for i, r in enumerate(ranks):
        members[r].append(i)
    length = [1] * (top + 1)
    below, above = list(range(-1, top)), list(range(1, top + 2))
    left = list(range(-1, n - 1))
    done = bytearray(n + 1)  # the last entry stands for "nothing before"
    now = top
    while now >= 0:
        mine = [i for i in members[now] if group[i] == now]
        for i in mine:
            done[i] = 1
        charged: dict[int, int] = {}
        for i in mine:
            j = k = left[i]
            while done[j]:
                j = left[j]
            while k != j:
                left[k], k = j, left[k]
            left[i] = j
            if j >= 0:
                charged[j] = charged.get(j, 0) + 1
        size = length[now]
        times: defaultdict[int, list[int]] = defaultdict(list)
        for j, k in charged.items():
            times[k].append(j)
        for k in sorted(times, reverse=True):
            fresh: dict[int, int] = {}
            for j in times[k]:
                old = group[j]
                new = fresh.get(old)
                if new is None:
                    new = fresh[old] = len(length)
                    length.append(length[old] + k * size)
                    members.append([])
                    below.append(old)
                    above.append(above[old])
                    if above[old] < len(below) - 1:
                        below[above[old]] = new
                    above[old] = new
                group[j] = new
                members[new].append(j)
        now = below[now]
    return group, [length[g] for g in group]


def lce(a: np.ndarray, i: int, j: int, step: int = 1) -> int:
    """Number of equal words of ``a`` from positions ``i`` and ``j`` on, forwards or with ``step`` -1 backwards."""
    room = len(a) - max(i, j) if step > 0 else min(i, j) + 1
    found, block = 0, 16
    while found < room:
        n = min(block, room - found)
        if step > 0:
            differ = a[i + found : i + found + n] != a[j + found : j + found + n]
        else:
            differ = (a[i - found - n + 1 : i - found + 1] != a[j - found - n + 1 : j - found + 1])[::-1]
        at = int(differ.argmax())
        if differ[at]:
            return found + at
        found, block = found + n, 2 * block
    return found


def lyndon_runs(ranks: np.ndarray, min_words: int, min_periods: int) -> set[tuple[int, int, int]]:
    """All runs ``(start, length, period)`` of a sequence of ranks 0, 1, 2, ... with at least ``min_words`` words and ``min_periods`` periods.

    In one of the two orders of words, the Lyndon roots of a run follow each other in one group, and three periods hold two whole ones. So chains of
    suffixes that share a group at the distance of their context are the runs up to less than a period at each end, where they are extended by comparing words.
    """
    found: set[tuple[int, int, int]] = set()
    n = len(ranks)
    for order in (ranks, int(ranks.max(initial=0)) - ranks):
        group, context = (np.array(v, dtype=np.int64) for v in grouped(order.tolist()))
        here = np.arange(n)
        after = here + context
        follows = np.zeros(n, dtype=bool)
        inside = after < n
        follows[inside] = group[after[inside]] == group[inside]
        before = here - context
        led = (before >= 0) & (group[np.maximum(before, 0)] == group)
        end: dict[int, int] = {}
        for i in np.flatnonzero(follows)[::-1].tolist():
            j = i + int(context[i])
            end[i] = end.get(j, j + int(context[i]))
        for i in np.flatnonzero(follows & ~led).tolist():
            p, stop = int(context[i]), end[i]
            least = max(min_words, min_periods * p)
            if stop - i + 2 * (p - 1) < least:
                continue
            start = i - (lce(order, i - 1, i - 1 + p, -1) if i else 0)
            stop += lce(order, stop - p, stop)
            if stop - start >= least:
                found.add((start, stop - start, p))
    return found


def repeated_stretches(words: list[bytes], min_words: int, min_periods: int) -> list[tuple[int, int]]:
    """Word ranges outside of which no run can be, often none.

    A run holds every short gram of its words twice or more, one period apart, so all its grams occur again in the text. The
    length of such a gram follows from the least run. Equal hashes only let more ranges pass.
    """
    most = min_words // min_periods
    gram = min(min_words + 1 - 2 * most, (min_periods - 2) * (most + 1) + 1)
    codes = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    mixed = codes * _BASE
    mixed ^= mixed >> np.uint64(29)
    h = mixed[: len(words) - gram + 1].copy()
    for k in range(1, gram):
        h = h * _BASE + mixed[k : k + len(h)]
    ordered = np.sort(h)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return []
    good = np.concatenate([[False], np.isin(h, again), [False]])
    edges = np.flatnonzero(good[1:] != good[:-1]).reshape(-1, 2)
    return [(a, b + gram - 1) for a, b in edges.tolist() if b + gram - 1 - a >= min_words]


def word_runs(words: list[bytes], min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """Runs ``(start, length, period)`` of a text's words by start, then period."""
    if len(words) < min_words:
        return []
    found = []
    for a, b in repeated_stretches(words, min_words, min_periods):
        part = words[a:b]
        rank = {w: k for k, w in enumerate(dict.fromkeys(part))}
        ranks = np.fromiter(map(rank.__getitem__, part), dtype=np.int64, count=len(part))
        found += [(a + s, n, p) for s, n, p in lyndon_runs(ranks, min_words, min_periods)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by one space, without those that a run holds after its first period."""
    if not found:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, n, p in found:
        change[start + p] += 1
        change[start + n] -= 1
    gone = np.cumsum(change[:-1]) > 0
    return b" ".join(w for w, g in zip(words, gone.tolist()) if not g)


def _finder(min_words: int, min_periods: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            size, every, best, short = [], [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                words = (text or b"").split()
                found = word_runs(words, min_words, min_periods)
                rows = [{"start": s, "length": n, "period": p} for s, n, p in found]
                size.append(len(words))
                every.append(rows)
                best.append(max(rows, key=lambda r: (Fraction(r["length"], r["period"]), -r["start"], -r["period"]), default=None))
                short.append(collapsed(words, found).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(size, pa.int64()), pa.array(every, pa.list_(_RUN)), pa.array(best, _RUN), pa.array(short, pa.string())],
                ["id", "n_words", "runs", "strongest", "collapsed"],
            )

    return step


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> DataFrame:
    """``(id, n_words, runs, strongest, collapsed)`` for every row, repeated rows and ids included.

    ``runs`` holds each stretch of words with a smallest period that no neighbouring word goes on, of at least ``min_words`` words and
    ``min_periods`` periods, as ``(start, length, period)`` by start, then period. ``strongest`` is the run with the greatest length / period, the
    smallest start, then period on ties, NULL if there is none. ``collapsed`` is the text's words, joined by one space, without those
    that any run holds after its first period.

    Words end at ASCII white space and count case. NULL and empty texts have no words, no runs and an empty ``collapsed``. A NULL
    id stays NULL. Other columns of ``docs`` are not read, whatever their names. An empty table gives an empty result.

    Each text is worked off in its task without a shuffle, in time about linear in its words; only stretches whose grams repeat are grouped.
    """
    if min_periods < 3 or min_words < 1:
        raise ValueError("only runs of three periods and more hold two neighbouring Lyndon roots for certain")
    ship(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))
    run = "struct<start: bigint, length: bigint, period: bigint>"
    return rows.mapInArrow(_finder(min_words, min_periods), f"id {kind}, n_words bigint, runs array<{run}>, strongest {run}, collapsed string")
