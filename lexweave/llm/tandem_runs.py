"""Runs of periodic text, from the branching tandem repeats of a suffix tree over words.

A text is a sequence of words. Stoye and Gusfield find its tandem repeats (a word sequence said
twice in a row) from the suffix tree: below an inner node of string depth ``D`` lie the places
where one sequence of ``D`` words begins; two of them ``D`` apart are a tandem repeat, and it is
*branching* when the word behind it breaks the period. It is enough to try the leaves outside the
node's largest child, in both directions, so every leaf is tried at most log n times. Each
maximal run ends in exactly one branching repeat of its period; turning that to the left for as
long as words agree gives the run's start.

The tree is held as arrays, for many texts at once: suffixes in order (prefix doubling over those
that are still tied), common prefixes of neighbours (from the doubling's own ranks), and the tree's
nodes as stretches of neighbours that share a prefix. Each text has an alphabet of its own, so no
node spans two texts. Everything is numpy; memory is some 4 bytes times log2 of the longest
repetition for each word of a batch, and a batch is one text or a few MB of them.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import given_back, whole_text
from lexweave.llm.tokens import text_slices

LEAST = 12  # words of a run
BATCH = 2 << 20  # bytes of text whose trees are built together


def word_codes(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, lengths): words as numbers, equal only for equal words of one text."""
    codes, used = [], 0
    for words in texts:
        known: dict[bytes, int] = {}
        codes.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)) + used)
        used += len(known)
    return np.concatenate(codes) if codes else np.zeros(0, np.int64), np.array([len(t) for t in texts], np.int64)


def suffix_order(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, rank, lcp): suffixes sorted, the place of each, and how many words each shares with the one before.

    No two suffixes of one text are equal and texts share no code, so every tie ends within a text.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    new = np.diff(codes[order], prepend=-1) != 0
    levels = []  # ranks by the first 1, 2, 4, ... words; behind the last word stands -1
    rank = np.full(n + 1, -1, np.int32)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1] if n else 0
    lcp = np.zeros(n, np.int32)
    h = 1
    while True:
        tied = ~new
        tied[:-1] |= tied[1:]
        at = np.flatnonzero(tied)  # places in ``order`` whose suffix shares its rank
        if not len(at):
            return order, rank[:n], lcp
        levels.append(rank.copy())
        own = order[at]
        key = rank[own].astype(np.int64) * (n + 2) + rank[np.minimum(own + h, n)] + 1
        by = np.argsort(key, kind="stable")
        own, key = own[by], key[by]
        order[at] = own
        parted = np.diff(key, prepend=-1) != 0  # the first of each rank is parted too, and was before
        fresh = at[parted & ~new[at]]
        if len(fresh):
            lcp[fresh] = _shared(levels, order[fresh - 1], order[fresh])
        new[at] |= parted
        rank[own] = at[np.maximum.accumulate(np.where(new[at], np.arange(len(at)), 0))]
        h *= 2


def _shared(levels: list, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words the suffixes at ``a`` and ``b`` share; fewer than twice what the last level tells apart."""
    a, b = a.copy(), b.copy()
    out = np.zeros(len(a), np.int32)
    for k in range(len(levels) - 1, -1, -1):
        same = (levels[k][a] == levels[k][b]) & (a != b)
        out[same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    return out


def _nearest(value: np.ndarray, places: np.ndarray, step: int, strict: bool) -> np.ndarray:
    """For each place the nearest one before (step -1) or behind (+1) whose value is smaller (or equal, unless strict).

    All places jump at once, each to where its present goal points, until none has to. Both ends of
    ``value`` are 0 and every place has more.
    """
    goal = np.arange(len(value), dtype=np.int64)
    goal[places] += step
    at = places
    while len(at):
        seen = value[goal[at]]
        on = seen >= value[at] if strict else seen > value[at]
        at = at[on]
        goal[at] = goal[goal[at]]
    return goal[places]


def branching_repeats(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of every branching tandem repeat: ``period`` words, said twice, then not a third time."""
    n = len(codes)
    none = np.zeros(0, np.int64)
    if n < 2:
        return none, none
    order, rank, lcp = suffix_order(codes)
    value = np.append(lcp, 0)
    inner = np.flatnonzero(value > 0)
    if not len(inner):
        return none, none
    depth = value[inner].astype(np.int64)
    left, right, behind = _nearest(value, inner, -1, True), _nearest(value, inner, 1, True), _nearest(value, inner, 1, False)
    before = _nearest(value, inner, -1, False)
    leads = before == left  # the first border of its node: what lies in front of it is a child as well
    lo, hi = np.concatenate((inner, left[leads])), np.concatenate((behind, inner[leads]))
    node_lo, node_hi = np.concatenate((left, left[leads])), np.concatenate((right, right[leads]))
    deep = np.concatenate((depth, depth[leads]))
    # children node by node, the largest of each last; it is left out
    by = np.lexsort((hi - lo, deep, node_lo))
    lo, hi, node_lo, node_hi, deep = lo[by], hi[by], node_lo[by], node_hi[by], deep[by]
    largest = np.ones(len(lo), bool)
    largest[:-1] = (np.diff(node_lo) != 0) | (np.diff(deep) != 0)
    lo, hi, node_lo, node_hi, deep = (x[~largest] for x in (lo, hi, node_lo, node_hi, deep))
    starts, periods = [], []
    ends = np.cumsum(hi - lo)
    for a, b in _shares(ends, 1 << 20):
        size = (hi - lo)[a:b]
        each = np.repeat(np.arange(a, b), size)
        leaf = order[np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size) + lo[each]]
        d, top, bottom = deep[each], node_lo[each], node_hi[each]
        for first, other in ((leaf, leaf + d), (leaf - d, leaf - d)):
            ok = (first >= 0) & (other >= 0) & (other < n)
            place = rank[np.where(ok, other, 0)]
            ok &= (place >= top) & (place < bottom)
            i, q = first[ok], d[ok]
            breaks = (i + 2 * q >= n) | (codes[i] != codes[np.minimum(i + 2 * q, n - 1)])
            starts.append(i[breaks])
            periods.append(q[breaks])
    start, period = np.concatenate(starts) if starts else none, np.concatenate(periods) if periods else none
    return start, period


def _shares(ends: np.ndarray, most: int):
    """Consecutive ranges of about ``most`` leaves, one node's child at least."""
    a = 0
    while a < len(ends):
        had = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, had + most, side="right")))
        yield a, b
        a = b


def maximal_runs(codes: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all maximal runs of at least ``least`` words and two periods, by start, then period."""
    start, period = branching_repeats(codes)
    end, first = start + 2 * period, start.copy()
    live = np.arange(len(start))
    for _ in range(least):  # turn all of them a few words to the left; most stop
        live = live[first[live] > 0]
        live = live[codes[first[live] - 1] == codes[first[live] - 1 + period[live]]]
        first[live] -= 1
    turning = np.zeros(len(start), bool)
    turning[live] = True
    long = np.flatnonzero(end - first >= least)
    found, here, place = [], [], -1  # ``here``: period and first word of the runs that end where this repeat does
    for k in long[np.lexsort((period[long], end[long]))].tolist():
        if end[k] != place:
            here, place = [], end[k]
        q, at = int(period[k]), int(first[k])
        if any(q % p == 0 and f <= start[k] for p, f in here):  # the same run, a multiple of its period
            continue
        if turning[k]:
            at = _first_of_run(codes, at, q)
        here.append((q, at))
        found.append((at, int(place) - at, q))
    runs = np.array(sorted(found, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)
    return runs[:, 0], runs[:, 1], runs[:, 2]


def _first_of_run(codes: np.ndarray, at: int, q: int) -> int:
    """How far to the left of ``at`` words agree with those ``q`` behind them, in growing strides."""
    stride = 64
    while at > 0:
        lo = max(0, at - stride)
        differ = np.flatnonzero(codes[lo:at] != codes[lo + q : at + q])
        if len(differ):
            return lo + int(differ[-1]) + 1
        at, stride = lo, stride * 2
    return at


def repeated(words: list, doc_id: int | None) -> list:
    """The words, of which every tenth document's repeat from a word on, as its id's checksum says; a null id is never one."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a : a + p]
    return words[:a] + (part * (-(-(n - a) // p)))[: n - a]


def runs_of_texts(texts: list[list[bytes]], least: int = LEAST) -> list[tuple]:
    """For each text, given as words: starts, lengths and periods of its runs, as arrays."""
    codes, lengths = word_codes(texts)
    start, length, period = maximal_runs(codes, least)
    first = np.cumsum(lengths) - lengths
    cut = np.searchsorted(start, np.append(first, len(codes)))
    return [(start[a:b] - f, length[a:b], period[a:b]) for a, b, f in zip(cut, cut[1:], first)]


def collapsed(words: list, start, length, period) -> list:
    """The words without those that a run holds behind its first period."""
    if not len(start):
        return words
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, start + period, 1)
    np.add.at(steps, start + length, -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]


def collapse_runs(docs: DataFrame, least: int = LEAST, plant: bool = False) -> DataFrame:
    """One row per document: doc_id, runs (array of start, length, period, by start) and collapsed (its text without repetitions).

    Words are runs of anything but ASCII white space, as they are written; in ``collapsed`` they
    stand one blank apart. A null text is empty and an empty text has no runs; repeated rows and
    null ids stay row by row; an empty table gives an empty result; other columns are ignored. Of
    two periods of one stretch the smaller is the run's. ``plant`` first makes every tenth document
    periodic (:func:`repeated`), to have something to find.
    """

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

        def told(ids, texts):
            texts = [repeated(w, d) if plant else w for d, w in zip(ids, texts)]
            found = runs_of_texts(texts, least)
            runs = pa.array([[{"start": int(s), "length": int(n), "period": int(p)} for s, n, p in zip(*f)] for f in found], kind)
            body = pa.array([b" ".join(collapsed(w, *f)).decode() for w, f in zip(texts, found)], pa.string())
            return pa.record_batch([pa.array(ids, pa.int64()), pa.array([len(w) for w in texts], pa.int64()), runs, body], names=["doc_id", "n_words", "runs", "collapsed"])

        ids, texts, size = [], [], 0
        for batch in batches:
            column = batch.column(0).to_pylist()
            for at, part in text_slices(batch.column(1), BATCH // 4):
                ids += column[at : at + len(part)]
                texts += [t.split() for t in part]
                size += sum(map(len, part))
                if size >= BATCH:
                    yield told(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield told(ids, texts)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    schema = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return rows.mapInArrow(lambda batches: given_back(run(batches)), schema)

