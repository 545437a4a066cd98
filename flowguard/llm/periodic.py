"""Periodic runs of words: maximal stretches whose words repeat with a period, found by an enhanced suffix array.

The texts of a slice are numbered word by word (exactly, by a dictionary), and sorted into one suffix array whose first key is
the text, so that no suffix is compared with another text's. Each LCP interval [l, r] of depth d holds the places of one
sequence x of d words. A branching tandem repeat xx starts at i if i and i + d both lie in the interval, in different children
of it; so for the suffixes of all children but the largest, the inverse array tells whether i + d or i - d is in [l, r] (Stoye
and Gusfield 2002; Abouelhoda, Kurtz and Ohlebusch 2004). Intervals come from the nearest smaller LCP values on both sides; no
tree is built. A branching square can't be shifted to the right, so its run ends with it; shifting it to the left finds where
the run begins, and squares that share an end and whose periods divide one another are one run.

A run of `exponent` periods or more has that many occurrences of x one period apart, which the inverse array also tells: only
such squares are shifted. All steps are array operations on a slice of about two megabytes of text, or on one longer text;
work is O(n log n) for n words, memory O(n log m) for a longest repeat of m words.

Null and empty texts, and those of white space alone, have no words, no runs and an empty collapsed text. Repeated rows get
equal results. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import _SPACE, slices, utf8

#: What a run is stored as, all counted in words.
RUNS = "array<struct<start: long, length: long, period: long>>"


def number_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number, first byte, size, text) of each word; equal words have equal numbers."""
    inside = np.r_[~_SPACE[data], False]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside & (first | np.r_[True, ~inside[:-1]]))
    sizes = np.flatnonzero(inside[:-1] & (~inside[1:] | first[1:])) + 1 - starts
    ends = np.r_[0, np.cumsum(sizes)]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data[inside[:-1]])])
    numbers = words.dictionary_encode().indices.to_numpy() if len(starts) else np.zeros(0, np.int32)
    return numbers, starts, sizes, np.searchsorted(offsets, starts, "right") - 1


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffixes in order, their places, common prefix of each with the one before) by prefix doubling.

    Some code must be the last of every pair of suffixes that are otherwise equal: each text ends with one of its own. A round
    sorts only the suffixes that are still equal to another; its ranks are kept to measure the common prefixes.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    new = np.r_[True, codes[order][1:] != codes[order][:-1]]
    place, rank = np.arange(n), np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, place, 0))
    levels, step = [rank.copy()], 1
    while True:
        alone = new & np.r_[new[1:], True]
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            break
        some = order[open_]
        key = rank[some].astype(np.int64) * n + rank[some + step]
        by = np.argsort(key, kind="stable")
        order[open_], key = some[by], key[by]
        new[open_] |= np.r_[True, key[1:] != key[:-1]]
        start = np.maximum.accumulate(np.where(new, place, 0))
        rank[order[open_]] = start[open_]
        levels.append(rank.copy())
        step *= 2
    common = np.zeros(n, np.int64)
    left, right = order[:-1], order[1:]
    todo = np.arange(n - 1)
    for k in range(len(levels) - 2, -1, -1):
        # levels[k] tells prefixes of 2^k apart; what two suffixes share is the sum of the powers at which they agree
        a, b = left[todo] + common[todo + 1], right[todo] + common[todo + 1]
        same = (a < n) & (b < n)
        same[same] = levels[k][a[same]] == levels[k][b[same]]
        common[todo[same] + 1] += 1 << k
    return order, rank, common


def next_smaller(values: np.ndarray, ask: np.ndarray) -> np.ndarray:
    """For each asked place the next place of a smaller value, len(values) if there is none: up and down a tree of minima."""
    n = len(values)
    fill = np.iinfo(values.dtype).max
    rows = [np.r_[values, np.full(n % 2, fill)]]
    while len(rows[-1]) > 2:
        m = np.minimum(rows[-1][0::2], rows[-1][1::2])
        rows.append(np.r_[m, np.full(len(m) % 2, fill)])
    out, found = np.full(len(ask), n), np.full(len(ask), -1)
    at, want, live = ask.copy(), values[ask], np.arange(len(ask))
    for k, row in enumerate(rows):
        turn = at[live] % 2 == 0
        turn[turn] = row[at[live][turn] + 1] < want[live][turn]
        hit = live[turn]
        found[hit], out[hit] = k, at[hit] + 1
        live = live[~turn]
        at[live] >>= 1
    for k in range(len(rows) - 1, 0, -1):
        here = np.flatnonzero(found == k)
        left = out[here] * 2
        out[here] = np.where(rows[k - 1][left] < want[here], left, left + 1)
        found[here] = k - 1
    return out


def branching_squares(order: np.ndarray, rank: np.ndarray, common: np.ndarray, exponent: int, chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of every branching tandem repeat that `exponent` - 2 more periods precede."""
    n = len(order)
    ask = np.flatnonzero(common > 0)
    if not len(ask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    right = next_smaller(common, ask) - 1
    left = n - 1 - next_smaller(common[::-1], n - 1 - ask)
    wide = right - left + 1 >= exponent
    ask, left, right = ask[wide], left[wide], right[wide]
    if not len(ask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    by = np.lexsort((ask, right, left))
    ask, left, right = ask[by], left[by], right[by]
    new = np.r_[True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])]
    owner = np.cumsum(new) - 1
    low, high, depth = left[new], right[new], common[ask[new]]
    # children of an interval lie between the places where its own depth stands
    child_low = np.r_[low, ask]
    child_owner = np.r_[np.arange(len(low)), owner]
    by = np.lexsort((child_low, child_owner))
    child_low, child_owner = child_low[by], child_owner[by]
    last = np.r_[child_owner[1:] != child_owner[:-1], True]
    child_high = np.where(last, high[child_owner], np.r_[child_low[1:], 0] - 1)
    size = child_high - child_low + 1
    by = np.lexsort((-size, child_owner))
    small = np.ones(len(size), bool)
    small[by[np.r_[True, child_owner[by][1:] != child_owner[by][:-1]]]] = False
    child_low, child_high, child_owner, size = child_low[small], child_high[small], child_owner[small], size[small]

    def inside(i: np.ndarray, which: np.ndarray) -> np.ndarray:
        ok = (i >= 0) & (i < n)
        k = rank[np.where(ok, i, 0)]
        return ok & (k >= low[which]) & (k <= high[which])

    starts, periods = [], []
    upto = np.cumsum(size)
    first = 0
    while first < len(size):
        past = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + chunk, "right")))
        of = np.repeat(np.arange(first, past), size[first:past])
        base = np.cumsum(size[first:past]) - size[first:past]
        slot = child_low[of] + np.arange(len(of)) - np.repeat(base, size[first:past])
        i, which = order[slot], child_owner[of]
        for sign in (1, -1):
            other = i + sign * depth[which]
            ok = np.flatnonzero(inside(other, which))
            k = rank[other[ok]]
            ok = ok[(k < child_low[of[ok]]) | (k > child_high[of[ok]])]
            start = np.minimum(i[ok], other[ok])
            for m in range(1, exponent - 1):
                more = inside(start - m * depth[which[ok]], which[ok])
                ok, start = ok[more], start[more]
            starts.append(start)
            periods.append(depth[which[ok]])
        first = past
    return np.concatenate(starts), np.concatenate(periods)


def _reach(codes: np.ndarray, start: int, period: int) -> int:
    """How far left of start the words still equal those one period later."""
    width, at = 64, start
    while at > 0:
        low = max(0, at - width)
        differ = np.flatnonzero(codes[low:at] != codes[low + period : at + period])
        if len(differ):
            return low + int(differ[-1]) + 1
        at, width = low, width * 4
    return 0


def find_runs(numbers: np.ndarray, text: np.ndarray, texts: int, least: int = 6, exponent: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, length, period) of the runs of words numbered over all texts, by first word and period.

    A run is maximal, has its smallest period q, and length >= max(least, exponent q); exponent is 2 or more.
    """
    nothing = np.zeros((3, 0), np.int64)
    if len(numbers) < min(least, exponent):
        return tuple(nothing)
    # each text's words, then one sign that no other text has
    count = np.bincount(text, minlength=texts)
    at = np.arange(len(numbers)) + text
    codes = np.empty(len(numbers) + texts, np.int64)
    owner = np.repeat(np.arange(texts), count + 1)
    wide = int(numbers.max()) + 2
    codes[:] = owner * wide
    codes[at] += numbers.astype(np.int64) + 1
    order, rank, common = suffix_array(codes)
    start, period = branching_squares(order, rank, common, exponent)
    end = start + 2 * period
    by = np.lexsort((period, end))
    found: list[tuple[int, int, int]] = []
    same_end: list[tuple[int, int]] = []
    previous = None
    for i in by:
        s, q, e = int(start[i]), int(period[i]), int(end[i])
        if e != previous:
            previous, same_end = e, []
        if any(q % p == 0 and e - exponent * q >= b for b, p in same_end):
            continue
        b = _reach(codes, s, q)
        same_end.append((b, q))
        if e - b >= max(least, exponent * q):
            found.append((b, e - b, q))
    if not found:
        return tuple(nothing)
    first, length, period = np.array(sorted(found, key=lambda x: (x[0], x[2])), np.int64).T
    return first - owner[first], length, period


def collapse(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, text: np.ndarray, texts: int, keep: np.ndarray) -> pa.Array:
    """The kept words of each text joined by a space."""
    starts, sizes, text = starts[keep], sizes[keep], text[keep]
    final = np.r_[text[1:] != text[:-1], True][: len(text)]
    width = sizes + ~final
    ends = np.cumsum(width)
    out = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
    step, before = np.arange(int(sizes.sum())), np.cumsum(sizes) - sizes
    out[np.repeat(ends - width - before, sizes) + step] = data[np.repeat(starts - before, sizes) + step]
    offsets = np.r_[0, np.cumsum(np.bincount(text, weights=width, minlength=texts).astype(np.int64))]
    return pa.LargeStringArray.from_buffers(texts, pa.py_buffer(offsets), pa.py_buffer(out)).cast(pa.string())


def detect_runs(docs: DataFrame, least: int = 6, exponent: int = 4) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): the runs of each text by start and period, and its text without the words that a run
    holds after its first period, joined by a space."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for batch in batches:
            for part in slices(batch, "text"):
                n = part.num_rows
                data, offsets = utf8(part.column("text"))
                numbers, starts, sizes, text = number_words(data, offsets)
                first, length, period = find_runs(numbers, text, n, least, exponent)
                change = np.zeros(len(numbers) + 1, np.int64)
                np.add.at(change, first + period, 1)
                np.add.at(change, first + length, -1)
                before = np.r_[0, np.cumsum(np.bincount(text, minlength=n))]
                of = text[first]
                rows = pa.StructArray.from_arrays([pa.array(first - before[of]), pa.array(length), pa.array(period)], fields=list(run))
                ends = np.r_[0, np.cumsum(np.bincount(of, minlength=n))]
                runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)
                kept = collapse(data, starts, sizes, text, n, np.cumsum(change)[:-1] == 0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(before)), runs, kept], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(detect, f"doc_id {id_type}, n_words long, runs {RUNS}, collapsed string")


def words_of(text: Column) -> Column:
    """The words of a text as an array: runs of other characters than space and 9 to 13."""
    return F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
