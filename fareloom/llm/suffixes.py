"""Removal of long repeated byte strings by suffix arrays.

A suffix array is built by induced sorting: suffixes are classified as smaller or larger
than the next one, the leftmost-smaller (LMS) substrings are sorted and ranked, the order of
the suffixes that begin there is found from the ranks by prefix tripling, and all other
suffixes are induced from it in two linear sweeps. The
permuted common prefixes come from the irreducible ones, which are compared directly; each
of the others is one less than its left neighbour's. Windows whose common prefix with a
neighbour in the array is long enough occur twice.

``fareloom.llm.windows`` brings the segments that may repeat to shards of a few MB.

Defined cases: null and empty texts have no bytes; matches never cross texts; rows equal in
id and text are texts of their own; further columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareloom.llm.common import ragged_ranges, ragged_starts, row_key, slices
from fareloom.llm.windows import Windows, covered, touched

WINDOW = 400


def _smaller(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last is the smallest of all."""
    n = len(t)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int64) - t[:-1])
    step[-1] = 1
    # equal neighbours take the type of the next change
    following = np.where(step != 0, np.arange(n), n)
    following = np.minimum.accumulate(following[::-1])[::-1]
    return step[following] > 0


def _induce_by_bucket(t: np.ndarray, small: np.ndarray, sigma: int, lms: np.ndarray) -> np.ndarray:
    """All suffixes from LMS positions in order, a bucket at a time (small alphabets).

    Inside a bucket the sweep goes in rounds: what a round puts into its own bucket is the
    next round.
    """
    n = len(t)
    size = np.bincount(t, minlength=sigma)
    start, end = np.cumsum(size) - size, np.cumsum(size)
    t = t.astype(np.uint16)  # numpy sorts short integers by radix
    sa = np.full(n, -1, np.int64)
    lms_size = np.bincount(t[lms], minlength=sigma)
    by_char = lms[np.argsort(t[lms], kind="stable")]
    sa[ragged_ranges(end - lms_size, lms_size)] = by_char
    free = start.copy()

    def push(cur: np.ndarray, to_small: bool) -> None:
        before = cur[cur > 0] - 1
        before = before[small[before] == to_small]
        if not len(before):
            return
        chars = t[before]
        order = np.argsort(chars, kind="stable")
        chars = chars[order].astype(np.int64)
        first = np.flatnonzero(np.append(True, chars[1:] != chars[:-1]))
        count = np.diff(np.append(first, len(chars)))
        rank = np.arange(len(chars)) - np.repeat(first, count)
        if to_small:
            sa[free[chars] - 1 - rank] = before[order]
            free[chars[first]] -= count
        else:
            sa[free[chars] + rank] = before[order]
            free[chars[first]] += count

    for c in np.flatnonzero(size).tolist():
        done = start[c]
        while done < free[c]:
            upto = free[c]
            push(sa[done:upto].copy(), False)
            done = upto
        if lms_size[c]:
            push(sa[end[c] - lms_size[c]:end[c]].copy(), False)
    larger_end, free = free, end.copy()
    sa[0], free[t[n - 1]] = n - 1, end[t[n - 1]] - 1  # the last suffix is the smallest
    for c in np.flatnonzero(size)[::-1].tolist():
        done = end[c]
        while done > free[c]:
            upto = free[c]
            push(sa[upto:done][::-1].copy(), True)
            done = upto
        if larger_end[c] > start[c]:
            push(sa[start[c]:larger_end[c]][::-1].copy(), True)
    return sa


def _induce_by_scan(t: np.ndarray, small: np.ndarray, sigma: int, lms: np.ndarray) -> np.ndarray:
    """The same with two plain sweeps (large alphabets, on shortened strings)."""
    n = len(t)
    size = np.bincount(t, minlength=sigma)
    end = np.cumsum(size)
    text, smaller = t.tolist(), small.tolist()
    sa, free = [-1] * n, end.tolist()
    for i in reversed(lms.tolist()):
        c = text[i]
        free[c] -= 1
        sa[free[c]] = i
    placed = free
    free = (end - size).tolist()
    for i in sa:  # the sweep sees what it has put in further on
        if i > 0 and not smaller[i - 1]:
            c = text[i - 1]
            sa[free[c]] = i - 1
            free[c] += 1
    for c, upto in enumerate(end.tolist()):  # the LMS places are filled anew
        for r in range(placed[c], upto):
            sa[r] = -1
    free = end.tolist()
    sa[0] = n - 1
    free[text[n - 1]] -= 1
    for i in reversed(sa):
        if i > 0 and smaller[i - 1]:
            c = text[i - 1]
            free[c] -= 1
            sa[free[c]] = i - 1
    return np.array(sa, np.int64)


def _named(t: np.ndarray, small: np.ndarray, sigma: int, lms: np.ndarray) -> np.ndarray:
    """For each LMS substring (up to the next LMS position, included), how many are smaller.

    Characters count with their types, larger ones first, so none is a prefix of another.
    As many as fit a 64-bit number are compared at once; what is equal so far goes on.
    """
    item = 2 * t + small
    bits = int(2 * sigma).bit_length()
    per, n = 64 // bits, len(lms)
    length = np.append(np.diff(lms) + 1, 1)
    rank, open_ = np.zeros(n, np.int64), np.arange(n)
    for done in range(0, int(length.max()), per):
        part = np.zeros(len(open_), np.uint64)
        for k in range(done, done + per):
            inside = k < length[open_]
            part <<= np.uint64(bits)
            part[inside] |= item[lms[open_[inside]] + k].astype(np.uint64)
        order = np.lexsort((part, rank[open_])) if done else np.argsort(part)
        open_, part = open_[order], part[order]
        before = rank[open_]
        first = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (before[1:] != before[:-1])))
        count = np.diff(np.append(first, len(open_)))
        # a rank is the number of smaller substrings, so a group's parts stay inside its range
        group = np.searchsorted(before, before)
        rank[open_] = before + np.repeat(first, count) - group
        open_ = open_[np.repeat(count > 1, count)]
        open_ = open_[length[open_] > done + per]
        if not len(open_):
            break
    return rank


def _ordered(rank: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of ``rank`` (for each character, how many are smaller; the last is the least).

    Suffixes whose first ``h`` characters are ranked are ranked by three times as many, by the
    ranks of what follows; those that stand alone drop out.
    """
    n = len(rank)
    bits = n.bit_length()
    threefold = 3 * bits <= 63
    rank, h = rank.copy(), 1
    open_ = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
    while len(open_):
        before = rank[open_]
        # equal beginnings do not reach the last character, so the next part begins inside
        key = before << bits | rank[open_ + h]
        if threefold:
            key = key << bits | rank[np.minimum(open_ + 2 * h, n - 1)]
        order = np.argsort(key)
        open_, before, key = open_[order], before[order], key[order]
        new = np.append(True, key[1:] != key[:-1])
        first = np.flatnonzero(new)
        group = np.flatnonzero(np.append(True, before[1:] != before[:-1]))
        count = np.diff(np.append(first, len(key)))
        rank[open_] = before + np.repeat(first, count) - np.repeat(group, np.diff(np.append(group, len(key))))
        open_ = open_[np.repeat(count > 1, count)]
        h *= 3 if threefold else 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order


def suffix_array(t: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array of integers below ``sigma`` whose last one is 0 and occurs nowhere else."""
    if len(t) == 1:
        return np.zeros(1, np.int64)
    small = _smaller(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) > 1:
        lms = lms[_ordered(_named(t, small, sigma, lms))]
    induce = _induce_by_bucket if sigma <= 512 else _induce_by_scan
    return induce(t, small, sigma, lms)


def permuted_prefixes(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place of ``text``, the common prefix with the suffix before it in the array."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    place = np.arange(n)
    # reducible: the characters on the left agree, so the value is the left one's less one
    reducible = (place > 0) & (before > 0)
    reducible[reducible] = text[place[reducible] - 1] == text[before[reducible] - 1]
    reducible[1:] &= before[:-1] >= 0
    result = np.zeros(n, np.int64)
    padded = np.concatenate([text, np.zeros(16, np.uint8)])
    eight = np.empty(n + 8, np.uint64)
    for k in range(8):
        eight[k::8] = np.frombuffer(padded, "<u8", len(eight[k::8]), k)
    own = np.flatnonzero(~reducible & (before >= 0))
    left, right, length = own, before[own], np.zeros(len(own), np.int64)
    most, active = n - np.maximum(left, right), np.arange(len(own))
    while len(active):
        differ = eight[left[active] + length[active]] ^ eight[right[active] + length[active]]
        whole = differ == 0
        lowest = differ[~whole] & (~differ[~whole] + np.uint64(1))
        length[active[~whole]] += np.frexp(lowest.astype(np.float64))[1].astype(np.int64) - 1 >> 3
        active = active[whole]
        length[active] += 8
        active = active[length[active] < most[active]]
    result[own] = np.minimum(length, most)
    source = np.maximum.accumulate(np.where(reducible, 0, place))
    return np.where(reducible, result[source] - (place - source), result)


def repeated_windows(segments: list[bytes], times: np.ndarray, windows: np.ndarray, size: int = WINDOW) -> list[np.ndarray]:
    """For each segment, which of its windows occur twice in the shard.

    Segment k stands for ``times[k]`` places; its first ``windows[k]`` positions start windows.
    """
    body = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    offsets = ragged_starts(np.array([len(s) + 1 for s in segments]))[:-1]
    chars = np.concatenate([body.astype(np.int64) + 1, [0]])
    sa = suffix_array(chars, 257)[1:]  # without the end mark
    common = permuted_prefixes(body, sa)[sa]
    weight = np.zeros(len(body), np.int64)
    weight[ragged_ranges(offsets, windows)] = np.repeat(times, windows)
    group = np.cumsum(common < size)
    twice = np.bincount(group, weight[sa])[group] > 1
    marked = np.zeros(len(body), bool)
    marked[sa[twice]] = True
    return [marked[o:o + n] for o, n in zip(offsets.tolist(), windows.tolist())]


def _bytes_of() -> Callable[[bytes], np.ndarray]:
    return lambda text: np.frombuffer(text, np.uint8)


def removed(docs: DataFrame, size: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``row_key, n_removed, n_spans, kept``: the texts that lose bytes, and what is left of them."""
    windows = Windows(size, gram=max(1, size * 4 // 25), fine_gram=max(1, size * 4 // 5))
    index = lambda segments, times, n: repeated_windows(segments, times, n, size)
    found = touched(docs, _bytes_of, index, windows, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            rows = []
            for body, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                gone = covered(len(body), spans, size)
                runs = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                rows.append((int(gone.sum()), runs, np.frombuffer(body, np.uint8)[~gone].tobytes()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                                              pa.array([r[2] for r in rows], pa.binary())], ["row_key", "n_removed", "n_spans", "kept"])

    return found.mapInArrow(run, "row_key binary, n_removed long, n_spans long, kept binary")


def remove(docs: DataFrame, size: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with the repeated byte strings cut out of their texts.

    A cut inside a character leaves its bytes; what is no valid UTF-8 then is replaced.
    """
    rows = docs.select(F.struct("*").alias("row"), row_key(doc_id, text).alias("row_key"))
    result = rows.join(removed(docs, size, doc_id, text), "row_key", "left")
    body = F.when(F.col("kept").isNull(), F.col("row")[text].cast("string")).otherwise(F.make_valid_utf8(F.col("kept").cast("string")))
    return result.select(*[(body.alias(c) if c == text else F.col("row")[c].alias(c)) for c in docs.columns])
