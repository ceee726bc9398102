"""Periodic runs of words: Karp-Miller-Rosenberg names of power-of-two blocks.

A run is a stretch of words with smallest period q (words q apart are the same),
at least ``min_repeats`` periods and ``min_words`` words long, that no neighbouring
word extends. The words of many texts are laid into one array and named: level 0
names each (text, word), level k names each block of 2^k words by the pair of
names of its halves, until no block of a level occurs twice. Equal names mean
equal blocks, so no hash can collide and nothing is verified again; as names hold
their text, no block reaches from one text into another.

A run of period p matches itself p words on along at least length - p words, so
one of the grid positions 0, g, 2g, ... with g = that least stretch lies in it. Each
grid position whose word equals the word p on is a candidate; it is extended to
both sides by descending through the levels (the binary digits of the common
extension, in array operations over all candidates). There are about n/3 * ln(n/4)
grid positions, whatever the text. A stretch that is periodic in a multiple of q
too comes out at the same place and is kept with q alone.

Memory: texts are taken up to ``WORDS`` words together (a longer one by itself),
candidates ``AT_ONCE`` at a time.

Defined results: null, empty and blank texts have no words, no runs and an empty
collapsed text; each row gives a row, repeated ones the same; a column that has
the name of a new one gives it up, other columns stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.store import fresh, release, without

MIN_WORDS, MIN_REPEATS = 6, 4
WORDS, AT_ONCE = 200_000, 2_000_000
NEW = ("n_words", "runs", "collapsed")

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def levels(first: np.ndarray, longest: int) -> list[np.ndarray]:
    """Names of all blocks of 1, 2, 4, ... words from the names of single words; no text has more than ``longest``.

    Ends at the last level on which two blocks are equal, so a common extension has
    fewer than twice the words of that level's blocks.
    """
    out = [first]
    while (size := 1 << (len(out) - 1)) * 2 <= min(longest, len(first)):
        last = out[-1].astype(np.int64)
        found, names = np.unique(last[:-size] * (int(last.max()) + 1) + last[size:], return_inverse=True)
        if len(found) == len(names):
            break
        out.append(names.astype(np.int32))
    return out


def ahead(named: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words from i on equal those from j on (i < j)."""
    got = np.zeros(len(i), np.int64)
    for k in reversed(range(len(named))):
        t = named[k]
        at = j + got
        same = t[np.minimum(i + got, len(t) - 1)] == t[np.minimum(at, len(t) - 1)]
        got += (same & (at < len(t))).astype(np.int64) << k
    return got


def behind(named: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words before i equal those before j (i < j)."""
    got = np.zeros(len(i), np.int64)
    for k in reversed(range(len(named))):
        t = named[k]
        at = i - got - (1 << k)
        same = t[np.maximum(at, 0)] == t[np.maximum(j - got - (1 << k), 0)]
        got += (same & (at >= 0)).astype(np.int64) << k
    return got


def _grid(begin: np.ndarray, size: np.ndarray, min_words: int, min_repeats: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (grid position, period) of texts that begin at ``begin`` and have ``size`` words."""
    most = np.where(size >= min_words, size // min_repeats, 0)
    of = np.repeat(np.arange(len(size)), most)
    period = np.arange(len(of)) - np.repeat(np.cumsum(most) - most, most) + 1
    step = np.maximum(min_words, min_repeats * period) - period
    count = (size[of] - period - 1) // step + 1
    done = np.cumsum(count)
    at = 0
    while at < len(of):
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + AT_ONCE, side="right")))
        n, ends = count[at:to], np.cumsum(count[at:to])
        t = np.arange(ends[-1]) - np.repeat(ends - n, n)
        yield np.repeat(begin[of[at:to]], n) + t * np.repeat(step[at:to], n), np.repeat(period[at:to], n)
        at = to


def find(words: np.ndarray, begin: np.ndarray, size: np.ndarray, min_words: int = MIN_WORDS, min_repeats: int = MIN_REPEATS) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and then period; texts lie one behind the other in ``words`` (codes)."""
    none = np.empty((0, 3), np.int64)
    if not len(words):
        return none
    text = np.repeat(np.arange(len(size)), size)
    first = np.unique(text * (int(words.max()) + 1) + words, return_inverse=True)[1]
    named, parts = levels(first.astype(np.int32), int(size.max())), [none]
    for i, p in _grid(begin, size, min_words, min_repeats):
        some = np.flatnonzero(named[0][i] == named[0][i + p])
        i, p = i[some], p[some]
        back = behind(named, i, i + p)
        length = back + ahead(named, i, i + p) + p
        enough = length >= np.maximum(min_words, min_repeats * p)
        rows = np.stack([i - back, length, p], 1)[enough]
        parts.append(np.unique(rows, axis=0))
    rows = np.concatenate(parts)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    least = np.ones(len(rows), bool)  # of one stretch, its smallest period
    least[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    rows = rows[least]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _texts(texts: list[str | None], min_words: int, min_repeats: int) -> tuple[list[int], list[list[dict]], list[str]]:
    split = [_WORD.findall(t or "") for t in texts]
    flat = [w for ws in split for w in ws]
    size = np.array([len(ws) for ws in split], np.int64)
    begin = np.cumsum(size) - size
    codes = pa.array(flat, pa.string()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    rows = find(codes, begin, size, min_words, min_repeats)
    gone = np.zeros(len(flat) + 1, np.int64)
    np.add.at(gone, rows[:, 0] + rows[:, 2], 1)
    np.add.at(gone, rows[:, 0] + rows[:, 1], -1)
    keep = np.cumsum(gone)[:-1] == 0
    ends = np.searchsorted(rows[:, 0], begin + size)
    runs, collapsed = [], []
    for a, n, low, high in zip(begin.tolist(), size.tolist(), [0, *ends.tolist()], ends.tolist()):
        runs.append([{"start": s - a, "length": m, "period": p} for s, m, p in rows[low:high].tolist()])
        collapsed.append(" ".join([flat[i] for i in (a + np.flatnonzero(keep[a : a + n])).tolist()] if high > low else flat[a : a + n]))
    return size.tolist(), runs, collapsed


def runs(df: DataFrame, text: str = "text", min_words: int = MIN_WORDS, min_repeats: int = MIN_REPEATS) -> DataFrame:
    """``df`` with n_words, runs (array of start, length, period in words) and collapsed (each run cut to its first period)."""
    if min_repeats < 2 or min_words < 2:
        raise ValueError("a run needs two periods and two words at least")
    kept = without(df, *NEW)
    own = df.select(*[F.col(f"`{c}`") for c in kept.columns], F.col(text).cast("string").alias(fresh(df, "_text")))
    run_type = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
    schema = T.StructType([*kept.schema.fields, *[T.StructField(n, k) for n, k in zip(NEW, (T.LongType(), run_type, T.StringType()))]])
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in (whole.slice(at, 512) for whole in batches for at in range(0, whole.num_rows, 512)):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            at = 0
            while at < len(texts):
                to, held = at, 0
                while to < len(texts) and (to == at or held + len(texts[to] or "") // 4 <= WORDS):
                    held += len(texts[to] or "") // 4  # words of these texts, about
                    to += 1
                n, found, collapsed = _texts(texts[at:to], min_words, min_repeats)
                some = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array(n, pa.int64()), pa.array(found, kind), pa.array(collapsed, pa.string())], names=[*some.schema.names[:-1], *NEW])
                at = to

    return own.mapInArrow(run, schema)
