"""Fill-in-the-middle transformation: cut ranks found by overlapping chunks, one linear pass.

A text is cut into units (code points, words or lines) at byte positions where a
predicate on two adjacent bytes holds. The bytes of a batch of texts are one
buffer, taken apart into chunks of ``CHUNK`` bytes that overlap their left
neighbour by one byte, so every chunk counts its unit starts by itself, all of
them in array operations. Prefix sums of the counts give each text's n and route
both cut ranks to the chunks that own them; only those chunks are scanned again
for the byte position. Nothing is decoded and nothing is shuffled: a text of any
length is cut where it lies, and Spark deals the texts over the tasks.

The draws come from SHA-256 of ``seed:doc_id``, so a repeated task gives the same
rows. The forms are plain, psm (prefix, suffix, middle) and spm (suffix, prefix,
middle), each part behind its sentinel; ``restored`` is exact, as a text that
holds a sentinel stays plain and no sentinel can arise across a joint.

Defined results: null and empty texts have n = 0, form plain and an empty output;
a null id draws as an empty one; each row gives a row, repeated ones the same; a
column that has the name of a new one gives it up, other columns stay. A word is
what stands between blanks and goes with the blanks behind it; blanks before the
first word belong to it. A line ends behind its line feed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.store import fresh, release, without

#: Bytes of a chunk; chunks of one array operation.
CHUNK, AT_ONCE = 4096, 2048
#: Sentinels before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
NEW = ("n", "form", "prefix_units", "middle_units", "output")


def _blank(x: np.ndarray) -> np.ndarray:
    return (x == 0x20) | ((x >= 0x09) & (x <= 0x0D))


#: Unit -> whether a unit starts at a byte, from the byte before and the byte itself.
STARTS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "char": lambda before, here: (here & 0xC0) != 0x80,
    "word": lambda before, here: _blank(before) & ~_blank(here),
    "line": lambda before, here: before == 0x0A,
}


class Chunks:
    """Unit starts of texts that lie one behind the other in ``data``, text t in begin[t]:end[t]."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, unit: str, chunk: int = CHUNK):
        self.data, self.begin, self.end, self.starts = data, begin, end, STARTS[unit]
        per_text = -(-(end - begin) // chunk)
        first = np.concatenate([[0], np.cumsum(per_text)])
        of = np.repeat(np.arange(len(begin)), per_text)
        self.low = begin[of] + (np.arange(first[-1]) - first[of]) * chunk
        self.high = np.minimum(self.low + chunk, end[of])
        self.heads = begin[end > begin]  # first bytes of texts, in order: a unit starts there whatever stands before
        counts = [self._counted(at, min(at + AT_ONCE, len(self.low))) for at in range(0, len(self.low), AT_ONCE)]
        self.upto = np.concatenate([[0], *counts]).cumsum()  # units before each chunk, over all texts
        self.base = self.upto[first[:-1]]
        self.n = self.upto[first[1:]] - self.base

    def marks(self, low: int, high: int) -> np.ndarray:
        """Whether a unit starts, for each byte of a range; one byte to its left is read with it."""
        here = self.data[low:high]
        before = self.data[low - 1 : high - 1] if low else np.concatenate([[0], self.data[: high - 1]]).astype(np.uint8)
        found = self.starts(before, here)
        found[self.heads[np.searchsorted(self.heads, low) : np.searchsorted(self.heads, high)] - low] = True
        return found

    def _counted(self, a: int, b: int) -> np.ndarray:
        low = self.low[a]
        return np.add.reduceat(self.marks(low, self.high[b - 1]), self.low[a:b] - low, dtype=np.int64)

    def positions(self, rank: np.ndarray) -> np.ndarray:
        """Byte position of unit ``rank[t]`` of each text t; its end for rank n."""
        out = self.end.copy()
        asked = np.flatnonzero(rank < self.n)
        wanted = self.base[asked] + rank[asked]
        owner = np.searchsorted(self.upto, wanted, side="right") - 1
        for t, w, c in zip(asked.tolist(), wanted.tolist(), owner.tolist()):
            out[t] = self.low[c] + np.flatnonzero(self.marks(self.low[c], self.high[c]))[w - self.upto[c]]
        return out


def draws(doc_id: Column, seed: int, n: int = 4) -> list[Column]:
    """The first ``n`` groups of eight hexadecimal digits of SHA-256 of ``seed:doc_id``, as whole numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)]


def _check(sentinels: tuple[str, ...]) -> None:
    for a in sentinels:
        for b in sentinels:
            if not a or (a != b and a in b) or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
                raise ValueError(f"sentinels {a!r} and {b!r} could arise across a joint")
    if len(set(sentinels)) != 3:
        raise ValueError("three different sentinels are needed")


def transform(df: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: str = "char", seed: int = 1, percent: int = 90, spm_percent: int = 20, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """``df`` with n (units), form, prefix_units, middle_units (null if plain) and output."""
    _check(sentinels)
    kept = without(df, *NEW)
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    h = draws(F.col(doc_id), seed)
    holds = [F.contains(whole, F.lit(s)) for s in sentinels]
    form = F.when((whole == "") | holds[0] | holds[1] | holds[2] | (h[2] % 100 >= percent), "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm")
    hidden = [fresh(df, f"_{x}") for x in ("text", "form", "h1", "h2")]
    own = df.select(*[F.col(f"`{c}`") for c in kept.columns], *[c.alias(n) for c, n in zip((whole, form, h[0], h[1]), hidden)])
    kinds = (T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType())
    schema = T.StructType([*kept.schema.fields, *[T.StructField(n, k) for n, k in zip(NEW, kinds)]])
    p, s, m = (x.encode() for x in sentinels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in (all_.slice(at, 512) for all_ in batches for at in range(0, all_.num_rows, 512)):
            *_, texts, forms, h1, h2 = batch.columns
            texts = texts.cast(pa.large_binary())
            at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            begin, end = at[:-1].copy(), at[1:].copy()
            found = Chunks(data, begin, end, unit)
            one, two = h1.to_numpy() % (found.n + 1), h2.to_numpy() % (found.n + 1)
            low, high = np.minimum(one, two), np.maximum(one, two)
            named = forms.to_pylist()
            plain = np.array([f == "plain" for f in named], bool)
            cut, cut2 = (found.positions(np.where(plain, found.n, r)) for r in (low, high))  # plain texts are not scanned again
            out = []
            for f, a, x, y, b in zip(named, begin.tolist(), cut.tolist(), cut2.tolist(), end.tolist()):
                raw = memoryview(data)[a:b] if f == "plain" else None
                if f == "psm":
                    raw = b"".join((p, memoryview(data)[a:x], s, memoryview(data)[y:b], m, memoryview(data)[x:y]))
                elif f == "spm":
                    raw = b"".join((s, memoryview(data)[y:b], p, memoryview(data)[a:x], m, memoryview(data)[x:y]))
                out.append(bytes(raw))
            new = [pa.array(found.n), forms, pa.array(low, mask=plain), pa.array(high - low, mask=plain), pa.array(out, pa.binary()).view(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-4], *new], names=[*batch.schema.names[:-4], *NEW])

    return own.mapInArrow(run, schema)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that ``transform`` was given, from its output and form."""
    parts = F.split(output, "|".join(rf"\Q{s}\E" for s in sentinels), -1)

    def joined(*order: int) -> Column:  # one split a row, whatever the number of parts
        return F.get(F.transform(F.array(parts), lambda x: F.concat(*[F.get(x, F.lit(i)) for i in order])), F.lit(0))

    return F.when(form == "psm", joined(1, 3, 2)).when(form == "spm", joined(2, 3, 1)).otherwise(output)
