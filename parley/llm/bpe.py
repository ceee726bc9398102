"""Byte-level BPE by a lazily determinised transducer, and its streaming inverse.

Encoding. A sequence of tokens is the merge result of its bytes exactly if every
token is the merge result of its own bytes and every two neighbours stay apart
when merged together. That makes the encoding the only accepted path of a
non-deterministic transducer whose states are *(last token, pending bytes)*: a
byte either extends the pending bytes along the vocabulary's prefix tree or
closes a token that is compatible with the last one. Subset states and arcs are
built on first use and kept. A hypothesis lives no longer than the longest token,
so tokens leave after a lookahead bounded by it.

Decoding. A UTF-8 automaton whose state is the unfinished byte sequence; each
(state, token) step is computed byte by byte once and kept. Malformed bytes
become U+FFFD, one per maximal malformed part, as the Unicode standard advises.

Defined results: null text counts as empty; an empty text has no ids and decodes
to the empty text; texts of any length stream through in time linear in their
length; repeated rows give a row each; other columns are kept, but for one that has
the name of a new column, which it gives up.
"""

from __future__ import annotations

import base64
import gc
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.store import fresh, large, without

#: Bounds of each worker's memory: pieces remembered, and subset states kept before starting afresh.
MAX_PIECES = 300_000
MAX_STATES = 300_000
#: Bytes of a long piece between two emissions.
PART = 1024
#: Longer pieces are encoded each time they occur.
MAX_PIECE_CHARS = 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    """Token ids of one pre-split piece of bytes.

    A hypothesis is one number, ``node << 17 | last + 1``: the tree node of the pending
    bytes and the last closed token. A subset state is a sorted tuple of them. Exactly
    one hypothesis closes a token at any byte (every prefix has one merge result), so an
    arc carries the next state and the token that closes there, ``state << 17 | token``.
    """

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values(), default=0) >= (1 << 17) - 1:
            raise ValueError("too many tokens")
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.size = {i: len(b) for b, i in ranks.items()}
        #: The prefix tree: children by ``node << 8 | byte``, the token that ends at each node (-1: none), whether it is a leaf.
        self.child: dict[int, int] = {}
        self.ends, self.inner, self.depth = [-1], [True], [0]
        for raw, i in ranks.items():
            node = 0
            for byte in raw:
                to = self.child.get(node << 8 | byte)
                if to is None:
                    to = self.child[node << 8 | byte] = len(self.ends)
                    self.ends.append(-1)
                    self.inner.append(False)
                    self.depth.append(self.depth[node] + 1)
                    self.inner[node] = True
                node = to
            self.ends[node] = i
        self.made_of: dict[int, tuple[int, int] | None] = {}
        self.edges: tuple[dict[int, list[int]], dict[int, list[int]]] = ({}, {})
        self.apart: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.number = {(0,): 0}
        self.members: list[tuple[int, ...]] = [(0,)]
        self.arcs: dict[int, int] = {}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one from its own bytes; None for a single byte or no merge."""
        found = self.made_of.get(token, ())
        if found == ():
            parts = [self.ranks[bytes((x,))] for x in self.token[token]]
            while len(parts) > 2:
                ranks = [self.ranks.get(self.token[a] + self.token[b], -1) for a, b in zip(parts, parts[1:])]
                best = min((r for r in ranks if r >= 0), default=-1)
                if best < 0:
                    break
                at = ranks.index(best)
                parts[at : at + 2] = [best]
            found = self.made_of[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return found

    def edge(self, token: int, side: int) -> list[int]:
        """Tokens that stand in turn at the left (0) or right (1) end while ``token`` is merged, the byte first."""
        found = self.edges[side].get(token)
        if found is None:
            found, at = [token], self.halves(token)
            while at:
                found.append(at[side])
                at = self.halves(at[side])
            self.edges[side][token] = found = found[::-1]
        return found

    def follows(self, last: int, token: int) -> bool:
        """Whether ``token`` may stand after ``last`` (-1: at the start) in a merge result."""
        raw = self.token[token]
        if len(raw) > 1 and not self.halves(token):
            return False
        if last < 0:
            return True
        pair = last << 17 | token
        ok = self.apart.get(pair)
        if ok is None:
            if len(self.apart) > 2 * MAX_STATES:
                self.apart.clear()
            ok = self.apart[pair] = self.stay_apart(self.edge(last, 1), self.edge(token, 0))
        return ok

    def stay_apart(self, left: list[int], right: list[int]) -> bool:
        """No merge across the border comes before those that complete its two sides.

        Merges run by rank, the leftmost first among equals, and a token ranks above
        its halves; so two edge tokens meet until the lower-ranked of the tokens that
        next absorb them is made, and a merge of the two happens if it ranks below.
        """
        i = j = 0
        never = len(self.token) + 1
        while True:
            a = left[i + 1] if i + 1 < len(left) else never
            b = right[j + 1] if j + 1 < len(right) else never
            across = self.ranks.get(self.token[left[i]] + self.token[right[j]])
            if across is not None and across < a and across <= b:
                return False
            if a == b == never:
                return True
            if a <= b:
                i += 1
            else:
                j += 1

    def step(self, state: int, byte: int) -> int:
        """The arc of a subset state, determinised on first use."""
        child, ends, inner, closed, nxt = self.child, self.ends, self.inner, -1, []
        for member in self.members[state]:
            to = child.get(member >> 17 << 8 | byte)
            if to is not None:
                last = member & 0x1FFFF
                if inner[to]:
                    nxt.append(to << 17 | last)
                if closed < 0:
                    token = ends[to]
                    if token >= 0 and self.follows(last - 1, token):
                        closed = token
                        nxt.append(token + 1)
        nxt.sort()
        members = tuple(nxt)
        to = self.number.get(members)
        if to is None:
            to = self.number[members] = len(self.members)
            self.members.append(members)
        arc = self.arcs[state << 8 | byte] = to << 17 | closed
        return arc

    def stream(self, pieces: Iterable[bytes]) -> Iterator[int]:
        """Ids of a piece that arrives in parts; each leaves once no live hypothesis can change it.

        Live hypotheses began at most one token's length ago; what lies before the last
        border that all their pasts share is certain.
        """
        arcs, state, closes, base = self.arcs, 0, [], 0
        for part in pieces:
            for byte in part:
                arc = arcs.get(state << 8 | byte)
                if arc is None:
                    arc = self.step(state, byte)
                state = arc >> 17
                closes.append(arc & 0x1FFFF)
            at = {len(closes) - self.depth[m >> 17] for m in self.members[state]}
            while len(at) > 1:
                far = max(at)
                at.remove(far)
                at.add(far - self.size[closes[far - 1]])
            yield from self._chain(closes, border := at.pop())
            del closes[:border]
        yield from self._chain(closes, len(closes))

    def _chain(self, closes: list[int], end: int) -> list[int]:
        out = []
        while end > 0:
            token = closes[end - 1]
            out.append(token)
            end -= self.size[token]
        return out[::-1]

    def encode(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        if len(self.members) > MAX_STATES:
            self.reset()
        if len(piece) > PART:
            return tuple(self.stream(piece[i : i + PART] for i in range(0, len(piece), PART)))
        arcs, state, closes = self.arcs, 0, []
        for byte in piece:
            arc = arcs.get(state << 8 | byte)
            if arc is None:
                arc = self.step(state, byte)
            state = arc >> 17
            closes.append(arc & 0x1FFFF)
        out, end, size = [], len(closes), self.size
        while end:
            token = closes[end - 1]
            out.append(token)
            end -= size[token]
        return tuple(out[::-1])


class Utf8Machine:
    """Incremental decoding; the state is the unfinished sequence (at most 3 bytes)."""

    @staticmethod
    def need(lead: int) -> tuple[int, int, int]:
        """Continuation bytes of a lead byte and the range of the first one; 0 if it leads none."""
        if 0xC2 <= lead <= 0xDF:
            return 1, 0x80, 0xBF
        if 0xE0 <= lead <= 0xEF:
            return 2, 0xA0 if lead == 0xE0 else 0x80, 0x9F if lead == 0xED else 0xBF
        if 0xF0 <= lead <= 0xF4:
            return 3, 0x90 if lead == 0xF0 else 0x80, 0x8F if lead == 0xF4 else 0xBF
        return 0, 0, 0

    @classmethod
    def feed(cls, state: bytes, data: bytes) -> tuple[str, bytes]:
        out = []
        for byte in data:
            while True:
                if not state:
                    if byte < 0x80:
                        out.append(chr(byte))
                    elif cls.need(byte)[0]:
                        state = bytes((byte,))
                    else:
                        out.append("�")
                    break
                n, low, high = cls.need(state[0])
                if len(state) > 1:
                    low, high = 0x80, 0xBF
                if low <= byte <= high:
                    state += bytes((byte,))
                    if len(state) == n + 1:
                        out.append(state.decode("utf-8"))
                        state = b""
                    break
                out.append("�")
                state = b""
        return "".join(out), state


class Pieces(dict):
    """Ids of pieces, encoded on first use; only so many short ones are kept."""

    def __init__(self, machine: Transducer):
        super().__init__()
        self.machine = machine

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.machine.encode(piece.encode("utf-8"))
        if len(self) < MAX_PIECES and len(piece) <= MAX_PIECE_CHARS:
            self[piece] = ids
        return ids


class Codec:
    def __init__(self, path: str, pattern: str):
        import regex

        self.machine = Transducer(read_ranks(path))
        self.split = regex.compile(pattern).findall
        self.pieces = Pieces(self.machine)
        #: By decoder state: id -> (text, next state).
        self.steps: dict[bytes, dict[int, tuple[str, bytes]]] = {b"": {}}
        token = self.machine.token
        self.alone: list[str | None] = [None] * (max(token, default=-1) + 1)
        for i, raw in token.items():
            text, state = Utf8Machine.feed(b"", raw)
            if not state and "�" not in text:
                self.alone[i] = text

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))

    def decode(self, ids: list[int]) -> str:
        try:
            return "".join([self.alone[i] for i in ids])  # tokens of whole characters leave the state empty
        except TypeError:
            pass
        out, state, token = [], b"", self.machine.token
        for i in ids:
            row = self.steps.setdefault(state, {})
            step = row.get(i)
            if step is None:
                step = row[i] = Utf8Machine.feed(state, token[i])
            out.append(step[0])
            state = step[1]
        return "".join(out) + "�" * bool(state)


def codec(path: str, pattern: str) -> Codec:
    gc.set_threshold(500_000, 50, 1000)  # the automata are large, acyclic and kept: frequent collections only cost
    return large((Codec, path, pattern), lambda: Codec(path, pattern))


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _chunks(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None, pattern: str | None = None) -> DataFrame:
    """``df`` with an ``array<int>`` of ids, and on request their decoded text beside it.

    ``path`` is a rank file; ``pattern`` splits texts first (default: the public one).
    """
    extra = [x for x in (ids, decoded) if x]
    pattern = pattern or default_pattern()
    kept = without(df, *extra)
    own = df.select(*[F.col(f"`{c}`") for c in kept.columns], F.col(text).cast("string").alias(fresh(df, "_text")))
    schema = T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)] + ([T.StructField(decoded, T.StringType(), False)] if decoded else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = codec(path, pattern)
        for whole in batches:
            for batch in _chunks(whole):
                flat, offsets, texts = [], [0], []
                total = 0
                for t in batch.column(batch.num_columns - 1).to_pylist():
                    got = codes.encode(t or "")
                    flat.append(np.array(got, dtype=np.int32))
                    total += len(got)
                    offsets.append(total)
                    if decoded:
                        texts.append(codes.decode(got))
                values = pa.array(np.concatenate(flat) if flat else np.empty(0, np.int32))
                columns = [*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(texts, pa.string())] if decoded else []), names=[*batch.schema.names[:-1], *extra])

    return own.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded", pattern: str | None = None) -> DataFrame:
    """``df`` with the text of an array of ids; a null array decodes to the empty text."""
    pattern = pattern or default_pattern()
    kept = without(df, text)
    own = df.select(*[F.col(f"`{c}`") for c in kept.columns], F.col(ids).alias(fresh(df, "_ids")))
    schema = T.StructType([*kept.schema.fields, T.StructField(text, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = codec(path, pattern)
        for whole in batches:
            for batch in _chunks(whole):
                texts = [codes.decode(x or []) for x in batch.column(batch.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], text])

    return own.mapInArrow(run, schema)


def digests(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, and SHA-256 of the spaced decimal ids and of the decoded bytes."""
    own = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    done = encode(own, path, "text", "ids", "decoded").select("doc_id", "ids", "decoded")
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
