"""Byte-level BPE by a lazily determinised transducer, and streaming decoding.

Every prefix of a piece has exactly one last token: the vocabulary token that ends
there and stands unmerged beside the last token of what is before it. The transducer
reads one byte at a time; its state is what can still matter: the last token that was
emitted, the bytes since, and the last token of every prefix of them. A later token can
only start where the bytes read so far begin some vocabulary token; as soon as the
token paths of all such places meet, the tokens up to the meeting point are emitted, so
the lookahead is at most the longest token. States and transitions are made when they
are first met and kept in tables of a bounded size (a full table starts anew).

Whole pieces (matches of the split pattern) that were read before are looked up.

Decoding runs a UTF-8 state machine over tokens: a transition takes a state (the bytes
of an unfinished character) and a token to the next state and the finished bytes.

Defined results: null and empty texts give no ids; ids do not depend on the caches;
repeated rows get one row each; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import chain, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Entries that each table of a worker may hold.
TABLE_LIMIT = 400_000
#: Bytes read since the last emission from which emission is tried; shorter pieces emit at their end.
HOLD = 16
_PIECES = 1 << 17
_TOLD, _IDS = itemgetter(0), itemgetter(1)


_OCTETS = [bytes((i,)) for i in range(256)]


class Transducer:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.octets = {i: t for t, i in ranks.items()}
        self.sizes = {i: len(t) for t, i in ranks.items()}
        self.starts = {t[:n] for t in ranks for n in range(1, len(t))}
        self.longest = max(map(len, ranks))
        self._reached: dict[int, bool] = {}
        self._beside: dict[tuple[int, int], bool] = {}
        self._spines: dict[tuple[int, int], list[tuple[bytes, int]]] = {}
        self._reset()

    def _reset(self) -> None:
        self.states: list[tuple[int, bytes, tuple[int, ...]]] = [(-1, b"", ())]
        self.number = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.ends: dict[int, tuple[int, ...]] = {}

    def merge(self, octets: bytes) -> list[int]:
        """The plain rule: the lowest rank merges first."""
        parts = [octets[i:i + 1] for i in range(len(octets))]
        while True:
            best = min(((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))),
                       default=(1 << 60, 0))
            if best[0] == 1 << 60:
                return [self.ranks[p] for p in parts]
            parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    def _spine(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """The tokens that stand at one end (0 left, 1 right) while the token is made, last first, each with the rank of
        the merge that takes it up."""
        known = self._spines.get((token, side))
        if known is None:
            octets, known = self.octets[token], [(self.octets[token], 1 << 60)]
            parts, steps = [octets[i:i + 1] for i in range(len(octets))], []
            while len(parts) > 1:
                rank, i = min((self.ranks.get(x + y, 1 << 60), i) for i, (x, y) in enumerate(zip(parts, parts[1:])))
                if i == (0 if side == 0 else len(parts) - 2):
                    steps.append((parts[i + side], rank))
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
            known += reversed(steps)
            self._spines[token, side] = known
        return known

    def beside(self, a: int, b: int) -> bool:
        """Tokens a and b stay as they are when their bytes stand together: no merge over the border comes before
        the merges that take its two sides up (of equal ranks the left one comes first)."""
        known = self._beside.get((a, b))
        if known is None:
            if len(self._beside) >= 4 * TABLE_LIMIT:
                self._beside.clear()
            known = True
            for left, until_left in self._spine(a, 1):
                for right, until_right in self._spine(b, 0):
                    rank = self.ranks.get(left + right)
                    if rank is not None and rank < until_left and rank <= until_right:
                        known = False
            self._beside[a, b] = known
        return known

    def _last(self, octets: bytes, end: int, last: Sequence[int], before: int) -> int:
        """The last token of octets[:end], given those of all shorter prefixes in ``last``."""
        ranks, reached, beside = self.ranks, self._reached, self._beside
        # exactly one place fits; most often the last token grows, else the new one is short
        grown = end - 1 - self.sizes[last[-1]] if last else -1
        start = grown if last else end - 1
        while True:
            token = ranks.get(octets[start:end], -1)
            if token >= 0:
                known = reached.get(token)
                if known if known is not None else self.reached(token):
                    prior = last[start - 1] if start else before
                    if prior < 0:
                        return token
                    known = beside.get((prior, token))
                    if known if known is not None else self.beside(prior, token):
                        return token
            if start == grown:
                start, grown = end, -1
            start -= 1
            if start < 0 or end - start > self.longest:
                raise ValueError("a byte without a token")

    def _step(self, state: int, octet: int) -> tuple[int, tuple[int, ...]]:
        before, read, last = self.states[state]
        n = len(read)
        read += _OCTETS[octet]
        token = self._last(read, n + 1, last, before)
        last += (token,)
        out: tuple[int, ...] = ()
        if n + 1 >= HOLD and (meet := self._meet(read, last)):
            out = self._path(last[:meet])
            before, read, last = out[-1], read[meet:], last[meet:]
        key = (before, read, last)
        if before < 0:  # nothing has left yet: a state has one way to it
            to = len(self.states)
            self.states.append(key)
        else:
            to = self.number.get(key, -1)
            if to < 0:
                to = self.number[key] = len(self.states)
                self.states.append(key)
        self.moves[state << 8 | octet] = (to, out)
        return to, out

    def _meet(self, read: bytes, last: tuple[int, ...]) -> int:
        """The last place that the token paths of all places share where a later token may start: here, or
        where the bytes up to here begin a longer token."""
        n = len(read)
        live = [n, *(s for s in range(max(0, n - self.longest + 1), n) if read[s:] in self.starts)]
        common: set[int] | None = None
        for s in live:
            path = {0}
            while s > 0:
                path.add(s)
                s -= len(self.octets[last[s - 1]])
            common = path if common is None else common & path
        return max(common or {0})

    def reached(self, token: int) -> bool:
        """The token's own bytes give the token (not so for ranks that no merge reaches)."""
        known = self._reached.get(token)
        if known is None:
            known = self._reached[token] = self.merge(self.octets[token]) == [token]
        return known

    def _path(self, last: Sequence[int]) -> tuple[int, ...]:
        out, at, sizes = [], len(last), self.sizes
        while at:
            token = last[at - 1]
            out.append(token)
            at -= sizes[token]
        return tuple(reversed(out))

    def ids(self, octets: bytes) -> Iterator[int]:
        """Ids of one piece, each emitted as soon as it is certain."""
        if len(self.states) > TABLE_LIMIT or len(self.moves) > 2 * TABLE_LIMIT:
            self._reset()
        state = 0
        for o in octets:
            state, out = self.moves.get(state << 8 | o) or self._step(state, o)
            yield from out
        tail = self.ends.get(state)
        if tail is None:
            tail = self.ends[state] = self._path(self.states[state][2])
        yield from tail


    def whole(self, octets: bytes) -> tuple[int, ...]:
        """Ids of one piece at once."""
        if len(octets) >= HOLD:
            return tuple(self.ids(octets))
        if len(self.states) > TABLE_LIMIT or len(self.moves) > 2 * TABLE_LIMIT:
            self._reset()
        state, moves = 0, self.moves
        for n, o in enumerate(octets):  # nothing leaves before the end
            move = moves.get(state << 8 | o)
            if move is None:
                break
            state = move[0]
        else:
            return self._path(self.states[state][2])
        # one more state is made; what follows of a piece met for the first time is read without making states
        state, _ = self._step(state, o)
        last = list(self.states[state][2])
        for end in range(n + 2, len(octets) + 1):
            last.append(self._last(octets, end, last, -1))
        return self._path(last)


class Encoder(dict):
    """Piece -> its ids, told in decimal, and how many they are."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex
        super().__init__()
        self.transducer = Transducer(ranks)
        self.pattern = regex.compile(pattern)

    def __missing__(self, piece: str) -> tuple[str, tuple[int, ...]]:
        if len(self) >= TABLE_LIMIT:
            self.clear()
        ids = self.transducer.whole(piece.encode())
        got = " ".join(map(str, ids)), ids
        if len(piece) < 64:
            self[piece] = got
        return got

    def pieces(self, text: str) -> Iterator[list[str]]:
        if len(text) < 1 << 20:
            yield self.pattern.findall(text)
            return
        found = (m.group() for m in self.pattern.finditer(text))
        while part := list(islice(found, _PIECES)):
            yield part

    def encode(self, text: str) -> Iterator[int]:
        for part in self.pieces(text):
            yield from chain.from_iterable(ids for _, ids in map(self.__getitem__, part))


class Decoder:
    """Ids to bytes; whole characters come out as soon as their last byte is read."""

    def __init__(self, octets: dict[int, bytes]) -> None:
        self.octets = octets
        self.moves: dict[tuple[bytes, int], tuple[bytes, bytes]] = {}

    @staticmethod
    def _open(read: bytes) -> int:
        """Bytes at the end that begin a character and do not finish it."""
        for n in range(1, min(3, len(read)) + 1):
            o = read[-n]
            if o & 0xC0 != 0x80:
                need = 2 if o >> 5 == 6 else 3 if o >> 4 == 14 else 4 if o >> 3 == 30 else 1
                return n if need > n else 0
        return 0

    def decode(self, ids: Iterable[int]) -> Iterator[bytes]:
        state, moves = b"", self.moves
        for i in ids:
            move = moves.get((state, i))
            if move is None:
                read = state + self.octets[i]
                cut = len(read) - self._open(read)
                if len(moves) >= TABLE_LIMIT:
                    moves.clear()
                move = moves[state, i] = read[cut:], read[:cut]
            state, out = move
            if out:
                yield out
        if state:
            yield state


    def decode_runs(self, runs: Iterable[list[int]]) -> Iterator[bytes]:
        """The same for runs of ids: one move of the machine takes a whole run."""
        state = b""
        for run in runs:
            read = state + b"".join(map(self.octets.__getitem__, run))
            cut = len(read) - self._open(read)
            state = read[cut:]
            if cut:
                yield read[:cut]
        if state:
            yield state


@lru_cache(maxsize=2)
def codec(ranks_file: str, pattern: str) -> tuple[Encoder, Decoder]:
    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}
    encoder = Encoder(ranks, pattern)
    return encoder, Decoder(encoder.transducer.octets)


def encode(docs: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int) of every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = codec(ranks_file, pattern)
        for b in batches:
            ids = [list(encoder.encode(t.as_py() or "")) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """doc_id, decoded (binary) of every row of ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decoder = codec(ranks_file, pattern)
        for b in batches:
            out = [b"".join(decoder.decode_runs([i.as_py() or []])) for i in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "decoded"])
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def digests(docs: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: both directions of every whole text, streamed."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = codec(ranks_file, pattern)
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                told, back, n = hashlib.sha256(), hashlib.sha256(), 0

                def runs() -> Iterator[list[int]]:
                    nonlocal n
                    for part in encoder.pieces(text.as_py() or ""):
                        got = list(map(encoder.__getitem__, part))
                        if got:
                            told.update(((" " if n else "") + " ".join(map(_TOLD, got))).encode())
                        each = list(chain.from_iterable(map(_IDS, got)))
                        n += len(each)
                        yield each
                for part in decoder.decode_runs(runs()):
                    back.update(part)
                rows.append((doc, n, told.hexdigest(), back.hexdigest()))
            cols = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()))], names)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
