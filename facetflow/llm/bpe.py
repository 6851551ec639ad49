"""Byte-level BPE by backtracking over longest matches; equal to merging by rank, in linear time."""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame


class Encoder:
    """Ids of a text by a rank file: `token rank` lines, the token in base64.

    Bytes are mapped to Latin-1 characters, so that pyahocorasick can hold the tokens. A piece is
    encoded by taking the longest token at each place; a token may follow another only if merging by rank
    would leave the two side by side (memoised by the pair), else a shorter one is tried, or the previous
    token is given up. Places from which no way leads on are marked, so each is visited once.
    """

    MEMO = 400_000  # pieces and pairs each kept at most; the memory bound of a worker

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.rank = {token.decode("latin-1"): i for token, i in ranks.items()}
        self.text = {i: token for token, i in self.rank.items()}
        self.raw = {i: token for token, i in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, tuple[str, int, bytes]] = {}
        self.shorter: dict[int, int] = {}
        self.tokens = ahocorasick.Automaton()
        for token, i in self.rank.items():
            if len(token) == 1 or self.split_of(token):  # others stand alone only as whole pieces
                self.tokens.add_word(token, (i, len(token)))
        self.tokens.make_automaton()

    @classmethod
    def load(cls, path: str, pattern: str) -> Encoder:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return cls(ranks, pattern)

    def merge(self, text: str) -> list[str]:
        """Plain merging by rank; used on single tokens, which are short."""
        parts = list(text)
        while len(parts) > 1:
            best, at = min((self.rank.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def split_of(self, token: str) -> tuple[str, str] | None:
        """The two tokens whose merge makes this one, None for a single byte and for a token that merging never makes."""
        if token not in self.halves:
            mine, last = self.rank[token], None
            if len(token) > 1:
                parts = list(token)
                while len(parts) > 2:
                    best, at = min((self.rank.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                    if best >= mine:
                        break
                    parts[at : at + 2] = [parts[at] + parts[at + 1]]
                last = (parts[0], parts[1]) if len(parts) == 2 else None
            self.halves[token] = last
        return self.halves[token]

    def adjacent(self, left: int, right: int) -> bool:
        """Whether merging the two tokens' bytes by rank leaves exactly these two."""
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            known = self._adjacent(self.text[left], self.text[right])
            if len(self.pairs) >= self.MEMO:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def prefix(self, token: int) -> int:
        """The longest token that is a proper prefix of this one; -1 if there is none."""
        known = self.shorter.get(token)
        if known is None:
            text, known = self.text[token], -1
            for end in range(len(text) - 1, 0, -1):
                i = self.rank.get(text[:end])
                if i is not None and (end == 1 or self.split_of(text[:end])):
                    known = i
                    break
            self.shorter[token] = known
        return known

    def _adjacent(self, left: str, right: str) -> bool:
        """Undo the later of the two tokens' last merges step by step; a merge across the border that would come first breaks the pair."""
        limit = 1 << 60
        while True:
            across = self.rank.get(left + right)
            if across is not None and across < limit:
                return False
            a, b = (self.rank[left] if len(left) > 1 else -1), (self.rank[right] if len(right) > 1 else -1)
            if a > b:
                # equal ranks merge from the left, so a border merge of the same rank as left's comes later
                limit = a
                halves = self.split_of(left)
                if halves is None:
                    return False
                left = halves[1]
                if (across := self.rank.get(left + right)) is not None and across < limit:
                    return False
            elif b >= 0:
                limit = b + 1  # a border merge of the same rank lies further left and comes first
                halves = self.split_of(right)
                if halves is None:
                    return False
                right = halves[0]
                if (across := self.rank.get(left + right)) is not None and across < limit:
                    return False
            else:
                return True

    def piece(self, piece: str) -> list[int]:
        """Ids of one piece (Latin-1 text of its bytes)."""
        if piece in self.rank:
            return [self.rank[piece]]
        n = len(piece)
        longest, size = [0] * n, [0] * n
        for end, (i, length) in self.tokens.iter(piece):  # a later match at a place is a longer one
            longest[end + 1 - length], size[end + 1 - length] = i, length
        dead: set[int] = set()
        out: list[int] = []
        pairs, at, token, length, left = self.pairs, 0, longest[0], size[0], -1
        while True:
            while True:
                if at + length not in dead and (left < 0 or (ok if (ok := pairs.get(left << 32 | token)) is not None else self.adjacent(left, token))):
                    out.append(token)
                    at += length
                    if at == n:
                        return out
                    left, token, length = token, longest[at], size[at]
                    break
                token = self.prefix(token)
                if token < 0:  # nothing fits here: give up the token before and try a shorter one in its place
                    dead.add(at)
                    token = out.pop()
                    at -= len(self.text[token])
                    left = out[-1] if out else -1
                    token = self.prefix(token)
                    while token < 0:
                        dead.add(at)
                        token = out.pop()
                        at -= len(self.text[token])
                        left = out[-1] if out else -1
                        token = self.prefix(token)
                length = len(self.text[token])

    def known(self, piece: str) -> tuple[str, int, bytes]:
        """(ids joined by commas, number of ids, decoded bytes) of a piece of the pattern."""
        found = self.pieces.get(piece)
        if found is None:
            ids = self.piece(piece.encode("utf-8", "surrogatepass").decode("latin-1"))
            found = (",".join(map(str, ids)), len(ids), b"".join([self.raw[i] for i in ids]))
            if len(self.pieces) >= self.MEMO:
                self.pieces.clear()
            if len(piece) <= 64:
                self.pieces[piece] = found
        return found

    def encode(self, text: str) -> list[int]:
        return [int(i) for piece in self.split(text) for i in self.known(piece)[0].split(",")]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.raw[i] for i in ids])


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder a worker process."""
    return Encoder.load(path, pattern)


def encoded(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, ids array<int>, decoded binary. Null or empty text: no ids, empty bytes. Narrow; the rank file's path must exist on every machine."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [own.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([own.decode(i) for i in ids], pa.binary())], names=[key, "ids", "decoded"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, n_tokens, ids_sha256, decoded_sha256 of the whole text's ids and of the bytes that they decode to.

    Null or empty text: 0 tokens and the digest of nothing. Repeated rows give repeated rows. Texts of any length are encoded whole, in time by
    their length. An empty table gives an empty result; other columns are ignored. The ids stay in the worker; only the digests leave it.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            counts, ids, raws = [], [], []
            for value in batch.column(1):
                parts = [own.known(p) for p in own.split(value.as_py() or "")]
                counts.append(sum([p[1] for p in parts]))
                ids.append(hashlib.sha256(",".join([p[0] for p in parts]).encode()).hexdigest())
                raws.append(hashlib.sha256(b"".join([p[2] for p in parts])).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(raws, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
