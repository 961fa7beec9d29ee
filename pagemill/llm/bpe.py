"""Byte-level BPE encoding and decoding.

Vocabulary bytes are mapped to Latin-1 characters, so that the trie of an Aho-Corasick automaton over strings finds
the longest token at a place; the shorter ones there are its prefixes, linked beforehand. A piece is encoded by
backtracking: take the longest token at each place whose pairing with the token before it is compatible (merging
the two tokens' bytes gives back just these two tokens); where none is, step back and try a shorter one. A
sequence whose neighbours are all compatible is the sequence that the merges give, so the result is exact; places
once left are not entered again, so the time is linear.
Compatibility is memoised.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame

from . import shared

#: Entries kept in a worker's memory of pieces and of pairs. Full, the pairs are emptied; the pieces become the
#: older of two generations, from which those met again are taken over.
PIECES, PAIRS = 200_000, 1_000_000
#: Pieces longer than this (characters) are encoded but not remembered.
LONG = 64


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """Encodes and decodes with the ranks in a file of base64 tokens and their ranks."""

    def __init__(self, path: str, pattern: str) -> None:
        import ahocorasick
        import regex

        self.ranks = load_ranks(path)
        self.bytes = {i: b for b, i in self.ranks.items()}
        self.text = {i: str(i) for i in self.bytes}
        self.split = regex.compile(pattern).findall
        self.find = ahocorasick.Automaton()
        self.tokens = {b.decode("latin-1"): i for b, i in self.ranks.items()}
        for chars, i in self.tokens.items():
            self.find.add_word(chars, i)
        self.size = {i: len(b) for b, i in self.ranks.items()}
        self.widest = max(self.size.values(), default=1)
        # For each token, the longest token that it begins with.
        self.shorter = {i: next((t for n in range(len(c) - 1, 0, -1) if (t := self.tokens.get(c[:n])) is not None), None) for c, i in self.tokens.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def merged(self, piece: bytes) -> list[int]:
        """Plain merging, for the few bytes of two neighbouring tokens."""
        parts, ranks = [piece[i : i + 1] for i in range(len(piece))], self.ranks
        while len(parts) > 1:
            best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(self.bytes[a] + self.bytes[b]) == [a, b]
        return known

    def longest(self, chars: str, p: int) -> int:
        """The longest token at place p: the trie gives the longest path, whose end is a token or lies close after one."""
        path = chars[p : p + self.widest]
        token = None
        n = self.find.longest_prefix(path)
        while n and (token := self.tokens.get(path[:n])) is None:
            n -= 1
        if token is None:
            raise ValueError("the vocabulary lacks a byte")
        return token

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        if (whole := self.ranks.get(piece)) is not None:
            return (whole,)
        chars, n = piece.decode("latin-1"), len(piece)
        size, shorter, pairs, longest = self.size, self.shorter, self.pairs, self.longest
        open_ = bytearray(b"\x01") * (n + 1)  # places not yet given up
        out: list[int] = []
        p, token = 0, longest(chars, 0)
        while True:
            # token: the next to try at p, None once all of them have been.
            while token is not None:
                end = p + size[token]
                if open_[end]:
                    fits = not out or pairs.get((out[-1], token))
                    if fits is None:
                        fits = self.compatible(out[-1], token)
                    if fits:
                        break
                token = shorter[token]
            if token is not None:
                out.append(token)
                if end == n:
                    return tuple(out)
                p, token = end, longest(chars, end)
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a byte")
                open_[p] = 0
                last = out.pop()
                p, token = p - size[last], shorter[last]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known, get, extend = self.pieces, self.pieces.get, out.extend
        for piece in self.split(text):
            ids = get(piece)
            if ids is None:
                ids = self.older.get(piece) or self.encode_piece(piece.encode("utf-8"))
                if len(piece) <= LONG:
                    if len(known) >= PIECES:
                        self.older, self.pieces = known, {}
                        known, get = self.pieces, self.pieces.get
                    known[piece] = ids
            extend(ids)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One for each worker process."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, row_id: str = "doc_id", text: str = "text", ids: bool = True) -> DataFrame:
    """row_id, n_tokens, ids (array<int>, if ids is set), ids_sha256 and decoded_sha256 of each row's whole text.

    Null texts count as empty: no tokens, and the hashes of nothing. Very long texts are encoded whole. Rows keep their number
    and order, repeated ones too; other columns are ignored, whatever they are called; an empty table gives an empty result. path
    is a file on every machine.
    """
    import pyarrow as pa

    shared.prepare(docs.sparkSession)
    kind = docs.schema[row_id].dataType.simpleString()
    schema = f"`{row_id}` {kind}, n_tokens bigint" + ", ids array<int>" * ids + ", ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            counts, lists, sums, back = [], [], [], []
            for t in batch.column(1):
                got = own.encode(t.as_py() or "")
                counts.append(len(got))
                sums.append(hashlib.sha256(" ".join(map(own.text.__getitem__, got)).encode()).hexdigest())
                back.append(hashlib.sha256(own.decode(got)).hexdigest())
                if ids:
                    lists.append(pa.array(got, pa.int32()))
            columns = {row_id: batch.column(0), "n_tokens": pa.array(counts, pa.int64())}
            if ids:
                ends = [0]
                for n in counts:
                    ends.append(ends[-1] + n)
                columns["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(lists) if lists else pa.array([], pa.int32()))
            columns |= {"ids_sha256": pa.array(sums, pa.string()), "decoded_sha256": pa.array(back, pa.string())}
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select(row_id, text).mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """rows with decoded (binary): the bytes of the ids; null ids decode to nothing."""
    import pandas as pd
    from pyspark.sql import functions as F

    @F.pandas_udf("binary")
    def back(lists: pd.Series) -> pd.Series:
        own = codec(path, pattern)
        return pd.Series([own.decode(list(x)) if x is not None else b"" for x in lists], dtype=object)

    return rows.withColumn("decoded", back(F.col(ids)))
