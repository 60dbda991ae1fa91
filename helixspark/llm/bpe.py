"""Byte-level BPE encoding and decoding with a public rank file.

The distinct pieces of a slice of text are laid out as padded matrices of token ids, bucketed by
length. Each round looks all neighbouring pairs up in an open-addressing hash table, merges every
row's leftmost pair of least rank, and closes the gaps; rows without a mergeable pair leave.
A piece longer than the widest of these matrices is a row of its own, of its own length, in which a round
merges the pair of least rank wherever it stands, from the left, up to the first place where that makes
a pair of lower rank, which goes first; so the ids are those of round after round. A worker keeps the pieces it has met, up to a bound.

Defined results: null counts as empty and has no ids; repeated rows repeat; an empty table gives
an empty result; other columns don't matter.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixspark.llm import words
from helixspark.llm.text import named
from helixspark.session import ship, table

WIDEST = 128
#: Cells of a matrix that are merged at once, and pieces that a worker remembers.
CELLS, REMEMBER = 1 << 19, 100_000
_U = np.uint64
_NONE = np.int32(2**31 - 1)


class PairTable:
    """Rank of a pair of token ids by hashing, for whole arrays at a time."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        rows = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        a, b, r = np.array(rows, np.uint64).reshape(-1, 3).T
        keys = (a << _U(32)) | b
        bits = max(4, int(np.ceil(np.log2(4 * len(keys) + 1))))
        self.shift, self.mask = _U(64 - bits), (1 << bits) - 1
        self.keys, self.ranks, self.probes = np.full(1 << bits, 2**64 - 1, np.uint64), np.full(1 << bits, _NONE, np.int32), 0
        left = np.arange(len(keys))
        while len(left):  # whoever finds its slot free takes it, the others go one further
            slot = (self._slot(keys[left]) + self.probes) & self.mask
            free = self.ranks[slot] == _NONE
            _, winner = np.unique(slot[free], return_index=True)
            take = np.flatnonzero(free)[winner]
            self.keys[slot[take]], self.ranks[slot[take]] = keys[left[take]], r[left[take]]
            left, self.probes = np.delete(left, take), self.probes + 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, _NONE where it isn't mergeable. Ids below 0 pair with nothing."""
        keys = (a.astype(np.uint64) << _U(32)) | (b.astype(np.uint64) & _U(0xFFFFFFFF))
        slot = self._slot(keys)
        found = np.where(self.keys[slot] == keys, self.ranks[slot], _NONE)
        for k in range(1, self.probes):
            open_ = np.flatnonzero((found == _NONE) & (self.ranks[(slot + k - 1) & self.mask] != _NONE))
            if not len(open_):
                break
            at = (slot[open_] + k) & self.mask
            found[open_] = np.where(self.keys[at] == keys[open_], self.ranks[at], _NONE)
        return found


class Codec:
    """Encoder and decoder for one rank file and split pattern."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.split = regex.compile(pattern).findall
        self.pairs = PairTable(self.ranks)
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        n = max(self.ranks.values()) + 1
        tokens = [b""] * n
        for t, r in self.ranks.items():
            tokens[r] = t
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids: list[np.ndarray] = []
        self.texts: list[str] = []

    def _long(self, piece: bytes) -> np.ndarray:
        """Merges one piece of any length."""
        ids = self.byte[np.frombuffer(piece, np.uint8)]
        rank = self.pairs(ids[:-1], ids[1:])
        while len(rank) and (best := rank.min()) != _NONE:
            at = np.flatnonzero(rank == best)
            if len(at) > 1:
                run = np.flatnonzero(np.diff(at, prepend=-2) != 1)  # of pairs that overlap the first, third, ... are merged
                at = at[(np.arange(len(at)) - np.repeat(run, np.diff(run, append=len(at)))) % 2 == 0]
                merged = np.full(len(at), best, np.int32)
                left = np.where(np.diff(at, prepend=-2) == 2, best, ids[np.maximum(at - 1, 0)])
                lower = (at > 0) & (self.pairs(left, merged) < best)
                lower |= (at + 2 < len(ids)) & (self.pairs(merged, ids[np.minimum(at + 2, len(ids) - 1)]) < best)
                if lower.any():
                    at = at[: int(lower.argmax()) + 1]
            ids[at] = best
            ids, at = np.delete(ids, at + 1), at - np.arange(len(at))
            rank = np.delete(rank, at + np.arange(len(at)))
            for side in (at - 1, at):
                side = side[(side >= 0) & (side < len(rank))]
                rank[side] = self.pairs(ids[side], ids[side + 1])
        return ids

    def _matrix(self, pieces: Sequence[bytes], width: int) -> list[np.ndarray]:
        """Merges pieces of at most ``width`` bytes together."""
        n = len(pieces)
        size = np.array([len(p) for p in pieces])
        ids = np.full((n, width), -1, np.int32)
        ids[np.arange(width) < size[:, None]] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        live, out = np.arange(n), ids.copy()
        rank = self._ranks(ids)
        while len(live):
            at = rank.argmin(1)
            row = np.arange(len(live))
            best = rank[row, at]
            done = best == _NONE
            if done.any():
                out[live[done]] = -1
                out[live[done], : ids.shape[1]] = ids[done]
                keep = ~done
                live, ids, rank, at, best, row = live[keep], ids[keep], rank[keep], at[keep], best[keep], np.arange(int(keep.sum()))
                if not len(live):
                    break
            ids[row, at] = best
            w = ids.shape[1]
            source = np.arange(w - 1)[None, :] + (np.arange(w - 1)[None, :] > at[:, None])
            ids, rank = np.take_along_axis(ids, source, 1), np.take_along_axis(np.pad(rank, ((0, 0), (0, 1)), constant_values=_NONE), source, 1)[:, : max(w - 2, 1)]
            if ids.shape[1] < 2:
                rank = np.full((len(live), 1), _NONE, np.int32)
                continue
            for side in (at - 1, at):  # only the merged token's two pairs are new
                ok = np.flatnonzero((side >= 0) & (side < ids.shape[1] - 1))
                a, b = ids[ok, side[ok]], ids[ok, side[ok] + 1]
                rank[ok, side[ok]] = np.where(b >= 0, self.pairs(a, b), _NONE)
        return [r[r >= 0] for r in out]

    def _ranks(self, ids: np.ndarray) -> np.ndarray:
        if ids.shape[1] < 2:
            return np.full((len(ids), 1), _NONE, np.int32)
        found = self.pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        found[ids[:, 1:] < 0] = _NONE
        return found

    def merge(self, pieces: Sequence[bytes]) -> list[np.ndarray]:
        """Ids of each piece."""
        found: list[np.ndarray | None] = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                found[k] = np.array([whole], np.int32)
            elif len(p) > WIDEST:
                found[k] = self._long(p)
            else:
                buckets.setdefault(4 * -(-len(p) // 4), []).append(k)
        for width, rows in buckets.items():
            step = max(1, CELLS // width)
            for i in range(0, len(rows), step):
                part = rows[i : i + step]
                for k, ids in zip(part, self._matrix([pieces[k] for k in part], width), strict=True):
                    found[k] = ids
        return found

    def _places(self, pieces: list[str]) -> list[int]:
        new = [p for p in dict.fromkeys(pieces) if p not in self.known]
        if new:
            for p, ids in zip(new, self.merge([p.encode() for p in new]), strict=True):
                self.known[p] = len(self.ids)
                self.ids.append(ids)
                self.texts.append(" ".join(map(str, ids.tolist())))
        return list(map(self.known.__getitem__, pieces))

    def encode(self, texts: Sequence[str]) -> list[tuple[np.ndarray, str]]:
        """Ids of each text, as numbers and as decimals joined by spaces."""
        if len(self.ids) > REMEMBER:
            self.forget()
        split = [self.split(t) for t in texts]
        places = self._places([p for x in split for p in x])
        found, i = [], 0
        for x in split:
            own = places[i : i + len(x)]
            i += len(x)
            ids = np.concatenate([self.ids[k] for k in own]) if own else np.zeros(0, np.int32)
            found.append((ids, " ".join([self.texts[k] for k in own])))
        return found

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.length[ids]
        ends = np.cumsum(n)
        return self.bytes[np.arange(ends[-1]) + np.repeat(self.start[ids] - ends + n, n)].tobytes() if len(ids) else b""


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str | None = None, pattern: str | None = None) -> Codec:
    """The worker's codec; by default for the 50k byte-level vocabulary of public_tokenizers."""
    import public_tokenizers

    key = (path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN)
    if key not in _codecs:
        _codecs[key] = Codec(*key)
    return _codecs[key]


SCHEMA = {"doc_id": "long", "n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded_sha256": "string"}


def _encoded(path: str | None, pattern: str | None, columns: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            _, offsets = words.buffers(batch.column(1))
            for i, j in words.slices(offsets):
                found = own.encode([t or "" for t in batch.column(1).slice(i, j - i).to_pylist()])
                out = {"doc_id": batch.column(0).slice(i, j - i), "n_tokens": pa.array([len(x) for x, _ in found], pa.int64())}
                if "ids" in columns:
                    ends = np.concatenate([[0], np.cumsum([len(x) for x, _ in found])])
                    out["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([x for x, _ in found]), pa.int32()))
                if "ids_sha256" in columns:
                    out["ids_sha256"] = pa.array([hashlib.sha256(s.encode()).hexdigest() for _, s in found])
                    out["decoded_sha256"] = pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x, _ in found])
                yield pa.RecordBatch.from_arrays([out[c] for c in columns], list(columns))
        own.forget()  # Spark keeps the worker for other tasks

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"))


def _in_batches(docs: DataFrame, id_col: str, text_col: str, path: str | None, pattern: str | None, columns: Sequence[str]) -> DataFrame:
    return _rows(docs, id_col, text_col).mapInArrow(_encoded(path, pattern, columns), ", ".join(f"{c} {SCHEMA[c]}" for c in columns))


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids of every document. ``path``: a rank file that every executor can open."""
    return _in_batches(docs, id_col, text_col, path, pattern, ("doc_id", "n_tokens", "ids"))


def decode_documents(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and the bytes of the ids, from the rows of encode_documents."""
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            raw = [own.decode(np.asarray(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["doc_id", "raw"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, raw binary")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the bytes decoded from them, in one pass."""
    return _in_batches(docs, id_col, text_col, path, pattern, ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"))


def tokenized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The ids with both digests."""
    return _in_batches(docs, id_col, text_col, path, pattern, tuple(SCHEMA))


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
