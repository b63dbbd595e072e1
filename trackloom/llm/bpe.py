"""Byte-level BPE encoding and decoding with given ranks.

Pieces of text are encoded together: distinct pieces that are not a token themselves are put by
length into padded matrices of token ids.  In every round each row merges its leftmost pair of
minimum rank; merged ranks come from an open-addressing table over hashed (left, right) pairs;
rows shift left after a merge, and rows without a pair left leave the matrix.  A piece of over
``LONG`` bytes is a matrix of its own: its ids fill rows of ``WIDTH``, each with its smallest rank, and a
round merges the leftmost pair of the smallest of all, so that time stays near the piece's length.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as T
from .shared import with_workers

LONG = 256
WIDTH = 512
#: Distinct pieces that a worker remembers; beyond, it starts anew.
REMEMBERED = 150_000
_NONE = np.int32(2**31 - 1)


class PairTable:
    """(left id, right id) to merged id, looked up for whole arrays."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.bits = max(4, (4 * len(pairs)).bit_length())
        keys = np.array([(a << 32) | b for a, b in pairs], np.uint64)
        values = np.array(list(pairs.values()), np.int32)
        self.keys = np.full(1 << self.bits, 2**64 - 1, np.uint64)
        self.values = np.full(1 << self.bits, _NONE, np.int32)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            free = self.keys[slot] == np.uint64(2**64 - 1)
            self.keys[slot[free]] = keys[left[free]]  # the last writer of a slot keeps it
            won = self.keys[slot] == keys[left]
            self.values[slot[won]] = values[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (T.mix(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], _NONE)
        left = np.flatnonzero((there != keys) & (there != np.uint64(2**64 - 1)))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[left]]
            same = there == keys[left]
            out[left[same]] = self.values[slot[left[same]]]
            left = left[~same & (there != np.uint64(2**64 - 1))]
        return out


class Codec:
    def __init__(self, ranks: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.find = regex.compile(pattern).findall
        pairs = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a, b] = rank
        self.pairs = pairs
        self.table = PairTable(pairs)
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.array([len(x) for x in tokens], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.empty(0, np.int32)
        self.first = np.zeros(1, np.int64)

    # encoding

    def _merge_rows(self, rows: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """Merge a padded matrix of ids to the end; row i has lengths[i] ids."""
        n, width = rows.shape
        out: list[np.ndarray] = [None] * n  # type: ignore[list-item]
        which, length = np.arange(n), lengths.copy()
        rank = np.full((n, width), _NONE, np.int32)
        inside = np.arange(width - 1)[None, :] < (length - 1)[:, None]
        r, c = np.nonzero(inside)
        rank[r, c] = self.table(rows[r, c], rows[r, c + 1])
        cols = np.arange(width)
        while len(which):
            j = rank.argmin(axis=1)
            every = np.arange(len(which))
            best = rank[every, j]
            done = best == _NONE
            if done.any():
                for i in np.flatnonzero(done):
                    out[which[i]] = rows[i, : length[i]].copy()
                go = ~done
                which, rows, rank, length, j, best = which[go], rows[go], rank[go], length[go], j[go], best[go]
                if not len(which):
                    break
                top = int(length.max())
                if top < rows.shape[1]:
                    rows, rank = rows[:, :top], rank[:, :top]
                cols = np.arange(rows.shape[1])
                every = np.arange(len(which))
            # what stands right of the merged pair moves one place to the left
            take = np.minimum(cols[None, :] + (cols[None, :] > j[:, None]), rows.shape[1] - 1)
            rows = np.take_along_axis(rows, take, 1)
            rank = np.take_along_axis(rank, take, 1)
            rows[every, j] = best
            length -= 1
            rank[every, np.maximum(length - 1, 0)] = _NONE
            has = j + 1 < length
            rank[every, j] = _NONE
            rank[every[has], j[has]] = self.table(rows[every[has], j[has]], rows[every[has], j[has] + 1])
            has = j > 0
            rank[every[has], j[has] - 1] = self.table(rows[every[has], j[has] - 1], rows[every[has], j[has]])
        return out

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """Merge one long piece, whose ids fill the rows of a matrix one after another.

        Each row keeps its smallest rank; a round merges the leftmost pair of the smallest of these.
        Once half of the ids are gone, the rest is laid out anew.
        """
        ids = self.byte[np.frombuffer(piece, np.uint8)]
        while len(ids) > LONG:
            n = len(ids)
            rank = np.full(-(-n // WIDTH) * WIDTH, _NONE, np.int32)
            rank[: n - 1] = self.table(ids[:-1], ids[1:])
            rows = rank.reshape(-1, WIDTH)
            least = rows.min(1)
            value, after, before = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
            for _ in range(n // 2):
                row = int(least.argmin())
                best = int(least[row])
                if best == _NONE:
                    return np.array([x for x in value if x >= 0], np.int32)
                i = row * WIDTH + int(rows[row].argmin())
                gone, left = after[i], before[i]
                right = after[i] = after[gone]
                value[i], value[gone], rank[gone], rank[i] = best, -1, _NONE, _NONE
                if right < n:
                    before[right] = i
                    rank[i] = self.pairs.get((best, value[right]), _NONE)
                if left >= 0:
                    rank[left] = self.pairs.get((value[left], best), _NONE)
                for changed in {row, gone // WIDTH, max(left, 0) // WIDTH}:
                    least[changed] = rows[changed].min()
            ids = np.array([x for x in value if x >= 0], np.int32)
        return self._merge_rows(ids[None, :], np.array([len(ids)]))[0]

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = [None] * len(pieces)  # type: ignore[list-item]
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (whole := self.ranks.get(p)) is not None:
                out[i] = np.array([whole], np.int32)
            elif len(p) > LONG:
                out[i] = self._merge_long(p)
            else:
                buckets.setdefault((len(p) + 3) // 4, []).append(i)
        for width, members in buckets.items():
            step = max(1, (1 << 20) // (width * 4))
            for at in range(0, len(members), step):
                part = members[at : at + step]
                lengths = np.array([len(pieces[i]) for i in part])
                raw = np.frombuffer(b"".join(pieces[i].ljust(width * 4, b"\0") for i in part), np.uint8).reshape(len(part), -1)
                for i, ids in zip(part, self._merge_rows(self.byte[raw], lengths), strict=True):
                    out[i] = ids
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's ids begin."""
        if len(self.known) > REMEMBERED:
            self.forget()
        found = [self.find(t) for t in texts]
        new = list({p for f in found for p in f if p not in self.known})
        if new:
            ids = self.encode_pieces([p.encode() for p in new])
            start = len(self.known)
            self.known.update(zip(new, range(start, start + len(new)), strict=True))
            self.ids = np.concatenate((self.ids, *ids))
            self.first = np.concatenate((self.first, self.first[-1] + np.cumsum([len(x) for x in ids])))
        get = self.known.__getitem__
        which = np.fromiter((x for f in found for x in map(get, f)), np.int64, sum(map(len, found)))
        many = self.first[which + 1] - self.first[which]
        ends = np.concatenate(([0], np.cumsum(many)))
        out = self.ids[np.repeat(self.first[which] - ends[:-1], many) + np.arange(ends[-1])]
        return out, ends[np.cumsum([0, *map(len, found)])]

    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows, and where each row's bytes begin."""
        many = self.size[ids]
        ends = np.concatenate(([0], np.cumsum(many)))
        return self.flat[np.repeat(self.at[ids] - ends[:-1], many) + np.arange(ends[-1])], ends[off]


_CODECS: dict[tuple[int, str], Codec] = {}


def _codec(ranks: bytes, pattern: str) -> Codec:
    key = (hash(ranks), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(ranks, pattern)
    return _CODECS[key]


def _with(schema, name: str, kind: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema if f.name != name), f"{name} {kind}"])


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """Append ``ids`` (array<int>): the tokens of column ``text``, without special tokens.

    ``ranks_path`` names a rank file (base64 token and rank a line) on the driver; it is sent to the
    workers.  Null and empty texts have no tokens.  An existing column ``ids`` is replaced.
    """
    spark = with_workers(docs.sparkSession)
    with open(ranks_path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())  # the vocabulary: its size doesn't depend on the data
    docs = docs.drop(ids)
    where = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value, pattern)
        for batch in batches:
            for i, j, data, off in T.pieces(*T.column(batch.column(where))):
                raw = data.tobytes()
                got, ends = codec.encode([raw[a:b].decode() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(got, pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, lists], [*batch.schema.names, ids])

    return docs.mapInArrow(T.tidy(run), _with(docs.schema, ids, "array<int>"))


def decode(df: DataFrame, ranks_path: str, *, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Append ``out`` (binary): the bytes that column ``ids`` stands for; null ids read as none."""
    spark = with_workers(df.sparkSession)
    with open(ranks_path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    df = df.drop(out)
    where = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value, "")
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                col = batch.column(where)
                if col.null_count:
                    col = pa.array([x or [] for x in col.to_pylist()], pa.list_(pa.int32()))
                off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
                flat = col.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]]
                data, ends = codec.decode(flat, off - off[0])
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())], [*batch.schema.names, out])

    return df.mapInArrow(T.tidy(run), _with(df.schema, out, "binary"))


def digests(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("token_ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Encode every whole text, decode the ids again, and give digests of both."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(decode(encode(docs, path, public_tokenizers.PATTERN).drop("text"), path))
