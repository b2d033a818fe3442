"""Byte-level BPE encoding and decoding on padded numpy matrices.

Pieces of text are deduplicated, bucketed by byte length and laid out as rows
of a padded matrix of token ids.  In every round each row merges its leftmost
pair of minimum rank, found through a hashed pair table, and is compacted by
one place; rows without a pair leave the matrix.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from rainloom.llm import common

#: Rank of a pair that does not merge.
NO_RANK = np.int32(2**31 - 1)
#: Pieces longer than this many bytes merge by the same rule over a heap, as a matrix row would cost its square.
LONGEST_ROW = 128
#: Pieces whose ids a worker remembers, and matrix cells that are worked on together.
REMEMBERED, CELLS = 500_000, 1 << 17

# Texts of these characters only are split by the faster engine: there the classes of the general pattern come to these.
_PLAIN_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_NOT_PLAIN = re.compile(r"[^\t-\r -~À-ÖØ-öø-ÿ]")
_CLASSES = ((r"[^\s\p{L}\p{N}]", rf"[^\s{_PLAIN_LETTERS}0-9]"), (r"\p{L}", f"[{_PLAIN_LETTERS}]"), (r"\p{N}", "[0-9]"))


class Codec:
    """Encoder and decoder for one rank file (lines of base64 token and rank) and one splitting pattern."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
        self.split = regex.compile(pattern).findall
        plain = pattern
        for general, own in _CLASSES:
            plain = plain.replace(general, own)
        self.split_plain = re.compile(plain).findall if r"\p" not in plain else None
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self._token_bytes()
        self._pair_table()
        self.known: dict[str, bytes] = {}

    def _token_bytes(self) -> None:
        """Token bytes back to back with their offsets, for decoding by id."""
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)

    def _pair_table(self) -> None:
        """Open-addressing table: (left id, right id) -> rank of the joined bytes."""
        keys, values = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self.bits = max(8, (len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NO_RANK, np.int32)
        key, value = np.array(keys, np.int64), np.array(values, np.int32)
        slot = self._slot(key)
        while len(key):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = key[free]  # of several keys for one slot the last stays
            placed = self.keys[slot] == key
            self.values[slot[placed]] = value[placed]
            key, value, slot = key[~placed], value[~placed], (slot[~placed] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``NO_RANK`` where it does not merge or a side is padding (-1)."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        key[(left < 0) | (right < 0)] = -2
        slot = self._slot(key)
        out = np.full(key.shape, NO_RANK, np.int32)
        found = self.keys[slot]
        hit = found == key
        out[hit] = self.values[slot[hit]]
        open_ = np.flatnonzero(~hit & (found != -1) & (key != -2))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    def merge_rows(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all pieces one after the other, and how many each has.

        All pieces are at most ``LONGEST_ROW`` bytes long and of similar length.
        """
        lengths = np.array([len(p) for p in pieces])
        width = int(lengths.max())
        ids = np.full((len(pieces), width + 1), -1, np.int32)
        ids[np.arange(width + 1) < lengths[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = self.pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), width)
        out = np.full((len(pieces), width), -1, np.int32)
        row = np.arange(len(pieces))
        while len(row):
            place = ranks.argmin(axis=1)  # the first of equal ranks is the leftmost
            best = ranks[np.arange(len(row)), place]
            merging = best != NO_RANK
            if not merging.all():
                out[row[~merging], :ids.shape[1] - 1] = ids[~merging, :-1]
                row, ids, ranks, place, best = row[merging], ids[merging], ranks[merging], place[merging], best[merging]
                if not len(row):
                    break
            at, last = np.arange(len(row)), ids.shape[1] - 2  # the last column of ids is always padding
            ids[at, place] = best
            ids = np.where(np.arange(last + 1) > place[:, None], ids[:, 1:], ids[:, :-1])
            ranks = np.where(np.arange(last) >= place[:, None], ranks[:, 1:], ranks[:, :-1])
            if not last:
                out[row, :1] = ids
                break
            before = np.maximum(place - 1, 0)
            inner = np.minimum(place, last - 1)
            new = self.pair_ranks(np.concatenate([ids[at, before], ids[at, inner]]),
                                  np.concatenate([ids[at, before + 1], ids[at, inner + 1]]))
            ranks[at, before], ranks[at, inner] = new[:len(row)], new[len(row):]
        kept = out >= 0
        return out[kept], kept.sum(axis=1)

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same rule for one long piece: a heap of (rank, place) yields the leftmost pair of minimum rank."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        table = self.pair_lookup
        heap = [(rank, i) for i in range(len(ids) - 1) if (rank := table.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= len(ids) or table.get(ids[i] << 32 | ids[j]) != rank:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < len(ids):
                before[k] = i
                if (new := table.get(rank << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (new, i))
            if before[i] >= 0 and (new := table.get(ids[before[i]] << 32 | rank)) is not None:
                heapq.heappush(heap, (new, before[i]))
        out = np.array(ids, np.int32)
        return out[out >= 0]

    @property
    def pair_lookup(self) -> dict[int, int]:
        if not hasattr(self, "_lookup"):
            used = self.keys >= 0
            self._lookup = dict(zip(self.keys[used].tolist(), self.values[used].tolist()))
        return self._lookup

    def learn(self, pieces: set[str]) -> None:
        """Put the ids of all new pieces into ``known``."""
        if len(self.known) + len(pieces) > REMEMBERED:
            self.known.clear()
        raw = [(p.encode("utf-8", "surrogatepass"), p) for p in pieces.difference(self.known)]
        raw.sort(key=lambda x: len(x[0]))
        start = 0
        while start < len(raw):
            size = len(raw[start][0])
            if size > LONGEST_ROW:
                for b, p in raw[start:]:
                    self.known[p] = self.merge_long(b).astype("<u4").tobytes()
                return
            end = start  # lengths of one bucket differ by a quarter at most
            while end < len(raw) and len(raw[end][0]) <= size + size // 4 and (end - start) * (size + 2) < CELLS:
                end += 1
            bucket = raw[start:end]
            ids, counts = self.merge_rows([b for b, _ in bucket])
            data, ends = ids.astype("<u4").tobytes(), (np.cumsum(counts) * 4).tolist()
            at = 0
            for (_, p), upto in zip(bucket, ends):
                self.known[p] = data[at:upto]
                at = upto
            start = end

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        split = [(self.split_plain if self.split_plain and not _NOT_PLAIN.search(t) else self.split)(t) for t in texts]
        self.learn(set().union(*split))
        known = self.known
        return [np.frombuffer(b"".join([known[p] for p in pieces]), "<u4") for pieces in split]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the tokens, gathered by id."""
        if not len(ids):
            return b""
        lengths = self.lengths[ids]
        first = np.cumsum(lengths) - lengths
        return self.flat[np.arange(int(lengths.sum())) + np.repeat(self.offsets[ids] - first, lengths)].tobytes()


@lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str) -> Codec:
    """One codec per worker process."""
    return Codec(ranks_path, pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text",
           decoded: bool = True) -> DataFrame:
    """Ids and decoded bytes of every whole text: ``key``, ``ids`` (array of int), ``decoded`` (binary).

    A null text counts as empty: no ids, no bytes.  Equal keys stay separate rows.  ``ranks_path`` must exist
    on every executor.
    """
    def work(batch: pa.RecordBatch):
        own = codec(ranks_path, pattern)
        texts = batch.column(1).to_pylist()
        for part in common.runs_of([len(t) for t in texts]):
            ids = own.encode(texts[part])
            back = [own.decode(i) if decoded else None for i in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[part], pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())),
                 pa.array(back, pa.binary())], ["key", "ids", "decoded"])

    rows = docs.select(docs[key].alias("key"), common.text_or_empty(text).alias("text"))
    return common.in_batches(rows, work, f"key {dict(rows.dtypes)['key']}, ids array<int>, decoded binary") \
        .withColumnRenamed("key", key)


def digest(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_tokens``, and SHA-256 of the ids (little-endian 32-bit) and of the decoded bytes of every text."""
    def work(batch: pa.RecordBatch):
        own = codec(ranks_path, pattern)
        texts = batch.column(1).to_pylist()
        for part in common.runs_of([len(t) for t in texts]):
            ids = own.encode(texts[part])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[part], pa.array([len(i) for i in ids], pa.int64()),
                 pa.array([hashlib.sha256(i.tobytes()).hexdigest() for i in ids]),
                 pa.array([hashlib.sha256(own.decode(i)).hexdigest() for i in ids])],
                ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(docs[key].alias("key"), common.text_or_empty(text).alias("text"))
    return common.in_batches(
        rows, work, f"key {dict(rows.dtypes)['key']}, n_tokens bigint, ids_sha256 string, decoded_sha256 string") \
        .withColumnRenamed("key", key)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(common.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                  public_tokenizers.PATTERN)
