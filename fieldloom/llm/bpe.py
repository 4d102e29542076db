"""Byte-level BPE by rank files, in two tiers.

A pre-token that is itself in the vocabulary is resolved by a minimal perfect hash: one hash, one displacement, one
comparison of the stored bytes. A pre-token that isn't is merged from its bytes with a heap of ranked pairs over a
doubly linked list, in O(n log n) for n bytes. Each Python worker keeps what it has resolved in a bounded memo, which
is emptied when full; it changes the speed only.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession

MEMO_ENTRIES = 400_000


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes to id, from the lines of a rank file (base64, space, id)."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}


class PerfectHash:
    """Minimal perfect hash by hash and displace: n keys in n slots, buckets of about three keys placed largest first."""

    def __init__(self, values: dict[bytes, int]):
        n = self.n = max(1, len(values))
        self.buckets = n // 3 + 1
        self.shift = [0] * self.buckets
        self.slots: list[tuple[bytes, int] | None] = [None] * n
        groups: dict[int, list[tuple[int, bytes]]] = {}
        for key in values:
            h = xxhash.xxh3_64_intdigest(key)
            groups.setdefault(h % self.buckets, []).append((h, key))
        free = iter(())
        for b, group in sorted(groups.items(), key=lambda g: -len(g[1])):
            if len(group) == 1:  # any free slot will do; the displacement is that slot, stored as a negative number
                if not isinstance(free, list):
                    free = [i for i in range(n) if self.slots[i] is None]
                at = [free.pop()]
                self.shift[b] = -at[0] - 1
            else:
                d = 0
                while True:
                    at = [self._slot(h, d) for h, _ in group]
                    if len(set(at)) == len(at) and all(self.slots[i] is None for i in at):
                        break
                    d += 1
                self.shift[b] = d
            for i, (_, key) in zip(at, group, strict=True):
                self.slots[i] = (key, values[key])

    def _slot(self, h: int, d: int) -> int:
        x = ((h ^ (d * 0x9E3779B97F4A7C15)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        return (x >> 24) % self.n

    def get(self, key: bytes) -> int | None:
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        held = self.slots[-d - 1 if d < 0 else self._slot(h, d)]
        return held[1] if held and held[0] == key else None


def merge(token: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: always the pair of lowest rank next, the leftmost of equals."""
    n = len(token)
    part: list[bytes | None] = [token[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get(token[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        a = part[i]
        if a is None or (j := after[i]) >= n or ranks.get(a + part[j]) != r:
            continue  # one of its halves has been merged since
        joined = part[i] = a + part[j]
        part[j] = None
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(joined + part[k])) is not None:
                heapq.heappush(heap, (r, i))
        if (h := before[i]) >= 0 and (r := ranks.get(part[h] + joined)) is not None:
            heapq.heappush(heap, (r, h))
    return [ranks[p] for p in part if p is not None]


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.whole, self.find = ranks, PerfectHash(ranks), regex.compile(pattern).findall
        self.bytes_of = {i: t for t, i in ranks.items()}
        codec = self

        class Memo(dict):
            def __missing__(self, token: str) -> bytes:
                raw = token.encode("utf-8")
                one = codec.whole.get(raw)
                ids = [one] if one is not None else merge(raw, codec.ranks)
                out = np.array(ids, "<u4").tobytes()
                if len(token) <= 64:
                    if len(self) >= MEMO_ENTRIES:
                        self.clear()
                    self[token] = out
                return out

        self.memo = Memo()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, self.find(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=2)
def codec_of(raw: bytes, pattern: str) -> Codec:
    return Codec(read_ranks(raw), pattern)


def encode_documents(df: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row per input row: ``key``, n_tokens, ids_sha256, decoded_sha256 and, with ``keep_ids``, ids (array of int).

    A null text counts as empty and has no tokens. Each match of the pattern is encoded separately; there are no
    special tokens. Other columns play no part, so clashing names don't matter; equal rows give equal rows.
    """
    with open(ranks_path, "rb") as f:
        raw = df.sparkSession.sparkContext.broadcast(f.read())  # the rank file, under 1 MB
    schema = f"`{key}` {dict(df.dtypes)[key]}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(raw.value, pattern)
        for batch in batches:
            n, a, b, kept = [], [], [], []
            for x in batch.column(1):
                ids = codec.encode(x.as_py() or "")
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                if keep_ids:
                    kept.append(np.frombuffer(ids, "<i4"))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return df.select(key, text).mapInArrow(work, schema)


def decode_ids(df: DataFrame, ranks_path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """The table with ``out``, the text of an id array; bytes that aren't UTF-8 become U+FFFD, null stays null."""
    with open(ranks_path, "rb") as f:
        raw = df.sparkSession.sparkContext.broadcast(f.read())
    kept = [c for c in df.columns if c != out]
    schema = df.select(*kept).schema.add(out, "string")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {i: t for t, i in read_ranks(raw.value).items()}
        for batch in batches:
            texts = [None if x is None else b"".join(map(table.__getitem__, x)).decode("utf-8", "replace") for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, out])

    return df.mapInArrow(work, schema)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document; see ``encode_documents`` for odd rows."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)
