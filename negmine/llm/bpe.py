"""Byte-level BPE with two tiers, from the ranks of a public vocabulary.

A pre-token that is a vocabulary entry is resolved whole through a minimal
perfect hash.  Any other pre-token is merged from its bytes: neighbours stand in
a linked list, and a heap yields the pair of the lowest rank next.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from negmine.llm.batches import bound_batches

# How many different pre-tokens a worker remembers, and as many of those before them.
REMEMBERED = 400_000


class Remembered(dict):
    """What ``work`` gives for a word, worked out at the first look.

    When it is full, its words become the older ones and take the place of those before; a word that is asked for again
    comes back from there, so frequent words are never worked out anew.
    """

    def __init__(self, work: Callable[[str], object], most: int | None = None, share: int = 1):
        super().__init__()
        self.work, self.most, self.share, self.older = work, most, share, {}

    def __missing__(self, word: str):
        value = self.older.pop(word, None)
        if value is None:
            value = self.work(word)
        if len(self) >= (self.most or REMEMBERED // self.share):
            self.older = dict(self)
            self.clear()
        self[word] = value
        return value


class PerfectHash:
    """A minimal perfect hash of the vocabulary: every entry gets a number of its own in 0..n-1.

    Level by level, an entry that is alone on its place stays there, the others go to the next level's
    places; numbers run through the taken places of all levels.
    """

    def __init__(self, entries: list[bytes]):
        self.entries: list[bytes] = []
        self.levels: list[array] = []
        left = [(e, xxhash.xxh3_64_intdigest(e)) for e in entries]
        while left:
            size = 2 * len(left)
            depth = len(self.levels)
            place = [self._place(h, depth, size) for _, h in left]
            taken = Counter(place)
            slots, later = [-1] * size, []
            for (entry, h), p in zip(left, place):
                if taken[p] == 1:
                    slots[p] = len(self.entries)
                    self.entries.append(entry)
                else:
                    later.append((entry, h))
            self.levels.append(array("i", slots))
            left = later
        self._steps = [(depth, 2 * depth + 0x9E3779B1, len(slots), slots) for depth, slots in enumerate(self.levels)]

    @staticmethod
    def _place(h: int, depth: int, size: int) -> int:
        return ((h >> depth) * (2 * depth + 0x9E3779B1) >> 16) % size

    def find(self, key: bytes) -> int:
        """The key's number, or -1 for what is no entry."""
        h = xxhash.xxh3_64_intdigest(key)
        for depth, times, size, slots in self._steps:
            at = slots[((h >> depth) * times >> 16) % size]  # as in _place, without a call
            if at >= 0:
                return at if self.entries[at] == key else -1
        return -1


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.split = regex.compile(pattern).findall
        self.whole = PerfectHash(list(ranks))
        self.rank_of = [ranks[e] for e in self.whole.entries]
        self.bytes_of = {rank: entry for entry, rank in ranks.items()}
        self.bytes_of_text = {str(rank): entry for entry, rank in ranks.items()}
        self.byte = [ranks[bytes([b])] for b in range(256)]
        # as a translation table where the ids of single bytes are below 256
        self.byte_order = bytes(self.byte) if max(self.byte) < 256 else None
        # (left id, right id) -> id of both together, for every way to cut an entry in two entries
        self.pairs = {
            a << 32 | b: rank for entry, rank in ranks.items() for i in range(1, len(entry))
            if (a := ranks.get(entry[:i])) is not None and (b := ranks.get(entry[i:])) is not None}
        # the same for two bytes, at first << 8 | second; -1 where they are no entry
        self.byte_pair = [self.pairs.get(a << 32 | b, -1) for a in self.byte for b in self.byte]
        # ids as text take more room than numbers
        self.text_of = {rank: text for text, rank in zip(self.bytes_of_text, ranks.values())}
        self.known = Remembered(lambda word: " ".join(map(self.text_of.__getitem__, self.pre_token(word))), share=2)

    def merge(self, word: bytes) -> list[int]:
        """Ranks of the pieces of one pre-token: the leftmost pair of the lowest rank merges first."""
        byte_pair, pair = self.byte_pair, self.pairs.get
        n = len(word)
        ids = list(word.translate(self.byte_order)) if self.byte_order else [self.byte[b] for b in word]
        # rank of the pair that begins at a place, -1 where none does; only neighbours of a merge are looked up again
        rank = [byte_pair[a << 8 | b] for a, b in zip(word, word[1:])]
        # a heap entry is rank * n + place; it holds if the pair at that place still has that rank
        heap = [r * n + i for i, r in enumerate(rank) if r >= 0]
        if not heap:
            return ids
        rank.append(-1)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heapify(heap)
        while heap:
            top = heappop(heap)
            r = top // n
            i = top - r * n
            if rank[i] != r:
                continue  # one of the two has changed since
            j = after[i]
            ids[i], ids[j] = r, -1
            rank[j] = x = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                x = pair(r << 32 | ids[k], -1)
                if x >= 0:
                    heappush(heap, x * n + i)
            rank[i] = x
            h = before[i]
            if h >= 0:
                x = rank[h] = pair(ids[h] << 32 | r, -1)
                if x >= 0:
                    heappush(heap, x * n + h)
        return [i for i in ids if i >= 0]

    def pre_token(self, text: str) -> list[int]:
        word = text.encode()
        found = self.whole.find(word)
        return [self.rank_of[found]] if found >= 0 else self.merge(word)

    def encode(self, text: str) -> list[int]:
        return [i for word in self.split(text) for i in self.pre_token(word)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_codecs: dict[str, Codec] = {}


def load_codec(path: str, pattern: str) -> Codec:
    """The codec of a rank file, built once per worker."""
    if path not in _codecs:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        _codecs[path] = Codec(ranks, pattern)
    return _codecs[path]


def vocabulary(name: str) -> Callable[[], tuple[str, str]]:
    """Finds a public vocabulary where the task runs; nothing is copied into this package."""

    def find() -> tuple[str, str]:
        import public_tokenizers

        return public_tokenizers.path(name), public_tokenizers.PATTERN

    return find


DEFAULT = "byte_bpe_50k.tiktoken"
# Words looked up together; bounds what a long text holds in memory beside itself.
_SLICE = 200_000


def digest(codec: Codec, text: str) -> tuple[int, str, str]:
    """Number of ids, and SHA-256 of the ids as text and of the decoded bytes."""
    ids_hash, bytes_hash, n, gap = hashlib.sha256(), hashlib.sha256(), 0, b""
    words = codec.split(text)
    for at in range(0, len(words), _SLICE):
        part = words[at:at + _SLICE]
        line = " ".join(map(codec.known.__getitem__, part))
        ids = line.split(" ")
        ids_hash.update(gap + line.encode())
        bytes_hash.update(b"".join(map(codec.bytes_of_text.__getitem__, ids)))
        n += len(ids)
        gap = b" "
    return n, ids_hash.hexdigest(), bytes_hash.hexdigest()


def encode_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   vocab: Callable[[], tuple[str, str]] | None = None) -> DataFrame:
    """Encode and decode every text; per row its id, ``n_tokens`` and the digests of ids and decoded bytes.

    A null text is an empty one: no ids, digests of nothing.  Rows stay as they are: repeated ones give
    repeated results, a null id stays null.  Other columns of ``docs`` are not read.
    """
    find = vocab or vocabulary(DEFAULT)
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load_codec(*find())
        for batch in batches:
            got = [digest(codec, t or "") for t in (x.as_py() for x in batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0] for g in got], pa.int64()),
                 pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.string())],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
            .withColumnRenamed("id", id_col))


def encode_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               vocab: Callable[[], tuple[str, str]] | None = None) -> DataFrame:
    """The ids themselves, one array per row; nulls and repeats as in ``encode_digests``."""
    find = vocab or vocabulary(DEFAULT)

    def run(batches):
        codec = load_codec(*find())
        for batch in batches:
            ids = [codec.encode(t or "") for t in (x.as_py() for x in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))],
                                             names=["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col))


def decode_ids(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids",
               vocab: Callable[[], tuple[str, str]] | None = None) -> DataFrame:
    """The bytes that arrays of ids stand for; a null array gives no bytes, an unknown id is an error."""
    find = vocab or vocabulary(DEFAULT)

    def run(batches):
        codec = load_codec(*find())
        for batch in batches:
            out = [codec.decode(ids or []) for ids in (x.as_py() for x in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "bytes"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return (encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
            .mapInArrow(run, f"id {kind}, bytes binary").withColumnRenamed("id", id_col))
