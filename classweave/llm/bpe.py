"""Byte-level BPE by replaying the merges over all words at once.

A task takes the distinct words of a stretch of the corpus and keeps an
inverted index from each mergeable token pair to the positions where it stands.
The pairs are applied in rank order; a merge touches its two neighbours only,
whose new pairs enter the index under their own rank. The words' ids are then
gathered back into their documents. Nothing is shuffled, memory follows the
stretch (``BLOCK_CHARS``), and a lost task is simply run again.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from classweave.llm.ragged import (
    KeyTable,
    Numbering,
    distinct,
    gather,
    held,
    offsets_of,
    piece_text,
    ragged,
    space_keys,
    text_blocks,
)

# characters whose new words are merged together; bounds a task's memory
BLOCK_CHARS = 2_000_000

IDS_TYPE = "array<int>"
DIGEST_TYPE = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>"


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank)
                for token, rank in map(bytes.split, lines) if token}


class Vocabulary:
    """Ranks, every pair of tokens that joins to a token, and the tokens' bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        codes, joined = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    codes.append(left * self.size + right)
                    joined.append(rank)
        order = np.argsort(np.array(codes, np.int64))
        # one slot past the end, so that a search always lands on a row
        self.codes = np.append(np.array(codes, np.int64)[order], -1)
        self.joined = np.append(np.array(joined, np.int64)[order], -1)
        self.bytes_to_id = np.array(
            [ranks[bytes([b])] for b in range(256)], np.int64)
        by_id = [b""] * self.size
        for token, rank in ranks.items():
            by_id[rank] = token
        self.token_starts = offsets_of(
            np.fromiter(map(len, by_id), np.int64, self.size))
        self.token_bytes = np.frombuffer(b"".join(by_id), np.uint8)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each joined pair, -1 where the pair does not join."""
        code = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.codes[:-1], code)
        return np.where(self.codes[at] == code, self.joined[at], -1)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.token_starts, self.token_bytes, ids)[0]


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """One word by definition: join the leftmost pair of lowest rank, repeat."""
    parts = [bytes([b]) for b in word]
    while len(parts) > 1:
        rank, at = min(
            ((ranks.get(parts[i] + parts[i + 1], 1 << 60), i)
             for i in range(len(parts) - 1)))
        if rank == 1 << 60:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def _first_of_chains(at: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Which pairs to join when some overlap: from the left, as each allows."""
    chosen, taken = np.ones(len(at), bool), set()
    for i, (pair, next_pair) in enumerate(zip(at.tolist(), following.tolist())):
        if pair in taken:
            chosen[i] = False
        else:
            taken.add(next_pair)
    return chosen


def merge_words(words: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and ids of all words: merges in rank order over one index."""
    starts = offsets_of(np.fromiter(map(len, words), np.int64, len(words)))
    n = int(starts[-1])
    raw = np.frombuffer(b"".join(words), np.uint8)
    # position n stands for "no neighbour"; it never joins
    tokens = np.append(vocab.bytes_to_id[raw], 0).astype(np.int32)
    after = np.arange(1, n + 2, dtype=np.int32)
    before = np.arange(-1, n, dtype=np.int32)
    lengths = np.diff(starts)
    after[starts[1:][lengths > 0] - 1] = n
    before[starts[:-1][lengths > 0]] = n
    after[n] = before[n] = n
    live = np.ones(n + 1, bool)
    live[n] = False
    rank_at = np.full(n + 1, -1, np.int32)
    marked = np.zeros(n + 1, bool)
    index: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []
    irregular: list[np.ndarray] = []

    def enter(at: np.ndarray) -> np.ndarray:
        """Set the ranks of the pairs that start at ``at`` and index them."""
        found = vocab.ranks_of(tokens[at], tokens[after[at]])
        found[after[at] == n] = -1
        rank_at[at] = found
        at, found = at[found >= 0], found[found >= 0]
        if not len(at):
            return found
        order = np.argsort(found, kind="stable")
        at, found = at[order], found[order]
        cuts = [0, *(np.flatnonzero(np.diff(found)) + 1).tolist(), len(at)]
        for low, high in zip(cuts, cuts[1:]):
            rank = int(found[low])
            if rank in index:
                index[rank].append(at[low:high])
            else:
                index[rank] = [at[low:high]]
                heappush(queue, rank)
        return found

    enter(np.arange(n, dtype=np.int32))
    while queue:
        rank = heappop(queue)
        lists = index.pop(rank)
        at = distinct(np.concatenate(lists))
        at = at[live[at] & (rank_at[at] == rank)]
        if not len(at):
            continue
        second = after[at]
        marked[at] = True
        chained = marked[second].any()
        marked[at] = False
        if chained:
            chosen = _first_of_chains(at, second)
            at, second = at[chosen], second[chosen]
        tokens[at] = rank
        live[second] = False
        rank_at[second] = -1
        after[at] = after[second]
        before[after[at]] = at
        before[n] = n
        left = before[at]
        new = enter(distinct(np.concatenate([at, left[left < n]])))
        if len(new) and new[0] < rank:
            # a new pair ranks below the merge just made, so this word's own
            # order departs from the corpus order; it is done by itself below
            irregular.append(at)
    ids = tokens[:n][live[:n]]
    word_of = np.repeat(np.arange(len(words)), lengths)
    counts = np.bincount(word_of[live[:n]], minlength=len(words))
    whole = [i for i, word in enumerate(words) if counts[i] > 1 and word in vocab.ranks]
    redo = dict.fromkeys(whole)
    for at in irregular:
        redo.update(dict.fromkeys(np.unique(word_of[at]).tolist()))
    if not redo:
        return offsets_of(counts), ids
    runs = np.split(ids, np.cumsum(counts)[:-1])
    for i in redo:
        own = vocab.ranks.get(words[i])
        runs[i] = np.array([own] if own is not None
                           else merge_word(words[i], vocab.ranks), np.int64)
    counts = np.fromiter(map(len, runs), np.int64, len(runs))
    return offsets_of(counts), np.concatenate(runs)


class Encoder:
    """Encodes blocks of texts; remembers the pieces it has met."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocab = Vocabulary(ranks)
        self.pattern = regex.compile(pattern)
        self.table = KeyTable(self._learn, np.int64)

    def _learn(self, pieces: list) -> tuple[np.ndarray, np.ndarray]:
        """Cut new pieces into words and merge the distinct words together."""
        words = Numbering()
        split = self.pattern.findall

        def words_of(key: str) -> list[int]:
            if key.isalpha():  # letters are one match
                return [words[" " + key]]
            return [words[w] for w in split(piece_text(key))]

        piece_starts, piece_words = ragged(map(words_of, pieces), np.int64)
        word_starts, word_ids = merge_words(
            [w.encode() for w in words], self.vocab)
        ids, ends = gather(word_starts, word_ids, piece_words)
        return ends[piece_starts], ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of the texts and their ids, one text after another."""
        return self.table.read(space_keys(texts))


def _worker_encoder(shared: Broadcast, pattern: str) -> Encoder:
    sha, ranks = shared.value
    return held(("bpe", sha, pattern), lambda: Encoder(ranks, pattern))


def share_ranks(spark: SparkSession, path: str) -> Broadcast:
    """Send a rank file, of the size of its vocabulary, to the executors."""
    ranks = read_ranks(path)
    sha = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
    return spark.sparkContext.broadcast((sha, ranks))


def encode_column(shared: Broadcast, pattern: str, text: Column) -> Column:
    """Token ids of each text; null and empty texts give an empty array."""

    def encode(texts: pa.Array) -> pa.Array:
        coder, parts = _worker_encoder(shared, pattern), []
        for block in text_blocks(texts, BLOCK_CHARS):
            starts, ids = coder.encode(block)
            parts.append(pa.ListArray.from_arrays(
                starts.astype(np.int32), ids.astype(np.int32)))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return F.arrow_udf(encode, IDS_TYPE)(text)


def decode_column(shared: Broadcast, pattern: str, ids: Column) -> Column:
    """The bytes that token ids stand for; null ids give empty bytes."""

    def decode(lists: pa.Array) -> pa.Array:
        vocab = _worker_encoder(shared, pattern).vocab
        return pa.array(
            [vocab.decode(np.array(run or [], np.int64)).tobytes()
             for run in lists.to_pylist()], pa.binary())

    return F.arrow_udf(decode, "binary")(ids)


def round_trip_column(shared: Broadcast, pattern: str, text: Column,
                      with_ids: bool = False) -> Column:
    """Encode, decode the ids again, and give the digests of both.

    ``ids_sha256`` is over the ids as little-endian unsigned 32-bit integers.
    The ids stay in the worker unless they are asked for. Null counts as empty.
    """

    def digest(texts: pa.Array) -> pa.Array:
        coder, rows, lists = _worker_encoder(shared, pattern), [], []
        for block in text_blocks(texts, BLOCK_CHARS):
            starts, ids = coder.encode(block)
            packed = ids.astype("<u4")
            if with_ids:
                lists.append(pa.ListArray.from_arrays(
                    starts.astype(np.int32), ids.astype(np.int32)))
            for low, high in zip(starts.tolist(), starts[1:].tolist()):
                decoded = coder.vocab.decode(ids[low:high])
                rows.append((
                    high - low,
                    hashlib.sha256(packed[low:high].tobytes()).hexdigest(),
                    hashlib.sha256(decoded.tobytes()).hexdigest()))
        count, ids_sha, decoded_sha = zip(*rows) if rows else ((), (), ())
        columns = {"n_tokens": pa.array(count, pa.int64()),
                   "ids_sha256": pa.array(ids_sha, pa.string()),
                   "decoded_sha256": pa.array(decoded_sha, pa.string())}
        if with_ids:
            columns["ids"] = (pa.concat_arrays(lists) if lists
                              else pa.array([], pa.list_(pa.int32())))
        return pa.StructArray.from_arrays(list(columns.values()), names=list(columns))

    kind = DIGEST_TYPE[:-1] + f",ids:{IDS_TYPE}>" if with_ids else DIGEST_TYPE
    return F.arrow_udf(digest, kind)(text)
