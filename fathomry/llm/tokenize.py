"""Encoding of a corpus by a public byte-level BPE vocabulary.

A partition's texts are cut into words (the vocabulary's own splitting pattern), of which only the distinct ones are
encoded. Their bytes lie in one array of symbols with links to the neighbours. A *pair occurrence index* maps each pair
that has a merge rank to all its positions in the partition, ordered by rank. Ranks are applied in ascending order: the
next stretch of active ranks is taken from the index, each word applies the lowest of its pairs in it at all places where
it stands (from the left where places overlap), and the pairs to both sides of a new symbol are put into the index under
their own ranks. A pair of a symbol has a higher rank than the merge that makes the symbol, and words don't touch each
other, so each word sees its merges in exactly the order of their ranks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shipping import map_arrow

#: Where the vocabulary files are, unless a call names another folder.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pattern that cuts a text into words before byte-level merges.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = np.int32(2**31 - 1)
#: Positions that one stretch of ranks should at least bring.
STRETCH = 8192
#: Characters of text that are encoded at once.
CHUNK_CHARS = 24_000_000
#: Distinct words of one task whose ids are kept from chunk to chunk.
MOST_WORDS = 1_500_000


@dataclass
class Vocabulary:
    """Ids of single bytes, and for each mergeable pair (as left * 2**20 + right, ascending) its rank; ids by rank."""

    byte_ids: np.ndarray
    pairs: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray

    @staticmethod
    def load(name: str, folder: str = TOKENIZERS) -> Vocabulary:
        """From ``<folder>/<name>.json``: bytes are written as printable characters, merges in order of rank."""
        model = json.loads(Path(folder, f"{name}.json").read_text())["model"]
        ids = model["vocab"]
        # Printable Latin-1 characters stand for their own byte, the other bytes for U+0100 onwards, in order.
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        other = [b for b in range(256) if b not in set(own)]
        sign = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(other)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        codes = np.array([(ids[a] << 20) + ids[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(codes)
        return Vocabulary(
            np.array([ids[sign[b]] for b in range(256)], dtype=np.int32),
            codes[order],
            order.astype(np.int32),
            np.array([ids[a + b] for a, b in pairs], dtype=np.int32),
        )

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = (left.astype(np.int64) << 20) + right
        at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        return np.where(self.pairs[at] == code, self.ranks[at], NONE)


def encode_words(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, one after the other, and where each word's begin (with the end of the last)."""
    length = np.fromiter((len(w) for w in words), dtype=np.int64, count=len(words))
    start = np.concatenate([[0], np.cumsum(length)])
    n = int(start[-1])
    sym = v.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)] if n else np.zeros(0, np.int32)
    word = np.repeat(np.arange(len(words), dtype=np.int64), length)
    nxt = np.arange(1, n + 1, dtype=np.int64)
    prv = np.arange(-1, n - 1, dtype=np.int64)
    full = length > 0
    nxt[start[1:][full] - 1] = -1
    prv[start[:-1][full]] = -1
    rank = np.full(n, NONE, dtype=np.int32)
    inner = np.flatnonzero(nxt >= 0)
    rank[inner] = v.rank_of(sym[inner], sym[inner + 1])
    alive = np.ones(n, dtype=bool)

    # The index: positions by rank, first of the pairs that are there from the start, then of those that arise.
    first = inner[rank[inner] < NONE]
    first = first[np.argsort(rank[first], kind="stable")]
    first_rank = rank[first]
    done, arisen = 0, np.zeros(0, dtype=np.int64)
    while done < len(first) or len(arisen):
        ahead = min(done + STRETCH, len(first)) - 1
        until = int(first_rank[ahead]) + 1 if done < len(first) else int(NONE)
        if done < len(first) and ahead == len(first) - 1:
            until = int(NONE)
        end = int(np.searchsorted(first_rank, until, side="left"))
        at = np.concatenate([first[done:end], arisen[rank[arisen] < until]])
        later = rank[arisen]
        arisen = arisen[(later >= until) & (later < NONE)]
        done = end
        while len(at):
            at = at[rank[at] < until]
            if not len(at):
                break
            # Of each word the lowest rank, by position.
            at = np.unique(at)
            w, r = word[at], rank[at]
            turn = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            low = np.minimum.reduceat(r, turn)
            chosen = at[r == np.repeat(low, np.diff(np.append(turn, len(at))))]
            # Where places overlap (p, next of p, ...), every other one from the left.
            if len(chosen) > 1:
                chain = np.zeros(len(chosen), dtype=bool)
                chain[1:] = (nxt[chosen[:-1]] == chosen[1:]) & (rank[chosen[1:]] == rank[chosen[:-1]])
                if chain.any():
                    i = np.arange(len(chosen))
                    chosen = chosen[(i - np.maximum.accumulate(np.where(chain, 0, i))) % 2 == 0]
            right = nxt[chosen]
            sym[chosen] = v.merged[rank[chosen]]
            alive[right] = False
            rank[right] = NONE
            after = nxt[right]
            nxt[chosen] = after
            more = after >= 0
            prv[after[more]] = chosen[more]
            rank[chosen] = NONE
            before = prv[chosen]
            left = before[before >= 0]
            fresh = np.unique(np.concatenate([chosen[more], left]))
            rank[fresh] = v.rank_of(sym[fresh], sym[nxt[fresh]])
            fresh = fresh[rank[fresh] < NONE]
            arisen = np.concatenate([arisen, fresh[rank[fresh] >= until]])
            at = np.concatenate([at, fresh[rank[fresh] < until]])
    kept = np.flatnonzero(alive)
    ends = np.concatenate([[0], np.cumsum(np.bincount(word[kept], minlength=len(words)))])
    return sym[kept], ends


class _Numbers(dict):
    """Numbers words in order of appearance."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Positions ``start[i] .. start[i] + count[i] - 1`` for each i, one after the other."""
    shift = start - np.concatenate([[0], np.cumsum(count)[:-1]]) if len(count) else start
    return np.repeat(shift, count) + np.arange(int(count.sum()))


class Encoder:
    """Encodes texts of one task; words that it has seen keep their ids."""

    def __init__(self, v: Vocabulary):
        import regex

        self.find = regex.compile(WORDS).findall
        self.v, self.numbers = v, _Numbers()
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and where each text's begin (with the end of the last). Null and empty texts have none."""
        known = len(self.numbers)
        number, find = self.numbers.__getitem__, self.find
        parts, count = [], np.zeros(len(texts), dtype=np.int64)
        for i, t in enumerate(texts):
            if t:
                found = np.fromiter(map(number, find(t)), dtype=np.int32)
                parts.append(found)
                count[i] = len(found)
        if len(self.numbers) > known:
            from itertools import islice

            new = [w.encode("utf-8", "surrogatepass") for w in islice(self.numbers, known, None)]
            ids, ends = encode_words(new, self.v)
            self.ids = np.concatenate([self.ids, ids])
            self.ends = np.concatenate([self.ends, self.ends[-1] + ends[1:]])
        used = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        size = (self.ends[1:] - self.ends[:-1])[used]
        flat = self.ids[spread(self.ends[:-1][used], size)] if len(used) else np.zeros(0, np.int32)
        bounds = np.concatenate([[0], np.cumsum(size)])
        return flat, bounds[np.concatenate([[0], np.cumsum(count)])]


def _runs(v: Vocabulary, counts_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, held, chars = Encoder(v), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            texts = [t for b in held for t in b.column(b.num_columns - 1).to_pylist()]
            ids, ends = encoder.texts(texts)
            at = 0
            for b in held:
                e = ends[at : at + b.num_rows + 1]
                at += b.num_rows
                if counts_only:
                    out = pa.array(np.diff(e))
                else:
                    out = pa.ListArray.from_arrays(pa.array((e - e[0]).astype(np.int32)), pa.array(ids[e[0] : e[-1]]))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], out], names=[*b.schema.names[:-1], "ids"])

        for b in batches:
            held.append(b)
            chars += b.column(b.num_columns - 1).nbytes
            if chars >= CHUNK_CHARS:
                yield from flush()
                held, chars = [], 0
                if len(encoder.numbers) > MOST_WORDS:  # bounded memory, whatever the partition's size
                    encoder = Encoder(v)
        if held:
            yield from flush()

    return run


def encode(df: DataFrame, text: str, keep: list[str], name: str = "byte_bpe_50k", folder: str = TOKENIZERS, counts_only: bool = False) -> DataFrame:
    """The columns ``keep`` and ``ids array<int>``: the ids of each text without special tokens; one row for each row.

    With ``counts_only`` the column is ``ids bigint``, the number of ids. Texts are encoded as they are stored.

    Defined cases: null and empty texts give an empty list (count 0); texts of any length are encoded whole; a special
    token's string in a text is ordinary text; equal texts have equal ids; an empty input gives no rows; columns outside
    ``keep`` are ignored. There is no shuffle: rows stay in their partitions.
    """
    kinds = dict(df.dtypes)
    rows = df.select(*[F.col(c) for c in keep], F.col(text).cast("string").alias("__text"))
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"ids {'bigint' if counts_only else 'array<int>'}"])
    return map_arrow(rows, _runs(Vocabulary.load(name, folder), counts_only), schema)
