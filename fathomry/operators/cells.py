"""Scores of all candidates without a row for each candidate in a shuffle.

Probes are dealt to lines and visitors to columns of a grid; a cell gets one line and one column whole, so each candidate
pair lies in exactly one cell, which finds it by common keys, drops its repeats and scores it there. Lines and columns are
stored once as compressed blobs and cells read them from there: each probe and each visitor is moved once, whatever the
number of cells and pairs. Visitors of a cell are held as arrays (a column has about ``COLUMN`` of them), probes pass by
in batches.

Keys, values and elements are compared by 64-bit hashes. Doubles are added in order of names, from weights that Spark
computed for each probe, so scores are those of :func:`fathomry.operators.scoring.scores`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut, opened, packed
from ..sources.shipping import map_arrow

#: Visitors of a column, about; pairs that are scored at once, about; frequent elements that are compared as bits.
COLUMN, PAIRS, BITS = 65_536, 1 << 18, 4096
#: Probes of a blob, about; probes that are looked up at once.
LINE, BATCH = 32_768, 10_000


def hashed_keys(keys: DataFrame, id_: str) -> DataFrame:
    """``(id, keys)``: the distinct keys of each id as numbers (keys that are numbers stay as they are)."""
    key = F.col("key") if dict(keys.dtypes)["key"] == "bigint" else F.xxhash64("key")
    return keys.where("key is not null").groupBy(F.col(id_).alias("id")).agg(F.array_sort(F.collect_set(key)).alias("keys"))


def parts(components: DataFrame, value: Column) -> DataFrame:
    """``(id, name, kind, tag, value, elems)``: components as numbers; ``tag`` tells name and kind, so parts are comparable where it is equal."""
    tag = F.concat_ws("\x1f", "name", "kind")
    hashes = F.when(F.col("kind") == "set", F.transform("elems", lambda x: F.xxhash64(x)))
    scalar = F.when((F.col("kind") != "set") & value.isNotNull(), F.xxhash64(value))
    rows = components.select("id", "name", "kind", tag.alias("tag"), scalar.alias("value"), hashes.alias("elems"))
    return rows.where("value is not null or elems is not null")


def records(rows: DataFrame, keys: DataFrame, agree: Column, differ: Column) -> DataFrame:
    """``(id, keys, parts)`` of an id's :func:`parts`, with its :func:`hashed_keys`; ids without keys have no candidates and are left out."""
    part = F.struct("tag", "value", "elems", agree.cast("double").alias("agree"), differ.cast("double").alias("differ"))
    return rows.groupBy("id").agg(F.array_sort(F.collect_list(part)).alias("parts")).join(keys, "id").select("id", "keys", "parts")


class _Side:
    """Records as arrays; ``form``: 0 where a tag is missing, 1 for a value, 2 for a set."""

    def __init__(self, ids: pa.Array, keys: pa.Array, parts_: pa.Array, tags: dict[str, int] | None = None) -> None:
        self.ids, n = ids, len(ids)
        self.key_rows = np.repeat(np.arange(n), pc.list_value_length(keys).to_numpy(zero_copy_only=False).astype(np.int64))
        self.keys = keys.flatten().to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(n), pc.list_value_length(parts_).to_numpy(zero_copy_only=False).astype(np.int64))
        tag, value, elems, agree, differ = parts_.flatten().flatten()
        coded = tag.dictionary_encode()
        words = coded.dictionary.to_pylist()
        if tags is None:
            tags = {t: i for i, t in enumerate(sorted(words, key=lambda t: [x.encode() for x in t.split("\x1f")]))}  # in order of names
        self.tags = tags
        codes = np.array([tags.get(t, -1) for t in words], dtype=np.int64)[coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)]
        has = value.is_valid().to_numpy(zero_copy_only=False)
        is_set = elems.is_valid().to_numpy(zero_copy_only=False)
        shape, known = (len(tags), n), codes >= 0
        at = (codes[known], rows[known])
        self.form = np.zeros(shape, dtype=np.int8)
        self.form[at] = np.where(is_set, 2, np.where(has, 1, 0))[known]
        self.value = np.zeros(shape, dtype=np.int64)
        self.value[at] = value.fill_null(0).to_numpy(zero_copy_only=False)[known]
        self.agree, self.differ = np.zeros(shape), np.zeros(shape)
        self.agree[at] = agree.fill_null(0.0).to_numpy(zero_copy_only=False)[known]
        self.differ[at] = differ.fill_null(0.0).to_numpy(zero_copy_only=False)[known]
        size = pc.list_value_length(elems).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.size = np.zeros(shape, dtype=np.int64)
        self.size[at] = size[known]
        self.scalars = (self.form == 1).sum(axis=0)
        self.own: dict[str, tuple[np.ndarray, np.ndarray]] = {}  # values of all tags, known or not
        for i, t in enumerate(words):
            at_ = has & (coded.indices.to_numpy(zero_copy_only=False) == i)
            if at_.any():
                form, values = np.zeros(n, dtype=bool), np.zeros(n, dtype=np.int64)
                form[rows[at_]], values[rows[at_]] = True, value.fill_null(0).to_numpy(zero_copy_only=False)[at_]
                self.own[t] = form, values
        self._flat = np.repeat(codes, size), np.repeat(rows, size), elems.flatten().to_numpy(zero_copy_only=False)

    def elements(self, tag: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and elements of all sets of a tag."""
        codes, rows, elems = self._flat
        at = codes == tag
        return rows[at], elems[at]


class _Sets:
    """The sets of one tag of a column: frequent elements as bits, the others as sorted pairs of row and element."""

    def __init__(self, rows: np.ndarray, elems: np.ndarray, n: int, bits: int) -> None:
        self.words, inverse, counts = np.unique(elems, return_inverse=True, return_counts=True)
        self.rank = np.empty(len(self.words), dtype=np.int64)  # frequent first
        self.rank[np.argsort(-counts, kind="stable")] = np.arange(len(self.words))
        self.width = -(-min(bits, len(self.words)) // 64) * 64
        self.n_words = max(len(self.words), 1)
        self.bits, self.rest = self.split(rows, self.rank[inverse], n)

    def split(self, rows: np.ndarray, ranks: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        bits = np.zeros((n, self.width // 64), dtype=np.uint64)
        low = ranks < self.width
        np.bitwise_or.at(bits, (rows[low], ranks[low] // 64), np.uint64(1) << (ranks[low] % 64).astype(np.uint64))
        return bits, np.unique(rows[~low] * self.n_words + ranks[~low])

    def of(self, rows: np.ndarray, elems: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Probes' sets in the same form; elements that no visitor of the column has are left out."""
        at = np.minimum(np.searchsorted(self.words, elems), len(self.words) - 1) if len(self.words) else np.zeros(0, dtype=np.int64)
        known = self.words[at] == elems if len(self.words) else np.zeros(len(elems), dtype=bool)
        return self.split(rows[known], self.rank[at[known]] if len(self.words) else at, n)

    def common(self, probe: tuple[np.ndarray, np.ndarray], pi: np.ndarray, li: np.ndarray) -> np.ndarray:
        """Number of common elements of each pair."""
        bits, rest = probe
        out = np.zeros(len(pi), dtype=np.int64)
        for w in range(self.width // 64):
            out += np.bitwise_count(bits[pi, w] & self.bits[li, w])
        if len(rest) and len(self.rest):
            begin, end = (np.searchsorted(rest, x * self.n_words) for x in (pi, pi + 1))
            pair, at = _spans(begin, end - begin)
            want = li[pair] * self.n_words + rest[at] % self.n_words
            found = np.minimum(np.searchsorted(self.rest, want), len(self.rest) - 1)
            out += np.bincount(pair[self.rest[found] == want], minlength=len(pi))
        return out


def _spans(begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For spans of places: the number of the span, and the place, of each."""
    which = np.repeat(np.arange(len(begin)), length)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(length) - length, length) + np.repeat(begin, length)


class _Column(_Side):
    """The visitors of a cell, ready to be looked up."""

    def __init__(self, ids: pa.Array, keys: pa.Array, parts_: pa.Array, bits: int = BITS) -> None:
        super().__init__(ids, keys, parts_)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.key_rows = self.keys[order], self.key_rows[order]
        self.place = np.empty(len(ids), dtype=np.int64)
        self.place[pc.sort_indices(ids).to_numpy(zero_copy_only=False).astype(np.int64)] = np.arange(len(ids))
        self.sets = {t: _Sets(*self.elements(t), len(ids), bits) for t in range(len(self.tags)) if (self.form[t] == 2).any()}
        self._flat = None

    def pairs(self, probe: _Side) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Distinct pairs of rows that share a key, in order; all pairs of a probe come together."""
        n = len(self.ids)
        begin, end = np.searchsorted(self.keys, probe.keys, "left"), np.searchsorted(self.keys, probe.keys, "right")
        load = np.concatenate([[0], np.cumsum(np.bincount(probe.key_rows, weights=end - begin, minlength=len(probe.ids)).astype(np.int64))])
        first = 0
        while first < len(probe.ids):
            last = max(first + 1, int(np.searchsorted(load, load[first] + PAIRS, "right")) - 1)
            a, b = np.searchsorted(probe.key_rows, [first, last])
            which, at = _spans(begin[a:b], (end - begin)[a:b])
            codes = np.unique(probe.key_rows[a:b][which] * n + self.key_rows[at])
            if len(codes):
                yield codes // n, codes % n
            first = last

    def similarities(self, probe: _Side, sets: dict, pi: np.ndarray, li: np.ndarray, agree: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each tag, in order of names: its number, which pairs have it on both sides, and how much they agree in it."""
        for t in range(len(self.tags)):
            form = probe.form[t][pi]
            both = (form == self.form[t][li]) & (form > 0)
            sim = (probe.value[t][pi] == self.value[t][li]).astype(np.float64)
            if t in sets and (two := np.flatnonzero(both & (form == 2))).size:
                p, q = pi[two], li[two]
                common = self.sets[t].common(sets[t], p, q)
                every = probe.size[t][p] + self.size[t][q] - common
                j = np.where(every == 0, 1.0, common / np.maximum(every, 1))
                sim[two] = np.where(j >= agree, 1.0, j)
            yield t, both, sim


def grid(probes: DataFrame, library: DataFrame, of: Callable, schema: str, column: int = COLUMN, bits: int = BITS) -> DataFrame:
    """``of(visitors, probes, probes' sets, pairs...)`` for some probes of a cell at a time; both sides are :func:`records`, ``library`` stored."""
    tasks = int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = max(1, -(-library.count() // column))
    lines = max(1, -(-tasks // columns))
    visitors = cut(packed(library.select(F.col("id").alias("visitor_id"), "keys", "parts").repartition(columns, "visitor_id"), column)).select(F.col("blob").alias("visitors"))
    asked = cut(packed(probes.select("id", "keys", "parts").repartition(lines, "id"), LINE)).select(F.col("blob").alias("probes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, block = None, None
        for b in batches:
            for mine, whole in zip(*b.columns, strict=True):
                if block is None or not last.equals(whole.as_buffer()):
                    last, block = pa.py_buffer(whole.as_py()), _Column(*(opened(whole).combine_chunks().column(c).chunk(0) for c in ("visitor_id", "keys", "parts")), bits)
                for part in opened(mine).to_batches(max_chunksize=BATCH):
                    probe = _Side(part.column("id"), part.column("keys"), part.column("parts"), block.tags)
                    sets = {t: s.of(*probe.elements(t), len(probe.ids)) for t, s in block.sets.items()}
                    for pi, li in block.pairs(probe):
                        yield of(block, probe, sets, pi, li)

    # a product of blobs is read from where they are stored: neither side is moved for the cells it lies in
    return map_arrow(asked.hint("shuffle_replicate_nl").crossJoin(visitors), run, schema)


def scored(probes: DataFrame, library: DataFrame, agree: float, column: int = COLUMN, bits: int = BITS) -> DataFrame:
    """``(id, visitor_id, score, compared)`` of all pairs that share a key."""

    def of(block: _Column, probe: _Side, sets: dict, pi: np.ndarray, li: np.ndarray) -> pa.RecordBatch:
        score, n = _score(block, probe, sets, pi, li, agree)
        return pa.RecordBatch.from_arrays([probe.ids.take(pa.array(pi)), block.ids.take(pa.array(li)), pa.array(score), pa.array(n)], names=["id", "visitor_id", "score", "compared"])

    return grid(probes, library, of, _schema(probes, library, "score double, compared int"), column, bits)


def best(probes: DataFrame, library: DataFrame, agree: float, column: int = COLUMN, bits: int = BITS) -> DataFrame:
    """The two best rows of :func:`scored` for each probe and column (equal scores: least visitor first), with ``names`` and ``sims``, what they agree in."""

    def of(block: _Column, probe: _Side, sets: dict, pi: np.ndarray, li: np.ndarray) -> pa.RecordBatch:
        score, n = _score(block, probe, sets, pi, li, agree)
        order = np.lexsort((block.place[li], -score, pi))
        row = pi[order]
        top = np.ones(len(row), dtype=bool)
        top[2:] = row[2:] != row[:-2]
        keep = order[top]
        p, q = pi[keep], li[keep]
        words = [t.split("\x1f")[0] for t in block.tags]
        which, tags, values = [], [], []
        for t, both, sim in block.similarities(probe, sets, p, q, agree):
            which.append(np.flatnonzero(both))
            tags.append(np.full(len(which[-1]), t))
            values.append(sim[both])
        which, tags, values = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (which, tags, values))
        by = np.argsort(which, kind="stable")
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(p)))]), pa.int32())
        names = pa.ListArray.from_arrays(offsets, pa.array(words, pa.string()).take(pa.array(tags[by])))
        sims = pa.ListArray.from_arrays(offsets, pa.array(values[by], pa.float64()))
        return pa.RecordBatch.from_arrays([probe.ids.take(pa.array(p)), block.ids.take(pa.array(q)), pa.array(score[keep]), pa.array(n[keep]), names, sims], names=["id", "visitor_id", "score", "compared", "names", "sims"])

    return grid(probes, library, of, _schema(probes, library, "score double, compared int, names array<string>, sims array<double>"), column, bits)


def shared_values(probes: DataFrame, library: DataFrame, column: int = COLUMN) -> DataFrame:
    """``(id, all_hits, tags, hits)`` for each probe and column: values of its candidates, and those equal to its own values (0 left out)."""

    def of(block: _Column, probe: _Side, sets: dict, pi: np.ndarray, li: np.ndarray) -> pa.RecordBatch:
        rows, at = np.unique(pi, return_inverse=True)
        all_hits = np.bincount(at, weights=block.scalars[li], minlength=len(rows)).astype(np.int64)
        words = list(block.tags)
        scalar = [t for t in range(len(words)) if (block.form[t] == 1).any()]
        own = list(probe.own)
        hits = np.zeros((len(rows), len(own)), dtype=np.int64)
        for k, tag in enumerate(own):
            form, value = probe.own[tag]
            n = np.zeros(len(pi), dtype=np.int64)
            for t in scalar:
                n += form[pi] & (block.form[t][li] == 1) & (value[pi] == block.value[t][li])
            hits[:, k] = np.bincount(at, weights=n, minlength=len(rows)).astype(np.int64)
        r, c = np.nonzero(hits)
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(r, minlength=len(rows)))]), pa.int32())
        tags = pa.ListArray.from_arrays(offsets, pa.array(own, pa.string()).take(pa.array(c)))
        return pa.RecordBatch.from_arrays([probe.ids.take(pa.array(rows)), pa.array(all_hits), tags, pa.ListArray.from_arrays(offsets, pa.array(hits[r, c]))], names=["id", "all_hits", "tags", "hits"])

    return grid(probes, library, of, f"id {dict(probes.dtypes)['id']}, all_hits bigint, tags array<string>, hits array<bigint>", column)


def _schema(probes: DataFrame, library: DataFrame, rest: str) -> str:
    return f"id {dict(probes.dtypes)['id']}, visitor_id {dict(library.dtypes)['id']}, {rest}"


def _score(block: _Column, probe: _Side, sets: dict, pi: np.ndarray, li: np.ndarray, agree: float) -> tuple[np.ndarray, np.ndarray]:
    score, n = np.zeros(len(pi)), np.zeros(len(pi), dtype=np.int32)
    for t, both, sim in block.similarities(probe, sets, pi, li, agree):
        score += np.where(both, sim * probe.agree[t][pi] + (1.0 - sim) * probe.differ[t][pi], 0.0)
        n += both
    return score, n
