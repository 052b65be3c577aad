"""Near-duplicate groups by parity sketches.

Texts become sets of words. A parity sketch flips one of its bits for each word, so words that two sets share cancel out:
the Hamming distance of two sketches is at most the size of the symmetric difference. Sets of ``n`` and ``m`` words that
overlap by ``t`` differ in at most ``(n + m) * (1 - t) / (1 + t)`` words, so a larger distance rules a pair out for certain.
In bands of sets too large for the sketch's bits, one word in ``2**j`` is sketched and the bound is widened by four deviations.

Joining: in each round, words are put on a circle by a hash, and segments of it are keyed by the XOR of their words' hashes.
The ``d`` differing words leave all other segments untouched, so pairs agree in some; these are the candidates. A
segment starts at one word in ``START`` and goes on until its words tell enough: a word that occurs in one set of ``2**k``
tells ``k`` bits, and a segment ends when its words would be expected together in at most ``TOGETHER`` sets. So words that
all texts have (names of fields, say) don't make a segment of their own, and rare ones need no company. A segment that
reaches its band's longest length before it tells enough is kept only for sets that have too few telling segments.

The number of rounds is calibrated for each set: a pair at the threshold shares no segment with a probability of at most
``miss``, if its differing words are drawn in proportion to what they tell. Candidates within the distance bound are
verified on the sets. Buckets that come out large all the same (words that go together) are dealt again by what words tell
within the bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..operators.fragment import skewed_join
from ..sources.shipping import map_arrow
from .buckets import DENSE, LIMIT, bucket_pairs, distinct_pairs, overlap_at_least, popcount
from .components import components
from .setjoin import as_set

#: Bits of the sketch; the other 16 of two words hold the size (rounded up to a 64th of an octave) and the sketch's sampling.
SKETCH_BITS, SIZE_STEPS = 112, 64
#: Sets that the words of a segment are expected in together; one word in so many starts a segment; longest segment.
TOGETHER, START, LONGEST = 128, 4, 8
#: Frequent words whose numbers are known to every task, at most; most bits that a word tells; units of a bit.
KNOWN, RARE_BITS, UNIT = 1 << 17, 12, 16
#: Segments of a set at most; sets that would need more take what tells too little, too.
MOST_SEGMENTS = 160
#: How often buckets are dealt again.
LEVELS = 3


def word_set(text) -> F.Column:
    """Distinct words (longest runs of a-z and 0-9 of the lower-cased text) as sorted 64-bit hashes; null if none."""
    return as_set(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != ""))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Layout:
    """Bands of sizes, lengths of segments and the number of rounds of a set."""

    def __init__(self, n: int, threshold: float, miss: float):
        self.t, self.miss = threshold, miss
        self.part = (1 - threshold) / (1 + threshold)
        self.enough = max(2, round((math.log2(max(n, 2)) - math.log2(TOGETHER)) * UNIT))  # units of a segment
        self.ratio = -3 * math.log(threshold)

    def band(self, size: np.ndarray) -> np.ndarray:
        """The band of the smaller set of a pair; sizes of a band differ by a factor of ``t ** -3`` at most."""
        return np.floor(np.log(np.maximum(size, 1)) / self.ratio + 1e-9).astype(np.int64)

    def lowest(self, band: int) -> int:
        return math.ceil(math.exp(band * self.ratio) - 1e-6)

    def longest(self, band: int) -> int:
        return max(1, min(LONGEST, int(0.35 * self.lowest(band))))

    def sampling(self, band: int) -> int:
        """One word in ``2**j`` is sketched, as the largest sets of a band would fill the sketch."""
        return max(0, math.ceil(math.log2(math.exp((band + 1) * self.ratio) / 140)))

    def rounds(self, size: np.ndarray, row: np.ndarray, words: np.ndarray, tells: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
        """Rounds of each set, and whether it takes segments that tell too little, too. ``words``: those that don't tell enough alone.

        At the threshold a partner lacks ``1 - t`` of a set's words at most. Where more words than that tell enough alone,
        one of these is shared for certain. Else the partner may lack them all; of the other words it then lacks
        fewer, each as likely as any other. Two circles with a segment from each word show how likely a segment stays whole.
        """
        inside = np.bincount(row, minlength=len(size))
        alone, lacks = size - inside, np.floor(size * (1 - self.t) + 1e-9)
        stays = 1 - np.maximum(lacks - alone, 0) / np.maximum(inside, 1)
        whole = np.zeros(len(size))
        for circle in range(2):
            c = Circle(row, words, tells, len(size), 77_003 + circle)
            seg = c.segments(np.arange(len(row)), self.enough, longest)
            told = seg.told >= self.enough
            owner = c.row[seg.start[told]]
            whole += np.bincount(owner, stays[owner] ** seg.length[told], len(size)) / 2
        need = np.where(alone > lacks, 0.0, -math.log(self.miss) * START / np.maximum(whole, 1e-9))
        most = np.ceil(MOST_SEGMENTS * START / np.maximum(inside, 1))
        return np.ceil(np.minimum(need, most)).astype(np.int64), need > most


class Circle:
    """The words of each row in the order of a hash; rows one after the other."""

    def __init__(self, row: np.ndarray, words: np.ndarray, tells: np.ndarray, rows: int, seed: int):
        h = _mix(words ^ np.uint64(seed))
        self.order = np.argsort((row.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)), kind="stable")
        self.row, self.words = row[self.order], words[self.order]
        n = np.bincount(self.row, minlength=rows)
        self.hi = np.cumsum(n)[self.row]
        self.lo = self.hi - n[self.row]
        self.told = np.concatenate([[0], np.cumsum(tells[self.order])])

    def segments(self, start: np.ndarray, enough: int, longest: int) -> Segments:
        """From each start as many words as tell ``enough``, at most ``longest``, going on at the row's beginning; none if that is all of the row."""
        told, lo, hi = self.told, self.lo[start], self.hi[start]
        end = np.minimum(np.searchsorted(told, told[start] + enough, side="left"), start + longest)
        wraps = end > hi
        rest = enough - (told[hi] - told[start])
        again = np.minimum(np.searchsorted(told, told[lo] + rest, side="left"), lo + longest - (hi - start))
        again, end = np.where(wraps, np.minimum(again, start), lo), np.where(wraps, hi, end)
        some = ~(wraps & (again >= start))
        s = Segments(start[some], end[some], lo[some], again[some])
        s.told = s.sums(told)
        return s


class Segments:
    """Words from ``start`` to ``end`` and from ``lo`` to ``again``, both ends excluded."""

    told: np.ndarray

    def __init__(self, start: np.ndarray, end: np.ndarray, lo: np.ndarray, again: np.ndarray):
        self.start, self.end, self.lo, self.again = start, end, lo, again
        self.length = end - start + again - lo

    def sums(self, before: np.ndarray) -> np.ndarray:
        """Sums over the segments, given the sums before each place (or, for hashes, their XOR)."""
        if before.dtype == np.uint64:
            return before[self.end] ^ before[self.start] ^ before[self.again] ^ before[self.lo]
        return before[self.end] - before[self.start] + before[self.again] - before[self.lo]


def frequent_words(sets: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Hashes (with their kind) of at most ``KNOWN`` frequent words, the units each tells, those any other word tells, and the largest kind."""
    words = sets.select("kind", F.explode("items").alias("w")).groupBy("kind", "w").agg(F.count("*").alias("df"))
    sizes = sets.groupBy("kind").agg(F.count("*").alias("sets"), F.sum(F.size("items")).alias("words"))
    total, n, largest = sizes.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("sets"), F.lit(0)), F.coalesce(F.max("sets"), F.lit(0))).first()
    often = words.where(F.col("df") * KNOWN > total).join(sizes.select("kind", "sets"), "kind").where(F.col("df") * (1 << RARE_BITS) > F.col("sets"))
    rest = max(1.0, min(RARE_BITS, math.log2(max(1, KNOWN * n / max(1, total)))))
    t = often.select("kind", "w", F.round(F.log2(F.col("sets") / F.col("df")) * UNIT).cast("bigint").alias("told")).toArrow()
    kind, w, told = (c.to_numpy().astype(np.int64) for c in t.columns) if t.num_rows else (np.zeros(0, np.int64),) * 3
    hashed = _mix(w.view(np.uint64) ^ _mix(kind.view(np.uint64) + np.uint64(0x51ED)))
    order = np.argsort(hashed)
    return hashed[order], np.minimum(told[order], round(rest * UNIT)), round(rest * UNIT), largest


def _segments(layout: Layout, often: np.ndarray, told: np.ndarray, rare: int, seed: int):
    """Rows ``(key, id, c1, c2)`` of the sets ``(kind, id, items)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                yield from part(b.slice(at, 2048))

    def part(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not b.num_rows:
            return
        lists = b.column("items")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        words = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False).view(np.uint64)
        size = np.diff(offsets)
        ids = b.column("id").to_numpy(zero_copy_only=False)
        kind = _mix(b.column("kind").to_numpy(zero_copy_only=False).view(np.uint64) + np.uint64(0x51ED))
        row = np.repeat(np.arange(len(ids)), size)
        words = _mix(words ^ kind[row])
        tells = np.full(len(words), rare, dtype=np.int64)
        if len(often):
            at = np.minimum(np.searchsorted(often, words), len(often) - 1)
            tells = np.where(often[at] == words, told[at], tells)
        own, down = layout.band(size), layout.band(np.ceil(layout.t * size - 1e-9))
        for band in np.unique(np.concatenate([own, down])):
            take = np.flatnonzero((own == band) | (down == band))
            inside = np.isin(row, take)
            number = np.zeros(len(ids), dtype=np.int64)
            number[take] = np.arange(len(take))
            yield from banded(int(band), ids[take], size[take], number[row[inside]], words[inside], tells[inside])

    def banded(band: int, ids: np.ndarray, size: np.ndarray, row: np.ndarray, words: np.ndarray, tells: np.ndarray) -> Iterator[pa.RecordBatch]:
        longest, j = layout.longest(band), layout.sampling(band)
        c1, c2 = _sketches(row, words, size, j)
        # Words that tell enough alone are segments; the others go on the circles.
        alone = tells >= layout.enough
        keys, owners = [_mix(words[alone])], [row[alone]]
        row, words, tells = row[~alone], words[~alone], tells[~alone]
        rounds, poor = layout.rounds(size, row, words, tells, longest)
        for r in range(int(rounds.max())):
            live = (rounds > r)[row]
            c = Circle(row[live], words[live], tells[live], len(ids), (seed + 1) * 1_000_003 + r * 7919 + band * 104_729)
            xor_before = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(_mix(c.words))])
            seg = c.segments(np.flatnonzero(_mix(c.words ^ np.uint64(0x5747 + r)) % np.uint64(START) == 0), layout.enough, longest)
            owner = c.row[seg.start]
            use = (seg.told >= layout.enough) | poor[owner]
            keys.append(seg.sums(xor_before)[use])
            owners.append(owner[use])
        # Equal segments of several rounds are one.
        pair = np.unique(np.stack([np.concatenate(owners).astype(np.uint64), np.concatenate(keys)]), axis=1)
        owner, key = pair[0].astype(np.int64), _mix(pair[1] ^ _mix(np.array([band + 1], dtype=np.uint64)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(key.view(np.int64)), pa.array(ids[owner]), pa.array(c1[owner].view(np.int64)), pa.array(c2[owner].view(np.int64))],
            names=["key", "id", "c1", "c2"],
        )

    return run


def _sketches(row: np.ndarray, words: np.ndarray, size: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
    """112 bits, one flipped by each word (by one in ``2**j``); above them the size, rounded up, and ``j``."""
    n = len(size)
    h = _mix(words + np.uint64(1))
    if j:
        use = (h >> np.uint64(32)) & np.uint64((1 << j) - 1) == 0
        h, row = h[use], row[use]
    bit = h % np.uint64(SKETCH_BITS)
    flips = np.bincount(row * SKETCH_BITS + bit.astype(np.int64), minlength=n * SKETCH_BITS).reshape(n, SKETCH_BITS) & 1
    power = np.uint64(1) << np.arange(64, dtype=np.uint64)
    c1 = (flips[:, :64].astype(np.uint64) * power).sum(axis=1, dtype=np.uint64)
    c2 = (flips[:, 64:].astype(np.uint64) * power[: SKETCH_BITS - 64]).sum(axis=1, dtype=np.uint64)
    steps = np.ceil(SIZE_STEPS * np.log2(size) - 1e-9).astype(np.uint64)
    return c1, c2 | (steps << np.uint64(48)) | (np.uint64(min(j, 31)) << np.uint64(59))


def _near(layout: Layout):
    low, step = np.uint64((1 << 48) - 1), np.uint64(0x7FF)
    apart = math.floor(-math.log2(layout.t) * SIZE_STEPS + 1 + 1e-9)

    def near(p1, p2, q1, q2):
        n, m = ((p2 >> np.uint64(48)) & step).astype(np.int64), ((q2 >> np.uint64(48)) & step).astype(np.int64)
        share = 0.5 ** (p2 >> np.uint64(59)).astype(np.float64)
        differ = (np.exp2(n / SIZE_STEPS) + np.exp2(m / SIZE_STEPS)) * layout.part
        most = np.floor(share * differ + 4 * np.sqrt(share * (1 - share) * differ) + 1e-9)
        return (np.bitwise_count(p1 ^ q1).astype(np.int64) + np.bitwise_count((p2 ^ q2) & low) <= most) & (np.abs(n - m) <= apart)

    return near


def near_duplicates(records: DataFrame, kind: str, key: str, text: str, num: int = 7, den: int = 10, miss: float = 1e-3, seed: int = 11, limit: int = LIMIT, dense: int = DENSE) -> DataFrame:
    """``(kind, leader_id, member_id)``: a row for each member of a group but the least key (as text), which leads it.

    Texts of one kind whose word sets overlap by ``num / den`` or more are neighbours, and groups are closed under this.

    Defined cases: records with a null kind, key or text, or with a text without words, take no part; texts with equal
    word sets are neighbours; repeated rows of a record are one member; a record with several texts belongs to the groups
    of all of them; texts of any length are compared whole; an empty input gives no rows; other columns are ignored.
    Buckets above the limit of the streaming comparison, or with more than ``dense`` near pairs for each row, aren't cut:
    each row is first linked to the bucket's first row; then rows outside of a bucket's main component are compared with
    all its rows of other components where these are few, and else the bucket is dealt again by its own words' numbers.
    """
    words = records.select(F.col(kind).cast("string").alias("kind"), F.col(key).cast("string").alias("key"), word_set(F.col(text)).alias("items"))
    words = words.where("kind is not null and key is not null and items is not null")
    members = cut(words.withColumn("id", F.xxhash64("kind", "items")))
    named = members.select("kind", "key", "id").distinct()
    sets = cut(members.groupBy("id").agg(F.first(F.xxhash64("kind")).alias("kind"), F.first("items").alias("items")))
    links = _links(sets, num, den, miss, seed, limit, dense)
    roots = components(links)
    placed = skewed_join(named, roots.withColumnRenamed("node", "id"), "id", "left")
    placed = placed.select("kind", F.col("key").alias("member_id"), F.coalesce("root", "id").cast("string").alias("root"))
    placed = cut(placed)
    leaders = placed.groupBy("root").agg(F.min("member_id").alias("leader_id"), F.count("*").alias("n")).where("n > 1").select("root", "leader_id")
    return skewed_join(placed, leaders, "root").where("member_id != leader_id").select("kind", "leader_id", "member_id").distinct()


def _links(sets: DataFrame, num: int, den: int, miss: float, seed: int, limit: int, dense: int) -> DataFrame:
    """Verified pairs of near sets, enough of them to connect each group."""
    links, dealt = None, sets
    for level in range(LEVELS):
        often, told, rare, n = frequent_words(dealt)
        layout = Layout(n, num / den, miss if level == 0 else miss**0.5)  # within one of several shared buckets
        rows = map_arrow(dealt.select("kind", "id", "items"), _segments(layout, often, told, rare, seed + level), "key bigint, id bigint, c1 bigint, c2 bigint")
        found = cut(bucket_pairs(rows, _near(layout), limit, stars=True, dense=dense))
        new = overlap_at_least(cut(distinct_pairs(found)), sets, num, den)
        links = cut(new if links is None else links.unionByName(new))
        big = found.where(F.col("b").isNull()).select("key", "a", "c1", "c2")
        if big.isEmpty():
            return links
        rows = cut(skewed_join(big, components(links).withColumnRenamed("node", "a"), "a", "left").select("key", "a", "c1", "c2", F.coalesce("root", "a").alias("label")))
        by_label = cut(rows.groupBy("key", "label").agg(F.count("*").alias("n")))
        loads = by_label.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("n"))
        loads = cut(loads.where("n > most").select("key", "main", ((F.col("n") - F.col("most")) * F.col("n")).alias("work"), "n"))
        again = F.col("work") > F.col("n") * limit
        last = level == LEVELS - 1
        direct = loads if last else loads.where(~again)
        if not direct.isEmpty():
            links = cut(links.unionByName(overlap_at_least(_across(rows, direct, layout), sets, num, den)))
        rest = loads.where(again)
        if last or rest.isEmpty():
            return links
        hard = skewed_join(rows.select("key", "a"), rest.select("key"), "key", "left_semi").select(F.col("key").alias("kind"), F.col("a").alias("id")).distinct()
        dealt = cut(hard.join(sets.select("id", "items"), "id"))
    return links


def _across(rows: DataFrame, loads: DataFrame, layout: Layout) -> DataFrame:
    """Pairs of rows of different components in a bucket: all but its main component against its rows, spread by load."""
    at = cut(skewed_join(rows, loads.select("key", "main"), "key"))
    few = at.where("label != main").select("key", F.col("a").alias("b"), F.col("c1").alias("q1"), F.col("c2").alias("q2"), F.col("label").alias("other"))
    size = lambda c: F.pow(2.0, F.shiftrightunsigned(c, 48).bitwiseAND(0x7FF) / SIZE_STEPS)
    share = F.pow(F.lit(0.5), F.shiftrightunsigned("c2", 59))
    differ = (size("c2") + size("q2")) * layout.part
    most = F.floor(share * differ + 4 * F.sqrt(share * (1 - share) * differ) + 1e-9)
    distance = popcount("c1", "q1") + F.bit_count(F.col("c2").bitwiseXOR(F.col("q2")).bitwiseAND((1 << 48) - 1))
    pairs = skewed_join(at.select("key", "a", "c1", "c2", "label"), few, "key").where((F.col("label") != F.col("other")) & (distance <= most))
    return cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
