"""Texts that were decoded with a wrong character encoding: finding the chain of encodings and undoing it.

A *chain* is what happened: bytes of one encoding were read as another, once or twice, with or without loss. All of them
leave ASCII alone, so only units (sentences, about) with other characters are looked at. A multinomial classifier on
hashed byte bigrams, trained on units of the corpus that were garbled on purpose by each chain, predicts a unit's chain
or that it is sound. The prediction is inverted and counts when the bytes decode strictly; where a loss makes that
impossible, a clearly larger likelihood decides. Text that is garbled in a part of a unit is found as a span of well-formed
sequences, classified and verified in the same way. A single sign that stands free in a text that is sound otherwise is a
mention (texts about garbling show it) if it is quoted, or if sound text has no such word in such a sentence: sentences of
the corpus tell which letters stand free as words, among which words, and between which two words a free sign may stand.
"""

from __future__ import annotations

import codecs
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..sources.shipping import map_arrow

#: Encodings that UTF-8 is misread as, older ones and what they are misread as.
UTF8_AS = ["cp1252", "latin1", "iso8859_15", "cp1250", "cp1251", "cp1254", "cp437", "cp850", "cp866", "mac_roman", "koi8_r", "gbk", "cp932"]
OLD_AS = {
    "cp1252": ["mac_roman", "cp850", "cp437", "cp1250", "cp1251", "utf8"],
    "cp1250": ["cp1252", "utf8"],
    "cp1251": ["cp1252", "koi8_r", "cp866", "utf8"],
    "koi8_r": ["cp1251", "cp1252"],
    "cp850": ["cp1252"],
    "mac_roman": ["cp1252"],
    "gbk": ["cp1252", "utf8"],
    "cp932": ["cp1252", "utf8"],
    "euc_jp": ["cp1252"],
}
TWICE = [("cp1252", "cp1252"), ("latin1", "latin1"), ("cp1252", "latin1"), ("latin1", "cp1252")]
LOST = ["cp1252", "latin1"]
#: Hash buckets of byte bigrams; passes of training.
BUCKETS, PASSES = 1 << 15, 2
#: Forms of texts whose soundness is kept at hand.
KNOWN = 50_000
#: Probability of a bucket that was never seen; bigrams of sound text that each chain's own are mixed with.
RARE, PRIOR = 1e-6, 300.0
#: Part of a unit that must consist of well-formed sequences where UTF-8 was misread and can't be had back.
COVERED = 0.6
#: Least gain in log-likelihood over sound: verified by strict decoding, where that isn't possible, and of a span.
VERIFIED, UNVERIFIED, SPAN = 3.0, 14.0, 9.0
ENDS = "[.!?。！？\\n]"
UNIT = re.compile(r"[^.!?。！？\n]+[.!?。！？\n]*")
BAD = "�"
#: Signs that quote what lies between two of them; signs that may stand before a sign that is shown.
QUOTES = "\"'`´‘’‚‛“”„‟‹›«»「」『』"
BEFORE = QUOTES + "([{<"
DAMAGED = re.compile(f"[{BAD}\x80-\x9f]")
NEAR = re.compile(r"[\x00-\x7F]?[^\x00-\x7F]+[\x00-\x7F]{0,2}")
FREE = re.compile(r"(?<!\w)[^\W\d_](?!\w)|(?<=\s)[^\w\s](?=\s)")


@cache
def chars_of(name: str) -> str | None:
    """The 256 characters of a single-byte encoding, undefined bytes as control characters; None for others."""
    try:
        return "".join(bytes([b]).decode(name, "ignore") or chr(b) for b in range(256)) if name not in ("gbk", "cp932", "euc_jp", "utf8") else None
    except LookupError:
        return None


@cache
def _back(name: str):
    return codecs.charmap_build(chars_of(name))


def misread(data: bytes, name: str) -> str:
    table = chars_of(name)
    return data.decode(name, "replace") if table is None else codecs.charmap_decode(data, "strict", table)[0]


def reread(text: str, name: str) -> bytes | None:
    """The bytes that ``misread`` would give this text for; None if there are none."""
    try:
        return text.encode(name) if chars_of(name) is None else codecs.charmap_encode(text, "strict", _back(name))[0]
    except UnicodeEncodeError:
        return None


@dataclass(frozen=True)
class Chain:
    """``steps``: (encoding of the bytes, encoding they were read as), in order; ``lost``: control characters were dropped."""

    steps: tuple[tuple[str, str], ...]
    lost: bool = False

    @property
    def name(self) -> str:
        return ", ".join(f"{a} as {b}" for a, b in self.steps) + (", loss" if self.lost else "")

    @property
    def fatal(self) -> bool:
        return self.lost or any(b == "utf8" for _, b in self.steps)

    @property
    def least(self) -> float:
        """The gain that is needed besides strict decoding, which proves little unless the bytes were UTF-8."""
        return VERIFIED if self.steps[0][0] == "utf8" else UNVERIFIED

    def garble(self, text: str) -> str | None:
        for a, b in self.steps:
            try:
                text = misread(text.encode(a), b)
            except UnicodeEncodeError:
                return None
        return re.sub("[\x80-\x9f]", "", text) if self.lost else text

    def garble_all(self, texts: list[str]) -> list[str | None]:
        """``garble`` of each text; where each character is garbled by itself, of all at once."""
        if all(a == "utf8" and chars_of(b) for a, b in self.steps):
            out = (self.garble("\0".join(texts)) or "").split("\0")
            if len(out) == len(texts):
                return out
        return [self.garble(t) for t in texts]

    def undo(self, text: str) -> str | None:
        """The original, if every step decodes strictly and gives another text."""
        if self.fatal:
            return None
        out = text
        for a, b in reversed(self.steps):
            data = reread(out, b)
            if data is None:
                return None
            try:
                out = data.decode(a)
            except UnicodeDecodeError:
                return None
        return out if out != text and not re.search("[\x80-\x9f]", out) else None


CHAINS = [
    *(Chain((("utf8", b),)) for b in UTF8_AS),
    *(Chain((("utf8", a), ("utf8", b))) for a, b in TWICE),
    *(Chain((("utf8", b),), True) for b in LOST),
    *(Chain(((a, b),)) for a, bs in OLD_AS.items() for b in bs),
]


@cache
def _spans(name: str) -> re.Pattern:
    """Well-formed UTF-8 sequences of two to four bytes as they look in a single-byte encoding."""
    t = chars_of(name)
    some = lambda lo, hi: "[" + "".join(re.escape(t[b]) for b in range(lo, hi + 1)) + "]"
    more = some(0x80, 0xBF)
    return re.compile(f"(?:{some(0xC2, 0xDF)}{more}|{some(0xE0, 0xEF)}{more}{{2}}|{some(0xF0, 0xF4)}{more}{{3}})+")


SINGLE = [b for b in UTF8_AS if chars_of(b)]


@cache
def _any_span() -> re.Pattern:
    lead = "".join(re.escape(c) for c in sorted({chars_of(b)[x] for b in SINGLE for x in range(0xC2, 0xF5)}))
    more = "".join(re.escape(c) for c in sorted({chars_of(b)[x] for b in SINGLE for x in range(0x80, 0xC0)}))
    return re.compile(f"[{lead}][{more}]")


def _covered(text: str, name: str) -> float:
    """The part of a text's characters other than ASCII that is in well-formed sequences read as ``name``."""
    return sum(m.end() - m.start() for m in _spans(name).finditer(text)) / max(1, sum(c > "\x7f" for c in text))


def bigrams(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed bigrams with a byte above 127 of all units, each once in a unit, and how many each unit has."""
    data = [u.encode("utf-8", "surrogatepass") for u in units]
    size = np.fromiter((len(d) for d in data), dtype=np.int64, count=len(data))
    b = np.frombuffer(b"".join(data), dtype=np.uint8).astype(np.int64)
    if len(b) < 2:
        return np.zeros(0, np.int64), np.zeros(len(units), np.int64)
    owner = np.repeat(np.arange(len(units)), size)
    use = ((b[1:] | b[:-1]) > 127) & (owner[1:] == owner[:-1])
    code = (b[:-1] << 8 | b[1:])[use]
    # Runs of one sign (rules, boxes) would otherwise count as so many independent observations.
    every = np.sort(owner[1:][use] * BUCKETS + (code * 40503 + (code >> 7)) % BUCKETS)
    once = every[np.concatenate([[True], every[1:] != every[:-1]])] if len(every) else every
    return (once % BUCKETS).astype(np.int32), np.bincount(once // BUCKETS, minlength=len(units))


def _words(text: str) -> set[str]:
    return set(re.findall(r"[^\W\d_]{2,}|(?<!\w)[a-z](?!\w)", text.lower()))


def _around(text: str, start: int, end: int) -> int:
    """A hash of the words on both sides of a sign, numbers being equal; the same in all processes."""
    before, after = text[max(0, start - 60) : start].split()[-1:], text[end : end + 60].split()[:1]
    both = " ".join(re.sub("[0-9]+", "0", "".join(w)).lower().strip(".,;:!?()") or "|" for w in (before, after))
    return zlib.crc32(both.encode("utf-8", "surrogatepass"))


class Usage:
    """Which signs other than ASCII stand free in sound sentences, and among which words."""

    def __init__(self, units: list[str]):
        self.units, self.words = len(units), Counter()
        self.letters: dict[str, tuple[int, Counter]] = {}
        self.between: set[int] = set()
        for u in units:
            own = _words(u)
            self.words.update(own)
            free = [m for m in FREE.finditer(u) if not m.group().isascii() and not _quoted(u, m.start(), m.end())]
            self.between.update(_around(u, m.start(), m.end()) for m in free)
            for c in {m.group().lower() for m in free if m.group().isalpha()}:
                n, among = self.letters.get(c, (0, Counter()))
                among.update(own)
                self.letters[c] = (n + 1, among)

    def rows(self) -> list[tuple[str | None, str | None, int]]:
        """``(letter, word, n)``, to be added up: words of a letter's sentences (of all: no letter), numbers of sentences (no word), surroundings (a number for a word, ``*`` for a letter)."""
        out = [(None, None, self.units), *((None, w, n) for w, n in self.words.items()), *(("*", str(h), 1) for h in self.between)]
        for c, (n, among) in self.letters.items():
            out += [(c, None, n), *((c, w, k) for w, k in among.items())]
        return out

    @classmethod
    def of(cls, rows: Iterable[tuple[str | None, str | None, int]]) -> Usage:
        out, among, sentences = cls([]), {}, {}
        for c, w, n in rows:
            if c == "*":
                out.between.add(int(w))
            elif c is None and w is None:
                out.units = n
            elif c is None:
                out.words[w] = n
            elif w is None:
                sentences[c] = n
            else:
                among.setdefault(c, Counter())[w] = n
        out.letters = {c: (n, among.get(c, Counter())) for c, n in sentences.items()}
        return out

    def word(self, letter: str, sentence: str) -> bool:
        """Whether a letter may be a word of a sentence: it is one in sound text, and not less so among these words."""
        n, among = self.letters.get(letter.lower(), (0, Counter()))
        return n > 0 and sum(np.log((among[w] + 1) / (self.words[w] * n / self.units + 1)) for w in _words(sentence)) >= 0


class Model:
    """Log-probabilities of bigram buckets: of sound text, and of each chain less those of sound text.

    A chain is compared twice: with the very units that were garbled by it as they were before (so that a unit's language
    is no evidence for chains that only some languages can go through), and with all sound units (so that another
    language's own letters are none either). The smaller gain counts.
    """

    def __init__(self, sound: np.ndarray, over: np.ndarray, usage: Usage):
        self.sound, self.over, self.usage = sound, over, usage
        self.known: dict[str, float] = {}  # soundness of the last forms

    def gains(self, units: list[str]) -> np.ndarray:
        """For each unit and chain: log-likelihood less that of sound text."""
        out = np.zeros((len(units), len(CHAINS)), dtype=np.float32)
        for at in range(0, len(units), 4096):
            code, count = bigrams(units[at : at + 4096])
            if len(code):
                has = np.flatnonzero(count)
                total = np.add.reduceat(self.over[code], (np.cumsum(count) - count)[has], axis=0)
                out[at + has] = np.minimum(total[:, : len(CHAINS)], total[:, len(CHAINS) :])
        return out

    def soundness(self, text: str) -> float:
        """Mean log-probability of a text's bigrams as sound text; 0 when all is ASCII."""
        form = _near(text)
        if form not in self.known:
            if len(self.known) >= KNOWN:
                self.known.clear()
            code, _ = bigrams([form])
            self.known[form] = float(self.sound[code].mean()) if len(code) else 0.0
        return self.known[form]


def _counted(units: list[str], times: np.ndarray) -> np.ndarray:
    """Rows of counts by bucket: of the units; then for each chain of what it makes of them, and of the units that it changes."""
    out = np.zeros((1 + 2 * len(CHAINS), BUCKETS))

    def add(row: int, found: tuple[np.ndarray, np.ndarray], w: np.ndarray) -> None:
        out[row] += np.bincount(found[0], np.repeat(w, found[1]), BUCKETS)

    plain = bigrams(units)
    add(0, plain, times)
    for i, c in enumerate(CHAINS):
        made = [(k, g) for k, (u, g) in enumerate(zip(units, c.garble_all(units), strict=True)) if g and g != u]
        at = np.array([k for k, _ in made], dtype=np.int64)
        own = np.zeros(len(units))
        own[at] = times[at]
        add(1 + 2 * i, bigrams([g for _, g in made]), times[at])
        add(2 + 2 * i, plain, own)
    return out


def _model(counts: np.ndarray, usage: Usage) -> Model:
    """A multinomial model of each class from :func:`_counted`; buckets never seen have the same probability in all of them."""

    def logs(n: np.ndarray) -> np.ndarray:
        return np.log((n / max(n.sum(), 1) + RARE) / (1 + RARE * BUCKETS)).astype(np.float32)

    sound = counts[0]
    whole = logs(sound)
    # The less there is to learn a chain from, the less it differs from sound text.
    prior = PRIOR * sound / max(sound.sum(), 1)
    over = np.zeros((BUCKETS, 2 * len(CHAINS)), dtype=np.float32)
    for i in range(len(CHAINS)):
        garbled = logs(counts[1 + 2 * i] + prior)
        over[:, i] = garbled - logs(counts[2 + 2 * i] + prior)
        over[:, len(CHAINS) + i] = garbled - whole
    return Model(whole, over, usage)


def decide(unit: str, gain: np.ndarray, model: Model) -> tuple[Chain, str | None] | None:
    """The chain of a unit and its original (None where it can't be had); None for sound text."""
    order = np.argsort(-gain, kind="stable")
    undone = [(CHAINS[i], back) for i in order if gain[i] >= CHAINS[i].least and (back := CHAINS[i].undo(unit)) is not None]
    if undone:
        best = max(undone, key=lambda x: model.soundness(x[1]))
        if model.soundness(best[1]) > model.soundness(unit):
            return best
    for i in order:
        if gain[i] < UNVERIFIED:
            break
        if _plausible(unit, CHAINS[i]):
            return CHAINS[i], None
    return None


def _plausible(unit: str, chain: Chain) -> bool:
    """Whether a unit that doesn't decode strictly may still have gone through a chain."""
    a, b = chain.steps[-1]
    if b == "utf8":
        return True
    if chain.lost:
        return _covered(unit, b) >= COVERED * 2 / 3
    if a != "utf8":
        return reread(unit, b) is not None
    if chars_of(b):
        return _covered(unit, b) >= COVERED
    data = unit.replace(BAD, "").encode(b, "ignore")
    kept = data.decode("utf8", "ignore")
    return len(kept.encode()) >= COVERED * len(data) and not kept.isascii()


def _quoted(text: str, start: int, end: int) -> bool:
    before, after = text[max(0, start - 2) : start].rstrip(), text[end : end + 2].lstrip()
    return before[-1:] in QUOTES and after[:1] in QUOTES and before != "" != after


def _free(text: str, start: int, end: int, back: str | None, usage: Usage) -> bool:
    """A sign that stands by itself although what it stands for wouldn't."""
    if start and text[start - 1].isalnum() or end < len(text) and text[end].isalnum():
        return False
    if back is None:
        return _quoted(text, start, end) or _around(text, start, end) not in usage.between
    if len(back) != 1:
        return False
    if back.isalnum():
        ends = [m.start() for m in re.finditer(ENDS, text)]
        lo, hi = max([e + 1 for e in ends if e < start], default=0), min([e for e in ends if e >= end], default=len(text))
        return _quoted(text, start, end) or not usage.word(back, text[lo:start] + " " + text[end:hi])
    # An opening quote has its words behind it, a closing one before it.
    return back in "’‘“”„'\"" and (not start or text[start - 1].isspace() or text[start - 1] in BEFORE)


def examine(texts: list[str], model: Model) -> list[tuple[str, str | None] | None]:
    """For each text: None if it is sound, else the chain most of it went through and the text restored where possible."""
    units, owner, place = [], [], []
    for i, t in enumerate(texts):
        for m in UNIT.finditer(t):
            u = m.group()
            if not u.isascii():
                units.append(u)
                owner.append(i)
                place.append(m.start())
    forms: dict[str, int] = {}
    of = {u: forms.setdefault(_near(u), len(forms)) for u in dict.fromkeys(units)}
    form = np.array([of[u] for u in units], dtype=np.int64)
    gains = model.gains([*forms])[form]  # a unit has the bigrams of its form, and spans where that has some
    suspect = gains.max(axis=1) >= VERIFIED if len(units) else np.zeros(0, dtype=bool)
    odd = np.array([BAD in f or _any_span().search(f) is not None for f in forms], dtype=bool)[form]
    hits: dict[int, list[tuple[int, int, str, str | None]]] = {}
    spans, where = [], []
    for k in np.flatnonzero(suspect | odd).tolist():
        u = units[k]
        found = decide(u, gains[k], model) if suspect[k] else None
        if found:
            hits.setdefault(owner[k], []).append((place[k], place[k] + len(u), found[0].name, found[1]))
        if found is None:
            for m in re.finditer(BAD + "+", u):
                spans.append(u[max(0, m.start() - 1) : m.end() + 1])
                where.append((owner[k], place[k] + m.start(), m.group(), ""))
        if (found is None or found[1] is None) and _any_span().search(u):
            for b in SINGLE:
                for m in _spans(b).finditer(u):
                    spans.append(u[max(0, m.start() - 1) : m.end() + 1])
                    where.append((owner[k], place[k] + m.start(), m.group(), b))
    if spans:
        more = model.gains(spans)
        lossy = [c for c, x in enumerate(CHAINS) if x.steps[-1][1] == "utf8"]
        for s, (i, at, text, b) in enumerate(where):
            if not b:
                c = max(lossy, key=lambda c: more[s][c])
                if more[s][c] >= SPAN:
                    hits.setdefault(i, []).append((at, at + len(text), CHAINS[c].name, None))
                continue
            own = [c for c, x in enumerate(CHAINS) if x.steps[-1] == ("utf8", b) and not x.lost and more[s][c] >= SPAN]
            for c in sorted(own, key=lambda c: -more[s][c]):
                back = CHAINS[c].undo(text)
                if back is not None and model.soundness(spans[s].replace(text, back)) > model.soundness(spans[s]):
                    hits.setdefault(i, []).append((at, at + len(text), CHAINS[c].name, back))
                    break
    _by_text(units, owner, place, gains, hits, model)
    _prefer_spans(texts, hits, model)
    out: list[tuple[str, str | None] | None] = [None] * len(texts)
    for i, own in hits.items():
        t = texts[i]
        kept: list[tuple[int, int, str, str | None]] = []
        for h in sorted(own, key=lambda h: (h[0], h[0] - h[1])):
            if not kept or h[0] >= kept[-1][1]:
                kept.append(h)
        if all(_mention(t, h, model.usage) for h in kept):
            continue
        size: dict[str, int] = {}
        parts, at = [], 0
        for lo, hi, name, back in kept:
            size[name] = size.get(name, 0) + hi - lo
            parts += [t[at:lo], t[lo:hi] if back is None else back]
            at = hi
        whole = all(back is not None for *_, back in kept)
        out[i] = (max(sorted(size), key=lambda n: size[n]), "".join(parts) + t[at:] if whole else None)
    return out


def _by_text(units: list[str], owner: list[int], place: list[int], gains: np.ndarray, hits: dict[int, list[tuple[int, int, str, str | None]]], model: Model) -> None:
    """One chain for the units of a text where one undoes them: units tell little each, and several chains may undo the same.

    Of the chains found in a text's units the one that undoes most of them (of equals, the one that leaves the soundest text)
    is taken for all units that it undoes to sounder text, also those whose gain alone was too small.
    """
    of_text: dict[int, list[int]] = {}
    for k, i in enumerate(owner):
        if i in hits:
            of_text.setdefault(i, []).append(k)
    number = {c.name: n for n, c in enumerate(CHAINS)}
    for i, own in of_text.items():
        whole = {place[k]: k for k in own}
        tried = {n for lo, hi, n, back in hits[i] if back is not None and lo in whole and hi - lo == len(units[whole[lo]])}
        if not tried or len(own) < 2:
            continue
        best: tuple[int, float, str, dict[int, str]] | None = None
        for n in sorted(tried):
            back = {k: y for k in own if gains[k][number[n]] > 0 and (y := CHAINS[number[n]].undo(units[k])) is not None}
            better = {k: model.soundness(y) - model.soundness(units[k]) for k, y in back.items()}
            back = {k: y for k, y in back.items() if better[k] > 0}
            rank = (len(back), sum(better[k] for k in back), n, back)
            if best is None or rank[:2] > best[:2]:
                best = rank
        undone = {place[k]: (place[k], place[k] + len(units[k]), best[2], y) for k, y in best[3].items()}
        hits[i] = [h for h in hits[i] if not any(lo <= h[0] and h[1] <= hi for lo, hi, _, _ in undone.values())] + list(undone.values())


def _prefer_spans(texts: list[str], hits: dict[int, list[tuple[int, int, str, str | None]]], model: Model) -> None:
    """Drops units that can't be had back as a whole where every sign left over by their spans is sound where it stands."""
    tried, rest, owner = [], [], []
    for i, own in hits.items():
        for h in own:
            lo, hi, _, back = h
            inner = sorted((x for x in own if x[3] is not None and lo <= x[0] and x[1] <= hi), key=lambda x: (x[0], x[0] - x[1]))
            if back is not None or not inner or BAD in texts[i][lo:hi]:
                continue
            parts, at = [], lo
            for a, b, _, y in inner:
                if a >= at:
                    parts += [texts[i][at:a], "\0" * len(y)]
                    at = b
            left = "".join(parts) + texts[i][at:hi]
            for m in re.finditer(r"[^\x00-\x7F]+", left):
                rest.append(left[max(0, m.start() - 1) : m.end() + 1].replace("\0", " "))
                owner.append(len(tried))
            tried.append((i, h))
    if tried:
        utf8 = [c for c, x in enumerate(CHAINS) if x.steps[0][0] == "utf8"]
        worse = set(np.array(owner, dtype=np.int64)[model.gains(rest)[:, utf8].max(axis=1) >= 0].tolist()) if rest else set()
        for k, (i, h) in enumerate(tried):
            if k not in worse:
                hits[i].remove(h)


def _mention(text: str, hit: tuple[int, int, str, str | None], usage: Usage) -> bool:
    """Whether all that is wrong with a hit is one sign that stands free."""
    lo, hi, _, back = hit
    bad = [(m.start(), m.end(), None) for m in re.finditer(BAD + "+", text[lo:hi])]
    for b in SINGLE:
        for m in _spans(b).finditer(text[lo:hi]):
            y = Chain((("utf8", b),)).undo(m.group())
            if y and not any(m.start() < e and s < m.end() for s, e, _ in bad):
                bad.append((m.start(), m.end(), y))
    return len(bad) == 1 and _free(text, lo + bad[0][0], lo + bad[0][1], bad[0][2], usage)


def fit(df: DataFrame, key: str, text: str, sample: int | None = None) -> Model:
    """Trains on all texts with other than ASCII characters, or on a share of them (by hash of key) that gives about ``sample``.

    Counts are whole numbers that tasks add up, so the model is the same however rows are laid out. The corpus holds garbled
    texts too. The first pass trains on units without obvious damage; each further pass takes off the counts of those that the
    pass before takes for garbled. Units are garbled once where they agree in :func:`_near`, all that bigrams can tell. What comes
    to the driver: at most 81 counts for each bucket, and the words, free signs and their surroundings in sound text (:class:`Usage`).
    """
    some = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").rlike(r"[^\x00-\x7F]"))
    if sample is not None:
        share = min(1.0, sample / max(some.count(), 1))
        some = some.where(F.coalesce(F.pmod(F.xxhash64("k"), F.lit(1 << 30)), F.lit(0)) < int(share * (1 << 30)))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near, kinds, clean = Counter(), {}, {}
            for u, n in Counter(u for t in b.column(0).to_pylist() for u in UNIT.findall(t) if not u.isascii()).items():
                near[form := _near(u)] += n
                if clean.setdefault(form, None) is None:
                    clean[form] = _clean(form)
                if clean[form]:
                    mask = _mask(u)
                    kinds[mask] = min(kinds.get(mask, u), u)
            near = {u: n for u, n in near.items() if clean[u]}
            yield pa.RecordBatch.from_arrays([pa.array([*near, *kinds], pa.string()), pa.array([None] * len(near) + [*kinds.values()], pa.string()), pa.array([*near.values()] + [0] * len(kinds), pa.int64())], names=["form", "unit", "n"])

    units = map_arrow(some.select("t"), split, "form string, unit string, n bigint").groupBy("form", F.col("unit").isNull().alias("near")).agg(F.min("unit").alias("unit"), F.sum("n").alias("n"))
    units = cut(units.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "form"))
    near, whole = units.where("near").select("form", "n"), units.where("not near").select("unit")

    def total(model: Model | None) -> np.ndarray:
        """Counts of all units, or of those that a model takes for garbled."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((1 + 2 * len(CHAINS), BUCKETS))
            for b in batches:
                own, times = b.column(0).to_pylist(), b.column(1).to_numpy().astype(np.float64)
                if model:
                    bad = ~_kept(own, model)
                    own, times = [u for u, x in zip(own, bad, strict=True) if x], times[bad]
                if own:
                    out += _counted(own, times)
            at = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out.ravel()[at].astype(np.int64))], names=["at", "n"])

        sums = map_arrow(near, run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros((1 + 2 * len(CHAINS)) * BUCKETS)
        out[sums["at"].to_numpy()] = sums["n"].to_numpy()
        return out.reshape(-1, BUCKETS)

    every = total(None)
    before, model = None, _model(every, Usage([]))
    for _ in range(PASSES - 1):
        before, model = model, _model(every - total(model), Usage([]))

    def used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_pylist()
            forms: dict[str, int] = {}
            form = np.array([forms.setdefault(_near(u), len(forms)) for u in own], dtype=np.int64)
            keep = (_kept([*forms], before) if before else np.ones(len(forms), dtype=bool))[form]
            rows = Usage([u for u, k in zip(own, keep, strict=True) if k]).rows()
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["letter", "word", "n"])

    rows = map_arrow(whole, used, "letter string, word string, n bigint").groupBy("letter", "word").agg(F.sum("n").alias("n")).toArrow()
    model.usage = Usage.of(zip(*(rows[c].to_pylist() for c in ("letter", "word", "n")), strict=True))
    return model


def _mask(unit: str) -> str:
    """Sentences that differ by numbers only are equal."""
    return re.sub(r"[0-9]+", "0", unit)


def _near(unit: str) -> str:
    """The characters other than ASCII, each with one ASCII character before it and two behind (a lost lead byte may take one with it)."""
    return "".join(NEAR.findall(unit))


def _clean(unit: str) -> bool:
    """Not damaged, and not made of well-formed sequences of one encoding for the most part."""
    if DAMAGED.search(unit):
        return False
    return not _any_span().search(unit) or max(_covered(unit, b) for b in SINGLE) < COVERED


def _kept(units: list[str], model: Model) -> np.ndarray:
    """Which units a model takes for sound."""
    return np.array([g.max() < UNVERIFIED or not (d := decide(u, g, model)) or d[1] is None for u, g in zip(units, model.gains(units), strict=True)], dtype=bool)


def train_on(texts: list[str]) -> Model:
    """:func:`fit` on a few texts at hand."""
    near, kinds = Counter(), {}
    for u in (u for t in texts for u in UNIT.findall(t) if not u.isascii()):
        if _clean(u):
            near[_near(u)] += 1
            kinds[_mask(u)] = min(kinds.get(_mask(u), u), u)
    units, times = [*near], np.array([*near.values()], dtype=np.float64)
    keep = np.ones(len(units), dtype=bool)
    before, model = None, _model(_counted(units, times), Usage([]))
    for _ in range(PASSES - 1):
        keep = _kept(units, model)
        before, model = model, _model(_counted(units, times * keep), Usage([]))
    whole = [*kinds.values()]
    model.usage = Usage([u for u, k in zip(whole, _kept(whole, before), strict=True) if k] if before else whole)
    return model


def restore(df: DataFrame, key: str, text: str, model: Model | None = None, sample: int | None = None) -> DataFrame:
    """``(key, chain, restored)`` of the garbled texts; ``restored`` is null where the original can't be had.

    Defined cases: null, empty and pure ASCII texts are sound; texts of any length are examined whole; repeated rows give
    repeated rows; a null key stays null; an empty input gives no rows; other columns are ignored. There is no shuffle:
    the model (about 10 MB, and the words of sound text) goes to the rows. What trains it is shuffled once, see :func:`fit`.
    """
    kinds = dict(df.dtypes)
    model = model or fit(df, key, text, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = examine(b.column(1).to_pylist(), model)
            at = [i for i, f in enumerate(found) if f]
            if at:
                out = [b.column(0).take(pa.array(at)), pa.array([found[i][0] for i in at]), pa.array([found[i][1] for i in at], pa.string())]
                yield pa.RecordBatch.from_arrays(out, names=["key", "chain", "restored"])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").rlike(r"[^\x00-\x7F]"))
    return map_arrow(rows, run, f"key {kinds[key]}, chain string, restored string")
