"""Score for abusive, hateful or sexual content: boosted trees over dense features.

The features are densities of word lists, nearness of a second person or a
group to a listed word, and rates of capitals, marks and disguised words, for the
whole text and for its worst sentence.  Besides the general lists below there is one
learned from the labelled texts: words by their log odds among abusive ones.  All
features of a batch are computed together on the bytes of its texts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicweave.llm.words import hash_runs, slices
from topicweave.plans.stage import stage

U = np.uint64
# Short general word lists in English, German, French and Spanish.
INSULT = """idiot idiots moron morons imbecile cretin stupid dumb fool fools loser losers jerk jerks scum scumbag bastard bastards pathetic worthless ugly
disgusting pig pigs clown clowns trash garbage coward cowards liar liars freak freaks dumbass jackass dummkopf dumm blöd trottel abschaum dreckig
imbécile crétin connard stupide ordure imbécil idiota idiotas estúpido tonto basura""".split()
PROFANE = """fuck fucks fucked fucking fucker shit shitty bullshit damn goddamn hell ass asshole arse arsehole crap bitch bitches piss pissed bollocks bugger
scheisse scheiße verdammt arsch arschloch merde putain bordel mierda puta puto joder carajo""".split()
THREAT = """kill kills killed murder hurt beat stab shoot hang burn strangle attack destroy smash punch die dead death töten umbringen schlagen sterben
tuer frapper mourir crever matar golpear morir muerte""".split()
DEHUMAN = """vermin subhuman subhumans rats cockroach cockroaches parasite parasites plague filth filthy savages inferior leeches animals ungeziefer untermenschen ratten
vermine cafards alimañas plaga ratas""".split()
SEXUAL = """sex sexy sexual nude nudes naked porn porno xxx cock cocks dick dicks pussy tits boobs penis vagina orgasm orgy horny cum blowjob anal erotic nipples
hardcore nackt ficken nue nus desnuda desnudo desnudas""".split()
GROUP = """they them their those people folk folks immigrants foreigners migrants refugees women men blacks whites jews muslims christians gays everyone sie ausländer
ils eux leur étrangers ellos ellas extranjeros inmigrantes""".split()
SECOND = "you your yours yourself yourselves u ur du dich dir dein deine ihr euch euer tu te toi ton ta vous votre vos tú ti usted ustedes".split()
KINDS = (INSULT, PROFANE, THREAT, DEHUMAN, SEXUAL)
_LISTED = {w for kind in KINDS for w in kind}

#: Letters that digits and marks stand for in disguised words.
_STANDS = {"@": "a", "$": "s", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "!": "i"}
_CODE = np.arange(256, dtype=np.uint8)
_CODE[ord("A") : ord("Z") + 1] += 32
for _k, _v in _STANDS.items():
    _CODE[ord(_k)] = ord(_v)
_KIND = np.zeros(256, np.uint8)  # 1 letter, 2 digit, 3 mark that may stand for a letter
for _c in range(256):
    _KIND[_c] = 1 if chr(_c).isascii() and chr(_c).isalpha() or _c >= 128 else 2 if chr(_c).isdigit() else 3 if chr(_c) in "@$*#" else 0
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?"]] = True
_REPEAT = re.compile(r"(.)\1{2,}")

_SENTENCE = 17
#: The largest value of each sentence feature, all of them of the worst sentence, and seven of the whole text.
FEATURES = 2 * _SENTENCE + 7


def _shown(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and offsets without invisible characters and markup, and the bytes taken out of each text.

    Typed quotes, dashes and the like become blanks or plain marks.
    """
    gone, raw = np.zeros(len(raw), bool), raw.copy()
    lead = np.flatnonzero((raw == 0xC2) | (raw == 0xE2) | (raw == 0xEF))
    if len(lead):
        second, third = (np.where(lead + k < len(raw), raw[np.minimum(lead + k, len(raw) - 1)], 0) for k in (1, 2))
        first = raw[lead]
        two = lead[(first == 0xC2) & (second == 0xAD)]  # soft hyphen
        three = lead[((first == 0xE2) & (second == 0x80) & (third >= 0x8B) & (third <= 0x8D)) | ((first == 0xE2) & (second == 0x81) & (third == 0xA0)) | ((first == 0xEF) & (second == 0xBB) & (third == 0xBF))]
        for at, n in ((two, 2), (three, 3)):
            for k in range(n):
                gone[at + k] = True
        typed = lead[(first == 0xE2) & (second == 0x80) & (third >= 0x93) & (third <= 0xA6)]
        for k in range(3):
            raw[typed + k] = 32
        marks = lead[(first == 0xC2) & (second != 0xAD) & (second < 0xC0)]
        for k in range(2):
            raw[marks + k] = 32
    low, high = np.flatnonzero(raw == ord("<")), np.flatnonzero(raw == ord(">"))
    if len(low) and len(high):
        k = np.searchsorted(high, low)
        end = high[np.minimum(k, len(high) - 1)]
        tag = (k < len(high)) & (end - low > 1) & (end - low < 22) & (np.searchsorted(offsets, low, "right") == np.searchsorted(offsets, end, "right"))
        step = np.zeros(len(raw) + 1, np.int64)
        np.add.at(step, low[tag], 1)
        np.add.at(step, end[tag] + 1, -1)
        gone |= np.cumsum(step[:-1]) > 0
    upto = np.r_[0, np.cumsum(gone)]
    return raw[~gone], offsets - upto[offsets], np.diff(upto[offsets])


def _fold(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes in lower case, and which were capitals (ASCII and Latin-1)."""
    capital = (raw >= 65) & (raw <= 90)
    low = np.where(capital, raw + 32, raw).astype(np.uint8)
    accent = np.zeros(len(raw), bool)
    accent[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    return np.where(accent, low + 32, low).astype(np.uint8), capital | accent


class Tokens:
    """Words of a batch of texts with their hashes, sentences and disguises."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string())
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
        raw, offsets, self.hidden = _shown(raw, offsets - offsets[0])
        self.offsets, self.n = offsets, n
        self.low, self.capital = _fold(raw)
        kind = _KIND[raw]
        letter = kind == 1
        inner = (raw == ord("!")) & np.r_[False, letter[:-1]] & np.r_[letter[1:], False]
        word = (kind > 0) | inner
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1] | edge[1:-1]
        ends[:-1] &= ~word[1:] | edge[1:-1]
        start = np.flatnonzero(begins)
        size = np.flatnonzero(ends) - start + 1
        count = lambda mask: np.diff(np.r_[0, np.cumsum(mask)][np.stack([start, start + size])], axis=0)[0] if len(start) else np.empty(0, int)
        letters = count(letter)
        code = np.where(word, _CODE[self.low], self.low)
        plain = letters == 0  # numbers stay what they are
        if plain.any():
            at = np.repeat(start[plain], size[plain]) + np.arange(size[plain].sum()) - np.repeat(np.cumsum(size[plain]) - size[plain], size[plain])
            code[at] = self.low[at]
        self.start, self.size, self.letters = start, size, letters
        self.hash = hash_runs(code, start, size)
        self.masked = (letters > 0) & (letters < size)
        self.starred = (letters > 0) & (count(raw == ord("*")) + count(raw == ord("#")) > 0)
        same = np.zeros(len(raw), bool)
        same[2:] = (code[2:] == code[1:-1]) & (code[1:-1] == code[:-2]) & word[1:-1] & word[:-2] & word[2:]
        self.drawn = (letters > 2) & (count(same) > 0)
        blank = (raw == 32) | (raw == 9) | (raw == 13)
        stop = raw == 10
        stop[1:] |= blank[1:] & _END[raw[:-1]]
        sentence = np.cumsum(stop) + np.searchsorted(offsets, np.arange(len(raw)), "right") if len(raw) else np.empty(0, np.int64)
        self.row = np.searchsorted(offsets, start, "right") - 1
        part = sentence[start] if len(start) else np.empty(0, np.int64)
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.empty(0, np.int64)
        self.first, self.part = first, np.cumsum(np.r_[True, part[1:] != part[:-1]]) - 1 if len(part) else part
        ids = part[first]
        inside = lambda mask: np.bincount(np.searchsorted(ids, sentence[mask]).clip(0, max(0, len(ids) - 1)), np.isin(sentence[mask], ids), minlength=len(ids)) if len(ids) else np.zeros(0)
        cased = self.capital | (letter & (raw < 128))
        total = inside(cased)
        self.caps = np.where(total > 8, inside(self.capital) / np.maximum(total, 1), 0.0)
        self.marks = inside(raw == ord("!"))
        self._spaced(letter)

    def _spaced(self, letter: np.ndarray) -> None:
        """Single letters with a blank between each stand for one word."""
        self.skip = np.zeros(len(self.start), bool)
        if len(self.start) < 4:
            return
        single = (self.size == 1) & (self.letters == 1)
        joined = single[1:] & single[:-1] & (np.diff(self.start) == 2) & (self.part[1:] == self.part[:-1])
        edges = np.flatnonzero(np.diff(np.r_[0, joined.astype(np.int8), 0]))
        for a, b in zip(edges[::2], edges[1::2]):
            if b - a >= 3:
                text = "".join(chr(self.low[self.start[i]]) for i in range(a, b + 1))
                found = max((w for w in _LISTED if len(w) > 3 and w in text), key=len, default=text)
                self.hash[a], self.masked[a] = _hash_of(found), True
                self.skip[a + 1 : b + 1] = True

    def text(self, i: int) -> str:
        return self.low[self.start[i] : self.start[i] + self.size[i]].tobytes().decode("utf-8", "replace")


def _hashes(words: list[str]) -> np.ndarray:
    folded = [_CODE[_fold(np.frombuffer(w.encode(), np.uint8))[0]] for w in words]
    size = np.array([len(x) for x in folded], np.int64)
    return hash_runs(np.concatenate(folded), np.cumsum(size) - size, size)


@lru_cache(100_000)
def _hash_of(word: str) -> int:
    return _hashes([word])[0]


class Lexicon:
    """Word hashes with their lists (bits 0-4 kinds, 5 group, 6 second person) and a learned weight."""

    def __init__(self, learned: dict[int, float]):
        table: dict[int, list] = {int(h): [0, w] for h, w in learned.items()}
        for bit, words in enumerate((*KINDS, GROUP, SECOND)):
            for h in _hashes(words).tolist():
                table.setdefault(h, [0, 0.0])[0] |= 1 << bit
        self.keys = np.array(sorted(table), U)
        self.lists = np.array([table[int(h)][0] for h in self.keys], np.uint8)
        self.weight = np.array([table[int(h)][1] for h in self.keys])
        self._solved: dict[str, int] = {}

    def find(self, h: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, h).clip(0, len(self.keys) - 1)
        return np.where(self.keys[at] == h, at, -1)

    def solve(self, token: str) -> int:
        """Place of the listed word behind drawn-out or starred letters, -1 for none."""
        if token not in self._solved:
            at = -1
            for put in (r"\1", r"\1\1"):
                at = max(at, int(self.find(np.array([_hash_of(_REPEAT.sub(put, token))], U))[0]))
            if at < 0 and ("*" in token or "#" in token):
                shape = re.compile("".join("." if c in "*#" else re.escape(_STANDS.get(c, c)) for c in token))
                found = next((w for w in sorted(_LISTED) if len(w) == len(token) and shape.fullmatch(w)), None)
                at = int(self.find(np.array([_hash_of(found)], U))[0]) if found else -1
            if len(self._solved) < 200_000:
                self._solved[token] = at
            return at
        return self._solved[token]


def _nearest(at: np.ndarray, others: np.ndarray, part: np.ndarray) -> np.ndarray:
    """1 / (1 + distance) from each token to the nearest of the others in its sentence, 0 without one."""
    out = np.zeros(len(at))
    if len(others):
        k = np.searchsorted(others, at)
        for side in (np.maximum(k - 1, 0), np.minimum(k, len(others) - 1)):
            other = others[side]
            out = np.maximum(out, np.where(part[other] == part[at], 1 / (1 + np.abs(other - at)), 0))
    return out


def features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """Dense features of each text; whole texts are read."""
    t = Tokens(texts)
    out = np.zeros((t.n, FEATURES))
    chars = np.maximum(1, np.diff(t.offsets))
    if len(t.start):
        at = lexicon.find(t.hash)
        for i in np.flatnonzero((t.starred | t.drawn) & (at < 0)):
            at[i] = lexicon.solve(t.text(i))
        known = (at >= 0) & ~t.skip
        lists = np.where(known, lexicon.lists[at], 0)
        weight = np.where(known, lexicon.weight[at], 0.0)
        sums = lambda v: np.add.reduceat(np.asarray(v, float), t.first)
        n = np.maximum(1, sums(~t.skip))
        kinds = [sums(lists >> k & 1) for k in range(5)]
        bad = (lists & 31) > 0
        hits = np.flatnonzero(bad | (weight > 1.5))
        near = np.zeros((2, len(t.start)))
        for row, bit in zip(near, (6, 5)):
            row[hits] = _nearest(hits, np.flatnonzero(lists >> bit & 1), t.part)
        plus = sums(np.maximum(weight, 0))
        sentence = np.stack([
            *(k / n for k in kinds), sums(bad) / n, np.maximum.reduceat(near[0], t.first), np.maximum.reduceat(near[1], t.first),
            plus / n, plus / np.sqrt(n), plus, -sums(np.minimum(weight, 0)) / n, t.caps, t.marks / n, sums(t.masked & ~t.skip) / n, sums((t.masked | t.drawn) & (bad | (weight > 1.5))) / n, n,
        ], 1)
        row = t.row[t.first]
        cut = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        docs = row[cut]
        out[docs, :_SENTENCE] = np.maximum.reduceat(sentence, cut, axis=0)
        # the worst sentence: the one with the most learned and listed words, the first of several
        order = np.lexsort((np.arange(len(row)), -(plus + 2 * sums(bad)), row))
        out[docs, _SENTENCE : 2 * _SENTENCE] = sentence[order[cut]]
        whole = lambda v: np.add.reduceat(v, cut)
        size = whole(n)
        out[docs, 2 * _SENTENCE :] = np.stack([whole(sums(bad)) / size, whole(plus) / size, whole(sums(t.masked)) / size, whole(t.marks) / size, whole(plus > 3), np.log1p(size), np.zeros(len(docs))], 1)
    out[:, -1] = t.hidden / chars
    return out


class Trees:
    """Gradient boosting with logistic loss on binned features, and an isotonic calibration."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, l2: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.l2 = rounds, depth, rate, bins, l2

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)], 1) if len(x) else np.zeros((0, len(self.cuts)), int)

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(v, np.linspace(0, 1, self.bins + 1)[1:-1])) if len(np.unique(v)) > self.bins else np.unique(v)[1:] for v in x.T]
        b = self._binned(x)
        p = np.clip((w * y).sum() / w.sum(), 1e-3, 1 - 1e-3)
        self.base, self.trees = math.log(p / (1 - p)), []
        raw = np.full(len(y), self.base)
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-raw))
            tree = self._grow(b, w * (prob - y), w * prob * (1 - prob), np.arange(len(y)), 0)
            self.trees.append(tree)
            raw += self.rate * self._walk(tree, b)
        return self

    def _grow(self, b, g, h, at, depth):
        leaf = -g[at].sum() / (h[at].sum() + self.l2)
        if depth == self.depth or len(at) < 8:
            return leaf
        top, split = 1e-6, None
        for j in range(b.shape[1]):
            gs, hs = (np.cumsum(np.bincount(b[at, j], v[at], self.bins + 2)) for v in (g, h))
            left = gs**2 / (hs + self.l2) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + self.l2) - gs[-1] ** 2 / (hs[-1] + self.l2)
            left[(hs < 0.5) | (hs[-1] - hs < 0.5)] = 0
            k = int(left.argmax())
            if left[k] > top:
                top, split = left[k], (j, k)
        if split is None:
            return leaf
        low = b[at, split[0]] <= split[1]
        return (*split, self._grow(b, g, h, at[low], depth + 1), self._grow(b, g, h, at[~low], depth + 1))

    def _walk(self, tree, b) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(b), tree)
        j, k, left, right = tree
        return np.where(b[:, j] <= k, self._walk(left, b), self._walk(right, b))

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        return self.base + self.rate * sum((self._walk(t, b) for t in self.trees), np.zeros(len(b)))

    def calibrate(self, raw: np.ndarray, y: np.ndarray, w: np.ndarray) -> Trees:
        """Isotonic regression by pooling adjacent violators."""
        blocks: list[list[float]] = []
        for i in np.argsort(raw, kind="stable"):
            blocks.append([y[i] * w[i], w[i], raw[i], raw[i]])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                s, n, _, high = blocks.pop()
                blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], high]
        self.points = [x for block in blocks for x in (block[2:4])]
        self.values = [v for s, n, _, _ in blocks for v in (s / n, s / n)]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.points, self.values)


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word of a labelled text once, by hash."""
    for batch in batches:
        for first, texts in slices(batch.column(0)):
            t = Tokens(texts)
            keep = np.flatnonzero(~t.skip)
            pairs = np.unique(np.rec.fromarrays([t.row[keep], t.hash[keep]], names="row,hash")) if len(keep) else None
            if pairs is not None:
                at = pa.array(first + pairs["row"], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(pairs["hash"].view(np.int64)), batch.column(1).take(at), batch.column(2).take(at)], ["hash", "y", "fold"])


def _odds(yes: np.ndarray, no: np.ndarray, n: tuple[float, float], least: int = 3) -> np.ndarray:
    """Log odds of words among abusive texts, shrunk by their number; 0 where they say little."""
    odds = np.log((yes + 0.5) / (n[1] + 1)) - np.log((no + 0.5) / (n[0] + 1))
    both = yes + no
    return np.where((both >= least) & (np.abs(odds) > 0.7), np.clip(odds, -4, 4) * both / (both + 3), 0.0)


def _featured(lexicons):
    """Features of labelled texts, each with the lexicon of the other folds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds = batch.column(2).to_numpy()
            for fold in np.unique(folds):
                own = batch.filter(pa.array(folds == fold))
                for first, texts in slices(own.column(1)):
                    x = features(texts, lexicons.value[fold])
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * FEATURES), pa.array(x.ravel()))
                    yield pa.RecordBatch.from_arrays([own.column(0).slice(first, len(texts)), lists], ["doc", "x"])

    return run


def train(x: np.ndarray, y: np.ndarray, w: np.ndarray, fold: np.ndarray) -> Trees:
    """Trees on all rows, calibrated on scores of rows that the scoring trees haven't seen."""
    held = np.zeros(len(y))
    for k in np.unique(fold):
        if (fold != k).any():
            held[fold == k] = Trees().fit(x[fold != k], y[fold != k], w[fold != k]).raw(x[fold == k])
    return Trees().fit(x, y, w).calibrate(held, y, w)


def toxicity_scores(
    documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_labels: int = 20_000, max_words: int = 50_000, flag_from: float = 0.5, folds: int = 4, keep: tuple[str, ...] = ()
) -> DataFrame:
    """``(doc, score, flagged, *keep)`` for every document with an identifier.

    The classifier is fitted on the labelled documents, ``max_labels`` of them at
    most (those with the smallest hashes of the identifier), and on the ``max_words`` words that
    divide these best.  Labels of one document are averaged; null labels and
    documents whose labels contradict each other in equal parts aren't used.  Null and empty texts
    score as texts without words.  Without any positive or without any negative label there is
    nothing to fit and every score is null, ``flagged`` false.  Columns of ``keep`` come along unchanged.
    """
    spark = documents.sparkSession
    kept = [documents[c].alias(f"_{c}") for c in keep]
    docs = documents.select(documents[key].cast("bigint").alias("doc"), F.coalesce(documents[text], F.lit("")).alias("text"), *kept).filter("doc is not null")
    named = [F.col(f"_{c}").alias(c) for c in keep]
    voted = labels.select(labels[key].cast("bigint").alias("doc"), labels[label].cast("double").alias("y")).filter("doc is not null and y is not null")
    voted = voted.groupBy("doc").agg(F.avg("y").alias("y"), F.count("*").alias("n")).filter("y <> 0.5").orderBy(F.xxhash64("doc"), "doc").limit(max_labels)
    voted = voted.select("doc", (F.col("y") > 0.5).cast("double").alias("y"), (F.abs(F.col("y") - 0.5) * 2 * F.sqrt("n")).alias("w"), F.pmod(F.xxhash64("doc", F.lit(3)), F.lit(folds)).cast("int").alias("fold"))
    # at most max_labels rows, so the texts stay where they are
    labelled = stage(docs.select("doc", "text").join(F.broadcast(voted), "doc"))
    sizes = {(int(r["y"]), r["fold"]): r["n"] for r in labelled.groupBy("y", "fold").agg(F.count("*").alias("n")).collect()}
    if {y for y, _ in sizes} != {0, 1}:
        return docs.select("doc", F.lit(None).cast("double").alias("score"), F.lit(False).alias("flagged"), *named)
    per = [F.count_if((F.col("y") == y) & (F.col("fold") == k)).alias(f"n{y}{k}") for y in (0, 1) for k in range(folds)]
    words = labelled.select("text", "y", "fold").mapInArrow(_seen, "hash bigint, y double, fold int").groupBy("hash").agg(*per, F.count("*").alias("n"), F.sum("y").alias("p"))
    share = sum(v for (y, _), v in sizes.items() if y) / sum(sizes.values())
    rows = words.filter("n >= 3").orderBy(F.desc(F.abs(F.col("p") - F.col("n") * share) / F.sqrt("n")), "hash").limit(max_words).collect()
    counts = np.array([[r[f"n{y}{k}"] for y in (0, 1) for k in range(folds)] for r in rows], float).reshape(len(rows), 2, folds)
    hashes = np.array([r["hash"] for r in rows], np.int64).view(U)
    n = np.array([[sizes.get((y, k), 0) for k in range(folds)] for y in (0, 1)], float)

    def lexicon(without: int | None) -> Lexicon:
        use = [k for k in range(folds) if k != without]
        odds = _odds(counts[:, 1, use].sum(1), counts[:, 0, use].sum(1), tuple(n[:, use].sum(1)))
        return Lexicon({h: w for h, w in zip(hashes.tolist(), odds.tolist()) if w})

    others = spark.sparkContext.broadcast([lexicon(k) for k in range(folds)])
    x = labelled.select("doc", "text", "fold").mapInArrow(_featured(others), "doc bigint, x array<double>").join(F.broadcast(voted), "doc").orderBy("doc").select("x", "y", "w", "fold").toPandas()
    model = train(np.stack(x["x"]), x["y"].to_numpy(), x["w"].to_numpy(), x["fold"].to_numpy())
    held = spark.sparkContext.broadcast((model, lexicon(None)))  # max_words words and a few hundred numbers per tree

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, lexicon = held.value
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                n = len(texts)
                values = model.predict(features(texts, lexicon))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(values, pa.float64()), *(c.slice(first, n) for c in batch.columns[2:])], ["doc", "score", *(f"_{c}" for c in keep)])

    kinds = "".join(f", `_{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)
    return docs.mapInArrow(score, f"doc bigint, score double{kinds}").select("doc", "score", (F.col("score") >= flag_from).alias("flagged"), *named)


def source_rates(scores: DataFrame, source: str = "source") -> DataFrame:
    """``(source, documents, flagged, rate, mean_score)`` of scores with their source; sources compared without case and outer blanks, null for none."""
    named = scores.select(F.nullif(F.lower(F.btrim(scores[source], F.lit(" \t\r\n"))), F.lit("")).alias("source"), "score", "flagged")
    flagged = F.count_if("flagged")
    return named.groupBy("source").agg(F.count("*").alias("documents"), flagged.alias("flagged"), (flagged / F.count("*")).alias("rate"), F.avg("score").alias("mean_score"))
