"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel of two words sums, over the subsequences of three letters that they share,
a decay for every letter spanned, so an insult with inserted or missing letters stays
close to itself. Words begin with a mark, which counts as a letter. The kernel is
normed, so that a word has 1 with itself, and raised to a power, which is a kernel
again. The kernel of two texts is the sum over all pairs of their words, plus RATE
squared times the mean over all pairs: both are kernels, and so is their sum.

Landmarks are texts of one word: words and word beginnings whose presence tells
labelled toxic texts from others, and a few common ones. A text's kernels with the landmarks, whitened by the
landmarks' kernel matrix (Nystroem), are its features; a linear machine is trained on
them by subgradient steps, and a logistic curve fitted to its margins gives the score.

Kernels are exact for words of any length. A word is described by its subsequences
themselves, each with its summed decays: short ones by all choices of three places at
once, long ones letter by letter, in time in proportion to their length. The product
with the landmarks' subsequences is the kernel. Letters that no landmark has are told
apart by CLASSES classes only, in all words alike. A worker keeps what it has found for
a word, within a bound.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxolark.llm.tables import held, pick, slices

#: Letters of a subsequence, decay, power.
ORDER, DECAY, POWER = 3, 0.9, 8
#: Classes of letters that no landmark has; letters up to which all choices of three places are looked at together.
CLASSES, SHORT = 12, 20
#: More than the letters that a subsequence of a short word spans with its mark; a power of two.
SPANS = 32
#: Weight of the mean over words: insults count by number and by share.
RATE = 100.0
#: Landmarks that tell toxic texts, and of common words, at most; words that a worker keeps.
LANDMARKS, PLAIN, KEPT = 64, 8, 200_000
#: Normed kernel from which two landmarks are too much alike.
ALIKE = 0.9
#: How often each toxic text is learnt from with its insults spoiled.
SPOILED = 2
#: Labelled texts used to fit, and their bytes.
SAMPLE, SAMPLE_BYTES = 6000, 64 << 20

_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[\W_]+")
#: Three or more single letters in a row, apart by one mark or space each: a word spelled out.
_SPELLED = re.compile(r"(?<![^\W_])[^\W\d_](?:[\W_]{1,2}[^\W\d_]){2,}(?![^\W_])")


def words_of(text: str) -> list[str]:
    """The words of a text, lower case, without marks at their ends; spelled-out words joined."""
    text = text.lower()
    out = text.split()
    if _SPELLED.search(text):
        out += [_INNER.sub("", m) for m in _SPELLED.findall(text)]
    return out


def form(word: str) -> str:
    """What is compared of a word: without marks around and inside; empty if it has fewer than ORDER letters."""
    if not word.isalpha():
        word = _INNER.sub("", _EDGES.sub("", word))
    return word if len(word) >= ORDER else ""


def kernel(a: str, b: str) -> float:
    """Subsequence kernel of two words by its recursion, without the marks before them."""
    prefix = np.ones((len(a) + 1, len(b) + 1))
    for _ in range(ORDER - 1):
        each = np.zeros_like(prefix)
        for i in range(1, len(a) + 1):
            run = 0.0
            for j in range(1, len(b) + 1):
                run = DECAY * run + (DECAY**2 * prefix[i - 1, j - 1] if a[i - 1] == b[j - 1] else 0.0)
                each[i, j] = DECAY * each[i - 1, j] + run
        prefix = each
    return float(sum(DECAY**2 * prefix[i, j] for i in range(len(a)) for j in range(len(b)) if a[i] == b[j]))


@dataclass
class Model:
    landmarks: list[str]
    weight: np.ndarray  # of a text's description: the machine's weights times the whitening
    bias: float
    slope: float
    offset: float

    def score(self, described: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (described @ self.weight + self.bias) + self.offset, -30, 30)))


class Describer:
    """Texts by their kernels with the landmarks."""

    def __init__(self, landmarks: list[str]):
        self.landmarks, self.m = landmarks, len(landmarks)
        letters = sorted({c for w in landmarks for c in w})
        self.letters = 1 + len(letters) + CLASSES  # the mark is letter 0
        self.letter = (1 + len(letters) + np.arange(0x110000) % CLASSES).astype(np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        # of each subsequence that a landmark has its summed decays in all of them, normed; row 0 for the others
        found = [self._long(w) for w in landmarks]
        norm = np.sqrt([float((d**2).sum()) for d in found])
        self.row = np.zeros(self.letters**ORDER, dtype=np.int32)
        some = np.flatnonzero(sum((d > 0).astype(int) for d in found)) if found else np.zeros(0, dtype=int)
        self.row[some] = np.arange(1, len(some) + 1)
        self.decays = np.zeros((len(some) + 1, self.m), dtype=np.float32)
        for j, d in enumerate(found):
            self.decays[1:, j] = d[some] / norm[j]
        self.places: dict[int, tuple[np.ndarray, ...]] = {}
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.table, self.used = np.zeros((1024, self.m), dtype=np.float32), 1  # row 0: near no landmark

    def _long(self, word: str) -> np.ndarray:
        """The summed decays of all subsequences of three letters, letter by letter."""
        n = self.letters
        one, two, three = np.zeros(n), np.zeros((n, n)), np.zeros((n, n, n))
        for c in [0, *self.letter[[ord(c) for c in word]].tolist()]:
            # decays from the first letter of a subsequence to the place now
            one, two = one * DECAY, two * DECAY
            three[:, :, c] += two * DECAY
            two[:, c] += one
            one[c] += 1
        return three.ravel()

    def _short(self, words: list[str]) -> np.ndarray:
        """Normed kernels of words of one length with the landmarks."""
        n = len(words[0]) + 1
        if n not in self.places:
            at = np.array(list(combinations(range(n), ORDER)), dtype=np.int64).T
            self.places[n] = *at, (at[2] - at[0] + 1).astype(np.int32)
        x, y, z, span = self.places[n]
        decays = (DECAY ** np.arange(SPANS)).astype(np.float32)
        s = np.zeros((len(words), n), dtype=np.int32)
        s[:, 1:] = self.letter[np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")].reshape(len(words), n - 1)
        code = (s[:, x] * self.letters + s[:, y]) * self.letters + s[:, z]
        row = self.row[code]
        out = np.zeros((len(words), self.m), dtype=np.float32)
        hits = np.count_nonzero(row, axis=1)
        own = np.argsort(-hits, kind="stable")[: np.count_nonzero(hits)]  # words with most to add up first
        if not len(own):
            return out
        word, place = np.nonzero(row[own])
        hits = hits[own]
        nth = np.arange(len(word)) - np.repeat(np.cumsum(hits) - hits, hits)
        which, weight = np.zeros((int(hits[0]), len(own)), dtype=np.int32), np.zeros((int(hits[0]), len(own), 1), dtype=np.float32)
        which[nth, word] = row[own][word, place]
        weight[nth, word, 0] = decays[span[place]]
        near, part = np.zeros((len(own), self.m), dtype=np.float32), np.empty((len(own), self.m), dtype=np.float32)
        for k in range(int(hits[0])):  # the k-th hit of every word that has so many
            n_words = int(np.searchsorted(-hits, -k, side="left"))
            some = np.take(self.decays, which[k, :n_words], axis=0, out=part[:n_words], mode="clip")
            some *= weight[k, :n_words]
            near[:n_words] += some
        # a word's kernel with itself: its subsequences' summed decays, squared; spans are sorted along in the last digits
        keys = np.sort(code[own] * SPANS + span, axis=1)
        subsequence = keys // SPANS
        new = np.ones(keys.shape, dtype=bool)
        new[:, 1:] = subsequence[:, 1:] != subsequence[:, :-1]
        squares = np.add.reduceat(decays[keys % SPANS].ravel(), np.flatnonzero(new)) ** 2
        counts = new.sum(axis=1)
        out[own] = near / np.sqrt(np.add.reduceat(squares, np.cumsum(counts) - counts))[:, None]
        return out

    def similar(self, words: list[str]) -> np.ndarray:
        """Normed kernels of words (in the form that is compared) with landmarks, raised to the power."""
        out = np.zeros((len(words), self.m), dtype=np.float32)
        if not words or not self.m:
            return out
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        for n in np.unique(sizes).tolist():
            same = np.flatnonzero(sizes == n)
            if n <= SHORT:
                step = max(1, min(1024, 2_000_000 // n**ORDER))
                for lo in range(0, len(same), step):
                    rows = same[lo : lo + step]
                    out[rows] = self._short([words[i] for i in rows])
                continue
            for i in same:
                found = self._long(words[i])
                met = np.flatnonzero(self.row)
                out[i] = found[met].astype(np.float32) @ self.decays[self.row[met]] / np.sqrt((found**2).sum())
        return np.minimum(out, 1) ** POWER

    def _learn(self, fresh: list[str]) -> None:
        compared = [form(w) for w in fresh]
        distinct = [w for w in dict.fromkeys(compared) if w]
        rows = self.similar(distinct)
        number = {"": 0} | dict(zip(distinct, range(self.used, self.used + len(distinct)), strict=True))
        if self.used + len(rows) > len(self.table):  # room for twice as many, so that rows are seldom moved
            more = np.zeros((2 * (self.used + len(rows)), self.m), dtype=np.float32)
            more[: self.used] = self.table[: self.used]
            self.table = more
        self.table[self.used : self.used + len(rows)] = rows
        self.used += len(rows)
        self.known |= zip(fresh, map(number.__getitem__, compared), strict=True)

    def describe(self, texts: list[str | None]) -> np.ndarray:
        """The kernels of texts with the landmarks: sums over words, and RATE times means over words."""
        if len(self.known) > KEPT:
            self.forget()
        parts = [words_of(t or "") for t in texts]
        self._learn(sorted(set().union(*parts).difference(self.known)))
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        number = np.fromiter(map(self.known.__getitem__, chain.from_iterable(parts)), dtype=np.int64, count=int(sizes.sum()))
        total = np.zeros((len(texts), self.m))
        some = np.flatnonzero(sizes)
        if len(some):
            starts = (np.cumsum(sizes) - sizes)[some]
            total[some] = np.add.reduceat(self.table[number], starts, axis=0)
        return np.concatenate([total, RATE * total / np.maximum(1, sizes)[:, None]], axis=1)


def is_held_out(doc_id: int | str) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def different(texts: list[str], labels: list[int]) -> list[int]:
    """Positions of the texts to fit on: of texts whose three smallest hashes of word triples agree (copies, mostly) the first."""
    seen = {}
    for i, text in enumerate(texts):
        own = words_of(text)
        triples = {" ".join(own[k : k + 3]) for k in range(max(1, len(own) - 2))}
        seen.setdefault((labels[i], *sorted({zlib.crc32(t.encode()) for t in triples})[:3]), i)
    return list(seen.values())


def choose_landmarks(texts: list[str], toxic: np.ndarray, most: int = LANDMARKS, plain: int = PLAIN) -> list[str]:
    """Words and word beginnings whose presence tells toxic texts from others, by likelihood gain (G statistic), and the commonest of the others.

    Of equal gains the longer comes first, then the first by code point. A beginning of
    a landmark, or a word that begins with one, isn't taken as well if it stands in about
    as many texts, and neither is what is ALIKE one by their kernel.
    The ``plain`` common words of clean texts show the machine what kernels mean nothing.
    """
    bad, clean = Counter(), Counter()
    for text, y in zip(texts, toxic.tolist(), strict=True):
        (bad if y else clean).update({f[:k] for w in set(words_of(text)) for f in (form(w),) for k in range(4, min(len(f), 12) + 1)})
    positive, n = int(toxic.sum()), len(texts)
    rate = positive / max(1, n)
    ranked = []
    for c, b in bad.items():
        all_, p = b + clean[c], b / (b + clean[c])
        if b >= max(3, 0.02 * positive) and p > 1.5 * rate:
            gain = b * np.log(p / rate) + ((all_ - b) * np.log((1 - p) / (1 - rate)) if all_ > b else 0)
            if gain < np.log(len(bad)) + 2:  # as good as the best of so many by chance
                continue
            ranked.append((-round(float(gain), 6), -len(c), c))
    count = bad + clean

    def same(c: str, x: str) -> bool:
        """Whether one begins with the other and both stand in about as many texts."""
        return (c.startswith(x) or x.startswith(c)) and 2 * count[c] < 3 * count[x] and 2 * count[x] < 3 * count[c]

    out: list[str] = []
    common = sorted(((-m, c) for c, m in clean.items() if bad[c] * n <= 1.2 * positive * (m + bad[c])))
    for words, bound in (([c for *_, c in sorted(ranked)], most), ([c for _, c in common[: 20 * plain]], plain)):
        start = len(out)
        for c in words:
            if len(out) - start == bound:
                break
            if not any(same(c, x) or _normed(c, x) > ALIKE for x in out):
                out.append(c)
        if not out:  # nothing tells toxic texts
            break
    return out


def _normed(a: str, b: str) -> float:
    a, b = f"^{a}", f"^{b}"
    return kernel(a, b) / np.sqrt(kernel(a, a) * kernel(b, b))


def _spoiled(word: str, rng: np.random.Generator) -> str:
    """The word with a letter put in, or one left out, somewhere inside."""
    at = int(rng.integers(1, len(word)))
    return word[:at] + str(rng.choice(list("xhzeqo"))) + word[at:] if rng.random() < 0.75 else word[:at] + word[at + 1 :]


def train(texts: list[str], labels: list[int], seed: int = 11, epochs: int = 400) -> Model:
    """Fits landmarks, machine and curve. Toxic texts count SPOILED times more with a letter put in or left out in each of their landmark words."""
    apart = different(texts, labels)
    texts, labels = [texts[i] for i in apart], [labels[i] for i in apart]
    y = np.array(labels, dtype=np.int64)
    landmarks = choose_landmarks(texts, y) if len(texts) else []
    if not landmarks or y.all() or not y.any():
        rate = (y.sum() + 0.5) / (len(y) + 1)
        return Model([], np.zeros(0), 0.0, 1.0, float(np.log(rate / (1 - rate))))
    describer = Describer(landmarks)
    x = np.concatenate([describer.describe(texts[i : i + 256]) for i in range(0, len(texts), 256)])
    rng = np.random.default_rng(seed)
    stems = tuple(landmarks)
    spoiled = []
    for text in (t for t, label in zip(texts, labels, strict=True) if label for _ in range(SPOILED)):
        own = words_of(text)
        changed = [_spoiled(w, rng) if w.startswith(stems) else w for w in own]
        if changed != own:
            spoiled.append(" ".join(changed))
    more = np.concatenate([describer.describe(spoiled[i : i + 256]) for i in range(0, len(spoiled), 256)]) if spoiled else x[:0]
    x, y = np.concatenate([x, more]), np.concatenate([y, np.ones(len(more), dtype=np.int64)])
    gram = describer.similar(landmarks).astype(np.float64)
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    keep = value > 1e-2 * value.max()
    root = (vector[:, keep] / np.sqrt(value[keep])) @ vector[:, keep].T
    whiten = np.block([[root, np.zeros_like(root)], [np.zeros_like(root), root]])
    z = x @ whiten
    sign = np.where(y == 1, 1.0, -1.0)
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    share = (share + 1 / len(y)) / 2  # between equal classes and equal rows
    w, b, mean_w, mean_b = np.zeros(z.shape[1]), 0.0, np.zeros(z.shape[1]), 0.0
    penalty = 1e-4
    for step in range(1, epochs + 1):
        short = sign * (z @ w + b) < 1
        pull = share[short] * sign[short]
        rate = 4.0 / np.sqrt(step)
        w -= rate * (penalty * w - pull @ z[short])
        b += rate * pull.sum()
        if step > epochs // 2:
            mean_w += w
            mean_b += b
    w, b = mean_w / (epochs - epochs // 2), mean_b / (epochs - epochs // 2)
    margin = z @ w + b
    slope, offset = 1.0, 0.0
    target = np.where(y == 1, ((y == 1).sum() + 1) / ((y == 1).sum() + 2), 1 / ((y == 0).sum() + 2))
    for _ in range(100):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(slope * margin + offset, -30, 30)))
        g = np.array([((p - target) * margin).sum(), (p - target).sum()])
        v = p * (1 - p)
        h = np.array([[(v * margin**2).sum(), (v * margin).sum()], [(v * margin).sum(), v.sum()]]) + 1e-6 * np.eye(2)
        move = np.clip(np.linalg.solve(h, g), -1, 1)
        slope, offset = slope - move[0], offset - move[1]
    return Model(landmarks, whiten @ w, float(b), float(slope), float(offset))


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Model:
    """A model of labelled texts, none with a held-out doc_id.

    At most ``bound`` texts are used, chosen by a hash of the doc_id, and of these the
    first whose sizes add up to ``most_bytes`` at most, so that the driver can hold them.
    Rows without doc_id or label are not used; a null text counts as empty.
    """
    known = pick(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null and crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
    chosen = known.select("doc_id", "toxic", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id", "toxic").limit(bound)
    texts = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = texts.select("doc_id", "text", F.xxhash64("text").alias("th")).join(F.broadcast(chosen), "doc_id")
    sized = keyed.groupBy("h", "doc_id", "toxic", "th").agg(F.max(F.octet_length("text")).alias("size")).orderBy("h", "doc_id", "toxic", "th").limit(bound).toPandas()
    taken = sized[sized["size"].cumsum() <= most_bytes]
    if not len(taken):
        return train([], [])
    wanted = docs.sparkSession.createDataFrame(taken[["doc_id", "toxic", "th", "h"]], keyed.select("doc_id", "toxic", "th", "h").schema)
    rows = texts.withColumn("th", F.xxhash64("text")).join(F.broadcast(wanted), ["doc_id", "th"]).groupBy("h", "doc_id", "toxic", "th").agg(F.first("text").alias("text"))
    got = rows.orderBy("h", "doc_id", "toxic", "th").select("text", "toxic").toArrow()
    return train(got["text"].to_pylist(), got["toxic"].to_pylist())


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` and ``score`` (0 to 1) of documents (text).

    A null or empty text is scored as one without words. Rows are returned as often
    as they occur; other columns are ignored; no rows give no rows.
    """
    rows = pick(docs, *keep, "text").toDF(*[f"k{i}" for i in range(len(keep))], "text")
    n, key = len(keep), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        describer = held(key, lambda: Describer(model.landmarks))
        for b in slices(batches):
            scores = model.score(describer.describe(b.column(n).to_pylist()))
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(scores, type=pa.float64())], names=[f.name for f in schema.fields])

    fields = [T.StructField(f"k{i}", rows.schema[f"k{i}"].dataType) for i in range(n)]
    schema = T.StructType([*fields, T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema).toDF(*keep, "score")
