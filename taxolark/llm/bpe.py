"""BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array. In a round, each word's neighbouring
pairs are looked up by binary search among the sorted pair keys of the merges, and
every word merges all places of its lowest-ranked pair at once; words without a pair
left are done. Chunks between white space that a worker has met are kept, within a
bound, so a round only sees new ones.

A long word would take a round for each rank it holds, all over its length. Long
words are merged by rounds of one rank over all of them instead: the places of each
rank are held ready, a round takes those of the lowest, and looks up only the pairs
that it makes. The lowest rank of all words is the lowest of every word that holds
it, so this merges as before, with work in proportion to the merges.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxolark.llm.tables import pick, slices

#: Fixed value: white space as Unicode defines it.
SPACE = "\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def category(first: str) -> str:
    """A character class of all code points of a general category, by Python's own tables."""
    points = [c for c in range(0x110000) if unicodedata.category(chr(c))[0] == first]
    cuts = [i for i in range(1, len(points)) if points[i] != points[i - 1] + 1]
    spans = zip([points[0], *(points[i] for i in cuts)], [*(points[i - 1] for i in cuts), points[-1]], strict=True)
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)


#: Letters, numbers and lower case of Unicode 16 and 17 that Python's tables lack and the tokenizer's have.
NEW_LETTERS = "\\u1c89\\u1c8a\\ua7cb-\\ua7cd\\ua7d2\\ua7d4\\ua7da-\\ua7dc\\U000105c0-\\U000105f3\\U00010d4a-\\U00010d65\\U00010d6f-\\U00010d85\\U00010ec2-\\U00010ec4\\U00011380-\\U00011389\\U0001138b\\U0001138e\\U00011390-\\U000113b5\\U000113b7\\U000113d1\\U000113d3\\U00011bc0-\\U00011be0\\U00013460-\\U000143fa\\U00016100-\\U0001611d\\U00016d40-\\U00016d6c\\U00018cff\\U0001e5d0-\\U0001e5ed\\U0001e5f0"
NEW_NUMBERS = "\\U00010d40-\\U00010d49\\U000116d0-\\U000116e3\\U00011bf0-\\U00011bf9\\U00016130-\\U00016139\\U00016d70-\\U00016d79\\U0001ccf0-\\U0001ccf9\\U0001e5f1-\\U0001e5fa"
NEW_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
NEW_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
_CASED = re.compile("[" + "".join(map(chr, NEW_LOWER)) + "]")

_LETTER, _NUMBER = category("L") + NEW_LETTERS, category("N") + NEW_NUMBERS
#: The alternatives that split a chunk into words.
SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{SPACE}{_LETTER}{_NUMBER}]+")
#: str.split() also splits at these, which are no Unicode white space.
SEPARATORS = re.compile("[\x1c-\x1f]")
NOT_SPACE = re.compile(f"[^{SPACE}]+")
WORD_END = "</w>"
#: Chunks that a worker keeps, and characters of the longest kept; symbols from which a word is long.
KEPT, KEPT_CHARS, LONG = 150_000, 64, 256


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else one from code point 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


def merge_all(symbols: np.ndarray, words: np.ndarray, keys: np.ndarray, ranks: np.ndarray, made: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Merges to the end: symbols of all words, each word's in a row, and the word of each symbol, sorted."""
    done_s, done_w = [], []
    while len(symbols):
        pair = symbols[:-1] * base + symbols[1:]
        at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        rank = np.where((keys[at] == pair) & (words[:-1] == words[1:]), ranks[at], len(ranks))
        rank = np.append(rank, len(ranks))
        starts = np.flatnonzero(np.diff(words, prepend=words[0] - 1))
        sizes = np.diff(starts, append=len(words))
        lowest = np.repeat(np.minimum.reduceat(rank, starts), sizes)
        ended = lowest == len(ranks)
        if ended.any():
            done_s.append(symbols[ended])
            done_w.append(words[ended])
        hit = (rank == lowest) & ~ended
        index = np.arange(len(hit))
        run = np.maximum.accumulate(np.where(hit, -1, index))  # in a run of hits, such as aaaa, every other one merges
        hit &= (index - run) % 2 == 1
        symbols = np.where(hit, made[np.minimum(rank, len(ranks) - 1)], symbols)
        stays = ~ended
        stays[1:] &= ~hit[:-1]
        symbols, words = symbols[stays], words[stays]
    if not done_s:
        return symbols, words
    symbols, words = np.concatenate(done_s), np.concatenate(done_w)
    order = np.argsort(words, kind="stable")
    return symbols[order], words[order]


def merge_long(symbols: np.ndarray, words: np.ndarray, keys: np.ndarray, ranks: np.ndarray, made: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The same as ``merge_all``, by rounds of one rank over linked places: for long words."""
    n, none = len(symbols), len(ranks)
    symbol, word = symbols.copy(), np.append(words, -1)
    after, prior = np.arange(1, n + 1), np.arange(-1, n - 1)
    rank = np.full(n + 1, none)
    ready: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def look_up(at: np.ndarray) -> None:
        """The ranks of the pairs that begin at the places, which are made ready."""
        follows = after[at]
        at, follows = at[inside := follows < n], follows[inside]
        pair = symbol[at] * base + symbol[follows]
        place = np.minimum(np.searchsorted(keys, pair), none - 1)
        rank[at] = np.where((keys[place] == pair) & (word[at] == word[follows]), ranks[place], none)
        at = at[rank[at] < none]
        at = at[np.argsort(rank[at], kind="stable")]
        own = rank[at]
        cuts = np.flatnonzero(np.diff(own, prepend=-1))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)], strict=True) if len(at) else ():
            r = int(own[a])
            if r not in ready:
                ready[r] = []
                heapq.heappush(heap, r)
            ready[r].append(at[a:b])

    look_up(np.arange(n))
    while heap:
        r = heapq.heappop(heap)
        at = np.unique(np.concatenate(ready.pop(r)))
        at = at[rank[at] == r]  # others have been merged away or changed
        follow = np.zeros(len(at), dtype=bool)
        follow[1:] = (after[at[:-1]] == at[1:]) & (word[at[:-1]] == word[at[1:]])
        index = np.arange(len(at))  # in a run, such as aaaa, every other one merges
        at = at[(index - np.maximum.accumulate(np.where(follow, 0, index))) % 2 == 0]
        right = after[at]
        symbol[at] = made[r]
        rank[right] = none
        after[at] = after[right]
        inner = after[at] < n
        prior[after[at][inner]] = at[inner]
        symbol[right] = -1
        before = prior[at]
        look_up(np.unique(np.concatenate([at, before[before >= 0]])))
        rank[at[~inner]] = none
    left = symbol >= 0
    return symbol[left], words[left]


class Tokenizer:
    """A word-level BPE vocabulary file: NFC, lower case, byte letters, end-of-word symbols, special tokens kept."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.base = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * self.base
        for token, i in (vocab | self.special).items():
            self.tokens[i] = token
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], dtype=np.int64)
        self.final = np.array([vocab[x + WORD_END] for x in letters], dtype=np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        pairs = np.array([vocab[a] * self.base + vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(pairs)
        self.keys, self.ranks = pairs[order], order
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.forget()

    def forget(self) -> None:
        """Of the chunks that are kept: number by chunk; start and length of their ids; the ids."""
        self.known: dict[str, int] = {}
        self.flat = np.array(list(self.special.values()), dtype=np.int32)
        self.starts, self.sizes = np.arange(len(self.flat)), np.ones(len(self.flat), dtype=np.int64)
        self.known |= {f" {token}": n for n, token in enumerate(self.special)}

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of each word."""
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.final[data[ends]]
        words = np.repeat(np.arange(len(raw)), sizes)
        if sizes.max(initial=0) < LONG:
            ids, of = merge_all(symbols, words, self.keys, self.ranks, self.made, self.base)
        else:
            long = np.repeat(sizes >= LONG, sizes)
            parts = [f(symbols[own], words[own], self.keys, self.ranks, self.made, self.base) for f, own in ((merge_all, ~long), (merge_long, long))]
            ids, of = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(of, kind="stable")
            ids, of = ids[order], of[order]
        return ids.astype(np.int32), np.bincount(of, minlength=len(raw))

    def _learn(self, chunks: list[str]) -> None:
        words: list[str] = []
        counts = []
        for c in chunks:
            own = SPLIT.findall(c)
            words += own
            counts.append(len(own))
        ids, sizes = self.encode_words(words) if words else (np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        cut = np.concatenate([[0], np.cumsum(np.array(counts, dtype=np.int64))])
        per_chunk = np.diff(ends[cut])
        first = len(self.flat)
        self.starts = np.concatenate([self.starts, first + ends[cut[:-1]]])
        self.sizes = np.concatenate([self.sizes, per_chunk])
        self.flat = np.concatenate([self.flat, ids])
        for c in chunks:
            self.known[c] = len(self.known)

    def _chunks(self, text: str) -> list[str]:
        """Normalised text between white space; no word of SPLIT crosses white space."""
        text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ").lower()  # letter by letter, so no final sigma
        if not text.isascii() and _CASED.search(text):
            text = text.translate(NEW_LOWER)
        return NOT_SPACE.findall(text) if SEPARATORS.search(text) else text.split()

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of each text; a null text has none. Equal texts are encoded once."""
        distinct = {t: n for n, t in enumerate(dict.fromkeys(texts))}
        if len(distinct) == len(texts):
            return self._encode(texts)
        ids, sizes = self._encode(list(distinct))
        own = np.fromiter((distinct[t] for t in texts), dtype=np.int64, count=len(texts))
        starts, sizes = (np.cumsum(sizes) - sizes)[own], sizes[own]
        ends = np.cumsum(sizes)
        return ids[np.repeat(starts - (ends - sizes), sizes) + np.arange(sizes.sum())], sizes

    def _encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        parts: list[list[str]] = []
        for text in texts:
            text = text or ""
            if self.marks is not None and "<|" in text:
                own = []
                for piece in self.marks.split(text):
                    own += [f" {piece}"] if piece in self.special else self._chunks(piece)  # no chunk holds a space
                parts.append(own)
            else:
                parts.append(self._chunks(text))
        if len(self.known) > KEPT:
            self.forget()
        fresh = dict.fromkeys(c for own in parts for c in own if c not in self.known)
        plain = [c for c in fresh if c[0] != " "]
        before = len(self.known), len(self.flat)
        self._learn(plain)
        counts = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        number = np.fromiter((self.known[c] for own in parts for c in own), dtype=np.int64, count=int(counts.sum()))
        sizes = self.sizes[number]
        ends = np.cumsum(sizes)
        take = np.repeat(self.starts[number] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        ids = self.flat[take]
        upto = np.concatenate([[0], ends])
        per_text = np.diff(upto[np.concatenate([[0], np.cumsum(counts)])])
        if any(len(c) > KEPT_CHARS for c in plain):  # long chunks hardly come again
            self._drop_after(*before, [c for c in plain if len(c) <= KEPT_CHARS])
        return ids, per_text

    def _drop_after(self, chunks: int, ids: int, keep: list[str]) -> None:
        kept = [self.known[c] for c in keep]
        pieces = [self.flat[self.starts[k] : self.starts[k] + self.sizes[k]] for k in kept]
        self.known = {c: n for c, n in self.known.items() if n < chunks}
        sizes = self.sizes[kept]
        self.starts = np.concatenate([self.starts[:chunks], ids + np.cumsum(sizes) - sizes]).astype(np.int64)
        self.sizes = np.concatenate([self.sizes[:chunks], sizes]).astype(np.int64)
        self.flat = np.concatenate([self.flat[:ids], *pieces])
        for c in keep:
            self.known[c] = len(self.known)

    def decode(self, ids: np.ndarray) -> str:
        """The tokens, special ones too, joined by spaces: the vocabulary names no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


_open: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """One for each worker process."""
    if path not in _open:
        _open[path] = Tokenizer(path)
    return _open[path]


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), decoded: bool = False) -> DataFrame:
    """The columns of ``keep`` and ``ids`` array<int> of documents (text); with ``decoded`` also the decoded text.

    ``path``: the vocabulary file, which each worker reads from its own installation.
    A null or empty text has no ids and decodes to an empty string. Rows are returned
    as often as they occur; other columns are ignored; no rows give no rows.
    """
    rows = pick(docs, *keep, "text")
    # the text again, in case it is kept as well
    rows = rows.toDF(*[f"k{i}" for i in range(len(keep))], "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for b in slices(batches):
            ids, sizes = own.encode_batch(b.column(len(keep)).to_pylist())
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            out = [*b.columns[: len(keep)], pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))]
            if decoded:
                out.append(pa.array([own.decode(ids[x:y]) for x, y in zip(ends[:-1], ends[1:], strict=True)], type=pa.string()))
            yield pa.RecordBatch.from_arrays(out, names=[f.name for f in schema.fields])

    fields = [T.StructField(f"k{i}", rows.schema[f"k{i}"].dataType) for i in range(len(keep))]
    schema = T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType())), *[T.StructField("decoded", T.StringType())] * decoded])
    return rows.mapInArrow(run, schema).toDF(*keep, "ids", *["decoded"] * decoded)


def decode(rows: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` and ``text`` of rows (ids array<int>); null ids decode to an empty string."""
    rows = pick(rows, *keep, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for b in slices(batches):
            texts = [own.decode(np.array(x or [], dtype=np.int64)) for x in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(texts, type=pa.string())], names=[*keep, "text"])

    schema = T.StructType([*[rows.schema[k] for k in keep], T.StructField("text", T.StringType())])
    return rows.mapInArrow(run, schema)


def digest(ids: str = "ids"):
    """Lowercase hex SHA-256 of the decimal ids joined by one space."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), " "), 256)
