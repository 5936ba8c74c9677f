"""SentencePiece encoding and decoding, with the place of every piece in the original text.

A text is normalised from its start by the longest prefix that the model's compiled
character map holds, or by one character where it holds none, and every normalised
character keeps the byte of the text that it comes from. The characters are cut where
no piece of the vocabulary holds both neighbours, so that no merge crosses a cut;
chunks that a worker has met are kept, within a bound. Of new chunks each round merges
the best pair of every chunk, of equals the leftmost, as the model's rule says. Long
chunks go through a heap, in proportion to their length. The pieces' lengths, summed
up, are places in the normalised text, and these map back to bytes of the original.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from taxolark.llm.tables import pick, slices

#: The mark that stands for a space in pieces.
SPACE = "▁"
#: Fixed values of the model's format: kinds of pieces, and the model type of BPE.
NORMAL, UNKNOWN, CONTROL, BYTE, BPE = 1, 2, 3, 6, 2
#: Chunks that a worker keeps, characters of the longest kept, and of the longest that is merged in rounds.
KEPT, KEPT_CHARS, LONG = 200_000, 64, 48
POINTS = 0x110000


def wire(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field, value) of a message in protocol buffers' wire format."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(tag & 7) or number()
        yield tag >> 3, data[at : at + size]
        at += size


def width(points: np.ndarray) -> np.ndarray:
    """UTF-8 bytes of code points."""
    return 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)


class CharMap:
    """A compiled character map: a double-array trie over bytes, whose leaves are places among the replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], dtype="<u4").tolist()
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest prefix of ``data[at:]`` that the map holds, and the prefix's length."""
        if not self.units:
            return None
        best = None
        node = self._child(self.units[0])
        for n in range(at, len(data)):
            node ^= data[n]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[n]:  # the unit's label
                break
            node ^= self._child(unit)
            if unit >> 8 & 1:
                best = self.units[node] & 0x7FFFFFFF, n + 1 - at
        if best is None:
            return None
        return self.texts[best[0] : self.texts.index(b"\0", best[0])], best[1]

    @staticmethod
    def _child(unit: int) -> int:
        return unit >> 10 << ((unit & 0x200) >> 6)


class Normalizer:
    """What the model's normalizer specification says, with the source of every character."""

    def __init__(self, spec: bytes):
        found = dict(wire(spec))
        self.map = CharMap(found.get(2, b""))
        self.dummy, self.squeeze, self.escape = (bool(found.get(n, 1)) for n in (3, 4, 5))
        self.space = SPACE if self.escape else " "

    @property
    def plain(self) -> bool:
        """Every character stands for itself, spaces but for their mark."""
        return not self.map.units and not self.squeeze and self.escape

    def __call__(self, text: str) -> tuple[str, list[int]]:
        """The normalised text; the byte of the text that each of its characters comes from, and the last byte's end."""
        data, out, source = text.encode(), [], []
        at, spaced = 0, self.squeeze
        parts = []
        while at < len(data):
            found = self.map.longest(data, at)
            if found is None:
                size = 1 + (data[at] >= 0xC0) + (data[at] >= 0xE0) + (data[at] >= 0xF0)
                found = data[at : at + size], size
            parts.append((found[0].decode(), at, at + found[1]))
            at += found[1]
        first = 0
        while self.squeeze and first < len(parts) and parts[first][0] == " ":
            first += 1
        if first == len(parts):
            return "", [0]
        if self.dummy:
            out.append(self.space)
            source.append(parts[first][1])
        for part, start, _ in parts[first:]:
            if spaced:
                part = part.lstrip(" ")
            if part:
                out += part.replace(" ", self.space)
                source += [start] * len(part)
                spaced = self.squeeze and part.endswith(" ")
        end = at
        while self.squeeze and out and out[-1] == self.space:
            out.pop()
            end = source.pop()
        return "".join(out), [*source, end]


def merge_rounds(symbols: np.ndarray, words: np.ndarray, table: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Merges of many words to their end: a round takes each word's best pair, of equals the leftmost.

    ``words`` tells the word of each symbol and is sorted.
    """
    place, rank = table.look_up(symbols[:-1], symbols[1:], words[:-1] == words[1:])
    place, rank = np.append(place, 0), np.append(rank, table.none)
    done = []
    while len(symbols):
        starts = np.flatnonzero(np.diff(words, prepend=-1))
        lowest = np.minimum.reduceat(rank, starts)
        sizes = np.diff(starts, append=len(words))
        going = np.repeat(lowest < table.none, sizes)
        if not going.all():
            done.append((symbols[~going], words[~going]))
            symbols, words, place, rank = symbols[going], words[going], place[going], rank[going]
            sizes, lowest = sizes[lowest < table.none], lowest[lowest < table.none]
            if not len(symbols):
                break
        hits = np.flatnonzero(rank == np.repeat(lowest, sizes))
        at = hits[np.diff(words[hits], prepend=-1) != 0]
        symbols[at] = table.made[place[at]]
        stays = np.ones(len(symbols), dtype=bool)
        stays[at + 1] = False
        symbols, words, place, rank = symbols[stays], words[stays], place[stays], rank[stays]
        at -= np.arange(len(at))
        for left in (at, at[at > 0] - 1):
            inner = left + 1 < len(symbols)
            right = np.where(inner, left + 1, left)
            place[left], rank[left] = table.look_up(symbols[left], symbols[right], inner & (words[left] == words[right]))
    if not done:
        return symbols, words
    symbols, words = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(words, kind="stable")
    return symbols[order], words[order]


def merge_heap(symbols: list[int], table: Merges) -> list[int]:
    """The same of one long word."""
    n = len(symbols)
    symbols, after, prior = list(symbols), [*range(1, n), -1], list(range(-1, n - 1))
    alive = [True] * n
    found, ranks = table.look_up(np.array(symbols[:-1]), np.array(symbols[1:]), np.ones(n - 1, dtype=bool))
    heap = [(r, i, symbols[i], symbols[i + 1], p) for i, (p, r) in enumerate(zip(found.tolist(), ranks.tolist(), strict=True)) if r < table.none]
    heapq.heapify(heap)
    while heap:
        _, left, a, b, p = heapq.heappop(heap)
        right = after[left]
        if not alive[left] or right < 0 or symbols[left] != a or symbols[right] != b:
            continue
        symbols[left] = int(table.made[p])
        alive[right] = False
        after[left] = after[right]
        if after[left] >= 0:
            prior[after[left]] = left
        for x in (prior[left], left):
            if x >= 0 and (y := after[x]) >= 0 and (more := table.one(symbols[x], symbols[y])) is not None:
                heapq.heappush(heap, (more[1], x, symbols[x], symbols[y], more[0]))
    return [s for s, lives in zip(symbols, alive, strict=True) if lives]


class Merges:
    """Pairs of symbols that make a piece: sorted keys, ranks by score (equal scores share one), the pieces made."""

    def __init__(self, pairs: list[tuple[int, int, int]], scores: np.ndarray, base: int):
        self.base = base
        raw = np.array(pairs, dtype=np.int64).reshape(-1, 3)
        keys = raw[:, 0] * base + raw[:, 1]
        order = np.argsort(keys)
        self.keys, self.made = keys[order], raw[order, 2]
        self.none = len(scores)
        self.ranks = np.unique(-scores, return_inverse=True)[1][self.made].astype(np.int64)
        self.single = {int(k): n for n, k in enumerate(self.keys)}

    def look_up(self, left: np.ndarray, right: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs: the place of their key, and the rank, which is ``none`` where no piece is made or ``whole`` is false."""
        if not len(self.keys):
            return np.zeros(len(left), dtype=np.int64), np.full(len(left), self.none)
        key = left * self.base + right
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return place, np.where(whole & (self.keys[place] == key) & (right >= 0), self.ranks[place], self.none)

    def one(self, left: int, right: int) -> tuple[int, int] | None:
        place = self.single.get(left * self.base + right) if left >= 0 and right >= 0 else None
        return None if place is None else (place, int(self.ranks[place]))


class Pieces:
    """A SentencePiece model of type BPE with byte fallback; others are refused."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = list(wire(f.read()))
        trainer = next((dict(wire(v)) for n, v in model if n == 2), {})
        entries = [dict(wire(v)) for n, v in model if n == 1]
        self.names = [e[1].decode() for e in entries]
        self.kinds = np.array([e.get(3, NORMAL) for e in entries])
        if trainer.get(3) != BPE or not trainer.get(35) or trainer.get(24) or not set(self.kinds.tolist()) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only BPE models with byte fallback and without user-defined or unused pieces are supported")
        self.normalizer = Normalizer(next((v for n, v in model if n == 3), b""))
        self.begin, self.end = self.names.index("<s>"), self.names.index("</s>")
        scores = np.array([struct.unpack("<f", e[2])[0] if 2 in e else 0.0 for e in entries])
        ids = {p: i for i, p in enumerate(self.names) if self.kinds[i] == NORMAL}
        self.bytes_ids = np.zeros(256, dtype=np.int64)
        for i in np.flatnonzero(self.kinds == BYTE):
            self.bytes_ids[int(self.names[i][1:-1], 16)] = i
        chars = dict.fromkeys(c for p in ids for c in p)
        symbols = dict(ids)
        for c in chars:  # a character that only occurs within pieces
            symbols.setdefault(c, len(self.names) + len(symbols) - len(ids))
        self.pieces = len(self.names)
        base = self.pieces + len(symbols) - len(ids)
        pairs = [(symbols[p[:n]], symbols[p[n:]], i) for p, i in ids.items() for n in range(1, len(p)) if p[:n] in symbols and p[n:] in symbols]
        self.merges = Merges(pairs, scores, base)
        # code points that no symbol stands for are below zero
        self.symbol = -1 - np.arange(POINTS, dtype=np.int64)
        self.length = np.ones(base, dtype=np.int64)
        for text, s in symbols.items():
            self.length[s] = len(text)
            if len(text) == 1:
                self.symbol[ord(text)] = s
        self.virtual = {s: c for c, s in symbols.items() if s >= self.pieces}
        inner = sorted({c for p in ids if len(p) > 1 for c in p})
        self.kind = np.zeros(POINTS, dtype=np.int32)
        self.kind[[ord(c) for c in inner]] = np.arange(1, len(inner) + 1)
        self.joined = np.zeros((len(inner) + 1, len(inner) + 1), dtype=bool)
        for p in ids:
            k = self.kind[[ord(c) for c in p]]
            self.joined[k[:-1], k[1:]] = True
        self.said = [b"" if k in (CONTROL, UNKNOWN) else bytes([int(p[1:-1], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() for p, k in zip(self.names, self.kinds.tolist(), strict=True)]
        for i in np.flatnonzero(self.kinds == UNKNOWN):
            self.said[i] = trainer.get(44, b" \xe2\x81\x87 ")
        self.forget()

    def forget(self) -> None:
        """Of the chunks that are kept: number by chunk; start and length of their ids; the ids and their characters."""
        self.known: dict[str, int] = {}
        self.flat, self.chars = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)
        self.starts, self.sizes = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def _merged(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of chunks: all ids in a row, the characters that each covers, and the number of ids of each chunk."""
        points = np.frombuffer("".join(chunks).encode("utf-32-le"), dtype="<u4")
        sizes = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        symbols, words = self.symbol[points], np.repeat(np.arange(len(chunks)), sizes)
        long = np.flatnonzero(sizes > LONG)
        if not len(long):
            symbols, words = merge_rounds(symbols, words, self.merges)
        else:
            short = np.repeat(sizes <= LONG, sizes)
            first = np.cumsum(sizes) - sizes
            parts = [merge_rounds(symbols[short], words[short], self.merges)]
            for w in long.tolist():
                own = np.array(merge_heap(symbols[first[w] : first[w] + sizes[w]].tolist(), self.merges), dtype=np.int64)
                parts.append((own, np.full(len(own), w)))
            symbols, words = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(words, kind="stable")
            symbols, words = symbols[order], words[order]
        for s in np.unique(symbols[symbols >= self.pieces]).tolist():
            symbols = np.where(symbols == s, -1 - ord(self.virtual[s]), symbols)
        odd = symbols < 0
        chars = self.length[np.where(odd, 0, symbols)]
        if odd.any():  # byte by byte; the last one covers the character
            points = -1 - symbols[odd]
            counts = np.ones(len(symbols), dtype=np.int64)
            counts[odd] = width(points)
            last = np.cumsum(counts) - 1
            spread = np.zeros(counts.sum(), dtype=np.int64)
            spread[last] = np.where(odd, 1, chars)
            ids, words, of = np.repeat(symbols, counts), np.repeat(words, counts), np.repeat(odd, counts)
            ids[of] = self.bytes_ids[np.frombuffer(points.astype("<u4").tobytes().decode("utf-32-le").encode(), dtype=np.uint8)]
            symbols, chars = ids, spread
        return symbols.astype(np.int32), chars.astype(np.int32), np.bincount(words, minlength=len(chunks))

    def _ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``_merged``, with what is known of chunks met before."""
        if len(self.known) > KEPT:
            self.forget()
        fresh = [c for c in dict.fromkeys(chunks) if c not in self.known]
        before, held = len(self.known), len(self.flat)
        if fresh:
            ids, chars, sizes = self._merged(fresh)
            self.flat, self.chars = np.concatenate([self.flat, ids]), np.concatenate([self.chars, chars])
            self.starts, self.sizes = np.concatenate([self.starts, held + np.cumsum(sizes) - sizes]), np.concatenate([self.sizes, sizes])
            self.known.update(zip(fresh, range(before, before + len(fresh)), strict=True))
        number = np.fromiter(map(self.known.__getitem__, chunks), dtype=np.int64, count=len(chunks))
        sizes = self.sizes[number]
        ends = np.cumsum(sizes)
        take = np.repeat(self.starts[number] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        out = self.flat[take], self.chars[take], sizes
        if any(len(c) > KEPT_CHARS for c in fresh):  # long chunks hardly come again, and make what is kept large
            for c in fresh:
                del self.known[c]
            self.flat, self.chars = self.flat[:held], self.chars[:held]
            self.starts, self.sizes = self.starts[:before], self.sizes[:before]
        return out

    def _normalised(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """All texts' normalised characters in a row, their number in each text; the byte that each comes from; each text's bytes.

        In a plain normalizer's row a space stands for its mark, and a dummy one for that of the beginning.
        """
        if not self.normalizer.plain:
            made = [self.normalizer(t) for t in texts]
            counts = np.array([len(n) for n, _ in made], dtype=np.int64)
            source = np.concatenate([np.array(s[:-1], dtype=np.int64) for _, s in made]) if made else np.zeros(0, dtype=np.int64)
            return "".join(n for n, _ in made), counts, source, np.array([s[-1] for _, s in made], dtype=np.int64)
        lead = " " if self.normalizer.dummy else ""
        row = "".join([lead + t if t else "" for t in texts])
        counts = np.fromiter((len(t) + len(lead) if t else 0 for t in texts), dtype=np.int64, count=len(texts))
        size = width(np.frombuffer(row.encode("utf-32-le"), dtype="<u4"))
        first = np.cumsum(counts) - counts
        if lead:
            size[first[counts > 0]] = 0
        upto = np.concatenate([[0], np.cumsum(size)])
        total = upto[first + counts] - upto[first]
        return row, counts, upto[:-1] - np.repeat(upto[first], counts), total

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids in a row, begin and end ids among them; the start and end byte of each in its text; the number of ids of each text."""
        row, counts, source, total = self._normalised([t or "" for t in texts])
        points = np.frombuffer(row.encode("utf-32-le"), dtype="<u4")
        if self.normalizer.plain:
            points = np.where(points == 32, ord(SPACE), points)
        kind = self.kind[points]
        cut = np.ones(len(points) + 1, dtype=bool)
        cut[1:-1] = ~self.joined[kind[:-1], kind[1:]]
        first = np.cumsum(counts) - counts
        cut[first] = True
        at = np.flatnonzero(cut)
        text = row.replace(" ", SPACE) if self.normalizer.plain else row
        bounds = at.tolist()
        ids, chars, sizes = self._ids([text[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
        # of each text: its chunks, then its ids
        upto = np.concatenate([[0], np.cumsum(sizes)])
        edge = upto[np.searchsorted(at, np.concatenate([first, [len(points)]]))]
        per_text = np.diff(edge)
        ends = np.cumsum(chars, dtype=np.int64)
        own = np.repeat(np.arange(len(texts)), per_text)
        byte = np.append(source, 0)
        last = (first + counts)[own] == ends
        start = np.where(ends - chars == (first + counts)[own], total[own], byte[ends - chars]) if len(own) else ends
        end = np.where(last, total[own], byte[ends]) if len(own) else ends
        out_ids, out_start, out_end = (np.zeros(len(ids) + 2 * len(texts), dtype=d) for d in (np.int32, np.int32, np.int32))
        place = np.arange(len(ids)) + 2 * own + 1
        out_ids[place], out_start[place], out_end[place] = ids, start, end
        sizes = per_text + 2
        after = np.cumsum(sizes)
        out_ids[after - sizes], out_ids[after - 1] = self.begin, self.end
        out_start[after - 1] = out_end[after - 1] = total
        return out_ids, out_start, out_end, sizes

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, marks as spaces but for that of the beginning; bytes that make no character become U+FFFD each."""
        said = list(map(self.said.__getitem__, ids))
        if self.normalizer.dummy or self.normalizer.squeeze:
            for n, i in enumerate(ids):
                if self.kinds[i] != CONTROL:
                    if self.kinds[i] == NORMAL and said[n][:1] == b" ":
                        said[n] = said[n][1:]
                        if self.normalizer.squeeze:
                            said[n] = said[n].lstrip(b" ")
                            if not said[n]:
                                continue
                    break
        try:
            return b"".join(said).decode()
        except UnicodeDecodeError:
            return self._mended(ids, said)

    def _mended(self, ids: list[int], said: list[bytes]) -> str:
        """Runs of bytes are read on their own, character by character."""
        out, run = [], b""
        for i, piece in [*zip(ids, said, strict=True), (-1, b"")]:
            if i >= 0 and self.kinds[i] == BYTE:
                run += piece
                continue
            while run:
                size = 1 + (run[0] >= 0xC0) + (run[0] >= 0xE0) + (run[0] >= 0xF0)
                try:
                    out.append(run[:size].decode())
                except UnicodeDecodeError:
                    out.append("�")
                    size = 1
                run = run[size:]
            out.append(piece.decode())
        return "".join(out)


_open: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One for each worker process."""
    if path not in _open:
        _open[path] = Pieces(path)
    return _open[path]


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), decoded: bool = False, packed: bool = False) -> DataFrame:
    """The columns of ``keep`` and the pieces of documents (text): ``ids``, ``starts`` and ``ends`` array<int>.

    ``starts`` and ``ends`` are the UTF-8 bytes of the whole original text that a piece
    stands for: of a character written byte by byte the last byte covers it, begin, end
    and the other bytes cover nothing. With ``packed`` the three are binary, little-endian
    and 32 bits each; with ``decoded`` there is also the text decoded from the ids.
    ``path``: the model's file, which each worker reads from its own installation.
    A null or empty text has the begin and end ids alone and decodes to an empty string.
    Rows are returned as often as they occur; other columns are ignored; no rows give no rows.
    """
    rows = pick(docs, *keep, "text").toDF(*[f"k{i}" for i in range(len(keep))], "text")
    kind = T.BinaryType() if packed else T.ArrayType(T.IntegerType())
    fields = [T.StructField(f"k{i}", rows.schema[f"k{i}"].dataType) for i in range(len(keep))]
    schema = T.StructType([*fields, *[T.StructField(n, kind) for n in ("ids", "starts", "ends")], *[T.StructField("decoded", T.StringType())] * decoded])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for b in slices(batches):
            *found, sizes = own.encode_batch(b.column(len(keep)).to_pylist())
            cuts = np.concatenate([[0], np.cumsum(sizes)]).tolist()
            spans = list(zip(cuts[:-1], cuts[1:], strict=True))
            if packed:
                columns = [pa.array([x[a:c].astype("<u4").tobytes() for a, c in spans], type=pa.binary()) for x in found]
            else:
                columns = [pa.ListArray.from_arrays(pa.array(cuts, type=pa.int32()), pa.array(x, type=pa.int32())) for x in found]
            if decoded:
                ids = found[0].tolist()
                columns.append(pa.array([own.decode(ids[a:c]) for a, c in spans], type=pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *columns], names=[f.name for f in schema.fields])

    return rows.mapInArrow(run, schema).toDF(*keep, "ids", "starts", "ends", *["decoded"] * decoded)


def decode(rows: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` and ``text`` of rows (ids array<int>); null ids decode to an empty string."""
    rows = pick(rows, *keep, "ids").toDF(*[f"k{i}" for i in range(len(keep))], "ids")
    schema = T.StructType([*[rows.schema[f"k{i}"] for i in range(len(keep))], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for b in slices(batches):
            texts = [own.decode(x or []) for x in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(texts, type=pa.string())], names=[f.name for f in schema.fields])

    return rows.mapInArrow(run, schema).toDF(*keep, "text")
