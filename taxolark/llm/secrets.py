"""Secret scans: a base of three exact patterns, and a linear-chain conditional random field.

The field tags each token as the begin of a secret, its inside, or outside, from the
token's shape, two neighbours on either side and features of the file, decoded by
Viterbi. It is trained here, on windows of a bounded sample of texts, anywhere in them,
into which secrets are put that are made by rule, and what looks like secrets: addresses
of pages, UUIDs, paths, names, numbers.

What a token adds to its own and its neighbours' scores depends on the token alone, so
it is looked up per distinct token and the scores of whole texts are sums of five
arrays. A token whose score for "outside" beats the others by more than any change of
transitions could make up is outside on the best path; what is left are short runs
between such tokens, which Viterbi decodes exactly.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxolark.llm.tables import held, pick, slices

KINDS = ("assign", "access", "hex", "model")
#: The base patterns; shorter matches are dropped after matching.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: A run is matched from its start or, being too short, not at all: the same as to match [0-9a-f]+ and drop the short.
HEX = re.compile(rf"[0-9a-f]{{{LEAST['hex']},}}")
WORDS = ("passw", "secret", "token", "apikey", "api_key")

TOKEN = re.compile(r"[\w+/.\-]+|[^\w\s]")
OUT, BEGIN, INSIDE = 0, 1, 2
#: Distinct tokens that a worker keeps.
KEPT = 200_000
#: Texts in the sample, windows of a text without and with a base secret, tokens of a window, and the seed of what is made.
SAMPLE, ANYWHERE, HOT, WINDOW, SEED = 200, 6, 2, 40, 7
#: The tokens on which a token's features bear: two before it to two after it.
PLACES = (-2, -1, 0, 1, 2)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then kind as listed; leftmost, not overlapping within a kind."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def secret_values(text: str) -> list[tuple[int, int]]:
    """(start, end) of what the base patterns find, without the names that values are assigned to."""
    out = []
    for a, b, kind in base_spans(text):
        out.append((ASSIGN.match(text, a).start(2) if kind == "assign" else a, b))
    return sorted(out)


def _bucket(n: float, cuts: tuple) -> int:
    return sum(n >= c for c in cuts)


_TRIGGER = frozenset("password passwd pwd pass secret token key apikey api_key bearer authorization auth credential credentials private access login client_secret access_token signature".split())
_RUNS = re.compile(r"[A-Z]+|[a-z]+|[0-9]+|[^A-Za-z0-9]")
#: Letters that may be a word: of one case, or small ones after a capital.
_LETTERS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SOUNDS = re.compile(r"(?=[aeiouy][b-df-hj-np-tv-xz]|[b-df-hj-np-tv-xz][aeiouy])")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")


def features(token: str) -> tuple[str, ...]:
    """Names of what is seen of a token: its shape, and whether it is a word or mark that stands near secrets."""
    if token.isalpha():
        low = token.lower()
        if low in _TRIGGER:
            return ("bias", "trigger", f"trigger:{low}")
        form = "lower" if token.islower() else "upper" if token.isupper() else "title" if token[1:].islower() else "mixed"
        size = _bucket(len(token), (4, 9, 16, 20, 28))
        out = ("bias", "alpha", f"alpha:{form}", f"size:{size}")
        return (*out, f"mixed:{size}", f"turns:{_bucket(len(_RUNS.findall(token)), (3, 6, 10, 16))}") if form == "mixed" else out
    if len(token) == 1:
        return ("bias", "mark", f"mark:{token}" if token in "=:\"'`<>(){}[],;@#$%&|!?*-_/.+" else "digit" if token.isdigit() else "mark:other")
    n = len(token)
    digits, upper, lower = sum(c.isdigit() for c in token), sum(c.isupper() for c in token), sum(c.islower() for c in token)
    size = _bucket(n, (4, 8, 12, 16, 20, 28, 40))
    classes = (digits > 0) + (upper > 0) + (lower > 0)
    out = ["bias", f"size:{size}", f"classes:{classes}", f"turns:{_bucket(len(_RUNS.findall(token)), (3, 5, 8, 12, 20))}", f"digits:{_bucket(digits / n, (0.01, 0.1, 0.3, 0.6, 0.999))}", f"classes:{classes}:{size}"]
    distinct = len(set(token))
    out.append(f"distinct:{_bucket(distinct / min(n, 36), (0.3, 0.45, 0.6))}:{min(size, 5)}")
    if digits + sum(c in ".-/+_" for c in token) == n:
        out.append("number")
    if not token.isascii():
        out.append("foreign")
    runs = [len(x) for x in _LETTERS.findall(token)]
    words = sum(x for x in runs if x >= 3) / n
    letters = upper + lower
    if letters >= 8:  # how often vowels and other letters take turns: words do so more than half of the time
        out.append(f"sound:{_bucket(len(_SOUNDS.findall(token.lower())) / letters, (0.25, 0.35, 0.45, 0.55))}:{min(size, 5)}")
    out += [f"wordy:{_bucket(words, (0.01, 0.3, 0.6, 0.8))}", f"run:{_bucket(max(runs, default=0), (3, 5, 8))}:{min(size, 6)}"]
    if _UUID.fullmatch(token):
        out.append("uuid")
    if token.startswith("//"):
        out.append("host" if "." in token else "user")
    elif token[0] in "/.~":
        out.append("path")
    if token.count(".") >= 2:
        out.append("dotted")
    if "/" in token:
        out.append("slash")
    if "_" in token or "-" in token:
        out.append("joined")
    low = token.lower().strip("._-")
    if low in _TRIGGER or low.rpartition("_")[2] in _TRIGGER or low.rpartition(".")[2] in _TRIGGER:
        out += ["trigger", "trigger:joined"]
    return tuple(out)


def file_features(text: str) -> np.ndarray:
    """Of the file: does it assign values, does it name secrets, is it prose."""
    n = max(1, len(text))
    low = text.lower()
    return np.array([min(1.0, 20 * (text.count("=") + text.count(":")) / n), float(any(w in low for w in WORDS)), min(1.0, 5 * text.count(" ") / n)])


FILE = 3


@dataclass
class Model:
    """Weights by feature, place (see PLACES) and tag; of file features and transitions by tag."""

    index: dict[str, int]
    weight: np.ndarray  # features x places x 3 tags
    file: np.ndarray  # file features x 3 tags
    move: np.ndarray  # tag x next tag

    def row(self, token: str) -> np.ndarray:
        known = [self.index[f] for f in features(token) if f in self.index]
        return self.weight[known].sum(axis=0)

    @property
    def swing(self) -> float:
        """The most that turning one tag to outside can lose in transitions."""
        m = self.move
        return max(m[a, y] + m[y, b] - m[a, OUT] - m[OUT, b] for a in range(3) for b in range(3) for y in (BEGIN, INSIDE))


# --- training ---------------------------------------------------------------------


_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


class _Maker:
    """Makes secrets, and what looks like them, as tokens and tags: of common forms, over the characters that they use."""

    def __init__(self, rng: np.random.Generator, words: list[str]):
        self.rng, self.words = rng, words

    def some(self, chars: str, lo: int, hi: int) -> str:
        return "".join(self.rng.choice(list(chars), size=int(self.rng.integers(lo, hi))))

    def pick(self, *of: str) -> str:
        return str(self.rng.choice(list(of)))

    def word(self) -> str:
        return self.words[int(self.rng.integers(len(self.words)))]

    def password(self) -> str:
        """Letters with a few digits, as people make them, or at random; sometimes with a mark inside."""
        kind = self.rng.integers(3)
        if kind == 0:
            return self.word()[:8].lower() + self.some(_DIGIT, 1, 5) + self.pick("", "!", self.word()[:6])
        if kind == 1:
            return self.some(_LOWER + _UPPER + _DIGIT, 8, 21)
        return self.word()[:6].capitalize() + self.pick("&", "!", "$", "#", "") + self.some(_DIGIT + _LOWER, 2, 9)

    def token(self) -> list[str]:
        every = _LOWER + _UPPER + _DIGIT
        kind = self.rng.integers(11)
        if kind == 0:
            return [self.some("0123456789abcdef", 24, 65)]
        if kind == 1:
            return ["AKIA" + self.some(_UPPER + _DIGIT, 16, 17)]
        if kind == 2:
            return [self.pick("ghp_", "gho_", "sk_live_", "pk_test_", "xoxb-", "glpat-", "key-", "") + self.some(every, 20, 40)]
        if kind == 3:
            return ["eyJ" + self.some(every, 17, 40) + ".eyJ" + self.some(every + "_-", 20, 60) + "." + self.some(every + "_-", 20, 43)]
        if kind == 4:
            return [self.some(every + "+/", 32, 65)]
        if kind == 5:
            return [self.some(every + "+/", 60, 65) for _ in range(int(self.rng.integers(2, 5)))]
        if kind == 6:
            return [self.some(every, 20, 33)]
        if kind == 7:
            return [self.some(every, 2, 5) + "." + self.some(every + "_-", 16, 24) + "." + self.some(every + "_-", 24, 44)]
        return [self.some(_UPPER + _DIGIT[: int(self.rng.integers(4, 11))], 24, 40)]

    def secret(self) -> tuple[list[str], list[int]]:
        kind = self.rng.integers(7)
        if kind <= 1:  # in an address: scheme, user, password, host
            lead = [self.pick("postgres", "mysql", "mongodb", "amqp", "ftp", "https", "redis"), ":", self.pick("//" + self.word().lower(), "//")]
            own, after = TOKEN.findall(self.password()), ["@", self.pick("localhost", "db." + self.word().lower() + ".com", "10.0.0.7") + self.pick("", "/" + self.word().lower())]
            lead += [":"] if lead[-1] != "//" else []
            if lead[-1] == "//":
                lead[-1:] = ["//", ":"]
        elif kind == 2:  # given a name, and short
            lead = [self.pick("pwd", "pass", "passphrase", "client_secret", "private_key", "auth", "credential", "login", "PASSWORD", "db_password", "secret_key")]
            lead += [self.pick("=", ":")] + ([self.pick('"', "'")] if self.rng.random() < 0.3 else [])
            own, after = TOKEN.findall(self.password()), lead[-1:] if lead[-1] in "\"'" else []
        else:
            leads = (["key", "="], ["token", ":"], ["password", "=", '"'], ["Authorization", ":", "Bearer"], ["Authorization", ":", "Basic"], ["secret", ":"], ["api_key", "=", "'"], ["X-Api-Key", ":"], [], [], [], [], [], [], [])
            lead = list(leads[self.rng.integers(len(leads))])
            own, after = self.token(), lead[-1:] if lead and lead[-1] in "\"'" else []
        return [*lead, *own, *after], [*[OUT] * len(lead), BEGIN, *[INSIDE] * (len(own) - 1), *[OUT] * len(after)]

    def harmless(self) -> tuple[list[str], list[int]]:
        """Long, mixed or near a name of secrets, and none."""
        word, kind = self.word, self.rng.integers(10)
        if kind == 0:
            path = "/".join(self.pick(word().lower(), self.some(_DIGIT, 1, 9), f"{word().lower()}-{word().lower()}") for _ in range(int(self.rng.integers(1, 6))))
            text = self.pick("https", "http") + "://" + self.pick("www.", "", "api.") + word().lower() + self.pick(".com", ".org", ".io") + "/" + path + self.pick("", ".html", "/", "?id=" + self.some(_DIGIT, 1, 6))
        elif kind == 1:
            text = "-".join(self.some("0123456789abcdef", n, n + 1) for n in (8, 4, 4, 4, 12))
        elif kind == 2:
            text = self.pick("/", "~/", "./", "../") + "/".join(self.pick(word().lower(), word() + self.some(_DIGIT, 1, 3), self.pick("usr", "lib", "src", "home"), word() + "_" + self.some(_DIGIT, 1, 5) + "_" + word().lower(), word().capitalize()) for _ in range(int(self.rng.integers(2, 7)))) + self.pick("", ".py", ".txt", ".so.1", ".json")
        elif kind == 3:
            text = "".join(word().capitalize() for _ in range(int(self.rng.integers(2, 5))))
        elif kind == 4:
            text = "_".join(word().lower() for _ in range(int(self.rng.integers(2, 6))))
        elif kind == 5:
            text = self.pick("mail : ", "", "write to ") + self.pick("", word().lower() + ".") + word().lower() + self.pick("", self.some(_DIGIT, 1, 4), "." + self.some(_DIGIT, 2, 3)) + "@" + self.pick("", "mail.") + word().lower() + ".com"
        elif kind == 6:
            text = self.pick("+49 ", "+1 ", "") + self.some(_DIGIT, 3, 5) + self.pick("-", " ", ".") + self.some(_DIGIT, 3, 9) + self.pick("", "-" + self.some(_DIGIT, 4, 5))
        elif kind == 7:
            text = self.pick("2024-01-31T12:00:01Z", "10.1234/" + word().lower() + ".2021." + self.some(_DIGIT, 4, 8), "v1.2." + self.some(_DIGIT, 1, 4) + "-rc1", self.some(_DIGIT, 12, 20), "978-3-" + self.some(_DIGIT, 6, 7) + "-1", ":".join(self.some("0123456789abcdef", 2, 3) for _ in range(6)))
        elif kind == 8:
            text = self.pick("the password is", "a token of", "secret", "login page :", "the key to", "auth :") + " " + word().lower() + " " + word().lower()
        else:
            text = word() + self.some(_DIGIT, 1, 4) + self.pick("", word().lower()) + self.pick("", "%", "$", "px")
        tokens = TOKEN.findall(text)
        return tokens, [OUT] * len(tokens)


Window = tuple[list[tuple[str, ...]], list[int], list[float], list[str]]


def windows(text: str) -> list[Window]:
    """(features of each token, tags by the base patterns, file features, some words): places of the text drawn by its hash, and some of its base secrets.

    Tagged is what a base pattern finds but for the name that it is given: a token that
    mostly lies in a value begins a secret, and the value's further tokens are inside.
    """
    found, out = [(m[0], m.start(), m.end()) for m in TOKEN.finditer(text)], []
    values = secret_values(text)
    rng = np.random.default_rng(crc32(text.encode()))
    tags, at, last = [], 0, -1
    for _, a, b in found:
        while at < len(values) and values[at][1] <= a:
            at += 1
        own = next((i for i in range(at, min(at + 3, len(values))) if 2 * (min(b, values[i][1]) - max(a, values[i][0])) > b - a), -1)
        tags.append(OUT if own < 0 else INSIDE if own == last else BEGIN)
        last = own
    hot = [i for i, t in enumerate(tags) if t == BEGIN]
    starts = [int(rng.integers(max(1, len(found) - WINDOW + 1))) for _ in range(ANYWHERE)]
    starts += [max(0, h - WINDOW // 2) for h in (rng.choice(hot, size=min(HOT, len(hot)), replace=False).tolist() if hot else ())]
    seen = file_features(text).tolist()
    for start in starts:
        own = [t for t, _, _ in found[start : start + WINDOW]]
        if own:
            out.append(([features(t) for t in own], tags[start : start + WINDOW], seen, [t for t in own if t.isalpha() and 3 <= len(t) <= 12]))
    return out


def _planted(given: list[Window], rng: np.random.Generator) -> list[tuple[list[tuple[str, ...]], list[int], list[float]]]:
    """The windows with six secrets made for every six, and five things that only look so."""
    words = sorted({w for *_, some in given for w in some}) or ["word", "other", "third"]
    maker, out = _Maker(rng, words), []
    for k, (seen, tags, file, _) in enumerate(given):
        seen, tags = list(seen), list(tags)
        for make in ((maker.secret, maker.secret), (maker.harmless, maker.secret), (maker.secret, maker.harmless), (), (maker.harmless, maker.harmless, maker.harmless), (maker.secret, maker.secret))[k % 6]:
            tokens, own = make()
            cut = int(rng.integers(len(seen) + 1))
            while 0 < cut < len(seen) and tags[cut] != OUT:
                cut += 1
            seen[cut:cut], tags[cut:cut] = [features(t) for t in tokens], own
        out.append((seen, tags, file))
    return out


def train(given: list[Window], steps: int = 90, seed: int = SEED, penalty: float = 1e-3) -> Model:
    """Maximum likelihood by forward-backward over padded batches and Adam, on windows with made secrets put in."""
    rng, pad = np.random.default_rng(seed), max(PLACES)
    drawn = _planted(given or [w for _ in range(12) for w in windows("nothing to hide in this text")], rng)
    kinds = {k: i for i, k in enumerate(dict.fromkeys(tuple(t) for seen, _, _ in drawn for t in seen))}  # tokens with the same features are of a kind
    index = {f: i for i, f in enumerate(sorted({f for kind in kinds for f in kind}))}
    has = np.zeros((len(kinds), len(index)))
    for kind, i in kinds.items():
        has[i, [index[f] for f in kind]] = 1
    width = max(len(t) for t, _, _ in drawn) + 2 * pad  # outside tokens at either end
    n, k = len(drawn), len(index)
    rows, cols = [], []
    tags, real, files = np.zeros((n, width), dtype=np.int64), np.zeros((n, width), dtype=bool), np.zeros((n, FILE))
    for i, (seen, own, file_seen) in enumerate(drawn):
        rows += range(i * width + pad, i * width + pad + len(seen))
        cols += [kinds[tuple(t)] for t in seen]
        tags[i, pad : len(own) + pad], real[i, pad : len(own) + pad], files[i] = own, True, file_seen
    rows, cols = np.array(rows), np.array(cols)
    place = [rows + o for o in PLACES]
    weight, file, move = np.zeros((k, len(PLACES), 3)), np.zeros((FILE, 3)), np.zeros((3, 3))
    state = [[p, np.zeros_like(p), np.zeros_like(p)] for p in (weight, file, move)]
    on = np.arange(1, width) < (real.sum(axis=1) + 2 * pad)[:, None]
    moved = np.zeros((3, 3))  # transitions as given
    np.add.at(moved, (tags[:, :-1][on], tags[:, 1:][on]), 1)
    for step in range(1, steps + 1):
        flat, each = np.zeros((n * width, 3)), (has @ weight.reshape(k, -1)).reshape(-1, len(PLACES), 3)
        for x in range(len(PLACES)):
            flat[place[x]] += each[cols, x]  # each place once
        score = flat.reshape(n, width, 3) + (files @ file)[:, None, :]
        score[~real] = (0.0, -1e4, -1e4)  # padding is outside
        alpha, beta = np.zeros_like(score), np.zeros_like(score)
        alpha[:, 0] = score[:, 0]
        for j in range(1, width):
            alpha[:, j] = _lse(alpha[:, j - 1, :, None] + move, axis=1) + score[:, j]
        for j in range(width - 2, -1, -1):
            beta[:, j] = _lse(move + (score[:, j + 1] + beta[:, j + 1])[:, None, :], axis=2)
        z = _lse(alpha[:, -1], axis=1)
        like = np.exp(alpha + beta - z[:, None, None])
        error = like - np.eye(3)[tags]
        error[~real] = 0
        flat = error.reshape(-1, 3)
        each = np.zeros((len(kinds), len(PLACES), 3))
        for x in range(len(PLACES)):
            for y in range(3):
                each[:, x, y] = np.bincount(cols, weights=flat[place[x], y], minlength=len(kinds))
        g_weight = (has.T @ each.reshape(len(kinds), -1)).reshape(weight.shape)
        g_file = files.T @ error.sum(axis=1)
        pair = np.exp(alpha[:, :-1, :, None] + move + (score + beta)[:, 1:, None, :] - z[:, None, None, None])
        g_move = pair[on].sum(axis=0) - moved
        for (p, m, v), g in zip(state, (g_weight, g_file, g_move), strict=True):
            g = g / n + penalty * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(index, weight, file, move)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


# --- tagging ----------------------------------------------------------------------


def viterbi(score: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The best tags of a run that stands between two outside tokens."""
    best, back = score[0] + move[OUT], []
    for row in score[1:]:
        each = best[:, None] + move
        back.append(each.argmax(axis=0))
        best = each.max(axis=0) + row
    tag = int((best + move[:, OUT]).argmax())
    out = [tag]
    for b in reversed(back):
        tag = int(b[tag])
        out.append(tag)
    return np.array(out[::-1])


class Tagger:
    def __init__(self, model: Model):
        self.model, self.swing = model, model.swing
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1, len(PLACES), 3))  # row 0 is the gap between texts

    def tags(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """Of each text the (first, last) token of each secret."""
        if len(self.known) > KEPT:
            self.forget()
        parts = [TOKEN.findall(t) for t in texts]
        fresh = list(dict.fromkeys(t for own in parts for t in own if t not in self.known))
        at = len(self.rows)
        made: dict[tuple, np.ndarray] = {}
        added = np.zeros((len(fresh), len(PLACES), 3))
        for i, t in enumerate(fresh):
            key = features(t)
            if key not in made:
                made[key] = self.model.row(t)
            added[i] = made[key]
            self.known[t] = at + i
        self.rows = np.concatenate([self.rows, added])
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        gap = max(PLACES)
        starts = np.cumsum(sizes + gap) - sizes  # of each text's tokens; gaps before and after each
        number = np.zeros(int(sizes.sum()) + gap * (len(parts) + 1), dtype=np.int64)
        inside = np.ones(len(number), dtype=bool)
        for x in range(gap):
            inside[np.append(starts - 1 - x, len(number) - 1 - x)] = False
        number[inside] = np.fromiter((self.known[t] for own in parts for t in own), dtype=np.int64, count=int(sizes.sum()))
        score = np.zeros((len(number), 3))
        for x, o in enumerate(PLACES):
            score[max(0, o) : len(score) + min(0, o)] += self.rows[number[max(0, -o) : len(score) - max(0, o)], x]
        seen = np.array([file_features(t) for t in texts]).reshape(-1, FILE) @ self.model.file
        text_of = np.repeat(np.arange(len(parts)), sizes)
        score[inside] += seen[text_of]
        score[~inside] = (0.0, -1e4, -1e4)
        open_ = score[:, OUT] - score[:, 1:].max(axis=1) <= self.swing
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], open_, [False]]).astype(np.int8)))
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            path = viterbi(score[a:b], self.model.move)
            if not (path == BEGIN).any():
                continue
            text = int(np.searchsorted(starts, a, side="right")) - 1
            first = None
            for i, tag in enumerate(path.tolist()):
                if tag == BEGIN:  # an inside without a begin is no secret
                    if first is not None:
                        out[text].append((first, a + i - 1 - starts[text]))
                    first = a + i - starts[text]
                elif tag == OUT and first is not None:
                    out[text].append((first, a + i - 1 - starts[text]))
                    first = None
            if first is not None:
                out[text].append((first, b - 1 - starts[text]))
        return out


def all_spans(text: str, tagged: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """The base spans, and the tagged ones, whole, that the base spans leave any text of uncovered.

    Of tagged ones those with as many letters and digits as a base value has at least.
    """
    out = base_spans(text)
    if tagged:
        base = [(a, b) for a, b, _ in out]
        where = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
        for first, last in tagged:
            while last > first and where[last][0] > where[last - 1][1] and _plain(text[where[last][0] : where[last][1]]):
                last -= 1  # a word behind white space is no end of a secret
            a, b = where[first][0], where[last][1]
            if sum(map(str.isalnum, text[a:b])) >= LEAST["assign"] and _uncovered(text, a, b, base):
                out.append((a, b, "model"))
        out.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return out


def _plain(token: str) -> bool:
    """Whether a token is a word, a number of few digits, or a mark."""
    return len(token) == 1 or (token.isalpha() and len(token) <= 16 and token[1:] == token[1:].lower()) or (token.isdigit() and len(token) <= 4)


def _uncovered(text: str, a: int, b: int, base: list[tuple[int, int]]) -> bool:
    """Whether anything but white space of text[a:b] is outside the base spans, given by start."""
    for x, y in base:
        if x >= b:
            break
        if y > a:
            if text[a:x].strip():
                return True
            a = y
    return bool(text[a:b].strip())


SPANS = "array<struct<kind:string,start:int,end:int>>"


def sample_windows(docs: DataFrame, bound: int = SAMPLE) -> list[Window]:
    """Windows to train on of at most ``bound`` different texts, those of the smallest hashes.

    The hashes are chosen first; windows are cut in the tasks out of whole texts, and
    only the features of their tokens and some words reach the driver.
    """
    own = pick(docs, "text").where("text is not null").withColumn("h", F.xxhash64("text"))
    chosen = [r["h"] for r in own.select("h").distinct().orderBy("h").limit(bound).collect()]
    if not chosen:
        return []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 16):
            for h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = windows(text)
                yield pa.RecordBatch.from_arrays([pa.array([h] * len(got), pa.int64()), pa.array(range(len(got)), pa.int32()), pa.array([json.dumps(w) for w in got], pa.string())], names=["h", "n", "window"])

    taken = own.where(F.col("h") <= max(chosen)).groupBy("h").agg(F.min("text").alias("text"))
    return [json.loads(r["window"]) for r in taken.mapInArrow(cut, "h long, n int, window string").orderBy("h", "n").collect()]


def scan(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), redact: str | None = None) -> DataFrame:
    """The columns of ``keep`` and ``spans`` (kind, start, end in code points) of documents (text).

    ``spans``: all base spans and those that the field adds, by start; one of the field
    may overlap a base span that stops short of it. With ``redact``
    also ``text`` in which each stretch of spans is replaced by that string. A null
    text counts as empty and has no spans; it stays null when redacted. Rows are
    returned as often as they occur; other columns are ignored; no rows give no rows.
    """
    rows = pick(docs, *keep, "text").toDF(*[f"k{i}" for i in range(len(keep))], "text")
    n, key = len(keep), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = held(key, lambda: Tagger(model))
        for b in slices(batches):
            raw = b.column(n).to_pylist()
            texts = [t or "" for t in raw]
            found = [all_spans(t, tags) for t, tags in zip(texts, tagger.tags(texts), strict=True)]
            spans = pa.array([[{"kind": k, "start": x, "end": y} for x, y, k in own] for own in found], type=pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))
            out = [*b.columns[:n], spans]
            if redact is not None:
                out.append(pa.array([t if t is None or not own else replaced(t, own, redact) for t, own in zip(raw, found, strict=True)], type=pa.string()))
            yield pa.RecordBatch.from_arrays(out, names=[f.name for f in schema.fields])

    fields = [T.StructField(f"k{i}", rows.schema[f"k{i}"].dataType) for i in range(n)]
    spans_type = T._parse_datatype_string(SPANS)
    schema = T.StructType([*fields, T.StructField("spans", spans_type), *[T.StructField("text", T.StringType())] * (redact is not None)])
    return rows.mapInArrow(run, schema).toDF(*keep, "spans", *["redacted"] * (redact is not None))


def replaced(text: str, spans: list[tuple[int, int, str]], by: str) -> str:
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], by]
        at = max(at, b)
    return "".join([*out, text[at:]])


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
