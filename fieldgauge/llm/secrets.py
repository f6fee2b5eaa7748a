"""Secret scan by a battery of randomness tests.

Besides the three plain patterns, every long run of letters, digits and base-64 signs that has both a letter and a
digit is a candidate; a run that no alphabet holds is cut at its inner ``=``, then at the signs that keep a piece out of
all alphabets, and the pieces that are long enough are candidates at their own places. The encoding is inferred from the signs it uses; under that encoding a uniform random key passes
a chi-squared test of alphabet use, a runs test about the median sign and a lag-one serial correlation test. The
least of the three p-values, times three, is the candidate's p-value; a small one speaks against randomness.

False discoveries are controlled within strata of encoding and length. Benjamini-Hochberg at level ``Q``, or a p-value of
``Q`` where that takes more, rejects candidates as not random. Whether survivors may be reported depends on the power of
the battery in that stratum: counters, repeated words, words with numbers and dates with counters are written in its
alphabet at its length, and the share rejected of the kind it rejects least is the power; where the corpus has MIN_WORDS
runs of that length in letters alone, ordinary words, the share rejected of those counts too. From the power and the
number rejected, plus three, so that no rejections bound the others as well, comes the expected number of survivors that
are not random, which must stay under ``MAX_FALSE`` of all survivors; otherwise the stratum reports nothing. All counts come from
the whole corpus as one small histogram.

Defined results: null text is empty and has no span; a repeated row is scanned as often as it comes; no rows give no
rows; other columns are never looked at.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fieldgauge.llm.common import query, table, texts_of

KINDS = ("assign", "access", "hex", "random")
LEAST = 16
Q = 0.05
MAX_FALSE = 0.1
P_BINS = 120        # of 0.1 in -log10 p
MIN_WORDS = 50
SAMPLES = 256       # strings of each kind that the power is taken from
LONGEST = 512       # power at greater lengths is that at this one at least
ALPHABETS = {       # narrowest first
    "hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz", "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "+/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64url": "-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz",
}
ENCODINGS = list(ALPHABETS)

_WORDS = ("deadbeef", "session", "customer", "internal", "release", "cafe", "backup", "account")  # parts of names
_HINTS = ("password", "passwd", "secret", "token", "api")
_ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
_EQUALS, _URL, _STANDARD = re.compile(r"=+(?=[^=])"), re.compile(r"[-_]+"), re.compile(r"[+/]+")
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the plain patterns. A run of hex digits that is long enough is the match of ``[0-9a-f]+``
    that passes, since matches of that are whole runs."""
    out = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    return out


def _codes() -> np.ndarray:
    """Sign to place in each alphabet, -1 if it is not in it."""
    grid = np.full((len(ENCODINGS), 128), -1, np.int16)
    for e, name in enumerate(ENCODINGS):
        for i, c in enumerate(ALPHABETS[name]):
            grid[e, ord(c)] = i
    return grid


def _tail(z: np.ndarray) -> np.ndarray:
    """Two-sided normal tail."""
    return np.fromiter(map(math.erfc, np.abs(z) / math.sqrt(2)), float, len(z))


def battery(tokens: list[str], encoding: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(encoding, p-value) of each token; encoding -1 where no alphabet holds it. All tokens of a batch at once. With
    ``encoding`` they are taken to be written in that alphabet."""
    if not tokens:
        return np.zeros(0, int), np.zeros(0)
    grid = _codes()
    bare = [t.rstrip("=") or "=" for t in tokens]
    n = np.array([len(t) for t in bare])
    flat = np.frombuffer("".join(bare).encode("ascii"), np.uint8)
    starts = np.r_[0, np.cumsum(n)[:-1]]
    owner = np.repeat(np.arange(len(n)), n)
    fits = np.stack([np.minimum.reduceat(grid[e][flat], starts) >= 0 for e in range(len(ENCODINGS))])
    enc = np.where(fits.any(0), fits.argmax(0), -1) if encoding is None else np.full(len(n), encoding)
    safe = np.maximum(enc, 0)
    size = np.array([len(ALPHABETS[e]) for e in ENCODINGS])[safe]
    code = grid[safe[owner], flat].astype(float)
    u = (code + 0.5) / size[owner]                                     # place within the alphabet, 0 to 1
    # chi-squared over bins that expect four signs or more, each bin whole signs of the alphabet
    bins = np.clip(n // 4, 2, 16)
    to = np.minimum((u * bins[owner]).astype(int), bins[owner] - 1)
    seen = np.bincount(owner * 16 + to, minlength=16 * len(n)).reshape(-1, 16)
    held = np.zeros((len(n), 16))
    for s in np.unique(size):
        for b in np.unique(bins[size == s]):
            share = np.bincount(np.minimum(((np.arange(s) + 0.5) / s * b).astype(int), b - 1), minlength=16) / s
            held[(size == s) & (bins == b)] = share
    want = held * n[:, None]
    chi = np.where(want > 0, (seen - want) ** 2 / np.where(want > 0, want, 1), 0).sum(1)
    df = bins - 1.0
    z = ((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / np.sqrt(2 / (9 * df))   # Wilson-Hilferty
    p_chi = np.where(z > 0, _tail(z) / 2, 1 - _tail(z) / 2)
    # runs about the middle of the alphabet
    high = u > 0.5
    turn = np.r_[False, (high[1:] != high[:-1]) & (owner[1:] == owner[:-1])]
    runs = 1.0 + np.add.reduceat(turn, starts)
    up = np.add.reduceat(high.astype(int), starts)
    down = n - up
    mean = 2.0 * up * down / n + 1
    var = np.maximum((mean - 1) * (mean - 2) / np.maximum(n - 1, 1), 0.25)
    p_runs = np.where((up == 0) | (down == 0), 2.0 ** (1 - n), _tail((runs - mean) / np.sqrt(var)))
    # lag-one serial correlation
    d = u - 0.5
    pair = np.r_[np.where(owner[1:] == owner[:-1], d[1:] * d[:-1], 0), 0]
    p_serial = _tail(np.add.reduceat(pair, starts) / (np.sqrt(np.maximum(n - 1, 1)) * (1 - 1 / size ** 2) / 12))
    return enc, np.clip(3 * np.minimum(np.minimum(p_chi, p_runs), p_serial), 1e-300, 1)


def length_bin(n: int) -> int:
    """Lengths of 16 to 31 for themselves, then eight bins for each doubling."""
    return n if n < 32 else 32 + int(8 * math.log2(n / 32))


def _split(start: int, t: str, cut: re.Pattern):
    """(start, part) of the parts of ``t`` between the matches of ``cut``."""
    at = 0
    for m in cut.finditer(t):
        yield start + at, t[at:m.start()]
        at = m.end()
    yield start + at, t[at:]


def _parts(start: int, t: str):
    """(start, part) of a run, as far as alphabets hold it: cut at inner ``=``; a part with signs of both kinds of base 64
    is cut at ``-`` and ``_`` and, apart from that, at ``+`` and ``/``, since either may be the signs of a key."""
    for at, part in _split(start, t, _EQUALS):
        if _URL.search(part) and _STANDARD.search(part):
            yield from dict.fromkeys([*_split(at, part, _URL), *_split(at, part, _STANDARD)])
        else:
            yield at, part


def _candidates(text: str):
    """Runs with letters, or their parts; one of letters alone is an ordinary string that tells the battery's power."""
    for m in _RUN.finditer(text):
        for start, t in _parts(m.start(), m[0]):
            if len(t) >= LEAST and _LETTER.search(t):
                yield start, start + len(t), t, _DIGIT.search(t) is None


def _p_bin(p: np.ndarray) -> np.ndarray:
    return np.minimum(-10 * np.log10(p), P_BINS - 1).astype(int)


def _histogram(batches):
    for batch in batches:
        found = [c for raw in texts_of(batch) for c in _candidates(raw.decode())]
        enc, p = battery([c[2] for c in found])
        cells: dict[tuple, int] = defaultdict(int)
        for (a, b, _, plain), e, k in zip(found, enc.tolist(), _p_bin(p).tolist()):
            if e >= 0:
                cells[e, length_bin(b - a), plain, k] += 1
        if cells:
            cols = list(zip(*[(*key, n) for key, n in cells.items()]))
            kinds = (pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["encoding", "length", "plain", "bin", "n"])


def shortest(length: int) -> int:
    """The least length of a bin."""
    return length if length < 32 else math.ceil(32 * 2 ** ((length - 32) / 8))


def not_random(encoding: int, n: int) -> list[list[str]]:
    """Kinds of strings of ``n`` signs that are no keys, in an alphabet."""
    signs = ALPHABETS[ENCODINGS[encoding]]
    digit = lambda text: "".join(c if c in signs else signs[int(c)] for c in text)
    pick = random.Random(n)

    def word(size: int) -> str:
        letters = "".join(pick.choice(_WORDS) for _ in range(size // 4 + 1))[:size]
        return "".join(c if c in signs else signs[(ord(c) - 97) % len(signs)] for c in letters)
    kinds = [[], [], [], []]
    for i in range(SAMPLES):
        step = 1 + 37 * i
        kinds[0].append((word(1) + digit(str(step).zfill(n)))[:1] + digit(str(step).zfill(n - 1)[-(n - 1):]))
        kinds[1].append((word(4 + i % 9) * n)[:n])
        kinds[2].append(word(n // 2) + digit("".join(pick.choice("0123456789") for _ in range(n - n // 2))))
        kinds[3].append((digit(f"2024{1 + i % 12:02}{1 + i % 28:02}") + word(1) + digit(str(step).zfill(n)[-max(n - 9, 0):] if n > 9 else ""))[:n])
    return kinds


@cache
def _rejected(encoding: int, n: int) -> tuple[np.ndarray, ...]:
    """Per kind of string, the bins of their p-values."""
    return tuple(_p_bin(battery(kind, encoding)[1]) for kind in not_random(encoding, n))


def power(encoding: int, length: int, first: int, words: np.ndarray) -> float:
    """Least share rejected, from bin ``first`` on, of the kinds of strings and of the words of that length, if there are enough."""
    shares = [(np.count_nonzero(k >= first) + 1) / (len(k) + 1) for k in _rejected(encoding, min(shortest(length), LONGEST))]
    if words.sum() >= MIN_WORDS:
        shares.append((words[first:].sum() + 1) / (words.sum() + 1))
    return min(shares)


def limits(rows, q: float = Q, max_false: float = MAX_FALSE) -> dict[tuple[int, int], int]:
    """For each (encoding, length) that may report: the first bin of -log10 p that is rejected."""
    own: dict[tuple, np.ndarray] = defaultdict(lambda: np.zeros(P_BINS, np.int64))
    words: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(P_BINS, np.int64))
    for e, length, plain, k, n in rows:
        if plain:
            words[length][k] += n
        else:
            own[e, length][k] += n
    out = {}
    for (e, length), hist in own.items():
        total = hist.sum()
        beyond = hist[::-1].cumsum()[::-1]                       # candidates in bin k or a smaller p
        bound = np.minimum(1.0, 10.0 ** (-np.arange(P_BINS) / 10))  # their p-values are at most this
        ok = np.flatnonzero(bound * total <= q * beyond)
        first = min(int(ok[0]) if len(ok) else P_BINS, int(_p_bin(np.array([q]))[0]))
        rejected, left = hist[first:].sum(), hist[:first].sum()
        share = power(e, length, first, words[length])
        if left and (rejected + 3) / share * (1 - share) <= max_false * left:
            out[e, length] = first
    return out


def _scan(limit: dict[tuple[int, int], int]):
    def run(batches):
        for batch in batches:
            found, owner, bases = [], [], []
            for i, raw in enumerate(texts_of(batch)):
                text = raw.decode()
                bases.append(base_spans(text))
                for c in _candidates(text):
                    if not c[3]:
                        found.append(c)
                        owner.append(i)
            enc, p = battery([c[2] for c in found])
            more: dict[int, list] = defaultdict(list)
            tested = sorted(zip(found, owner, enc.tolist(), _p_bin(p).tolist()), key=lambda x: (x[3], x[0][0] - x[0][1]))
            for (a, b, _, _), i, e, k in tested:     # of parts that overlap, the most random and then the longest
                if k < limit.get((e, length_bin(b - a)), 0) and all(b <= s or t <= a for s, _, t in bases[i] + more[i]):
                    more[i].append((a, "random", b))
            rank = {k: r for r, k in enumerate(KINDS)}
            cols = [[], [], [], [], [], []]
            for i, base in enumerate(bases):
                def line(spans):
                    return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(spans, key=lambda s: (s[0], rank[s[1]], s[2])))
                for c, kind in zip(cols, KINDS):
                    c.append(sum(k == kind for _, k, _ in base + more[i]))
                cols[4].append(hashlib.sha256(line(base).encode()).hexdigest())
                cols[5].append(line(base + more[i]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:4]], *[pa.array(c, pa.string()) for c in cols[4:]]],
                                             names=["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])
    return run


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: counts by kind, digest of the plain spans, all spans."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    cells = (rows.mapInArrow(_histogram, "encoding int, length int, plain boolean, bin int, n bigint")
             .groupBy("encoding", "length", "plain", "bin").agg(F.sum("n").alias("n")))
    limit = limits([tuple(r) for r in cells.collect()])  # encodings x length bins x bins of p
    return rows.mapInArrow(_scan(limit), "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_random bigint, base_sha256 string, spans string")


@query("op1_secret_scan")
def op1_secret_scan(spark, sf_dir):
    return find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
