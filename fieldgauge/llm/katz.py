"""Katz backoff language model: trained and evaluated on whole texts.

Tokens are words (ASCII lower-cased) and one end per text; a token's number is its XXH64. Documents whose CRC-32 of the
doc_id, as text, is 2 modulo 7 are held out of training.

The model, for word w after history h:

    P(w | h) = d(r) r / C(h)      if the pair was seen r > 0 times
             = alpha(h) P(w)      otherwise
    P(w)     = d(c) c / N         if w was seen c > 0 times, else the mass left over, for the one unknown word

d is the Good-Turing discount up to K; larger counts lose half a count, so that every history keeps some mass.
alpha(h) = (1 - sum of seen P(. | h)) / (1 - sum of P(w) over the words seen after h), so each distribution sums to 1.
A history is the word before, or the start of a text. Every word has its own; only if a caller gives a history_share do
the words below that share of all tokens have one history together.

Both cases divide by C(h), and the history of a token is the token before, so each word gives its document 1 / C(word) where
its count is known anyway. Left open are seen pairs by count and unseen ones by history. Histories of at least HOT_SHARE of
all tokens, at most 1 / HOT_SHARE of them, are numbered and their alpha goes to all tasks; the others, none of them a hot
key, stay in a table that is joined to the open events by history. HOT_SHARE has no influence on scores.

Tables, all in the shared folder: word counts; history counts and what each document adds, in partitions by kind.
Counting pairs and evaluating them are one pass: pairs go to the partition of their word, where counts meet all
documents that need them, as arrays, one row for each block of documents and partition. Frequent words are spread over
partitions by history too, and a pair seen often enough to fill a partition is counted in a pass of its own, summed before it
is shuffled; all tasks know the counts of those pairs (at most total / BUCKET_TOKENS of them) and score them where they
stand, so no word and no pair is a hot key.

Defined results: null and empty texts are one end token; a null doc_id counts as the text "" for the fold; repeated
documents count and are scored as often as they come; without training text every word is the unknown one, with
probability 1; no rows give no rows; other columns are never looked at.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from fieldgauge.llm.common import query, table, texts_of
from fieldgauge.sources.workspace import materialise, new_path

K = 5
HISTORY_SHARE = 0.0
HOT_SHARE = 1e-6
BLOCK_TOKENS = 400_000
BLOCK_DOCS = 16_000   # twice a document's number is a 16-bit integer
DOC_BITS = 16
BUCKET_TOKENS = 2_500_000
SLICES = 16
HELD = (7, 2)
END = np.int64(zlib.crc32(b"end of text") + (1 << 40))
START, POOLED = END + 1, END + 2            # histories that are no word
START_CLASS, RARE_CLASS, FIRST_CLASS = 0, 1, 2   # RARE_CLASS: one history if pooled, else all that are not numbered
NS = K + 2          # pairs seen 1 .. K + 1 times, and more often


def discounts(n: list[int], k: int = K) -> np.ndarray:
    """d(1) .. d(k) from counts of counts n[1 ..]; where Good-Turing gives no proper value, half a count goes."""
    d = np.array([(r - 0.5) / r for r in range(1, k + 1)])
    if all(n[r] > 0 for r in range(1, k + 2)):
        a = (k + 1) * n[k + 1] / n[1]
        good = [((r + 1) * n[r + 1] / n[r] / r - a) / (1 - a) if a != 1 else 0.0 for r in range(1, k + 1)]
        if all(0 < g < 1 for g in good):
            d = np.array(good)
    return d


def kept(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Discounted counts."""
    small = (counts > 0) & (counts <= len(d))
    return np.where(small, counts * d[np.clip(counts, 1, len(d)) - 1], np.maximum(counts - 0.5, 0))


class Words:
    """What every task needs of the word counts: totals, discounts, and the numbers and counts of frequent words."""

    def __init__(self, total: int, types: int, n: list[int], train_docs: int, frequent: dict[int, int], pooled: bool = False):
        self.total, self.types, self.d, self.train_docs, self.pooled = total, types, discounts(n), train_docs, pooled
        low = sum((1 - self.d[r - 1]) * r * n[r] for r in range(1, K + 1)) + 0.5 * (types - sum(n[1:K + 1]))
        self.unknown = low / total if total else 1.0
        self.ids = np.array(sorted(frequent), np.int64)
        self.counts = np.array([frequent[i] for i in self.ids.tolist()], np.int64)
        self.rest = total - train_docs - self.counts[self.ids != END].sum()   # an end is no history
        self.numbered = np.r_[START, POOLED, self.ids]
        self.hot, self.hot_n = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def pair(self, w: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Number of a pair of frequent words, -1 for others."""
        place, cls = self.place(w), self.classes(h)
        return np.where((place >= 0) & (cls != RARE_CLASS), place * len(self.numbered) + cls, -1)

    def hot_count(self, w: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Count of a pair that is counted beforehand, 0 for others."""
        if not len(self.hot):
            return np.zeros(len(w), np.int64)
        pair = self.pair(w, h)
        at = np.minimum(np.searchsorted(self.hot, pair), len(self.hot) - 1)
        return np.where(self.hot[at] == pair, self.hot_n[at], 0)

    def place(self, ids: np.ndarray) -> np.ndarray:
        """Number among the frequent words, or -1."""
        if not len(self.ids):
            return np.full(len(ids), -1)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[at] == ids, at, -1)

    def history(self, ids: np.ndarray) -> np.ndarray:
        """The history a word makes."""
        return np.where(self.place(ids) >= 0, ids, POOLED) if self.pooled else ids

    def classes(self, histories: np.ndarray) -> np.ndarray:
        """Number of a history, RARE_CLASS if it has none of its own."""
        place = self.place(histories)
        return np.where(histories == START, START_CLASS, np.where(place >= 0, place + FIRST_CLASS, RARE_CLASS))

    def history_total(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """C of the histories that words make, from the counts of the words; 1 where nothing was seen after it."""
        own = np.where(self.place(ids) >= 0, counts, self.rest) if self.pooled else counts
        return np.where(ids == END, 1, np.maximum(own, 1))

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, kept(counts, self.d) / max(self.total, 1), self.unknown)


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else b"%d" % doc_id) % HELD[0] == HELD[1]


def _numbers(raw: bytes) -> np.ndarray:
    from xxhash import xxh64_intdigest

    words = raw.lower().split()
    out = np.empty(len(words) + 1, np.int64)
    out[:-1] = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)
    out[-1] = END
    return out


def _documents(batch: pa.RecordBatch, size: int = 256):
    """(doc_id, text) of a batch, a few hundred rows at a time as Python values."""
    for i in range(0, batch.num_rows, size):
        part = batch.slice(i, size)
        yield from zip(part.column(0).to_pylist(), texts_of(part))


def _count_words(batches):
    """(word, n) of training documents, summed within a few batches."""
    def flush():
        ids, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n.astype(np.int64))], names=["word", "n"])
    parts, size = [], 0
    for batch in batches:
        for doc_id, raw in _documents(batch):
            if not held_out(doc_id):
                parts.append(_numbers(raw))
                size += len(parts[-1])
                if size >= BLOCK_TOKENS:
                    yield flush()
                    parts, size = [], 0
    if parts:
        yield flush()


def _histories(words: Words, docs: list) -> np.ndarray:
    """The history of each token of joined documents."""
    w = np.concatenate(docs)
    h = np.r_[START, words.history(w[:-1])]
    h[np.cumsum([0, *map(len, docs[:-1])])] = START
    return h


def _count_hot(words: Words, least: int):
    """(pair, n) of pairs whose word and history both occur ``least`` times in training, summed over a block."""
    often = words.ids[words.counts >= least]
    start = words.train_docs >= least

    def run(batches):
        def flush():
            w, h = np.concatenate(docs), _histories(words, docs)
            some = np.isin(w, often) & (np.isin(h, often) | (h == START if start else False))
            pair, n = np.unique(words.pair(w[some], h[some]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n.astype(np.int64))], names=["pair", "n"])
        docs, size = [], 0
        for batch in batches:
            for doc_id, raw in _documents(batch):
                if not held_out(doc_id):
                    docs.append(_numbers(raw))
                    size += len(docs[-1])
                    if size >= BLOCK_TOKENS:
                        yield flush()
                        docs, size = [], 0
        if docs:
            yield flush()
    return run


_SENT = ("bucket int, block bigint, w array<bigint>, pairs array<int>, h array<int>, rare array<bigint>, entries array<int>, doc array<smallint>, "
         "ids array<bigint>, tokens array<int>, hot_doc array<int>, hot_fixed array<double>, hot_base array<double>, hot_n array<int>")


_SENT_NAMES = [c.split()[0] for c in _SENT.split(", ")]
_EMPTY = [pa.list_(t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int16())]   # w .. doc


def _lists(values: np.ndarray, ends: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def _send(words: Words, buckets: int):
    """Blocks of documents as rows (bucket, block): distinct words, their histories by number (``rare``: the words of those
    without one, in turn), and per pair the documents it
    occurs in (twice the number in the block, plus 1 if held out), one entry per occurrence. Pairs counted beforehand are not
    sent; what they are worth to each document travels with the block's first row."""
    def block_rows(block: int, docs: list, lengths: list):
        w = np.concatenate(docs)
        n = np.array(lengths)
        ids = [i for i, _ in meta]
        held = np.array([h for _, h in meta])
        h = _histories(words, docs)
        docs.clear()
        doc = np.repeat(2 * np.arange(len(n)) + held, n)
        r = words.hot_count(w, h)
        hot = np.flatnonzero(r)
        c = words.counts[words.place(w[hot])]
        hot_doc, slot = np.unique(doc[hot], return_inverse=True)
        hot_fixed = np.bincount(slot, np.log10(r[hot] - 0.5) - np.log10(words.history_total(w[hot], c)), len(hot_doc))
        hot_base, hot_n = np.bincount(slot, np.log10(c + 1.0), len(hot_doc)), np.bincount(slot, minlength=len(hot_doc))
        first = lambda v, k, t: pa.ListArray.from_arrays(pa.array(np.r_[0, np.full(k, len(v))], pa.int32()), pa.array(v, t))
        extra = lambda k: [first(v, k, t) for v, t in ((ids, pa.int64()), (n, pa.int32()), (hot_doc, pa.int32()), (hot_fixed, pa.float64()), (hot_base, pa.float64()), (hot_n, pa.int32()))]
        if len(hot) == len(w):                                 # nothing else to send
            yield pa.RecordBatch.from_arrays([pa.array([block % buckets], pa.int32()), pa.array([block], pa.int64()),
                                              *[pa.array([[]], t) for t in _EMPTY], *extra(1)], names=_SENT_NAMES)
            return
        if len(hot):
            rest = r == 0
            w, h, doc = w[rest], h[rest], doc[rest]
        mix = w.view(np.uint64) ^ (w.view(np.uint64) >> np.uint64(29))
        mix = mix + np.where(words.place(w) >= 0, h, 0).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mix = mix ^ (mix >> np.uint64(32))
        bucket = ((mix * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)) % np.uint64(buckets)
        order = np.lexsort((h, w, bucket))
        w, h, doc, bucket = w[order], h[order], doc[order], bucket[order].astype(np.int64)
        new_b = np.r_[True, bucket[1:] != bucket[:-1]]
        new_w = new_b | np.r_[True, w[1:] != w[:-1]]
        new_p = new_w | np.r_[True, h[1:] != h[:-1]]
        at_b, at_w, at_p = np.flatnonzero(new_b), np.flatnonzero(new_w), np.flatnonzero(new_p)
        size = len(w)
        pairs = np.diff(np.r_[np.searchsorted(at_p, at_w), len(at_p)])
        entries = np.diff(np.r_[at_p, size])
        cut = np.r_[at_b, size]
        ends_w, ends_p = np.searchsorted(at_w, cut), np.searchsorted(at_p, cut)
        k = len(at_b)
        cls = words.classes(h[at_p])
        rare = cls == RARE_CLASS
        ends_rare = np.r_[0, np.cumsum(rare)][ends_p]
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket[at_b], pa.int32()), pa.array(np.full(k, block), pa.int64()), _lists(w[at_w], ends_w, pa.int64()),
             _lists(pairs, ends_w, pa.int32()), _lists(cls, ends_p, pa.int32()), _lists(h[at_p][rare], ends_rare, pa.int64()), _lists(entries, ends_p, pa.int32()), _lists(doc, cut, pa.int16()),
             *extra(k)], names=_SENT_NAMES)                    # the block's documents travel with its first row

    meta: list = []

    def run(batches):
        docs, lengths, size, block = [], [], 0, TaskContext.get().partitionId() << 20
        meta.clear()
        for batch in batches:
            for doc_id, raw in _documents(batch):
                docs.append(_numbers(raw))
                lengths.append(len(docs[-1]))
                meta.append((doc_id, held_out(doc_id)))
                size += lengths[-1]
                if size >= BLOCK_TOKENS or len(docs) >= BLOCK_DOCS:
                    yield from block_rows(block, docs, lengths)
                    docs, lengths, size, block = [], [], 0, block + 1
                    meta.clear()
        if docs:
            yield from block_rows(block, docs, lengths)
    return run


_MET = ("kind string, block bigint, doc array<int>, fixed array<double>, base array<double>, known array<int>, seen array<int>, "
        "event_h array<int>, event_doc array<int>, rare array<bigint>, rare_doc array<int>, ids array<bigint>, tokens array<int>, h array<int>, "
        "ns array<int>, covered array<double>")
_MET_SCHEMA = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("doc", pa.list_(pa.int32())), ("fixed", pa.list_(pa.float64())),
                         ("base", pa.list_(pa.float64())), ("known", pa.list_(pa.int32())), ("seen", pa.list_(pa.int32())),
                         ("event_h", pa.list_(pa.int32())), ("event_doc", pa.list_(pa.int32())),
                         ("rare", pa.list_(pa.int64())), ("rare_doc", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64())),
                         ("tokens", pa.list_(pa.int32())), ("h", pa.list_(pa.int32())), ("ns", pa.list_(pa.int32())), ("covered", pa.list_(pa.float64()))])


def _whole(col) -> pa.Array:
    if isinstance(col, pa.ChunkedArray):
        return pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    return col


def _flat(col) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the length of each list."""
    col = _whole(col)
    return col.flatten().to_numpy(zero_copy_only=False), col.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _rows(kind: str, columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind] * n) if f.name == "kind" else columns.get(f.name, pa.nulls(n, f.type)) for f in _MET_SCHEMA], schema=_MET_SCHEMA)


def _meet(words: Words):
    """All blocks of one bucket: total the pairs, then give each document what its tokens are worth. What depends on the
    discounts of pairs or on alpha is left open: tokens seen 1 .. K times by number, unseen ones as events."""
    def run(_, group):
        word, _ = _flat(group.column("w"))
        pairs, _ = _flat(group.column("pairs"))
        cls, per_row = _flat(group.column("h"))
        h = words.numbered[cls]
        h[cls == RARE_CLASS] = POOLED if words.pooled else _flat(group.column("rare"))[0]
        entries, _ = _flat(group.column("entries"))
        doc, per_entry = _flat(group.column("doc"))
        w = np.repeat(word, pairs)
        row = np.repeat(np.arange(group.num_rows, dtype=np.int32), per_row)
        first = np.r_[0, np.cumsum(entries, dtype=np.int64)[:-1]]
        # a slot for each document of each row
        ends = np.r_[0, np.cumsum(per_entry)]
        hot_doc, per_hot = _flat(group.column("hot_doc"))
        hot_ends = np.r_[0, np.cumsum(per_hot)]
        most = lambda v, a, b: int(v[a:b].max()) + 1 if b > a else 0
        room = np.array([max(most(doc, *e), most(hot_doc, *f)) for e, f in zip(zip(ends, ends[1:]), zip(hot_ends, hot_ends[1:]))])
        offset = np.r_[0, np.cumsum(room)]
        slots = int(offset[-1])
        fixed, base = np.zeros(slots), np.zeros(slots)
        known, there, times = np.zeros(slots, np.int32), np.zeros(slots, bool), np.zeros((slots, K), np.int32)
        hot_slot = np.repeat(offset[:-1], per_hot) + hot_doc
        fixed[hot_slot], base[hot_slot], known[hot_slot] = (_flat(group.column(c))[0] for c in ("hot_fixed", "hot_base", "hot_n"))
        there[hot_slot] = True
        no_event = (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int16))
        events, histories = [no_event], [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        slice_of = ((w ^ (w >> np.int64(23))) & (SLICES - 1)).astype(np.int8)
        for s in range(SLICES):                                # a part of the words at a time keeps arrays short
            at = np.flatnonzero(slice_of == s)
            if not len(at):
                continue
            n = entries[at].astype(np.int64)
            begin = np.r_[0, np.cumsum(n)[:-1]]
            pick = np.repeat(first[at] - begin, n) + np.arange(n.sum())
            trained = np.add.reduceat((doc[pick] & 1) == 0, begin, dtype=np.int64)
            ws, hs = w[at], h[at]
            order = np.lexsort((hs, ws))
            new_w = np.r_[True, ws[order][1:] != ws[order][:-1]]
            new_p = new_w | np.r_[True, hs[order][1:] != hs[order][:-1]]
            cut_p, cut_w = np.flatnonzero(new_p), np.flatnonzero(new_w)
            r_each = np.add.reduceat(trained[order], cut_p)
            c_word = np.add.reduceat(trained[order], cut_w)
            to_word = np.cumsum(new_w)[cut_p] - 1
            w_each, h_each, c_each = ws[order][cut_p], hs[order][cut_p], c_word[to_word]
            if len(words.counts):
                place = words.place(w_each)
                c_each = np.where(place >= 0, words.counts[np.maximum(place, 0)], c_each)
            p_each = words.unigram(c_each)
            of = np.empty(len(order), np.int64)
            of[order] = np.cumsum(new_p) - 1
            r, c = r_each[of], c_each[of]
            worth = np.log10(np.where(r > K, r - 0.5, np.where(r > 0, r, p_each[of]))) - np.log10(words.history_total(w_each, c_each)[of])
            e_of = np.repeat(np.arange(len(at)), n)
            slot = offset[row[at]][e_of] + doc[pick]
            there[slot] = True
            fixed += np.bincount(slot, worth[e_of], slots)
            base += np.bincount(slot, np.log10(c + 1.0)[e_of], slots)
            known += np.bincount(slot[c[e_of] > 0], minlength=slots).astype(np.int32)
            for k in range(1, K + 1):
                times[:, k - 1] += np.bincount(slot[r[e_of] == k], minlength=slots).astype(np.int32)
            open_ = r[e_of] == 0
            events.append((row[at][e_of[open_]], hs[e_of[open_]], doc[pick[open_]]))
            ok = r_each > 0
            hist, inv = np.unique(h_each[ok], return_inverse=True)
            ns = np.bincount(inv * NS + np.minimum(r_each[ok], NS) - 1, minlength=len(hist) * NS)
            histories.append((hist, ns, np.bincount(inv, p_each[ok], len(hist))))
        slot = np.flatnonzero(there)
        k_row = np.searchsorted(offset, slot, "right") - 1
        cut = np.searchsorted(k_row, np.arange(group.num_rows + 1))
        ev_row, ev_h, ev_doc = (np.concatenate(x) for x in zip(*events))
        ev_class = words.classes(ev_h)
        joined = (ev_class == RARE_CLASS) & (not words.pooled)
        order, order_rare = (np.flatnonzero(x)[np.argsort(ev_row[x], kind="stable")] for x in (~joined, joined))
        cut_open, cut_rare = (np.searchsorted(ev_row[o], np.arange(group.num_rows + 1)) for o in (order, order_rare))
        part = {"block": group.column("block"), "doc": _lists(slot - offset[k_row], cut, pa.int32()), "fixed": _lists(fixed[slot], cut, pa.float64()),
                "base": _lists(base[slot], cut, pa.float64()), "known": _lists(known[slot], cut, pa.int32()), "seen": _lists(times[slot].ravel(), cut * K, pa.int32()),
                "event_h": _lists(ev_class[order], cut_open, pa.int32()), "event_doc": _lists(ev_doc[order], cut_open, pa.int32()),
                "rare": _lists(ev_h[order_rare], cut_rare, pa.int64()), "rare_doc": _lists(ev_doc[order_rare], cut_rare, pa.int32()),
                "ids": group.column("ids"), "tokens": group.column("tokens")}
        part = {k: _whole(v) for k, v in part.items()}
        one = lambda x, t: pa.array([np.concatenate(x)], pa.list_(t))
        hist, ns, covered = (np.concatenate(x) for x in zip(*histories))
        hist, inv = np.unique(hist, return_inverse=True)
        ns = np.stack([np.bincount(inv, x, len(hist)) for x in ns.reshape(-1, NS).T], 1).astype(np.int64)
        covered = np.bincount(inv, covered, len(hist))
        number = words.classes(hist)
        own = (number != RARE_CLASS) | words.pooled
        return pa.Table.from_batches([
            _rows("documents", part, group.num_rows),
            _rows("histories", {"h": one([number[own], [RARE_CLASS]], pa.int32()), "ns": one([ns[own].ravel(), ns[~own].sum(0)], pa.int32()),
                                "covered": one([covered[own], [0.0]], pa.float64())}, 1),   # last: totals of those that are joined
            _rows("rare", {"rare": one([hist[~own]], pa.int64()), "ns": one([ns[~own].ravel()], pa.int32()), "covered": one([covered[~own]], pa.float64())}, 1)])
    return run


def _rare_histories(batches):
    """(h, n1 .., covered) of the histories without a number, one row each."""
    for batch in batches:
        h, ns, covered = (_flat(batch.column(batch.schema.get_field_index(c)))[0] for c in ("rare", "ns", "covered"))
        if len(h):
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), *[pa.array(n, pa.int64()) for n in ns.reshape(-1, NS).T], pa.array(covered, pa.float64())],
                                             names=["h", *[f"n{r + 1}" for r in range(NS)], "covered"])


def _rare_events(batches):
    """(h, at) of the open events whose history has no number; ``at`` is block and document in one number."""
    for batch in batches:
        h, n = _flat(batch.column(batch.schema.get_field_index("rare")))
        doc, _ = _flat(batch.column(batch.schema.get_field_index("rare_doc")))
        block = np.repeat(batch.column(batch.schema.get_field_index("block")).to_numpy(), n)
        if len(h):
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(block << DOC_BITS | doc, pa.int64())], names=["h", "at"])


def _settle(d: np.ndarray, log_a: np.ndarray, per_token: float, start: float):
    """All parts of one block: a row for each document. Opens what was left open."""
    log_d = np.log10(d)

    def run(_, group):
        ids = _whole(group.column("ids")).flatten().to_pylist()
        tokens, _ = _flat(group.column("tokens"))
        n = len(tokens)
        doc, _ = _flat(group.column("doc"))
        fixed, base, known = (_flat(group.column(c))[0] for c in ("fixed", "base", "known"))
        event_h, _ = _flat(group.column("event_h"))
        event_doc, _ = _flat(group.column("event_doc"))
        part = fixed + _flat(group.column("seen"))[0].reshape(-1, K) @ log_d
        score = np.bincount(doc >> 1, part, n) + np.bincount(event_doc >> 1, log_a[event_h], n) - start
        score += np.bincount(_flat(group.column("rare_doc"))[0] >> 1, _flat(group.column("rare_add"))[0], n)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "held_out": pa.array([held_out(i) for i in ids], pa.bool_()), "n_tokens": pa.array(tokens, pa.int64()),
                         "n_known": pa.array(np.bincount(doc >> 1, known, n).astype(np.int64)), "base_score": np.bincount(doc >> 1, base, n) + per_token * tokens, "score": score})
    return run


def score_texts(docs: DataFrame, bucket_tokens: int = BUCKET_TOKENS, history_share: float = HISTORY_SHARE,
                hot_pair: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each document. A ``history_share`` gives
    the words below that share of all tokens one history together. Pairs seen ``hot_pair`` times, or as often as
    there are tokens in a partition, are counted beforehand; that changes no score."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    counts = materialise(rows.mapInArrow(_count_words, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    have = counts.agg(F.sum("n").alias("total"), F.count("*").alias("types"), F.sum(F.when(F.col("word") == int(END), F.col("n"))).alias("docs"),
                      *[F.count_if(F.col("n") == r).alias(f"n{r}") for r in range(1, K + 2)]).first()
    total = have["total"] or 0
    frequent = counts.where(F.col("n") >= max(1, total * (history_share or HOT_SHARE))).toArrow().to_pydict()  # at most 1 / share rows
    words = Words(total, have["types"], [0] + [have[f"n{r}"] for r in range(1, K + 2)], have["docs"] or 0, dict(zip(frequent["word"], frequent["n"])), history_share > 0)
    buckets = max(1, -(-total // bucket_tokens))
    hot_pair = max(K + 2, hot_pair or bucket_tokens)   # rarer pairs take part in the discounts
    if (words.counts >= hot_pair).any():
        hot = (rows.mapInArrow(_count_hot(words, hot_pair), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
               .where(F.col("n") >= hot_pair).orderBy("pair").toArrow().to_pydict())                    # at most total / hot_pair rows
        words.hot, words.hot_n = np.array(hot["pair"], np.int64), np.array(hot["n"], np.int64)
    path = new_path(docs.sparkSession, "katz")
    (rows.mapInArrow(_send(words, buckets), _SENT).groupBy("bucket").applyInArrow(_meet(words), _MET).write.partitionBy("kind").parquet(path))
    met = docs.sparkSession.read.schema(_MET).parquet(path)
    each = met.where("kind = 'histories'").select(F.posexplode("h").alias("i", "h"), "ns", "covered")
    n_at = [F.get("ns", F.col("i") * NS + r).alias(f"n{r + 1}") for r in range(NS)]
    hist = (each.select("h", F.get("covered", F.col("i")).alias("covered"), *n_at).groupBy("h")
            .agg(F.sum("covered").alias("covered"), *[F.sum(f"n{r + 1}").alias(f"n{r + 1}") for r in range(NS)])).toArrow().to_pydict()  # one row per numbered history
    ns = np.array([hist[f"n{r + 1}"] for r in range(NS)], np.int64).reshape(NS, -1)
    d = discounts([0, *ns.sum(1).tolist()])
    loss = [(1 - d[r]) * (r + 1) if r < K else 0.5 for r in range(NS)]
    log_a = np.zeros(len(words.numbered))
    at = np.array(hist["h"], np.int64)
    left, covered = np.zeros(len(log_a)), np.zeros(len(log_a))
    left[at], covered[at] = np.array(loss) @ ns, hist["covered"]
    hot_w, hot_h = np.divmod(words.hot, len(words.numbered))
    np.add.at(left, hot_h, loss[-1])
    np.add.at(covered, hot_h, words.unigram(words.counts[hot_w]))
    known = left > 0
    log_a[known] = np.log10(left[known] / np.maximum(1 - covered[known], 1e-12))
    per_token = -np.log10(total + have["types"] + 1)
    rare_sum = [F.sum(f"n{r + 1}") * F.lit(float(loss[r])) for r in range(NS)]
    rare = (met.where("kind = 'rare'").select("rare", "ns", "covered")
            .mapInArrow(_rare_histories, "h bigint, " + ", ".join(f"n{r + 1} bigint" for r in range(NS)) + ", covered double").groupBy("h")
            .agg(F.log10(sum(rare_sum[1:], rare_sum[0]) / F.greatest(1 - F.sum("covered"), F.lit(1e-12))).alias("add")))
    parts = met.where("kind = 'documents'").select("block", "doc", "fixed", "base", "known", "seen", "event_h", "event_doc", "ids", "tokens")
    events = met.where("kind = 'documents'").select("block", "rare", "rare_doc").mapInArrow(_rare_events, "h bigint, at bigint")
    doc = F.col("at").bitwiseAND(F.lit((1 << DOC_BITS) - 1)).cast("int")
    added = (events.join(rare, "h").groupBy("at").agg(F.sum("add").alias("add"))     # no row: nothing seen after it, alpha is 1
             .select(F.shiftright("at", DOC_BITS).alias("block"), doc.alias("doc"), "add").groupBy("block").agg(F.collect_list("doc").alias("rare_doc"), F.collect_list("add").alias("rare_add")))
    empty = {c: F.array().cast(t) for c, t in parts.dtypes if c != "block"}
    parts = (parts.withColumns({"rare_doc": F.array().cast("array<int>"), "rare_add": F.array().cast("array<double>")})
             .unionByName(added.withColumns(empty)))
    settle = _settle(d, log_a, per_token, math.log10(max(words.train_docs, 1)))
    scored = parts.groupBy("block").applyInArrow(settle, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score")


@query("op3_katz_scores")
def op3_katz_scores(spark, sf_dir):
    return score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))
