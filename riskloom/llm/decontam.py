"""Remove passages of test items from documents.

A generalised suffix automaton of the items' words finds, at every document word, the longest stretch ending there that
also stands in an item. The automaton holds only item words; a document word that no item has ends every match, so runs
of other words cost one dictionary look-up each. Items are read in blocks of a bounded number of words and each block's
automaton is sent to the tasks; documents never move.

Defined results: words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z; NULL has none. An item with
fewer words than the window is one window, an item without words none. Several rows with one item_id are one item; an
item without id hits words but is not listed. Repeated documents are judged alike. No items: nothing is hit. The found
columns replace columns of the input with their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import bounded_batches, stored

#: Lower-cases A-Z and turns every byte outside 0-9, a-z and non-ASCII into a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Words of items in one automaton; a state takes a few hundred bytes.
BLOCK_WORDS = 1_000_000


class Automaton:
    """Suffix automaton over word numbers, one string after another (never across items)."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.len = [0]
        self.ids = sorted({i for i, _ in items if i is not None})
        number = {x: k for k, x in enumerate(self.ids)}
        strings = []
        for i, words in items:
            if words:
                strings.append((number.get(i, -1), [self.vocab.setdefault(w, len(self.vocab)) for w in words]))
                self._add(strings[-1][1])
        self.shortest = min((min(len(w), window) for _, w in strings), default=1)
        self.whole: dict[int, dict[int, set[int]]] = {}      # state of short items: items by length
        self.windows: dict[int, set[int]] = {}               # state of a window: its items
        for k, words in strings:
            self._mark(k, words)
        order = sorted(range(1, len(self.len)), key=self.len.__getitem__)
        self.short = [-1] * len(self.len)                    # nearest state upwards that is a short item
        for s in order:
            self.short[s] = s if s in self.whole else self.short[self.link[s]]

    def _add(self, words):
        last = 0
        for w in words:
            last = self._extend(last, w)

    def _extend(self, last, w):
        nxt, link, length = self.next, self.link, self.len
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(length)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p, w, q):
        nxt, link, length = self.next, self.link, self.len
        copy = len(length)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = copy
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        return copy

    def _mark(self, item, words):
        """Which states stand for a window of this item."""
        state = 0
        for n, w in enumerate(words, 1):
            state = self.next[state][w]
            if n >= self.window:
                at = self.holding(state, self.window)
                self.windows.setdefault(at, set()).add(item)
        if len(words) < self.window:
            self.whole.setdefault(self.holding(state, len(words)), {}).setdefault(len(words), set()).add(item)

    def holding(self, state, n):
        """The state upwards whose strings include the one of length n."""
        while self.len[self.link[state]] >= n:
            state = self.link[state]
        return state

    def longest(self, numbers):
        """For each word: the state reached and the length of the longest match that ends with it."""
        state, n = 0, 0
        for w in numbers:
            nxt = self.next[state]
            while w not in nxt and state:
                state = self.link[state]
                n = self.len[state]
                nxt = self.next[state]
            if w in nxt:
                state = nxt[w]
                n += 1
            yield state, n

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit stretches [from, to) in word positions, merged and in order, and the items found."""
        get = self.vocab.get
        numbers = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
        known = np.flatnonzero(np.diff(np.r_[False, numbers >= 0, False].astype(np.int8)))
        spans, items, window = [], set(), self.window
        for a, b in zip(known[::2].tolist(), known[1::2].tolist()):
            if b - a < self.shortest:
                continue
            for i, (state, n) in enumerate(self.longest(numbers[a:b].tolist()), a + 1):
                size = 0
                if n >= window:
                    items |= self.windows[self.holding(state, window)]
                    size = window
                s = self.short[state]
                while s > 0:
                    for length, found in self.whole[s].items():
                        if length <= n:
                            items |= found
                            size = max(size, length)
                    s = self.short[self.link[s]]
                if size:
                    start = i - size
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, i))
        return spans, items


def _words(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def _find(items, window):
    def run(batches):
        held = items.value                                   # one per Python worker, so the automaton is built once there
        if "automaton" not in held:
            held["automaton"] = Automaton([(i, _words(x)) for i, x in held["items"]], window)
        automaton = held["automaton"]
        for b in batches:
            n, starts, ends, found = [], [], [], []
            for text in b.column(0).cast(pa.binary()).to_pylist():
                words = _words(text)
                spans, hit = automaton.hits(words)
                n.append(len(words))
                starts.append([a for a, _ in spans])
                ends.append([z for _, z in spans])
                found.append([automaton.ids[k] for k in sorted(hit) if k >= 0])
            arrays = [pa.array(n, pa.int64()), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())),
                      pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *arrays], names=[*b.schema.names, *FOUND.names])
    return run


FOUND = T.StructType([T.StructField("__n", T.LongType()), T.StructField("__from", T.ArrayType(T.IntegerType())),
                      T.StructField("__to", T.ArrayType(T.IntegerType())), T.StructField("__items", T.ArrayType(T.StringType()))])


def _blocks(items: DataFrame, id_col: str, text_col: str, block_words: int) -> list[DataFrame]:
    """Items in blocks of about `block_words` words; one item never spans two blocks, nor do rows of one id matter."""
    size = items.agg(F.sum(F.length(text_col) / 2 + 1).alias("n")).first().n or 0       # never below the words
    blocks = int(size // block_words) + 1
    rows = items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("x")).filter("x is not null")
    return [rows.filter(F.pmod(F.xxhash64("x"), F.lit(blocks)) == k) for k in range(blocks)] if blocks > 1 else [rows]


def mark_hits(docs: DataFrame, items: DataFrame, window: int = 10, text_col: str = "text", item_id: str = "item_id",
              item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """`docs` with __n (words), the hit stretches __from and __to in word positions and the ids __items found."""
    ship(__name__)
    spark = docs.sparkSession
    bounded_batches(spark)
    out = None
    for k, block in enumerate(blocks := _blocks(items, item_id, item_text, block_words)):
        held = spark.sparkContext.broadcast({"items": [(r.i, r.x.encode()) for r in block.collect()]})
        held_rows = docs if out is None else out
        body = held_rows.select(F.col(f"`{text_col}`"), *[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(held_rows.columns)])
        schema = T.StructType([*body.schema.fields, *FOUND.fields])
        found = body.mapInArrow(_find(held, window), schema)
        found = found.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(held_rows.columns)],
                             *([F.col(c) for c in FOUND.names] if out is None else [F.col(c).alias(f"{c}2") for c in FOUND.names]))
        if out is not None:
            found = found.withColumns({c: F.concat(c, f"{c}2") for c in FOUND.names[1:]}).drop(*[f"{c}2" for c in FOUND.names])
        out = found if len(blocks) == 1 else stored(found, f"hits-{k}")
    return out


def _merge(starts, ends):
    out = []
    for a, z in sorted(zip(starts, ends)):
        if out and out[-1][1] >= a:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return out


def _report(batches):
    for b in batches:
        hits, n_items, shas = [], [], []
        for starts, ends, items in zip(*[b.column(i).to_pylist() for i in (2, 3, 4)]):
            hits.append(sum(z - a for a, z in _merge(starts, ends)))
            ids = sorted(set(items))
            n_items.append(len(ids))
            shas.append(hashlib.sha256(",".join(ids).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(hits, pa.int64()), pa.array(n_items, pa.int64()), pa.array(shas)],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256"])


def hit_report(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256 (of the sorted ids, comma-joined), contaminated."""
    marked = mark_hits(docs.select("doc_id", "text"), items, window).select("doc_id", *FOUND.names)
    return marked.mapInArrow(_report, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string") \
        .withColumn("contaminated", F.col("n_hit") > 0)


def _cut(at: int, width: int, min_words: int, max_share: float):
    def strip(text, n, starts, ends):
        """The text without its hit stretches, or None if they are too large a part of it."""
        spans = [s for s in _merge(starts, ends) if s[1] - s[0] >= min_words]
        if not spans:
            return text
        if sum(z - a for a, z in spans) > max_share * n:
            return None
        folded = np.frombuffer(text.translate(FOLD), np.uint8) != 32
        edge = np.diff(np.r_[False, folded, False].astype(np.int8))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        out, done = [], 0
        for a, z in spans:
            out.append(text[done:first[a]])
            done = last[z - 1]
        return b"".join([*out, text[done:]])

    def run(batches):
        for b in batches:
            texts = b.column(at).cast(pa.binary()).to_pylist()
            cols = [b.column(width + i).to_pylist() for i in range(3)]
            new = [x if x is None else strip(x, *rest) for x, *rest in zip(texts, *cols)]
            stay = [i for i, (x, y) in enumerate(zip(texts, new)) if x is None or y is not None]
            kept = b.take(pa.array(stay, pa.int64()))
            arrays = [kept.column(i) for i in range(width)]
            arrays[at] = pa.array([new[i] for i in stay], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=b.schema.names[:width])
    return run


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, min_span: int = 0, max_coverage: float = 0.5,
                  text_col: str = "text") -> DataFrame:
    """`docs` with hit stretches of `min_span` words or more cut out; documents of which they cover more than
    `max_coverage` go. Separators around a cut stay as they are."""
    marked = mark_hits(docs, items, window, text_col)
    names = docs.columns
    return marked.select(*[F.col(f"`{x}`") for x in names], "__n", "__from", "__to").mapInArrow(
        _cut(names.index(text_col), len(names), min_span, max_coverage), docs.schema)
