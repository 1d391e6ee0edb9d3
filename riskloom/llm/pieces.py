"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

The merges come from a public model file (read on the driver, 32,000 pieces, sent to the tasks). A text is cut where no
piece can reach across: before runs of blanks and around line ends. Each part goes through an agenda of candidate
merges, best score first, leftmost among equals; a candidate that comes up is skipped when a keyed hash of (seed,
document id, number of the part, place and length of the merge) falls under the dropout rate. Segmentations so depend on
the seed, the document and the place only, never on task order, and repeat after a lost executor; every occurrence of a
word has a draw of its own. What does not hang on the draw is remembered: the undropped segmentation of a part and the
merges that lead to it. An occurrence that skips none of them is that segmentation; the others go through the agenda.

With dropout 0 the ids equal those of the library (save for U+2581, which the library turns into a blank; here it goes
through byte pieces, so that every text decodes to itself).

Defined results: NULL texts give NULL ids and decode to NULL; empty texts give no ids. Repeated rows of one id give
equal ids; rows without id draw by their text. Empty tables give empty tables. Output columns replace columns of the
input with their names.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import bounded_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
MASK = (1 << 64) - 1
#: Characters of parts whose undropped segmentation one Python worker remembers before it starts anew, documents taken at
#: once, occurrences of parts drawn at once, and the longest part that is remembered (longer ones always run on their own).
REMEMBERED, AT_ONCE, DRAWN_AT_ONCE, SHORT = 1_500_000, 250, 200_000, 32
#: Multipliers of the hash that decides a skip.
BY_PLACE, BY_LENGTH, MIX, MIX2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53


def load(path: str = MODEL) -> dict:
    """Pieces of the model: rank of each piece by score, its id, and what each id decodes to."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    size = sp.get_piece_size()
    bytes_of, ids, score, byte_id = [b""] * size, {}, {}, [sp.unk_id()] * 256
    for i in range(size):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            value = int(piece[3:5], 16)
            byte_id[value], bytes_of[i] = i, bytes([value])
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            ids[piece], score[piece] = i, -sp.get_score(i)
            bytes_of[i] = piece.replace(BLANK, " ").encode()
    # a cut before blanks or beside a line end is safe if no piece reaches across it
    words = not any(BLANK in p.lstrip(BLANK) for p in ids)
    lines = not any("\n" in p for p in ids)
    return {"ids": ids, "cost": score, "bytes": bytes_of, "byte_id": byte_id, "words": words, "lines": lines}


class PairTable:
    """Which two symbols merge, as arrays: symbols are pieces and the single characters of pieces."""

    def __init__(self, ids: dict[str, int], cost: dict[str, float]):
        self.symbols = list(ids)
        number = {p: k for k, p in enumerate(self.symbols)}
        for p in ids:
            for c in p:
                if c not in number:
                    number[c] = len(self.symbols)
                    self.symbols.append(c)
        self.piece_id = np.array([ids.get(x, -1) for x in self.symbols], np.int32)
        self.length = np.array([len(x) for x in self.symbols], np.uint64)
        self.char = np.full(0x110000, -1, np.int32)
        for x in self.symbols:
            if len(x) == 1:
                self.char[ord(x)] = number[x]
        levels = {c: k for k, c in enumerate(sorted(set(cost.values())))}
        pairs = [(number[p[:k]] << 32 | number[p[k:]], levels[cost[p]], number[p])
                 for p in ids for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        pairs.sort()
        self.key = np.array([x[0] for x in pairs], np.int64)
        self.level = np.array([x[1] for x in pairs], np.int32)
        self.merged = np.array([x[2] for x in pairs], np.int32)
        self._place()

    def _place(self) -> None:
        """Deal the pairs to slots, eight times as many, by a hash; one whose slot is taken goes to the next free one."""
        bits = (8 * len(self.key)).bit_length()
        self.shift = np.uint64(64 - bits)
        self.slot = np.full(1 << bits, -1, np.int32)
        last = (1 << bits) - 1
        for x, at in enumerate(self._slots(self.key).tolist()):
            while self.slot[at] >= 0:
                at = at + 1 & last
            self.slot[at] = x
        # a free slot holds a key that no pair has
        self.slot_key = np.where(self.slot >= 0, self.key[self.slot], FREE) if len(self.key) else np.full(1 << bits, FREE)

    def _slots(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (key.view(np.uint64) * np.uint64(BY_PLACE) >> self.shift).astype(np.int64)

    def find(self, left, right):
        """Level (NEVER if the two do not merge) and merged symbol."""
        k = (left.astype(np.int64) << 32 | right).ravel()         # negative where one of them is
        at = self._slots(k)
        held = self.slot_key[at]
        ok = held == k
        level, merged = np.full(len(k), NEVER, np.int32), np.zeros(len(k), np.int32)
        on = np.flatnonzero(~ok & (held != FREE) & (k >= 0))
        while len(on):
            at[on] = at[on] + 1 & len(self.slot) - 1
            held = self.slot_key[at[on]]
            ok[on] = held == k[on]
            on = on[(held != k[on]) & (held != FREE)]
        pair = self.slot[at[ok]]
        level[ok], merged[ok] = self.level[pair], self.merged[pair]
        return level.reshape(left.shape), merged.reshape(left.shape)


NEVER, FREE = np.int32(2**31 - 1), np.int64(-(1 << 63))


def gather(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of runs of the given sizes, one run after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


class Encoder:
    def __init__(self, model: dict, dropout: float = 0.1, seed: int = 0):
        self.ids, self.cost, self.byte_id, self.bytes = model["ids"], model["cost"], model["byte_id"], model["bytes"]
        self.words, self.lines = model["words"], model["lines"]
        self.seed = seed
        self.limit = int(dropout * (1 << 32))
        self.pairs = PairTable(self.ids, self.cost)
        self.forget()

    def forget(self) -> None:
        """Undropped ids and merges of the known parts, one after the other, and where each part's begin."""
        self.known: dict[str, int] = {}
        self.held = 0
        self.plain, self.merges = np.zeros(0, np.int32), np.zeros(0, np.uint64)
        self.plain_at, self.merges_at = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def key(self, doc, text: str) -> int:
        """A document's key: from its id, or from its text where it has none."""
        data = b"t" + text.encode("utf-8", "surrogatepass") if doc is None else f"d{doc}".encode()
        return xxhash.xxh64_intdigest(data, self.seed & MASK)

    @staticmethod
    def part_keys(keys: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Key of each occurrence from its document's key and its number in the document."""
        with np.errstate(over="ignore"):
            z = keys + (number.astype(np.uint64) + np.uint64(1)) * np.uint64(BY_PLACE)
            z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
            return z ^ z >> np.uint64(31)

    def skipped(self, key: np.ndarray, merge: np.ndarray) -> np.ndarray:
        """Whether the draw of an occurrence skips a merge; merge: place * BY_PLACE + length * BY_LENGTH."""
        with np.errstate(over="ignore"):
            x = (key ^ merge) * np.uint64(MIX)
            return ((x ^ x >> np.uint64(29)) * np.uint64(MIX2) >> np.uint64(32)) < np.uint64(self.limit)

    def parts(self, text: str) -> list[str]:
        """Parts that are segmented on their own; joined they are the text with its leading blank."""
        if not text:
            return []
        if not self.words:
            return [BLANK + text.replace(" ", BLANK)]
        out, blanks = [], 1
        for k, line in enumerate(text.split("\n") if self.lines else [text]):
            if k:
                if blanks:
                    out.append(BLANK * blanks)
                out.append("\n")
                blanks = 0
            if "  " not in line and line[-1:] != " " and line[:1] != " ":
                if line:
                    first, *rest = line.split(" ")
                    out.append(BLANK * blanks + first)
                    out += [BLANK + w for w in rest]
                    blanks = 0
                continue
            for j, w in enumerate(line.split(" ")):
                blanks += j > 0
                if w:
                    out.append(BLANK * blanks + w)
                    blanks = 0
        if blanks:
            out.append(BLANK * blanks)
        return out

    def segment(self, part: str, key: int | None = None, literal: bool = False) -> tuple[list[int], list[int]]:
        """Ids of one part and the merges that were made, through the agenda; without a key none is skipped. literal: the part
        holds U+2581 of the text itself, marked as U+0000 + U+2581 before."""
        cost, limit = self.cost, 0 if key is None else self.limit
        sym = re.findall("\x00▁|.", part, re.S) if literal else list(part)
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda, made = [], []
        for i in range(n - 1):
            c = cost.get(sym[i] + sym[i + 1])
            if c is not None:
                agenda.append((c, i, i + 1, sym[i] + sym[i + 1]))
        heapq.heapify(agenda)
        while agenda:
            c, i, j, piece = heapq.heappop(agenda)
            if sym[i] is None or sym[j] is None or after[i] != j or sym[i] + sym[j] != piece:
                continue
            merge = i * BY_PLACE + len(piece) * BY_LENGTH & MASK
            if limit:
                x = (key ^ merge) * MIX & MASK
                if (x ^ x >> 29) * MIX2 >> 32 & 0xFFFFFFFF < limit:
                    continue
            made.append(merge)
            sym[i], sym[j] = piece, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                merged = piece + sym[k]
                c = cost.get(merged)
                if c is not None:
                    heapq.heappush(agenda, (c, i, k, merged))
            h = before[i]
            if h >= 0:
                merged = sym[h] + piece
                c = cost.get(merged)
                if c is not None:
                    heapq.heappush(agenda, (c, h, i, merged))
        ids, out = self.ids, []
        for s in sym:
            if s is not None:
                i = ids.get(s)
                if i is None:
                    out += [self.byte_id[b] for b in s.lstrip("\x00" if literal and len(s) > 1 else "").encode()]
                else:
                    out.append(i)
        return out, made

    def segment_many(self, wanted: list[str], key: np.ndarray | None = None, part: np.ndarray | None = None):
        """`segment` for many short parts at once: the same agenda, one candidate of every part per round. Ids of all parts,
        their count per part, and the same of the merges (only without keys). part: which of the parts each row is, where
        parts occur more than once; what all rows of a part start from is worked out once."""
        table, m = self.pairs, len(wanted)
        size = np.fromiter(map(len, wanted), np.int64, m)
        width = int(size.max())
        codes = np.frombuffer("".join(wanted).encode("utf-32-le"), np.uint32)
        sym = np.full((m, width + 1), -1, np.int32)
        sym[np.repeat(np.arange(m), size), gather(np.zeros(m, np.int64), size)] = table.char[codes]
        level = np.full((m, width + 1), NEVER, np.int32)
        merged = np.zeros((m, width + 1), np.int32)
        level[:, :-1], merged[:, :-1] = table.find(sym[:, :-1], sym[:, 1:])
        if part is not None:
            m, sym, level, merged = len(part), sym[part], level[part], merged[part]
        after = np.broadcast_to(np.arange(1, width + 2, dtype=np.int32), (m, width + 1)).copy()
        before = np.broadcast_to(np.arange(-1, width, dtype=np.int32), (m, width + 1)).copy()
        live, rows, merges = np.arange(m), [], []
        # cells of the tables by one number, row * wide + place
        wide = width + 1
        sym_, after_, before_, level_, merged_ = (x.reshape(-1) for x in (sym, after, before, level, merged))
        with np.errstate(over="ignore"):
            while len(live):
                i = level[live].argmin(1)
                at = live * wide + i
                go = level_[at] < NEVER
                r, i, at = live[go], i[go], at[go]
                live = r
                piece = merged_[at]
                merge = i.astype(np.uint64) * np.uint64(BY_PLACE) + table.length[piece] * np.uint64(BY_LENGTH)
                if key is None:
                    rows.append(r)
                    merges.append(merge)
                elif self.limit:
                    skip = self.skipped(key[r], merge)
                    level_[at[skip]] = NEVER
                    stay = ~skip
                    r, i, at, piece = r[stay], i[stay], at[stay], piece[stay]
                base = at - i
                j = base + after_[at]
                k = after_[j]
                end = base + np.minimum(k, width)
                sym_[at], sym_[j], level_[j] = piece, -1, NEVER
                after_[at] = k
                before_[end] = i
                level_[at], merged_[at] = table.find(piece, sym_[end])
                h = before_[at]
                has = h >= 0
                h, piece = (base + h)[has], piece[has]
                level_[h], merged_[h] = table.find(sym_[h], piece)
        alive = sym >= 0
        row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        merge = np.concatenate(merges)[np.argsort(row, kind="stable")] if rows else np.zeros(0, np.uint64)
        return table.piece_id[sym[alive]], alive.sum(1), merge, np.bincount(row, minlength=m)

    def whole(self, wanted: list[str]) -> np.ndarray:
        """Which short parts are made of characters that are pieces; the others go through bytes."""
        codes = self.pairs.char[np.frombuffer("".join(wanted).encode("utf-32-le", "surrogatepass"), np.uint32)]
        size = np.fromiter(map(len, wanted), np.int64, len(wanted))
        return np.logical_and.reduceat((codes >= 0) & (self.pairs.piece_id[codes] >= 0), np.cumsum(size) - size)

    def run(self, wanted: list[str], key: np.ndarray | None = None, part: np.ndarray | None = None):
        """Ids, counts, merges and their counts of many parts in the given order: short plain ones in blocks of like length,
        others one by one. part: as in `segment_many`."""
        part = np.arange(len(wanted)) if part is None else part
        size = np.fromiter(map(len, wanted), np.int64, len(wanted))
        many = (size > 1) & (size <= SHORT)
        if many.any():
            at = np.flatnonzero(many)
            many[at] = self.whole([wanted[x] for x in at])
        many, size = many[part], size[part]
        order, found = [], []
        for alike in np.unique((size[many] + 3) // 4):
            at = np.flatnonzero(many & ((size + 3) // 4 == alike))
            for k in range(0, len(at), 20_000):
                block = at[k:k + 20_000]
                order.append(block)
                here, row = np.unique(part[block], return_inverse=True)
                found.append(self.segment_many([wanted[x] for x in here], None if key is None else key[block], row))
        rest = np.flatnonzero(~many)
        if len(rest):
            one = [self.segment(wanted[part[x]], None if key is None else int(key[x])) for x in rest]
            order.append(rest)
            found.append((np.array([i for ids, _ in one for i in ids], np.int32), np.array([len(ids) for ids, _ in one]),
                          np.array([i for _, made in one for i in made], np.uint64), np.array([len(made) for _, made in one])))
        back = np.argsort(np.concatenate(order))
        out = []
        for flat, count in ((0, 1), (2, 3)):
            n = np.concatenate([f[count] for f in found]).astype(np.int64)
            start = (np.cumsum(n) - n)[back]
            out += [np.concatenate([f[flat] for f in found])[gather(start, n[back])] if key is None or flat == 0 else None, n[back]]
        return out

    def learn(self, wanted: list[str]) -> None:
        """Remember the undropped ids and merges of parts; of long ones only that they are always run."""
        if not wanted:
            return
        self.held += sum(map(len, wanted))
        ids, n, merges, made = self.run(wanted)
        self.known.update(zip(wanted, range(len(self.known), len(self.known) + len(wanted))))
        self.plain, self.merges = np.concatenate([self.plain, ids]), np.concatenate([self.merges, merges])
        self.plain_at = np.concatenate([self.plain_at, self.plain_at[-1] + np.cumsum(n)])
        self.merges_at = np.concatenate([self.merges_at, self.merges_at[-1] + np.cumsum(made)])

    def occurrences(self, flat: list[str], key: np.ndarray):
        """Ids and counts of occurrences of parts with their keys."""
        always = np.fromiter(map(len, flat), np.int64, len(flat)) > SHORT
        at = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int64, len(flat))
        again = always.copy()
        if self.limit:
            start = np.where(always, 0, self.merges_at[at])
            made = np.where(always, 0, self.merges_at[at + 1] - start)
            skip = self.skipped(np.repeat(key, made), self.merges[gather(start, made)])
            again[np.repeat(np.arange(len(flat)), made)[skip]] = True
        start = np.where(again, 0, self.plain_at[at])
        n = np.where(again, 0, self.plain_at[at + 1] - start)
        source = self.plain
        if again.any():
            mine = np.flatnonzero(again)
            which = np.where(always[mine], len(self.known) + np.arange(len(mine)), at[mine])
            _, first, part = np.unique(which, return_index=True, return_inverse=True)
            ids, size, _, _ = self.run([flat[x] for x in mine[first]], key[mine], part)
            source = np.concatenate([source, ids])
            start[mine], n[mine] = len(self.plain) + np.cumsum(size) - size, size
        return source[gather(start, n)], n

    def encode_all(self, texts: list[str], docs: list) -> list[np.ndarray]:
        """docs: the ids of the texts' documents."""
        if self.held > REMEMBERED:
            self.forget()
        keys = np.array([self.key(d, t) for d, t in zip(docs, texts)], np.uint64)
        cut = [[] if BLANK in text else self.parts(text) for text in texts]
        flat = [p for parts in cut for p in parts]
        self.learn([p for p in dict.fromkeys(flat) if len(p) <= SHORT and p not in self.known])
        size = np.fromiter(map(len, cut), np.int64, len(cut))
        drawn = self.part_keys(np.repeat(keys, size), gather(np.zeros(len(cut), np.int64), size))
        ids, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for k in range(0, len(flat), DRAWN_AT_ONCE):
            i, n = self.occurrences(flat[k:k + DRAWN_AT_ONCE], drawn[k:k + DRAWN_AT_ONCE])
            ids.append(i)
            counts.append(n)
        ids, ends = np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(counts))])[np.concatenate([[0], np.cumsum(size)])]
        out = [ids[a:z] for a, z in zip(ends[:-1], ends[1:])]
        for i, text in enumerate(texts):
            if BLANK in text:
                part = BLANK + text.replace(BLANK, "\x00" + BLANK).replace(" ", BLANK)
                out[i] = np.array(self.segment(part, int(self.part_keys(keys[i:i + 1], np.zeros(1))[0]), True)[0], np.int32)
        return out

    def encode(self, text: str, doc=0) -> np.ndarray:
        return self.encode_all([text], [doc])[0]

    def decode(self, ids) -> str:
        table = self.bytes
        text = b"".join(map(table.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def _encoder(held, dropout, seed):
    """One encoder per Python worker, kept beside the broadcast pieces."""
    key = ("encoder", dropout, seed)
    if key not in held.value:
        held.value[key] = Encoder(held.value, dropout, seed)
    return held.value[key]


def _each(coder, texts, docs):
    coded = iter(coder.encode_all([x for x in texts if x is not None], [d for x, d in zip(texts, docs) if x is not None]))
    return [None if x is None else next(coded) for x in texts]


def _encode(held, at, id_at, want, *how):
    """want: which of ids, size, sha (of the ids), same (they decode to the text) to add."""
    def run(batches):
        coder = _encoder(held, *how)
        for whole in batches:
            for k in range(0, whole.num_rows, AT_ONCE):
                b = whole.slice(k, AT_ONCE)
                texts = b.column(at).to_pylist()
                coded = _each(coder, texts, b.column(id_at).to_pylist())
                made = {
                    "ids": lambda: pa.array(coded, pa.list_(pa.int32())),
                    "size": lambda: pa.array([None if x is None else len(x) for x in coded], pa.int64()),
                    "sha": lambda: pa.array([None if x is None else hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in coded], pa.string()),
                    "same": lambda: pa.array([None if x is None else coder.decode(x.tolist()) == t for x, t in zip(coded, texts)], pa.bool_())}
                yield pa.RecordBatch.from_arrays([*b.columns, *[made[w]() for w in want]], names=[*b.schema.names, *[f"__{w}" for w in want]])
    return run


KINDS = {"ids": T.ArrayType(T.IntegerType()), "size": T.LongType(), "sha": T.StringType(), "same": T.BooleanType()}


def _coded(docs, path, dropout, seed, text_col, id_col, want):
    ship(__name__)
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(load(path))
    schema = T.StructType([*docs.schema.fields, *[T.StructField(f"__{w}", KINDS[w]) for w in want]])
    return docs.mapInArrow(_encode(held, docs.columns.index(text_col), docs.columns.index(id_col), want, dropout, seed), schema)


def encode(docs: DataFrame, path: str = MODEL, dropout: float = 0.1, seed: int = 42,
           text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """`docs` with ids, the piece ids of the whole text, and lossless: whether they decode to it."""
    out = _coded(docs, path, dropout, seed, text_col, id_col, ("ids", "same"))
    return out.withColumns({"ids": F.col("__ids"), "lossless": F.col("__same")}).drop("__ids", "__same")


def encode_report(docs: DataFrame, path: str = MODEL, dropout: float = 0.1, seed: int = 42) -> DataFrame:
    """doc_id, n_pieces, ids_sha256 (of the ids as little-endian 32-bit numbers) and lossless (they decode to the text)."""
    out = _coded(docs.select("doc_id", "text"), path, dropout, seed, "text", "doc_id", ("size", "sha", "same"))
    return out.select("doc_id", F.col("__size").alias("n_pieces"), F.col("__sha").alias("ids_sha256"), F.col("__same").alias("lossless"))


def _decode(held, at):
    def run(batches):
        coder = Encoder(held.value)
        for b in batches:
            text = [None if x is None else coder.decode(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], names=[*b.schema.names, "__text"])
    return run


def decode(encoded: DataFrame, path: str = MODEL, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """`encoded` with the text of its piece ids."""
    ship(__name__)
    bounded_batches(encoded.sparkSession)
    held = encoded.sparkSession.sparkContext.broadcast(load(path))
    schema = T.StructType([*encoded.schema.fields, T.StructField("__text", T.StringType())])
    out = encoded.mapInArrow(_decode(held, encoded.columns.index(ids_col)), schema)
    return out.withColumn(text_col, F.col("__text")).drop("__text")
