"""Alignment of two tokenizers over the same bytes, by pointer jumping.

A is a byte-level BPE file, B a SentencePiece BPE model; both are read on the driver and sent to the tasks. The two token
sequences of a text cover the same bytes (a blank and the text). Every token points to the overlapping token that ends
farthest right, at equal ends to A's; doubling all pointers at once, in a few array operations for many texts together,
takes every token to the last token of its component, and these terminal tokens number the groups. A group so is the
stretch between two places where tokens of both end.

Links are the pairs of tokens whose byte ranges end together. One of the two is then a suffix of the other, so the two
vocabularies alone bound the pairs that can ever be linked (`possible`, some hundred thousand); corpus-wide counts of them
are summed in the tasks first and are small enough to be sent to every task whatever the size of the corpus.

Defined results: NULL and empty texts, and texts whose tokens do not spell them (U+2581 is a blank to B), have no tokens:
NULL lists, zeros and the hash ''. Special tokens' names are plain text. NULL ids and repeated rows are rows like
others. Empty tables give empty tables. Other columns pass through `align` untouched, unless they have the name of an
output, which replaces them. Texts of any length go through whole; memory is linear in the longest.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import bounded_batches, stored

BYTE_BPE, PIECE_BPE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Characters of text taken at once.
AT_ONCE = 400_000
#: Texts of these characters give the same ids in the faster library; the classes of the others hang on the Unicode version.
PLAIN = re.compile("[\\t\\n\\r -~¡-ԯ]*")
#: How byte-level BPE cuts a text into words before merging; a fixed value.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others, in
    order, for U+0100 and on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def load(byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> dict:
    with open(byte_bpe, encoding="utf-8") as f:
        a = f.read()
    with open(piece_bpe, "rb") as f:
        b = f.read()
    return {"a": a, "b": b}


class Aligner:
    def __init__(self, files: dict):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(files["a"])
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=files["b"])
        vocab, letters = self.a.get_vocab(), byte_letters()
        added = {t["content"] for t in json.loads(files["a"]).get("added_tokens", [])}
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            if token not in added:
                self.bytes_a[i] = bytes(letters[c] for c in token)
        self.quick = self._quick(json.loads(files["a"]))
        self.bytes_b = [b""] * self.b.get_piece_size()
        for i in range(len(self.bytes_b)):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.bytes_b[i] = bytes([int(piece[3:5], 16)])
            elif not (self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_unused(i)):
                self.bytes_b[i] = piece.replace(BLANK, " ").encode()
        self.size_a = np.array([len(x) for x in self.bytes_a])
        self.size_b = np.array([len(x) for x in self.bytes_b])
        self._pairs = self._names = None

    # ---- tokens ----

    def _quick(self, file: dict):
        """The same tokenizer in a faster library, for plain characters; None unless the file merges in the order of ids
        and cuts words by WORDS."""
        model, cut = file["model"], file.get("pre_tokenizer") or {}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        made = [model["vocab"][x + y] for x, y in pairs]
        if (cut.get("type") != "ByteLevel" or not cut.get("use_regex", True) or cut.get("add_prefix_space") or file.get("normalizer")
                or model.get("dropout") or made != sorted(made) or len(made) + 256 != sum(map(bool, self.bytes_a))):
            return None
        import tiktoken

        ranks = {x: i for i, x in enumerate(self.bytes_a) if x}
        return tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of A and B of each text, None where they do not spell it."""
        quick = [bool(self.quick and PLAIN.fullmatch(x)) for x in texts]
        slow = iter(self.a.encode_batch([" " + x for x, q in zip(texts, quick) if not q], add_special_tokens=False))
        out = []
        for x, q, b in zip(texts, quick, self.b.encode(texts, num_threads=1)):
            a = self.quick(" " + x) if q else next(slow).ids
            whole = (" " + x).encode()
            same = b"".join(map(self.bytes_a.__getitem__, a)) == whole == b"".join(map(self.bytes_b.__getitem__, b))
            out.append((np.array(a, np.int32), np.array(b, np.int32)) if same else None)
        return out

    # ---- groups ----

    @staticmethod
    def groups(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Group of every A and B token, and the B token that ends with each group's last A token, from the ends of
        both sequences (rising, the last ones equal)."""
        n = len(end_a)
        to_b, to_a = np.searchsorted(end_b, end_a), np.searchsorted(end_a, end_b)
        at = np.arange(n)
        jump = np.concatenate([np.where(end_b[to_b] > end_a, n + to_b, at), to_a])
        while True:
            further = jump[jump]
            if np.array_equal(further, jump):
                break
            jump = further
        last = jump[:n] == at
        number = np.cumsum(last) - 1
        return number[jump[:n]], number[jump[n:]], to_b[last]

    @property
    def possible(self) -> np.ndarray:
        """All pairs of ids, as a * (size of B) + b, whose tokens can end together: one is a suffix of the other."""
        if self._pairs is None:
            by_bytes: dict[bytes, list[int]] = {}
            for i, x in enumerate(self.bytes_b):
                by_bytes.setdefault(x, []).append(i)
            n, found = len(self.bytes_b), set()
            for i, x in enumerate(self.bytes_a):
                found.update(i * n + j for k in range(len(x)) for j in by_bytes.get(x[k:], ()))
            by_bytes = {}
            for i, x in enumerate(self.bytes_a):
                by_bytes.setdefault(x, []).append(i)
            for j, x in enumerate(self.bytes_b):
                found.update(i * n + j for k in range(len(x)) for i in by_bytes.get(x[k:], ()))
            self._pairs = np.array(sorted(found), np.int64)
        return self._pairs

    @property
    def names(self) -> list[bytes]:
        """Decimal ids, A's before B's, each followed by one of three marks."""
        if self._names is None:
            self._names = [b"%d%s" % (i, m) for size, marks in ((len(self.bytes_a), b",|"), (len(self.bytes_b), b",;"))
                           for i in range(size) for m in (marks[:1], marks[1:])]
        return self._names

    def align(self, texts: list[str | None]) -> list[dict | None]:
        """Per text: a, b (ids), a_sizes, b_sizes (tokens of each group), links (places in `possible`), spelt (the groups
        as `a,a|b;a|b,b`), or None for a text without tokens."""
        wanted = [k for k, x in enumerate(texts) if x]
        out: list[dict | None] = [None] * len(texts)
        coded = [(k, x) for k, x in zip(wanted, self.tokens([texts[k] for k in wanted])) if x is not None]
        if not coded:
            return out
        a, b = (np.concatenate([x[s] for _, x in coded]) for s in (0, 1))
        group_a, group_b, with_b = self.groups(np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]))
        size_a, size_b = np.bincount(group_a), np.bincount(group_b)
        last_a, last_b = np.cumsum(size_a), np.cumsum(size_b)
        link = np.searchsorted(self.possible, a[last_a - 1].astype(np.int64) * len(self.bytes_b) + b[with_b]).astype(np.int32)
        # the ids in the order in which groups are spelt
        code = np.empty(len(a) + len(b), np.int64)
        mark = np.zeros(len(a), np.int64)
        mark[last_a - 1] = 1
        code[np.arange(len(a)) + (last_b - size_b)[group_a]] = 2 * a.astype(np.int64) + mark
        mark = np.zeros(len(b), np.int64)
        mark[last_b - 1] = 1
        code[np.arange(len(b)) + last_a[group_b]] = 2 * (len(self.bytes_a) + b.astype(np.int64)) + mark
        name = self.names.__getitem__
        i = j = g = 0
        for k, (x, y) in coded:
            i2, j2 = i + len(x), j + len(y)
            g2 = int(group_a[i2 - 1]) + 1
            out[k] = {"a": x, "b": y, "a_sizes": size_a[g:g2], "b_sizes": size_b[g:g2], "links": link[g:g2],
                      "spelt": lambda s=code[i + j:i2 + j2]: b"".join(map(name, s.tolist()))[:-1]}
            i, j, g = i2, j2, g2
        return out


def _aligner(held) -> Aligner:
    """One per Python worker, kept beside the files."""
    if "aligner" not in held.value:
        held.value["aligner"] = Aligner(held.value)
    return held.value["aligner"]


def _slices(batch, at):
    """Slices of a batch with about AT_ONCE characters of text each, at least one row."""
    sizes = np.array([len(x or "") for x in batch.column(at).to_pylist()]).cumsum()
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, before + AT_ONCE, "right")))
        yield batch.slice(start, stop - start)
        start = stop


INTS = T.ArrayType(T.IntegerType())
OUTPUTS = {"a_ids": INTS, "b_ids": INTS, "a_sizes": INTS, "b_sizes": INTS, "links": INTS, "n_a": T.LongType(), "n_b": T.LongType(),
           "n_groups": T.LongType(), "n_links": T.LongType(), "groups_sha256": T.StringType()}


def _column(name, found):
    ints = lambda key: pa.array([None if x is None else x[key] for x in found], pa.list_(pa.int32()))
    count = lambda key: pa.array([0 if x is None else len(x[key]) for x in found], pa.int64())
    if name == "groups_sha256":
        return pa.array(["" if x is None else hashlib.sha256(x["spelt"]()).hexdigest() for x in found], pa.string())
    counts = {"n_a": "a", "n_b": "b", "n_groups": "a_sizes", "n_links": "links"}
    return count(counts[name]) if name in counts else ints({"a_ids": "a", "b_ids": "b"}.get(name, name))


def _run(held, at, keep, want):
    def run(batches):
        own = _aligner(held)
        for whole in batches:
            for b in _slices(whole, at):
                found = own.align(b.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], *[_column(w, found) for w in want]],
                                                 names=[*[b.schema.names[i] for i in keep], *want])
    return run


def _aligned(docs, held, text_col, keep, want):
    ship(__name__)
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    kept = [i for i, x in enumerate(docs.columns) if x in keep and x not in want]
    schema = T.StructType([*[docs.schema.fields[i] for i in kept], *[T.StructField(w, OUTPUTS[w]) for w in want]])
    return docs.mapInArrow(_run(held, at, kept, want), schema)


def align(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, text_col: str = "text") -> DataFrame:
    """`docs` with a_ids and b_ids, the tokens of both, and a_sizes and b_sizes, the numbers of tokens of A and of B in
    each group, in order."""
    held = docs.sparkSession.sparkContext.broadcast(load(byte_bpe, piece_bpe))
    return _aligned(docs, held, text_col, docs.columns, ("a_ids", "b_ids", "a_sizes", "b_sizes"))


def _counted(batches):
    total = np.zeros(0, np.int64)
    for b in batches:
        links = b.column(0).flatten().to_numpy()
        if len(links):
            more = np.bincount(links, minlength=len(total))
            more[:len(total)] += total
            total = more
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["link", "n"])


def link_counts(linked: DataFrame) -> DataFrame:
    """link (place in `possible`) and n, how often it occurs in the corpus; `linked` has column links. No more rows than
    the vocabularies have possible pairs."""
    ship(__name__)
    return linked.select("links").mapInArrow(_counted, "link int, n long").groupBy("link").agg(F.sum("n").alias("n"))


def _judged(held, at):
    def run(batches):
        count, best = held.value
        for b in batches:
            lists = b.column(at)
            flat = lists.flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy())])
            summed = np.concatenate([[0], np.cumsum(count[flat])])[ends]
            good = np.concatenate([[0], np.cumsum(best[flat], dtype=np.int64)])[ends]
            others = [i for i in range(b.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in others], pa.array(np.diff(good)), pa.array(np.diff(summed))],
                                             names=[*[b.schema.names[i] for i in others], "n_best", "count_sum"])
    return run


def align_report(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose count in the corpus is the highest of their B
    id, ties included), count_sum (of its links' counts) and groups_sha256 (of the groups spelt `a,a|b;a|b,b`)."""
    spark = docs.sparkSession
    files = load(byte_bpe, piece_bpe)
    want = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links")
    table = stored(_aligned(docs.select(F.col("doc_id").cast("long"), "text"), spark.sparkContext.broadcast(files), "text", ["doc_id"], want), "aligned")
    own = Aligner(files)
    b_of = own.possible % len(own.bytes_b)
    count = np.zeros(len(own.possible), np.int64)
    for batch in link_counts(table).toArrow().to_batches():
        count[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    top = np.zeros(len(own.bytes_b), np.int64)
    np.maximum.at(top, b_of, count)
    held = spark.sparkContext.broadcast((count, count == top[b_of]))
    schema = T.StructType([f for f in table.schema.fields if f.name != "links"] + [T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    return table.mapInArrow(_judged(held, table.columns.index("links")), schema)
