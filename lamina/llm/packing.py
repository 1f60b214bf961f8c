"""Packing documents into token windows by order-preserving dynamic programming.

A task's documents, in their order, form one stream of ids.  Windows are cut
from it at points with a price: nothing at a document's end, a little at a
sentence's end, more at grid points between ids (only where sentences are far
apart).  The
cost of a window is its padding plus the price of its last cut; padding is what
is missing to WINDOW, or nothing if the length is a power of two.  For a cut at
position p the best earlier cut minimises cost(q) + q over p - WINDOW <= q < p,
which a monotone queue yields in constant amortised time; the power-of-two
lengths are looked up beside it.  The stream is solved in stretches of bounded
length, each at least cost by itself, and a stretch's last window carries over
into the next one.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 4096
#: Id that ends a document.
END = 2
#: Prices of a cut inside a document, in tokens of padding: at a sentence's end, and elsewhere.
SENTENCE, INSIDE = 8, 256
#: Ids of a stretch that is solved at once; distance of the priced cuts inside long sentences.
STRETCH, GRID = 1 << 19, 512
#: Words whose ids a worker remembers.
HELD = 600_000
VOCABULARY = "word_bpe_49k.json"

#: The vocabulary's pretokens, as its own pattern reads on lower-cased Latin-1 text.
_pretoken = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\t-\r \x85\xa0a-z0-9ªµºß-öø-ÿ²³¹¼-¾]+")
_lower = bytes(ord(chr(c).lower()) for c in range(256))
#: A byte that no UTF-8 text has; it marks a pretoken's end.
_close = b"\xff"


class Tokenizer(dict):
    """Ids of whole texts; as a dict, the packed ids of the words met so far.

    Texts within Latin-1 are split here, as the vocabulary's splitting is plain there (normal form C and
    lower-casing act letter by letter), and the ids of a word between white space are remembered.  The merges run
    in a byte-pair encoder over the same vocabulary: a pretoken's last byte and the end mark merge first,
    then all other pairs in the vocabulary's order.  Any other text goes through the public tokenizer.
    """

    def __init__(self, path: str | None = None) -> None:
        import json

        import tiktoken
        from tokenizers import Tokenizer as Public

        super().__init__()
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        self.public = Public.from_file(path)
        self.public.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        # the printable letters that stand for bytes: themselves where printable, else 256, 257, ... in order
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(plain))}
        byte = {c: b for b, c in letter.items()}

        def raw(token: str) -> bytes:
            body = token.removesuffix("</w>")
            return bytes(byte[c] for c in body) + _close * (body != token)

        order = [bytes([b]) for b in range(256)] + [bytes([b]) + _close for b in range(256) if b != 255]
        known = set(order)
        for pair in model["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            if (token := raw(left + right)) not in known:
                known.add(token)
                order.append(token)
        self.merge = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks={token: at for at, token in enumerate(order)}, special_tokens={})._encode_single_piece
        ids = {raw(token): at for token, at in model["vocab"].items() if not token.startswith("<|")}
        self.packed = [ids.get(token, 0).to_bytes(4, "little") for token in order]
        self.stop = np.zeros(max(model["vocab"].values()) + 1, bool)
        self.stop[[self.public.encode(sign, add_special_tokens=False).ids[-1] for sign in ".!?…。"]] = True

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= HELD:
            self.clear()
        body, mark = word[:-1], word[-1:]
        if mark in b",." and body.isalpha():  # a plain word and its stop are two pretokens
            packed = self[body] + self.packed[self.merge(mark + _close)[0]]
        else:
            pieces = (word,) if word.isalpha() else [piece.encode() for piece in _pretoken.findall(word.decode("latin-1"))]
            packed = b"".join([self.packed[at] for piece in pieces for at in self.merge(piece + _close)])
        self[word] = packed
        return packed

    def ids(self, text: str) -> np.ndarray:
        try:
            plain = text.encode("latin-1")
        except UnicodeEncodeError:
            return np.array(self.public.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.frombuffer(b"".join(map(self.__getitem__, plain.translate(_lower).split())), "<u4")


def cut_points(ids: np.ndarray, stop: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end, and their prices; `ends` are the documents' ends, the last one len(ids)."""
    price = np.full(len(ids) + 1, -1, np.int16)
    price[0] = 0
    price[1:][stop[ids]] = SENTENCE
    price[ends] = 0
    known = np.flatnonzero(price >= 0)
    wide = np.flatnonzero(np.diff(known) > GRID)
    for at in wide:
        price[np.arange(known[at] + GRID, known[at + 1], GRID)] = INSIDE
    where = np.flatnonzero(price >= 0)
    return where, price[where]


def windows(where: np.ndarray, price: np.ndarray, size: int = WINDOW) -> list[int]:
    """The cheapest cuts of positions where[0] .. where[-1] into windows of at most `size`; no gap may exceed it."""
    at, cost, back = where.tolist(), [0] * len(where), [0] * len(where)
    place = {p: i for i, p in enumerate(at)}
    powers = [1 << k for k in range(size.bit_length()) if 1 << k < size]
    queue: deque[int] = deque([0])  # cuts by rising cost + position: the best one first
    for i in range(1, len(at)):
        p = at[i]
        while at[queue[0]] < p - size:
            queue.popleft()
        j = queue[0]
        best, origin = cost[j] + size - (p - at[j]), j
        for length in powers:
            q = place.get(p - length)
            if q is not None and cost[q] < best:
                best, origin = cost[q], q
        cost[i], back[i] = best + int(price[i]), origin
        value = cost[i] + p
        while queue and cost[queue[-1]] + at[queue[-1]] >= value:
            queue.pop()
        queue.append(i)
    cuts, i = [], len(at) - 1
    while i:
        cuts.append(at[i])
        i = back[i]
    return cuts[::-1]


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"


def _pack(parts: Iterator[pa.RecordBatch], vocabulary: str | None, with_ids: bool) -> Iterator[pa.RecordBatch]:
    tokenizer = Tokenizer(vocabulary)
    sequence = TaskContext.get().partitionId() << 36
    docs: list[tuple[int | None, int, int]] = []  # id, ids before the held ones, all ids
    held: list[np.ndarray] = []
    total = 0

    def solve(last: bool) -> tuple[pa.RecordBatch, int]:
        """Rows of the windows of the held ids; all but the last window's unless this is the end."""
        ids = np.concatenate(held)
        ends = np.cumsum([len(x) for x in held])
        cuts = windows(*cut_points(ids, tokenizer.stop, ends))
        if last:
            tail = len(ids) - (cuts[-2] if len(cuts) > 1 else 0)  # lengths that are powers of two need no padding
            at, cuts = len(ids) - tail, cuts[:-1]
            for bit in range(WINDOW.bit_length() - 1, -1, -1):
                if tail >> bit & 1:
                    at += 1 << bit
                    cuts.append(at)
        else:
            cuts = cuts[:-1]
        out: dict[str, list] = {name: [] for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")}
        low, d, number = 0, 0, sequence
        starts = np.concatenate([[0], ends[:-1]])
        for high in cuts:
            begin = low
            while low < high:
                to = min(high, int(ends[d]))
                piece = ids[low:to].astype("<u4")
                doc_id, before, tokens = docs[d]
                for name, value in (("doc_id", doc_id), ("start", before + low - int(starts[d])), ("length", to - low), ("ids_crc32", zlib.crc32(piece.tobytes())), ("doc_tokens", tokens), ("sequence_id", number), ("offset", low - begin), ("ids", piece.astype(np.int32) if with_ids else None)):
                    out[name].append(value)
                low = to
                d += low == ends[d]
            number += 1
        types = {"ids": pa.list_(pa.int32())}
        return pa.RecordBatch.from_pydict({name: pa.array(column, types.get(name, pa.int64())) for name, column in out.items()}), low

    for part in parts:
        for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            ids = np.append(tokenizer.ids(text or ""), np.uint32(END))
            docs.append((doc_id, 0, len(ids)))
            held.append(ids)
            total += len(ids)
            if total >= STRETCH:
                rows, done = solve(False)
                yield rows
                sequence += len(np.unique(rows.column(5)))
                total -= done
                while done:
                    if len(held[0]) <= done:
                        done -= len(held.pop(0))
                        docs.pop(0)
                    else:
                        docs[0] = (docs[0][0], docs[0][1] + done, docs[0][2])
                        held[0], done = held[0][done:], 0
    if held:
        yield solve(True)[0]


def pack(docs: DataFrame, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece of a document.

    `docs` has doc_id and text.  Every document is the ids of its whole text and the id END; a null text is
    empty, so its document is END alone; null ids stay null; repeated rows are packed each; an empty table
    gives no rows.  `vocabulary` is the path of the tokenizer's file on every machine.  Pieces of a task's
    documents follow in order; sequence_id holds the task's number in its upper bits.  `with_ids` adds the
    pieces' ids.  Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lambda parts: _pack(parts, vocabulary, with_ids), SCHEMA)
    return rows if with_ids else rows.drop("ids")
