"""Packing of tokenized documents into sequences of bounded length by swap-based local search.

Documents longer than a sequence are cut; the pieces are dealt at random into groups of bounded
size, each packed in a task of its own: best fit in order of falling length first, then a
local search over the underfull bins. The emptiest bin gives: a piece of it moves to the bin
that it fills best; or it is exchanged for a smaller one, one for one, two for one or one for two,
such that the other bin gets fuller by the difference. As the giver is the emptiest, every
exchange increases the sum of squared fills, so the search ends, and a giver that has become
small enough is dissolved. It stops early where the number of bins meets a lower bound. What
is still far from full in any group is opened and packed once more in fewer, new groups.
"""
from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docspark.session import materialize

from .bpe import byte_symbols
from .bytetext import chunks
from .common import record

GROUP = 16_384   # pieces that are packed together
ROUNDS = 2
LOOSE = 16       # a bin with more than 1/16 of it free is opened for the next round

#: How byte-level vocabularies of this kind cut a text, and blocks of code points that the two libraries
#: class alike (tested one by one); a text with any other is left to the tokenizers library.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ALIKE = "\0-ſΑ-ΡЀ-џ‐-‧₠-₵ぁ-ゖ一-龥가-힣"
RUN = 4096       # a run of so many characters without a blank, or of blanks, is left to the tokenizers library, too


class Encoder:
    """Token ids of whole texts as the tokenizers library gives them for a byte-level BPE file.

    Most texts are encoded by tiktoken with the same vocabulary, which is several times faster.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.file = f.read()
        self._ready = False

    def __getstate__(self):
        return {"file": self.file, "_ready": False}

    def ready(self) -> "Encoder":
        if not self._ready:
            spec = json.loads(self.file)
            self.whole = Tokenizer.from_str(self.file)
            self.whole.no_truncation()
            self.whole.no_padding()
            back = {c: bytes([b]) for b, c in enumerate(byte_symbols())}
            ranks = {b"".join(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if all(c in back for c in token)}
            special = {t["content"]: t["id"] for t in spec["added_tokens"]}
            ranks = {t: i for t, i in ranks.items() if i not in set(special.values())}
            merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
            first = len(ranks) - len(merges)
            vocab = spec["model"]["vocab"]
            by_rank = all(vocab[a + b] == first + k for k, (a, b) in enumerate(merges))
            plain = spec["normalizer"] is None and spec["pre_tokenizer"]["type"] == "ByteLevel" and spec["pre_tokenizer"]["use_regex"] \
                and not spec["pre_tokenizer"]["add_prefix_space"]
            self.fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special) if by_rank and plain else None
            self.odd = re.compile(f"[^{ALIKE}]|\\S{{{RUN}}}|\\s{{{RUN}}}").search
            self._ready = True
        return self

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or self.odd(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode(text, allowed_special="all"), np.uint32)


_loaded: dict[str, Encoder] = {}
_PIECES = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())]


def cut(docs: DataFrame, path: str, size: int = 1024, end: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids) of every document: its tokens (the file at `path`, read by the
    driver) and the id `end`, in one piece or, if longer than `size`, in pieces of which only the first
    may be shorter. `start` counts the document's ids before the piece; `ids` holds 4 bytes each,
    little-endian.

    Takes (doc_id, text, any others). A null or empty text is the id `end` alone. Strings of special
    tokens in a text are those tokens. Rows that repeat an id, or have none, give their own pieces.
    """
    code = docs.sparkSession.sparkContext.broadcast(Encoder(path))  # of the vocabulary's size

    def run(batches):
        if path not in _loaded:
            _loaded[path] = code.value.ready()
        encode = _loaded[path].encode
        for batch in batches:
            for i, j, *_ in chunks(batch.column(1)):
                rows: list[list] = [[], [], [], [], []]
                for doc, text in zip(batch.column(0).slice(i, j - i).to_pylist(), batch.column(1).slice(i, j - i).to_pylist()):
                    ids = np.append(encode(text), np.uint32(end)) if text else np.array([end], np.uint32)
                    first = len(ids) % size or size
                    starts = [0, *range(first, len(ids), size)]
                    data = ids.astype("<u4").tobytes()
                    for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                        for column, value in zip(rows, (doc, k, a, b - a, data[4 * a:4 * b])):
                            column.append(value)
                yield record(_PIECES, rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids binary")


def least_bins(lengths: np.ndarray, size: int) -> int:
    """A number of bins that no packing can be below (the bound L2 of Martello and Toth, 1990)."""
    count = np.bincount(lengths, minlength=size + 1)
    total = count * np.arange(size + 1)
    n, s = np.cumsum(count), np.cumsum(total)
    half = size // 2
    best = -(-int(s[-1]) // size)
    for k in range(0, half + 1):  # pieces below k are left out
        large = int(n[size] - n[half])
        middle = int(s[size - k] - s[half])                      # larger than half, at most size - k
        room = int(n[size - k] - n[half]) * size - middle
        small = int(s[half] - (s[k - 1] if k else 0))
        best = max(best, large + max(0, -(-(small - room) // size)))
    return best


class _Bins:
    """Underfull bins, found by what they could take: a piece, or one in exchange for one or two of theirs."""

    def __init__(self, size: int):
        self.size = size
        self.bins: list[dict[int, list[int]]] = []   # length -> pieces
        self.free: list[int] = []
        self.room = [[{} for _ in range(size + 1)] for _ in range(3)]  # by number given back: room -> entries, in order
        self.bits = [0, 0, 0]

    def new(self) -> int:
        self.bins.append({})
        self.free.append(self.size)
        return len(self.bins) - 1

    def put(self, b: int, length: int, piece: int) -> None:
        self.bins[b].setdefault(length, []).append(piece)
        self.free[b] -= length

    def take(self, b: int, length: int) -> int:
        pieces = self.bins[b][length]
        piece = pieces.pop()
        if not pieces:
            del self.bins[b][length]
        self.free[b] += length
        return piece

    def _entries(self, b: int):
        free = self.free[b]
        if not free:
            return
        yield 0, free, (b,)
        have = sorted(self.bins[b])
        for i, y in enumerate(have):
            yield 1, free + y, (b, y)
            if len(self.bins[b][y]) > 1 and free + 2 * y <= self.size:
                yield 2, free + 2 * y, (b, y, y)
            for z in have[i + 1:]:
                yield 2, free + y + z, (b, y, z)

    def show(self, b: int) -> None:
        for kind, v, entry in self._entries(b):
            self.room[kind][v][entry] = True
            self.bits[kind] |= 1 << v

    def hide(self, b: int) -> None:
        for kind, v, entry in self._entries(b):
            at = self.room[kind][v]
            at.pop(entry, None)
            if not at:
                self.bits[kind] &= ~(1 << v)

    def find(self, kind: int, x: int):
        """(what stays free, entry): the bin that x fills best among those tried, giving back less than x. Of the
        entries with equal room the oldest is tried; the next larger room follows."""
        bits = self.bits[kind] >> x
        v = x
        while bits:
            step = (bits & -bits).bit_length() - 1
            v += step
            for entry in self.room[kind][v]:
                if sum(entry[1:]) < x:
                    return v - x, entry
                break
            bits >>= step + 1
            v += 1
        return None


def local_search(bins: _Bins, least: int) -> None:
    """Exchanges between underfull bins until the number of bins is `least` or no giver can be lowered."""
    live = {b for b in range(len(bins.bins)) if bins.bins[b]}
    open_ = sorted((b for b in live if bins.free[b]), key=lambda b: (-bins.free[b], b))
    for b in open_:
        bins.show(b)
    for giver in open_:
        if len(live) <= least:
            break
        if not bins.bins[giver] or not bins.free[giver]:
            continue
        bins.hide(giver)
        while bins.bins[giver]:
            have = sorted(bins.bins[giver], reverse=True)
            best = None
            for x in have:
                found = bins.find(0, x)
                if found and (best is None or found[0] < best[0]):
                    best = (found[0], (x,), found[1])
            if best is None:
                twos = [(x, z) for i, x in enumerate(have) for z in have[i:] if x != z or len(bins.bins[giver][x]) > 1]
                for given in [(x,) for x in have] + [p for p in twos if sum(p) <= bins.size]:
                    for kind in (1, 2) if len(given) == 1 else (1,):
                        found = bins.find(kind, sum(given))
                        # the other bin has to be the fuller one afterwards
                        if found and (best is None or found[0] < best[0]) and \
                                bins.size - bins.free[found[1][0]] + sum(given) - sum(found[1][1:]) > bins.size - bins.free[giver]:
                            best = (found[0], given, found[1])
            if best is None:
                break
            _, given, (other, *back) = best
            bins.hide(other)
            go = [(x, bins.take(giver, x)) for x in given]
            come = [(y, bins.take(other, y)) for y in back]
            for x, piece in go:
                bins.put(other, x, piece)
            for y, piece in come:
                bins.put(giver, y, piece)
            bins.show(other)
        if bins.bins[giver]:
            bins.show(giver)
        else:
            live.discard(giver)


def pack_group(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each of some pieces, of 1 to `size` tokens."""
    bins = _Bins(size)
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    bits = 0
    order = np.argsort(-lengths, kind="stable")
    for piece, x in zip(order.tolist(), lengths[order].tolist()):
        fits = bits >> x
        if fits:
            v = x + (fits & -fits).bit_length() - 1
            b = by_room[v].pop()
            if not by_room[v]:
                bits &= ~(1 << v)
        else:
            b, v = bins.new(), size
        bins.put(b, x, piece)
        if v - x:
            by_room[v - x].append(b)
            bits |= 1 << (v - x)
    least = least_bins(lengths, size)
    if len(bins.bins) > least:
        local_search(bins, least)
    where, offset, k = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for content in bins.bins:
        at = 0
        for x in sorted(content, reverse=True):
            for piece in sorted(content[x]):
                where[piece], offset[piece] = k, at
                at += x
        k += bool(content)
    return where, offset


def pack(pieces: DataFrame, size: int = 1024, length: str = "length", rounds: int = ROUNDS) -> DataFrame:
    """Adds `sequence_id` and `offset` to pieces of `length` tokens: sequences of at most `size`, filled without
    gaps from 0, as few as the search finds. All other columns are handed on; those named sequence_id
    or offset are replaced. A length that is null, below 1 or above `size` has no place (both null).
    Repeated rows are packed each for itself; an empty table stays empty.
    """
    rows = pieces.drop("sequence_id", "offset")
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()))
    fits = F.col(f"`{length}`").between(1, size)
    none = F.lit(None).cast("long")
    done = rows.where(~F.coalesce(fits, F.lit(False))).withColumns({"sequence_id": none, "offset": none}).drop("_row")
    left = rows.where(fits)
    def packed_by(turn):
        def one(key, t):
            w, row = t.column(length).to_numpy().astype(np.int64), t.column("_row").to_numpy()
            order = np.lexsort((row, -w))
            back = np.argsort(order)
            where, offset = (x[back] for x in pack_group(w[order], size))
            fill = np.bincount(where, weights=w).astype(np.int64)
            return t.drop_columns(["_group"]).append_column("sequence_id", pa.array((turn << 56) + (key[0].as_py() << 24) + where)) \
                .append_column("offset", pa.array(offset)).append_column("_fill", pa.array(fill[where]))

        return one

    for turn in range(rounds):
        n = left.count()
        if not n:
            break
        groups = -(-n // GROUP)

        dealt = left.withColumn("_group", F.pmod(F.xxhash64(F.lit(turn), "_row"), F.lit(groups)))
        packed = materialize(dealt.groupBy("_group").applyInArrow(packed_by(turn), f"{schema}, _row long, sequence_id long, offset long, _fill long"))
        last = turn == rounds - 1 or groups == 1
        loose = F.lit(False) if last else F.col("_fill") < size - size // LOOSE
        done = done.union(packed.where(~loose).drop("_row", "_fill"))
        left = packed.where(loose).drop("sequence_id", "offset", "_fill")
        if last:
            break
    return done
