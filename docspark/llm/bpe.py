"""BPE encoding and decoding with a tokenization automaton (Berglund, Martens, van der Merwe, 2024).

The automaton reads *tokens*: a path from the start accepts exactly the token sequences that
BPE produces. It starts as one state with an arc for every base symbol. The merge u v -> w,
in order of rank, is a gadget: w's arcs out are a copy of v's, an arc for w is laid beside
every arc for u, and u's state loses its arc for v. All arcs for a token lead to the same
state, so a state is named by the token last read.

A copy is kept as a link, not as a set: a token remembers the two it was made of and when.
Whether state x has an arc for y is read from those three tables by undoing the gadgets from
the latest on, and the answer goes into a transition table that workers fill as they read.
Words are encoded by following arcs whose labels spell the word; the accepting path is
unique. Decoding writes the labels of the arcs.
"""
from __future__ import annotations

import json
import re
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bytetext import chunks
from .common import trimmed

WORDS = 400_000  # words, and transitions times 8, that a worker remembers before it starts afresh


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Automaton:
    """The compiled merges of a byte-level BPE vocabulary with an end-of-word suffix."""

    def __init__(self, vocabulary: dict[str, int], merges: list, suffix: str):
        self.ids, self.suffix = dict(vocabulary), suffix
        n = max(vocabulary.values()) + 1
        self.labels = [""] * n
        for token, i in vocabulary.items():
            self.labels[i] = token
        self.first, self.second, self.made = list(range(n)), list(range(n)), [-1] * n
        self.removed: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(merges):
            u, v = pair.split(" ") if isinstance(pair, str) else pair
            a, b, w = vocabulary[u], vocabulary[v], vocabulary[u + v]
            if self.made[w] >= 0 or max(self.made[a], self.made[b]) >= rank:
                raise ValueError("a token must come from one merge, after those of its parts")
            self.first[w], self.second[w], self.made[w] = a, b, rank
            self.removed[a, b] = rank
        self.longest = max(len(t.removesuffix(suffix) if suffix else t) for t in vocabulary)
        self.reach: dict[str, int] = {}  # by the first four symbols, how long a token can be
        for token in vocabulary:
            t = token.removesuffix(suffix) if suffix else token
            if len(t) > 3:
                self.reach[t[:4]] = max(len(t), self.reach.get(t[:4], 3))
        self._arcs: dict[int, bool] = {}

    def __getstate__(self):
        return self.__dict__ | {"_arcs": {}}

    def has_arc(self, x: int, y: int) -> bool:
        """Whether the state after token x has an arc for token y."""
        made, removed = self.made, self.removed
        before = len(made) * 2 + 2  # twice the rank of the gadget being undone, less one if it copied before removing
        while True:
            gone = removed.get((x, y))
            if gone is not None and 2 * gone < before:
                return False
            if made[x] > made[y]:
                before = 2 * made[x]      # arcs out were copied before this merge removed its arc
                x = self.second[x]
            elif made[y] >= 0:
                before = 2 * made[y] + 1  # arcs in were laid after it
                y = self.first[y]
            else:
                return True

    def encode(self, word: str) -> list[int]:
        """The tokens of one word, given as byte symbols: the longest arc that spells on, as long as one does."""
        n, ids, arcs, size, tail = len(word), self.ids, self._arcs, len(self.made), word + self.suffix
        if len(arcs) > 8 * WORDS:
            arcs.clear()
        path, i, x = [], 0, -1
        while i < n:
            j = min(n, i + self.reach.get(word[i:i + 4], 3))
            while j > i:
                y = ids.get(tail[i:] if j == n else word[i:j])
                if y is not None:
                    if x < 0:
                        break
                    known = arcs.get(x * size + y)
                    if known is None:
                        known = arcs[x * size + y] = self.has_arc(x, y)
                    if known:
                        break
                j -= 1
            else:
                return self._search(word)
            path.append(y)
            i, x = j, y
        return path

    def _search(self, word: str) -> list[int]:
        """The accepting path, with steps back where an arc that spells on leads nowhere."""
        n, ids, tail = len(word), self.ids, word + self.suffix
        path: list[int] = []
        # one frame a token read: (start, end to try next)
        starts, ends, dead = [0], [n], set()
        while True:
            i, j = starts[-1], ends[-1]
            if i == n:
                return path
            last = path[-1] if path else -1
            found = -1
            j = min(j, i + self.longest)
            while j > i:
                t = ids.get(tail[i:] if j == n else word[i:j], -1)
                if t >= 0 and (last < 0 or self.has_arc(last, t)) and (j, t) not in dead:
                    found = t
                    break
                j -= 1
            if found >= 0:
                ends[-1] = j - 1
                path.append(found)
                starts.append(j)
                ends.append(n)
            else:
                if not path:
                    raise ValueError(f"no path for {word!r}")
                dead.add((i, path.pop()))
                starts.pop()
                ends.pop()


def _plain_pattern(pattern: str) -> str:
    """The pattern for characters below U+0300, its classes written out."""
    sets = {}
    for name in ("L", "N"):
        of = regex.compile(rf"\p{{{name}}}")
        sets[name] = "".join(rf"\u{c:04x}" for c in range(0x300) if of.match(chr(c)))
    out = pattern.replace(r"[\p{L}]", r"\p{L}").replace(r"[\p{N}]", r"\p{N}")
    out = re.sub(r"\[\^\\s\\p\{L\}\\p\{N\}\]", lambda m: "[^" + "".join(rf"\u{c:04x}" for c in range(0x300) if regex.match(r"[\s\p{L}\p{N}]", chr(c))) + "]", out)
    return out.replace(r"\p{L}", f"[{sets['L']}]").replace(r"\p{N}", f"[{sets['N']}]")


def _newer_characters(split, pattern: str) -> str:
    """Characters that this Python's Unicode doesn't know and that the file's own step cuts otherwise than `pattern` does."""
    unknown = [chr(c) for c in range(0x300, 0x40000) if unicodedata.category(chr(c)) == "Cn"]
    find, symbols = regex.compile(pattern).findall, byte_symbols()

    def differ(text: str) -> bool:
        theirs = [p for p, _ in split.pre_tokenize_str(text)]
        return theirs != ["".join([symbols[b] for b in p.encode()]) for p in find(text)]

    out = []
    for at in range(0, len(unknown), 512):
        some = unknown[at:at + 512]
        if differ(" ".join(f"a{c}1{c}a" for c in some)):
            out += [c for c in some if differ(f"a{c}1{c}a")]
    return "".join(out)


class Codec:
    """A tokenizer file: its special tokens, normaliser, word pattern and automaton."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            text = f.read()
        spec = json.loads(text)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or spec["decoder"] is not None or split[0]["type"] != "Split" or split[1]["type"] != "ByteLevel":
            raise ValueError("a BPE file with a Split and a ByteLevel step and no decoder is needed")
        self.automaton = Automaton(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
        self.pattern = split[0]["pattern"]["Regex"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = list(self.automaton.labels)
        for token, i in self.special.items():
            self.labels += [""] * (i + 1 - len(self.labels))
            self.labels[i] = token
        # only the normaliser of the file is needed on workers
        bare = {**spec, "model": {**model, "vocab": {k: v for k, v in model["vocab"].items() if v < 512}, "merges": []}, "added_tokens": []}
        self.normaliser = json.dumps(bare)
        self.newer = _newer_characters(Tokenizer.from_str(self.normaliser).pre_tokenizer, self.pattern)
        self._ready = False

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k in ("automaton", "pattern", "special", "labels", "normaliser", "newer")} | {"_ready": False}

    def ready(self) -> "Codec":
        if not self._ready:
            self._normal = Tokenizer.from_str(self.normaliser).normalizer
            self._find = regex.compile(self.pattern).findall
            self._rare = regex.compile(f"[{self.newer}]") if self.newer else None
            self._split = Tokenizer.from_str(self.normaliser).pre_tokenizer
            # Below U+0200 nothing combines and white space is dropped, so lower() is the whole normaliser; what it
            # gives is below U+0300, or a mark, and the pattern's classes can be written out.
            self._beyond = re.compile("[^\0-\u01ff]").search
            self._near = re.compile(_plain_pattern(self.pattern)).findall
            self._symbols = byte_symbols()
            self._cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
            self._words = _Memo(self)
            self._ready = True
        return self

    def word_ids(self, word: str) -> bytes:
        symbols = self._symbols
        ids = self.automaton.encode("".join([symbols[b] for b in word.encode()]))
        return b"".join([i.to_bytes(4, "little") for i in ids])

    def _pieces(self, text: str) -> list[str]:
        if not self._beyond(text):
            return self._near(text.lower())
        text = self._normal.normalize_str(text)
        if self._rare and self._rare.search(text):
            # characters that the two libraries' Unicode versions class differently: the file's own step cuts
            back = {c: b for b, c in enumerate(self._symbols)}
            return [bytes(back[c] for c in piece).decode() for piece, _ in self._split.pre_tokenize_str(text)]
        return self._find(text)

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        parts = self._cut.split(text) if self._cut and "<" in text else [text]
        out = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.special[part].to_bytes(4, "little"))
            elif part:
                if len(self._words) > WORDS:
                    self._words.clear()
                out += map(self._words.__getitem__, self._pieces(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        labels = self.labels
        return " ".join([labels[i] for i in memoryview(ids).cast("I")])


class _Memo(dict):
    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self.codec.word_ids(word)
        return ids


_loaded: dict[str, Codec] = {}


def _shared(df: DataFrame, path: str):
    """A function that gives the codec on a worker; a worker keeps it, with what it remembers, from task to task."""
    codec = df.sparkSession.sparkContext.broadcast(Codec(path))  # of the vocabulary's size

    def get() -> Codec:
        if path not in _loaded:
            _loaded[path] = codec.value.ready()
        return _loaded[path]

    return get


def _mapped(df: DataFrame, column: str, name: str, kind: str, arrow: pa.DataType, one, blank: str) -> DataFrame:
    columns = [c for c in df.columns if c != name]
    taken = df.select(*[F.col(f"`{c}`") for c in columns], F.coalesce(F.col(f"`{column}`"), F.lit(blank).cast(dict(df.dtypes)[column])).alias(name))
    schema = ", ".join(f"`{c}` {t}" for c, t in taken.dtypes[:-1]) + f", `{name}` {kind}"

    def run(batches):
        do = one()
        for batch in batches:
            last = batch.num_columns - 1
            for i, j, *_ in chunks(batch.column(last)):
                part = batch.slice(i, j - i)
                done = pa.array([do(x) for x in part.column(last).to_pylist()], arrow)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], done], names=batch.schema.names)

    return taken.mapInArrow(run, schema)


def bpe_encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds (or replaces) the binary column `ids`: the tokens of the whole `text`, 4 bytes each, little-endian.

    `path` names the tokenizer file, read by the driver. Special tokens' strings in a text
    are those tokens; nothing is added, cut or padded. A null or empty text has no tokens.
    """
    get = _shared(df, path)
    return _mapped(df, text, ids, "binary", pa.binary(), lambda: get().encode, "")


def bpe_decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds (or replaces) the string column `text`: the labels of `ids` joined by blanks, special tokens
    included, as the file has no decoder step. Null ids decode to an empty text."""
    get = _shared(df, path)
    return _mapped(df, ids, text, "string", pa.string(), lambda: get().decode, "")


def bpe_round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Both: replaces `text` by `ids`, as bpe_encode gives them, and `decoded`, what bpe_decode makes of these ids.
    Each row is encoded and decoded by one worker, so that a task holds one automaton."""
    get = _shared(df, path)
    columns = [c for c in df.columns if c not in (text, ids, decoded)]
    taken = df.select(*[F.col(f"`{c}`") for c in columns], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(text))
    schema = ", ".join(f"`{c}` {t}" for c, t in taken.dtypes[:-1]) + f", `{ids}` binary, `{decoded}` string"

    def run(batches):
        codec = get()
        for batch in batches:
            last = batch.num_columns - 1
            for i, j, *_ in chunks(batch.column(last)):
                part = batch.slice(i, j - i)
                done = [codec.encode(x) for x in part.column(last).to_pylist()]
                back = pa.array([codec.decode(x) for x in done], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(done, pa.binary()), back], names=[*columns, ids, decoded])

    return taken.mapInArrow(trimmed(run), schema)
