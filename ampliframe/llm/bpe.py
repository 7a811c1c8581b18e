"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a byte string exactly one token can come last in the prefix's encoding: the
token ``t`` whose bytes end there and that is *stable* after the last token ``s`` of the shorter
prefix, meaning that merging the bytes of ``s`` and ``t`` alone gives back ``s, t``. Keeping
that token per prefix makes an append a continuation of the table, and an edit a cut of it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterable

import numpy as np
import pyarrow.fs as pafs
import regex
from pyspark.sql import DataFrame

from ampliframe.llm.common import map_rows, plain

#: A vocabulary file goes to every executor, so its size is checked.
MAX_VOCABULARY_BYTES = 64 << 20
#: Pieces whose ids are remembered in a task; the memory is emptied when it is full.
MAX_CACHED = 450_000
MAX_CACHED_CHARS = 48
#: Pairs of tokens whose stability is remembered.
MAX_PAIRS = 500_000
#: Prefixes whose last token is remembered.
MAX_PREFIXES = 400_000
#: Above every rank.
NEVER = 1 << 62


class Vocabulary:
    """Tokens by rank, with the merge rule of rank-ordered byte pairs."""

    def __init__(self, ranks: dict[bytes, int], max_prefixes: int = MAX_PREFIXES):
        self.ranks, self.max_prefixes = ranks, max_prefixes
        self.tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        missing = [i for i in range(256) if bytes([i]) not in ranks]
        if missing:
            raise ValueError(f"not a byte-level vocabulary: {len(missing)} bytes have no token")
        self.longest = max(map(len, ranks))
        # Longest token by its last three bytes (all of a shorter token).
        self.reach: dict[bytes, int] = {}
        for token in ranks:
            for ending in {token[-3:], token[-2:], token[-1:]}:
                self.reach[ending] = max(len(token), self.reach.get(ending, 2))
        self.pairs: dict[int, bool] = {}
        self.prefixes: dict[bytes, int] = {}  # last token of prefixes that words share
        self._edges: dict[int, tuple | None] = {}

    def merged(self, data: bytes, trace: list | None = None) -> list[bytes]:
        """Pairs merged by lowest rank, leftmost first: the definition, used on short strings.
        ``trace`` gets each merge's rank and the outer parts after it."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if best[0] == NEVER:
                break
            i = best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            if trace is not None:
                trace.append((best[0], parts[0], parts[-1]))
        return parts

    def edges(self, token: int) -> tuple | None:
        """How the outer parts of a token grow while it is merged: for the left and the right end
        a list of (part, rank at which it came, rank at which it goes). None if merging does not
        reach the token, or not in rising order of rank."""
        if token not in self._edges:
            data, trace = self.tokens[token], []
            whole = len(self.merged(data, trace)) == 1
            if not whole or any(a[0] >= b[0] for a, b in zip(trace, trace[1:]) if a[1:] != b[1:]):
                self._edges[token] = None if not whole else ()
            else:
                ends = []
                for side in (1, 2):
                    grown = [(data[:1] if side == 1 else data[-1:], -1)]
                    for step in trace:
                        if step[side] != grown[-1][0]:
                            grown.append((step[side], step[0]))
                    ends.append([(part, came, grown[i + 1][1] if i + 1 < len(grown) else NEVER)
                                 for i, (part, came) in enumerate(grown)])
                self._edges[token] = tuple(ends)
        return self._edges[token]

    def whole(self, token: int) -> bool:
        """Whether merging reaches the token at all."""
        return self.edges(token) is not None

    def stable(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when their bytes are merged together: at no
        time does a right end of ``left`` meet a left end of ``right`` that it merges with
        before either has grown on. (At equal ranks the merge further left goes first.)"""
        a, b = self.edges(left), self.edges(right)
        if not a or not b:  # no rising order of merges: by definition
            first, second = self.tokens[left], self.tokens[right]
            return self.merged(first + second) == [first, second]
        for x, x_came, x_goes in a[1]:
            for y, y_came, y_goes in b[0]:
                if x_came <= y_goes and y_came < x_goes:
                    rank = self.ranks.get(x + y, NEVER)
                    if rank < x_goes and rank <= y_goes and rank != NEVER:
                        return False
        return True


class PrefixTable:
    """The encoding of a growing byte string; ``last[i]`` ends the encoding of the first ``i + 1`` bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, bytearray(), []
        self.append(data)

    def append(self, more: bytes) -> None:
        v, start = self.vocabulary, len(self.data)
        self.data += more
        data, last, token_of, pairs, longest = bytes(self.data), self.last, v.ranks.get, v.pairs, v.longest
        for end in range(start + 1, len(data) + 1):
            for begin in range(max(0, end - longest), end):
                token = token_of(data[begin:end])
                if token is None:
                    continue
                if begin:
                    pair = last[begin - 1] << 32 | token
                    valid = pairs.get(pair)
                    if valid is None:
                        if len(pairs) >= MAX_PAIRS:
                            pairs.clear()
                        valid = pairs[pair] = v.stable(last[begin - 1], token)
                else:
                    valid = v.whole(token)
                if valid:
                    last.append(token)
                    break

    def replace(self, start: int, stop: int, new: bytes) -> None:
        """Change ``data[start:stop]``. The table before the edit stays; behind it, the old table
        is taken over again from the first place where both have the same last token long enough
        for no token to reach across."""
        old_last, old_data = self.last, bytes(self.data)
        tail, shift = old_data[stop:], start + len(new) - stop
        self.data, self.last = self.data[:start], old_last[:start]
        self.append(new)
        agree = 0
        for i in range(len(tail)):
            self.append(tail[i:i + 1])
            agree = agree + 1 if self.last[-1] == old_last[stop + i] else 0
            if agree >= 2 * self.vocabulary.longest:
                self.data += tail[i + 1:]
                self.last += old_last[stop + i + 1:]
                return

    def ids(self) -> list[int]:
        out, end = [], len(self.last)
        while end:
            token = self.last[end - 1]
            out.append(token)
            end -= len(self.vocabulary.tokens[token])
        return out[::-1]


def short_ids(v: Vocabulary, data: bytes) -> list[int]:
    """As ``PrefixTable(v, data).ids()``, with the table filled only where the last token of the
    whole string asks for it; for strings short enough to recurse."""
    last: dict[int, int] = {}
    out, end = [], len(data)
    while end:
        token = last.get(end)
        if token is None:
            token = _fill(v, data, end, last)
        out.append(token)
        end -= len(v.tokens[token])
    out.reverse()
    return out


def _fill(v: Vocabulary, data: bytes, end: int, last: dict[int, int]) -> int:
    token_of, pairs = v.ranks.get, v.pairs
    # No token with this ending is longer than its reach.
    begin = end - v.reach.get(data[end - 3:end] if end >= 3 else data[:end], 2)
    for begin in range(begin if begin > 0 else 0, end):
        token = token_of(data[begin:end])
        if token is None:
            continue
        if not begin:
            if v.whole(token):
                break
            continue
        before = last.get(begin)
        if before is None:
            prefix = data[:begin]
            before = v.prefixes.get(prefix)
            if before is None:
                before = _fill(v, data, begin, last)
                if len(v.prefixes) >= v.max_prefixes:
                    v.prefixes.clear()
                v.prefixes[prefix] = before
            last[begin] = before
        pair = before << 32 | token
        valid = pairs.get(pair)
        if valid is None:
            if len(pairs) >= MAX_PAIRS:
                pairs.clear()
            valid = pairs[pair] = v.stable(before, token)
        if valid:
            break
    last[end] = token
    return token


class _Pieces(dict):
    """Piece of text -> its ids as little-endian 32-bit integers. A full memory becomes the older
    generation, from which pieces that occur again move back; so frequent ones stay."""

    def __init__(self, vocabulary: Vocabulary, most: int):
        super().__init__()
        self.vocabulary, self.most, self.older = vocabulary, most, {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            data = piece.encode()
            known = self.vocabulary.ranks.get(data)
            if known is not None:
                ids = [known]
            elif len(data) <= MAX_CACHED_CHARS:
                ids = short_ids(self.vocabulary, data)
            else:
                ids = PrefixTable(self.vocabulary, data).ids()
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= MAX_CACHED_CHARS:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[piece] = packed
        return packed


def _narrow_pattern(pattern: str, limit: int) -> str:
    """The pattern with its Unicode classes cut to the first ``limit`` characters, for texts that hold
    no others: the built-in matcher then takes half the time."""
    def members(prop: str) -> str:
        return "".join(re.escape(c) for c in map(chr, range(limit)) if regex.fullmatch(prop, c))

    def narrow(found: re.Match) -> str:
        inside, prop = found.string.rfind("[", 0, found.start()) > found.string.rfind("]", 0, found.start()), found[0]
        if prop == r"\S":
            return members(r"\S") if inside else f"[^{members(chr(92) + 's')}]"
        return members(prop) if inside else f"[{members(prop)}]"

    return re.sub(r"\\p\{\w+\}|\\s|\\S", narrow, pattern)


class Codec:
    """Encodes texts piece by piece (every match of ``pattern`` by itself) and decodes ids. Of pieces up to twice
    ``cached`` are remembered; fewer take less memory and more time."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cached: int = MAX_CACHED):
        self.vocabulary = Vocabulary(ranks, min(MAX_PREFIXES, cached))
        self.find = regex.compile(pattern).findall
        self.find_ascii, self.find_latin = (re.compile(_narrow_pattern(pattern, n)).findall for n in (128, 256))
        self.pieces = _Pieces(self.vocabulary, cached)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def split(self, text: str) -> list[str]:
        """The pattern's matches."""
        if text.isascii():
            return self.find_ascii(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.find(text)
        return self.find_latin(text)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids))


def read_vocabulary(path: str) -> bytes:
    """The file's bytes; on the driver. Its size is checked, since every executor gets it."""
    fs, where = pafs.FileSystem.from_uri(path)
    size = fs.get_file_info(where).size
    if size is None or size > MAX_VOCABULARY_BYTES:
        raise ValueError(f"no vocabulary of at most {MAX_VOCABULARY_BYTES} bytes: {path}")
    with fs.open_input_stream(where) as stream:
        return stream.read()


def parse_ranks(content: bytes) -> dict[bytes, int]:
    """Lines of a base64 token and its rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())}


_codecs: dict[tuple[str, str, int], Codec] = {}


def codec(content: bytes, pattern: str, cached: int = MAX_CACHED) -> Codec:
    """One codec per Python worker, vocabulary and memory of pieces."""
    name = (hashlib.sha256(content).hexdigest(), pattern, cached)
    if name not in _codecs:
        _codecs[name] = Codec(parse_ranks(content), pattern, cached)
    return _codecs[name]


class SharedCodec:
    """A codec for use inside tasks: the vocabulary is broadcast, tables are built once per worker."""

    def __init__(self, spark, path: str, pattern: str, cached: int = MAX_CACHED):
        self.content, self.pattern, self.cached = spark.sparkContext.broadcast(read_vocabulary(path)), pattern, cached
        self._codec = None

    def get(self) -> Codec:
        if self._codec is None:
            self._codec = codec(self.content.value, self.pattern, self.cached)
        return self._codec

    def __getstate__(self):
        return {"content": self.content, "pattern": self.pattern, "cached": self.cached, "_codec": None}


def encode_texts(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """``doc_id, ids`` (binary, little-endian unsigned 32-bit), one row per input row.

    Null and empty texts have no ids; no special tokens are made. A map without shuffle: each
    text is encoded whole, a piece at a time, in memory in proportion to that text.
    """
    shared = SharedCodec(docs.sparkSession, vocabulary, pattern)

    def work(rows):
        encode = shared.get().encode
        return {"doc_id": rows["doc_id"], "ids": [encode(t) for t in rows["text"]]}

    return map_rows(plain(docs, key, text).select("doc_id", "text"), work, "doc_id long, ids binary")


def decode_ids(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``doc_id, ids, decoded`` (the bytes); null ids decode to nothing. A map without shuffle."""
    shared = SharedCodec(encoded.sparkSession, vocabulary, pattern)

    def work(rows):
        decode = shared.get().decode
        return {**rows, "decoded": [decode(np.frombuffer(x or b"", "<u4").tolist()) for x in rows["ids"]]}

    return map_rows(encoded.select("doc_id", "ids"), work, "doc_id long, ids binary, decoded binary")


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, cached: int = MAX_CACHED) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encoded, decoded and digested in one pass."""
    shared = SharedCodec(docs.sparkSession, vocabulary, pattern, cached)

    def work(rows):
        c = shared.get()
        counts, ids_sha, decoded_sha = [], [], []
        for text in rows["text"]:
            packed = c.encode(text)
            ids = np.frombuffer(packed, "<u4")
            counts.append(len(ids))
            ids_sha.append(hashlib.sha256(packed).hexdigest())
            decoded_sha.append(hashlib.sha256(c.decode(ids.tolist())).hexdigest())
        return {"doc_id": rows["doc_id"], "n_tokens": counts, "ids_sha256": ids_sha, "decoded_sha256": decoded_sha}

    return map_rows(plain(docs).select("doc_id", "text"), work,
                    "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
