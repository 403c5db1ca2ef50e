"""Byte-level BPE: encoding by a lazily determinised finite-state transducer, decoding by a UTF-8 state machine.

The merges are compiled into a nondeterministic transducer that may begin a token at any byte; its subset construction
is done lazily: a state is the set of trie nodes of all places where a token may have begun, made when first met and
then only looked up, so there are no more states than trie nodes. A transition names the tokens that may end at that
byte; of these just one may follow the token before it, namely the one that the merges leave as it is next to it,
which is asked once a pair. What lies before the last cut that all live starts share is emitted, so lookahead is
bounded by the longest token and long pieces need no more memory than short ones.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from .common import documents, map_batches

#: Bounds of what a worker remembers; beyond them it forgets and starts again, with the same results.
MAX_PAIRS, MAX_PIECES = 500_000, 200_000
#: Rows whose ids are held at once before they are handed on.
ROWS = 256
#: Bytes of a piece after which what is final is emitted.
EMIT_EVERY = 4096
WHITE = "\t-\r \x85\xa0  -     　"


@functools.lru_cache(maxsize=1)
def piece_pattern() -> re.Pattern:
    r"""The public pattern with \p{L}, \p{N} and \s written out as ranges, for the faster of the two engines."""
    import regex

    def ranges(category: str) -> str:
        every = regex.compile(rf"\p{{{category}}}+").finditer("".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000)))))
        return "".join(f"{re.escape(m[0][0])}-{re.escape(m[0][-1])}" if len(m[0]) > 1 else re.escape(m[0]) for m in every)

    letters, numbers = ranges("L"), ranges("N")
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{WHITE}{letters}{numbers}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


@functools.lru_cache(maxsize=1)
def _spaces() -> tuple[re.Pattern, re.Pattern]:
    """Finds a space that white space or nothing follows; splits at spaces that something else follows."""
    return re.compile(rf" (?![^{WHITE}])"), re.compile(rf" (?=[^{WHITE}])")


def read_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merged(ranks: dict[bytes, int], data: bytes) -> list[bytes]:
    """The definition: merge the leftmost pair of lowest rank until none is left. Slow; asked for pairs of tokens."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best = min(((ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks), default=None)
        if best is None:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class State:
    """A set of trie nodes (one for each place where a token may have begun), longest first; the root is always live."""

    __slots__ = ("nodes", "depths", "next")

    def __init__(self, nodes, depths):
        self.nodes, self.depths, self.next = nodes, depths, {}


class Transducer:
    """Encodes one piece of text at a time; the same tokens as repeated merging of lowest-ranked pairs."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.trie: list[dict[int, int]] = [{}]
        self.token_at: list[int | None] = [None]
        self.depth: list[int] = [0]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                to = self.trie[node].get(byte)
                if to is None:
                    to = self.trie[node][byte] = len(self.trie)
                    self.trie.append({})
                    self.token_at.append(None)
                    self.depth.append(self.depth[node] + 1)
                node = to
            self.token_at[node] = rank
        self.pairs: dict[int, bool] = {}
        self.states: dict[tuple[int, ...], State] = {}
        self.start = self._state((0,))

    def _state(self, nodes: tuple[int, ...]) -> State:
        if (state := self.states.get(nodes)) is None:
            state = self.states[nodes] = State(nodes, tuple(self.depth[n] for n in nodes))
        return state

    def _reachable(self, token: int) -> bool:
        """Whether merging the bytes of a token gives that token."""
        return len(merged(self.ranks, self.bytes_of[token])) == 1

    def _may_follow(self, a: int, b: int) -> bool:
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        known = self.pairs[a << 32 | b] = merged(self.ranks, self.bytes_of[a] + self.bytes_of[b]) == [self.bytes_of[a], self.bytes_of[b]]
        return known

    def _step(self, state: State, byte: int) -> tuple[State, tuple[tuple[int, int], ...]]:
        """The transition: the next state, and the (token, length) that may end here, longest first."""
        nodes = [to for n in state.nodes if (to := self.trie[n].get(byte)) is not None]
        ends = tuple((t, self.depth[n]) for n in nodes if (t := self.token_at[n]) is not None and self._reachable(t))
        found = state.next[byte] = self._state((*nodes, 0)), ends
        return found

    def encode(self, piece: bytes) -> list[int]:
        if (token := self.ranks.get(piece)) is not None:
            return [token]
        # tokens[i]: the last token of the first i bytes from base on; starts[i]: where it begins
        state, pairs, ids, tokens, starts, n = self.start, self.pairs, [], [-1], [0], 0
        for byte in piece:
            found = state.next.get(byte) or self._step(state, byte)
            state = found[0]
            n += 1
            for token, length in found[1]:
                before = tokens[n - length]
                if before < 0 or (known if (known := pairs.get(before << 32 | token)) is not None else self._may_follow(before, token)):
                    tokens.append(token)
                    starts.append(n - length)
                    break
            if n >= EMIT_EVERY:
                done = self._agreed(state, starts, n)
                if done:
                    ids.extend(self._path(tokens, starts, done))
                    tokens, starts, n = tokens[done:], [max(0, x - done) for x in starts[done:]], n - done
        ids.extend(self._path(tokens, starts, n))
        return ids

    @staticmethod
    def _path(tokens: list[int], starts: list[int], at: int) -> list[int]:
        out = []
        while at > 0:
            out.append(tokens[at])
            at = starts[at]
        return out[::-1]

    @staticmethod
    def _agreed(state: State, starts: list[int], n: int) -> int:
        """The last cut that the paths to every live start have in common: what lies before it is final."""
        live = {n - d for d in state.depths}
        while len(live) > 1:
            last = max(live)
            live.discard(last)
            live.add(starts[last])
        return live.pop()


class Utf8Stream:
    """Incremental decoder: feed token bytes in any cuts, get text; ill-formed bytes give U+FFFD once per maximal part.

    The state is how many continuation bytes are due, the range the next one must lie in, and the bits so far.
    """

    def __init__(self):
        self.due, self.low, self.high, self.code = 0, 0x80, 0xBF, 0

    def feed(self, data: bytes) -> str:
        out = []
        if not self.due:  # what is well-formed needs no machine; it takes over at the first byte that isn't
            try:
                return data.decode("utf-8")
            except UnicodeDecodeError as e:
                out, data = [data[: e.start].decode("utf-8")], data[e.start :]
        for b in data:
            if self.due:
                if self.low <= b <= self.high:
                    self.code, self.due, self.low, self.high = self.code << 6 | b & 0x3F, self.due - 1, 0x80, 0xBF
                    if not self.due:
                        out.append(chr(self.code))
                    continue
                out.append("�")
                self.due, self.low, self.high = 0, 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self.due, self.code = 1, b & 0x1F
            elif 0xE0 <= b <= 0xEF:
                self.due, self.code = 2, b & 0x0F
                self.low, self.high = (0xA0 if b == 0xE0 else 0x80), (0x9F if b == 0xED else 0xBF)
            elif 0xF0 <= b <= 0xF4:
                self.due, self.code = 3, b & 0x07
                self.low, self.high = (0x90 if b == 0xF0 else 0x80), (0x8F if b == 0xF4 else 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def close(self) -> str:
        end = "�" if self.due else ""
        self.__init__()
        return end


class Memory(dict):
    """What ``make`` gave for a key; two generations of at most ``most`` keys, keys over 64 characters not at all."""

    def __init__(self, make, most: int):
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        if (value := self.older.get(key)) is None:
            value = self.make(key)
        if len(key) <= 64:
            self[key] = value
        return value


class Tokenizer:
    def __init__(self, ranks: dict[bytes, int]):
        self.machine = Transducer(ranks)
        self.pieces = Memory(self._piece, MAX_PIECES)
        self.spaced = Memory(lambda part: self._pieces(" " + part), MAX_PIECES)
        self.table = [self.machine.bytes_of.get(i) for i in range(max(ranks.values(), default=-1) + 1)]

    def _piece(self, piece: str) -> bytes:
        ids = self.machine.encode(piece.encode("utf-8", "surrogatepass"))
        return struct.pack(f"<{len(ids)}I", *ids)

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, piece_pattern().findall(text)))

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers.

        The pattern always cuts before a space that is followed by no white space, and what it does on either side
        of such a cut doesn't depend on the other side; so the parts between are looked up whole.
        """
        first, *parts = _spaces()[1].split(text) if _spaces()[0].search(text) else text.split(" ")
        return self._pieces(first) + b"".join(map(self.spaced.__getitem__, parts))

    def decode_bytes(self, ids: bytes) -> Iterator[bytes]:
        """The bytes of packed ids, in blocks."""
        get = self.table.__getitem__
        for i in range(0, len(ids), 1 << 18):
            yield b"".join(map(get, memoryview(ids)[i : i + (1 << 18)].cast("I")))

    def decode(self, ids: bytes) -> str:
        stream = Utf8Stream()
        return "".join(chain((stream.feed(x) for x in self.decode_bytes(ids)), [stream.close()]))


@functools.lru_cache(maxsize=2)
def tokenizer(vocabulary: str) -> Tokenizer:
    """One a worker process; the vocabulary is a file of every machine, like the library that it comes with."""
    with open(vocabulary, "rb") as lines:
        return Tokenizer(read_ranks(lines))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _texts(column: pa.Array) -> Iterator[str]:
    for x in column:
        yield "" if (data := x.as_buffer()) is None else data.to_pybytes().decode("utf-8", "replace")


def _parts(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def encode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ids (array of int): null and empty texts give no ids. Repeated rows are encoded alike."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        for batch in _parts(batches):
            packed = [tokenizer(path).encode(t) for t in _texts(batch.column(1))]
            offsets = [0]
            for x in packed:
                offsets.append(offsets[-1] + len(x) // 4)
            ids = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(packed))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), ids)], ["id", "ids"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return map_batches(source, run, f"id {dict(source.dtypes)['id']}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: id, text; null ids give empty text, ill-formed bytes U+FFFD."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        import numpy as np

        for batch in batches:
            texts = [tokenizer(path).decode(np.asarray(x.values if x.is_valid else [], dtype="<u4").tobytes()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    source = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return map_batches(source, run, f"id {dict(source.dtypes)['id']}, text string").withColumnRenamed("id", id_col)


def digest(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256; ids and decoded bytes stay in the worker."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        for batch in batches:
            n, of_ids, of_bytes = [], [], []
            machine = tokenizer(path)
            for text in _texts(batch.column(1)):
                ids = machine.encode(text)
                n.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                back = hashlib.sha256()
                for block in machine.decode_bytes(ids):
                    back.update(block)
                of_bytes.append(back.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return map_batches(source, run, f"id {dict(source.dtypes)['id']}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def tokenized(docs: DataFrame, vocabulary: str | None = None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with ids (array of int), n_tokens and round_trip (whether the ids decode to the text) in
    place of the text; columns of those names give way. Null text has no ids."""
    path = vocabulary or default_vocabulary()
    others = [c for c in docs.columns if c not in (text_col, "ids", "n_tokens", "round_trip")]
    source = docs.select(*others, F.col(text_col).cast("binary").alias(text_col))

    def run(batches):
        for batch in _parts(batches):
            machine = tokenizer(path)
            packed, same = [], []
            for text in _texts(batch.column(len(others))):
                packed.append(machine.encode(text))
                same.append(machine.decode(packed[-1]) == text)
            n = [len(x) // 4 for x in packed]
            offsets = pa.array([0, *accumulate(n)], pa.int32())
            ids = pa.Array.from_buffers(pa.int32(), sum(n), [None, pa.py_buffer(b"".join(packed))])
            columns = [*batch.columns[:-1], pa.ListArray.from_arrays(offsets, ids), pa.array(n, pa.int64()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, [*others, "ids", "n_tokens", "round_trip"])

    schema = StructType([*(f for f in source.schema.fields[:-1]), StructField("ids", ArrayType(IntegerType())), StructField("n_tokens", LongType()), StructField("round_trip", BooleanType())])
    return map_batches(source, run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir))
