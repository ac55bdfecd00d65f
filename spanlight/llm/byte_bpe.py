"""Byte-level BPE by a lazily determinised transducer, and streaming decode.

A sequence of tokens is what the merges make of its bytes exactly if every two
neighbours are what the merges make of theirs alone.  So the last token of the
encoding of each prefix follows from those of shorter prefixes, and text can be
read once from left to right.  A state of the transducer is the last token
emitted and the bytes read since; it branches over the places where a token
that is still incomplete may start.  As soon as all branches agree on a token it
is emitted, so lookahead is bounded by the longest token.  States and their
moves are made when first needed and kept, up to a bound; further ones are made
for the moment.
"""

from __future__ import annotations

import base64
import gc
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import documents, give_back

#: States that a worker keeps.
MAX_KEPT = 30_000
#: Pieces whose ids a worker keeps: those met lately.
MAX_PIECES = 400_000
#: Pairs of tokens that a worker keeps.
MAX_PAIRS = 200_000
#: Bytes that branches read before what they agree on is emitted.
WINDOW = 256
#: Ids decoded at a time.
DECODE_IDS = 65_536


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks from a rank file: a base64 token and a number a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class _State:
    __slots__ = ("last", "came", "live", "number", "pending", "previous", "rest")

    def __init__(self, previous, pending, last, came, live):
        self.previous, self.pending, self.last, self.came, self.live = previous, pending, last, came, live
        self.number = -1  # of a state that is not kept
        self.rest = None


def _meeting(came, live) -> int:
    """The furthest place that all branches pass: of two the one further on steps back till they meet."""
    cut = live[-1][0]
    for k, _ in live:
        while k != cut:
            if k > cut:
                k = came[k]
            else:
                cut = came[cut]
    return cut


class _Pieces(dict):
    """Ids of the pieces met lately: the younger half here, the older half behind; a piece met again is young again."""

    def __init__(self, encode, most):
        self.encode, self.half, self.old = encode, max(1, most // 2), {}

    def __missing__(self, piece):
        found = self.old.get(piece)
        if found is None:
            found = self.encode(piece.encode("utf-8"))
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[piece] = found
        return found


def _trie(ranks: dict[bytes, int]) -> tuple[dict[int, int], list[int]]:
    """Moves (node << 8 | byte) of the tree of all tokens, odd nodes having children, and each node's token or -1; the root is 0."""
    opens = {token[:k] for token in ranks for k in range(1, len(token))}
    numbers, grow, token_at = {b"": 0}, {}, [-1, -1]
    for part in sorted(opens | ranks.keys()):  # a beginning comes before what goes on from it
        if len(token_at) % 2 != (part in opens):
            token_at.append(-1)
        numbers[part] = len(token_at)
        grow[numbers[part[:-1]] << 8 | part[-1]] = len(token_at)
        token_at.append(ranks.get(part, -1))
    return grow, token_at


class Transducer:
    def __init__(self, ranks: dict[bytes, int], pattern: str, max_kept: int = MAX_KEPT, max_pieces: int = MAX_PIECES):
        import regex

        self.ranks, self.max_kept = ranks, max_kept
        self.bytes_of = token_bytes(ranks)
        self.grow, self.token_at = _trie(ranks)
        self.pairs: dict[int, bool] = {}
        self.states: dict[tuple[int, bytes], _State] = {}
        self.moves: dict[int, tuple] = {}
        self.start = _State(-1, b"", (-1,), (0,), [(0, 0)])
        self.start.number = 0
        self.split_of: list[list[int] | None] = [None] * len(self.bytes_of)
        self.single = [bytes([k]) for k in range(256)]
        self.split = regex.compile(pattern).findall
        self.pieces = _Pieces(self.piece, max_pieces)

    def merged(self, data: bytes, down_to: int = 1) -> list[int]:
        """The merges applied one by one, lowest rank first, leftmost first, till so many tokens are left; the definition."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > down_to:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> list[int]:
        """The two tokens that the last merge of this one joins; none for a byte."""
        if (known := self.split_of[token]) is None:
            data = self.bytes_of[token]
            known = self.split_of[token] = self.merged(data, 2) if len(data) > 1 else []
        return known

    def follows(self, a: int, b: int) -> bool:
        """Whether the merges leave a border between the two.

        Takes merges back, the latest first, and looks whether the tokens then
        at the border would have been merged across it earlier.
        """
        if a < 0:
            return True
        if (known := self.pairs.get(a << 32 | b)) is not None:
            return known
        left, right, bound, fine = a, b, 1 << 60, None
        while fine is None:
            if self.ranks.get(self.bytes_of[left] + self.bytes_of[right], 1 << 60) < bound:
                fine = False
                break
            inner, outer = self.halves(left), self.halves(right)
            if inner and (left > right or not outer):
                left, bound = inner[1], left
            elif outer:
                right, bound = outer[0], right + 1  # of equal ranks the one on the left comes first
            else:
                fine = True
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        self.pairs[a << 32 | b] = fine
        return fine

    def _move(self, state: _State, byte: int):
        pending = state.pending + self.single[byte]
        end, token, live = len(pending), -1, []
        for start, node in state.live:
            node = self.grow.get(node << 8 | byte)
            if node is not None:
                if token < 0 <= self.token_at[node] and self.follows(state.last[start], self.token_at[node]):
                    token, begin = self.token_at[node], start
                if node & 1:
                    live.append((start, node))
        if token < 0:
            raise ValueError("a byte is no token of this vocabulary")
        last, came = (*state.last, token), (*state.came, begin)
        live.append((end, 0))
        out, cut = (), 0
        if live[0][0]:  # else a token that begins at 0 may go on, and nothing is sure
            cut = _meeting(came, live)
            k, found = cut, []
            while k:
                found.append(last[k])
                k = came[k]
            out = tuple(reversed(found))
        previous = last[cut]
        after = self.states.get((previous, pending[cut:]))
        if after is None:
            if cut:
                pending, last, came, live = pending[cut:], last[cut:], tuple([c - cut if c > cut else 0 for c in came[cut:]]), [(k - cut, node) for k, node in live]
            after = _State(previous, pending, last, came, live)
            if len(self.states) < self.max_kept:
                self.states[previous, pending] = after
                after.number = len(self.states)
        if state.number >= 0 <= after.number:
            self.moves[state.number << 8 | byte] = after, out
        return after, out

    def _branches(self, state: _State, data: bytes, at: int) -> list[int]:
        """Tokens of ``data`` from place ``at`` on, reached in ``state``, by all branches side by side; no state is kept."""
        out: list[int] = []
        grow, token_at, pairs, follows = self.grow.get, self.token_at, self.pairs.get, self.follows
        last, came, live, end = [*state.last], [*state.came], state.live, len(state.pending)
        while True:
            for byte in data[at : at + WINDOW]:
                end += 1
                found, onward = -1, []
                for start, node in live:
                    node = grow(node << 8 | byte)
                    if node is not None:
                        if found < 0 and (token := token_at[node]) >= 0 and (fine if (fine := pairs(last[start] << 32 | token)) is not None else follows(last[start], token)):
                            found, begin = token, start
                        if node & 1:
                            onward.append((start, node))
                if found < 0:
                    raise ValueError("a byte is no token of this vocabulary")
                last.append(found)
                came.append(begin)
                onward.append((end, 0))
                live = onward
            at += WINDOW
            cut = end if at >= len(data) else _meeting(came, live)
            k, found = cut, []
            while k:
                found.append(last[k])
                k = came[k]
            out += found[::-1]
            if at >= len(data):
                return out
            last, came, live, end = last[cut:], [c - cut if c > cut else 0 for c in came[cut:]], [(k - cut, node) for k, node in live], end - cut

    def piece(self, data: bytes) -> bytes:
        """Ids of one piece of the split: along moves made before, then one more is made, and the rest is read without keeping states."""
        state, moves = self.start, self.moves
        out: list[int] = []
        for at, byte in enumerate(data):
            move = moves.get(state.number << 8 | byte)
            if move is None:
                state, emitted = self._move(state, byte)
                out += emitted
                out += self._branches(state, data, at + 1)
                return np.array(out, "<u4").tobytes()
            state, emitted = move
            if emitted:
                out += emitted
        if state.rest is None:
            rest, k = [], len(state.pending)
            while k:
                rest.append(state.last[k])
                k = state.came[k]
            state.rest = tuple(reversed(rest))
        return np.array((*out, *state.rest), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.split(text)))


def token_bytes(ranks: dict[bytes, int]) -> list[bytes]:
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


class Decoder:
    """The bytes of all tokens in one line, and where each begins and how long it is."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = token_bytes(ranks)
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.line = np.frombuffer(b"".join(tokens), np.uint8)

    def parts(self, ids: bytes):
        """Bytes of the tokens, some at a time."""
        numbers = np.frombuffer(ids, "<u4")
        for k in range(0, len(numbers), DECODE_IDS):
            part = numbers[k : k + DECODE_IDS]
            size = self.size[part]
            ends = np.cumsum(size)
            yield self.line[np.arange(ends[-1]) + np.repeat(self.begin[part] - ends + size, size)].tobytes()

    def text(self, ids: bytes) -> str:
        stream = Utf8Stream()
        return "".join([*map(stream.feed, self.parts(ids)), stream.finish()])


class Utf8Stream:
    """Text from bytes that arrive in parts cut anywhere.

    The state is the beginning of a character that is not complete yet: at most
    three bytes.  What is no UTF-8 comes out as U+FFFD.
    """

    def __init__(self):
        self.held = b""

    def feed(self, part: bytes) -> str:
        data = self.held + part
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 == 0x80:
                continue
            need = 2 if byte & 0xE0 == 0xC0 else 3 if byte & 0xF0 == 0xE0 else 4 if byte & 0xF8 == 0xF0 else 1
            if need > back:
                cut -= back
            break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


_compiled: dict = {}


def _transducer(ranks: dict[bytes, int], pattern: str, key: str, *bounds: int) -> Transducer:
    """One for each vocabulary in a Python worker, with what it has learned."""
    if (key, bounds) not in _compiled:
        _compiled.clear()
        _compiled[key, bounds] = Transducer(ranks, pattern, *bounds)
    return _compiled[key, bounds]


def _shared(docs: DataFrame, path: str, pattern: str):
    ranks = read_ranks(path)
    key = hashlib.sha256(repr(sorted(ranks.items())).encode() + pattern.encode()).hexdigest()
    return docs.sparkSession.sparkContext.broadcast(ranks), key


def _kept(docs: DataFrame, *own: str) -> tuple[list[str], str]:
    names = [n for n in docs.columns if n not in own]
    return names, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in names)


def encode_bpe(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "token_ids", keep_learned: bool = True, decoded_col: str | None = None, max_kept: int = MAX_KEPT, max_pieces: int = MAX_PIECES) -> DataFrame:
    """Columns of ``docs`` and ``ids_col``: the ids as little-endian unsigned 32-bit integers in a binary; a column of that name is replaced.

    ``path`` is read by the driver and the ranks (a vocabulary, of fixed size)
    are broadcast.  Null and empty texts have no ids.  Repeated rows get equal
    ids.  An empty table gives no rows.  Whole texts are encoded, of any length,
    one at a time; a piece that the split leaves whole, however long, is read in
    parts of WINDOW bytes.  A worker keeps what it has learned for its next
    partitions; without ``keep_learned`` it lets go of it at the end of each, for
    jobs whose other operators use the same workers.  ``max_kept`` and
    ``max_pieces`` bound what it learns, not what it encodes.  With
    ``decoded_col`` the ids are also decoded, in the same pass, to a column of
    that name.
    """
    ranks, key = _shared(docs, path, pattern)
    names, schema = _kept(docs, ids_col, *([decoded_col] if decoded_col else []))
    added = [ids_col, *([decoded_col] if decoded_col else [])]

    def encode(batches):
        coder = _transducer(ranks.value, pattern, key, max_kept, max_pieces)
        back = Decoder(ranks.value) if decoded_col else None
        gc.disable()  # what is learned has no cycles that are let go of, and is all that a collection would walk through
        try:
            for batch in batches:
                texts = pc.fill_null(batch.column(batch.schema.get_field_index(text_col)).cast(pa.large_string()), "")
                for part, some in _slices(batch, texts):
                    ids = [coder.encode(t.as_py()) for t in some]
                    again = [pa.array(map(back.text, ids), pa.string())] if back else []
                    yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(n)) for n in names), pa.array(ids, pa.binary()), *again], [*names, *added])
        finally:
            gc.enable()
        if not keep_learned:
            del coder
            _compiled.clear()
            give_back()

    columns = [*([schema] if names else []), f"`{ids_col}` binary", *([f"`{decoded_col}` string"] if decoded_col else [])]
    return docs.mapInArrow(encode, ", ".join(columns))


def _slices(batch: pa.RecordBatch, values, most: int = 256, limit: int = 1 << 22):
    """Rows of the batch and of ``values`` a few at a time: at most ``most``, and at most about ``limit`` bytes of values beyond the first."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(values), 0)).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right"))
        stop = min(max(stop, at + 1), at + most)
        yield batch.slice(at, stop - at), values.slice(at, stop - at)
        at = stop


def decode_bpe(tokens: DataFrame, path: str, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """Columns of ``tokens`` and ``text_col``, the text of the ids, decoded in parts; null ids give the empty text."""
    ranks, _ = _shared(tokens, path, "")
    names, schema = _kept(tokens, text_col)

    def decode(batches):
        back = Decoder(ranks.value)
        for batch in batches:
            for part, some in _slices(batch, batch.column(batch.schema.get_field_index(ids_col))):
                texts = [back.text(each.as_py() or b"") for each in some]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(n)) for n in names), pa.array(texts, pa.string())], [*names, text_col])

    return tokens.mapInArrow(decode, f"{schema}, `{text_col}` string" if names else f"`{text_col}` string")


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op4_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Encodes and decodes each text in one pass."""
    path, pattern = vocabulary()
    tokens = encode_bpe(documents(spark, sf_dir).select("doc_id", "text"), path, pattern, decoded_col="text")
    return tokens.select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
