"""Byte-level BPE: merges compiled into a lazily determinised transducer.

**Encoding.**  A prefix of a piece has exactly one last token: the token ``t``
that ends there and may follow the last token ``u`` of what precedes it, that is,
for which the merges turn ``u + t`` into ``[u, t]``.  A transducer state holds every
place where a token may still be open: the node of the token trie reached since
that place, and the last token before it.  Reading a byte extends all open tokens,
closes the one that fits and outputs it, the last token so far.  Which outputs
stand is known as soon as no earlier place is open, so at most the longest token's
length later; the tokens of a piece are read off its outputs from the end.
Every byte is read by a transition; transitions are made when first met and kept.
Beyond ``max_moves`` the older half is given up, with the states that no transition
needs any more, and made anew when met.
Pieces and their tokens are remembered from their second time on (most are never met again),
in two generations of ``max_pieces``: the older one goes when the younger is full, and what
is met again moves to the younger.  Whether two tokens may meet is remembered in a table of
fixed size, where a later pair takes an earlier one's place.
The bounds limit memory only (a process grew by 199 MB over 130 million characters, with the
bounds not all reached); results don't depend on them.
A worker keeps them from task to task until a task of another operator comes.

Whether ``t`` may follow ``u`` shows where they meet: while merging, the last part of ``u``
and the first part of ``t`` grow in the order of their ranks, and a merge across the
border takes place if its rank comes before the next one on either side.

**Decoding.**  A UTF-8 automaton (RFC 3629) walks the bytes token by token; its
transition for a whole token is computed when first met.  Bytes and text come out
as soon as characters are complete: bytes unchanged, text with U+FFFD for ill-formed parts.

Defined cases: null and empty texts have no tokens; lone surrogates, which
Spark strings cannot hold, are replaced; repeated rows stay repeated; null keys stay; an
empty table gives no row.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import kept, per_chunk, text_table


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with lines ``base64 rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


_NEVER = 1 << 60
_LAST = (1 << 20) - 1


class Transducer:
    """Pieces to tokens by rank merges."""

    def __init__(self, ranks: dict[bytes, int], *, max_moves: int = 600_000, max_pieces: int = 300_000, max_pairs: int = 400_000, max_heads: int = 20_000):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.length = {rank: len(token) for token, rank in ranks.items()}
        self.max_moves, self.max_pieces, self.max_heads = max_moves, max_pieces, max_heads
        # One object for each rank, whichever transition it is read off.
        self.same = {rank: rank for rank in ranks.values()}
        # The token trie: node * 256 + byte to node, and each node's token (-1: none) and whether it goes on.
        self.child: dict[int, int] = {}
        self.token_at, self.goes_on = [-1], [True]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                self.goes_on[node] = True
                nxt = self.child.get(node << 8 | byte)
                if nxt is None:
                    nxt = self.child[node << 8 | byte] = len(self.token_at)
                    self.token_at.append(-1)
                    self.goes_on.append(False)
                node = nxt
            self.token_at[node] = rank
        self.edges: dict[int, tuple | None] = {}
        # (u + 1 << 20 | t) << 1 | whether they may meet, at a place that the pair gives.
        self.follows = array("q", [-1]) * (1 << max_pairs.bit_length() - 1)
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        # By hash, whether a piece has been met; pieces that share a hash are remembered a time too early.
        self.met = bytearray(1 << 20)
        # A place is node << 20 | last token + 1, and a state its places as 64-bit integers.  States have multiples
        # of 256 as numbers, so that a state and a byte make one key; a transition is the next state's number << 20 |
        # output token.  The output is the state's last place, so a state's transitions from anywhere are one object.
        self.states: list[bytes | None] = [array("q", [0]).tobytes()]
        self.into: dict[bytes, int] = {}
        self.unused: list[int] = []
        self.moves: dict[int, int] = {}
        self.heads: dict[bytes, tuple[int, list[int]]] = {}

    def merge(self, piece: bytes, least_parts: int = 1) -> list[bytes]:
        """Parts by the merges themselves, lowest rank first, until ``least_parts`` are left."""
        get = self.ranks.get
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = [get(parts[i] + parts[i + 1], _NEVER) for i in range(len(parts) - 1)]
        while len(parts) > least_parts and (least := min(ranks)) < _NEVER:
            at = ranks.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = get(parts[at - 1] + parts[at], _NEVER)
            if at < len(ranks):
                ranks[at] = get(parts[at] + parts[at + 1], _NEVER)
        return parts

    def _edges(self, t: int) -> tuple | None:
        """What the first and the last part of a token have been while it was merged, as (bytes, rank) from one byte on.

        None where the token's merges don't come in the order of their ranks.
        """
        if t in self.edges:
            return self.edges[t]
        token = self.tokens[t]
        if len(token) == 1:
            out = (((token, -1),), ((token, -1),))
        else:
            parts = self.merge(token, 2)
            halves = [self._edges(self.ranks[p]) for p in parts] if len(parts) == 2 else [None]
            if None in halves or any(len(p) > 1 and self.ranks[p] >= t for p in parts):
                out = None
            else:
                out = ((*halves[0][0], (token, t)), (*halves[1][1], (token, t)))
        self.edges[t] = out
        return out

    def may_follow(self, u: int, t: int) -> bool:
        """Whether the merges of both tokens' bytes end in these two (-1: nothing precedes)."""
        key = (u + 1 << 20) + t
        at = u * 31_337 + t & len(self.follows) - 1
        known = self.follows[at]
        if known >> 1 != key:
            known = self.follows[at] = key << 1 | self._border_holds(u, t)
        return known & 1 == 1

    def _border_holds(self, u: int, t: int) -> bool:
        if u < 0:
            return len(self.merge(self.tokens[t])) == 1
        left, right = self._edges(u), self._edges(t)
        if left is None or right is None:
            return self.merge(self.tokens[u] + self.tokens[t]) == [self.tokens[u], self.tokens[t]]
        left, right, get, i, j = left[1], right[0], self.ranks.get, 0, 0
        while True:
            across = get(left[i][0] + right[j][0], _NEVER)
            before = left[i + 1][1] if i + 1 < len(left) else _NEVER
            after = right[j + 1][1] if j + 1 < len(right) else _NEVER
            # Equal ranks are merged from the left.
            if across < before and across <= after:
                return False
            if before == after == _NEVER:
                return True
            if before <= after:
                i += 1
            else:
                j += 1

    def _move(self, state: int, byte: int) -> int:
        """A new transition: the next state's number and the last token so far."""
        child, token_at, goes_on, places, last = self.child.get, self.token_at, self.goes_on, [], -1
        for place in memoryview(self.states[state >> 8]).cast("q"):
            node = child(place >> 20 << 8 | byte)
            if node is None:
                continue
            before = place & _LAST
            if last < 0 and (t := token_at[node]) >= 0 and self.may_follow(before - 1, t):
                last = t
            if goes_on[node]:
                places.append(node << 20 | before)
        if last < 0:
            raise ValueError(f"the vocabulary has no token for byte {byte}")
        places.append(last + 1)
        key = array("q", places).tobytes()
        move = self.into.get(key)
        if move is None:
            if self.unused:
                at = self.unused.pop()
                self.states[at] = key
            else:
                at = len(self.states)
                self.states.append(key)
            move = self.into[key] = at << 28 | last
        self.moves[state | byte] = move
        return move

    def _give_up_half(self, now: int) -> None:
        """Drops the older half of the transitions and the states that only they met, but not the state ``now``."""
        self.moves = dict(islice(self.moves.items(), len(self.moves) // 2, None))
        used = bytearray(len(self.states))
        used[0] = used[now >> 8] = 1
        for key, move in self.moves.items():
            used[key >> 8] = used[move >> 28] = 1
        for at, places in enumerate(self.states):
            if not used[at] and places is not None:
                del self.into[places]
                self.states[at] = None
                self.unused.append(at)
        self.heads = {}

    def run(self, piece: bytes) -> tuple[int, ...]:
        """The tokens of one piece: a token itself, or what the transducer emits for its bytes."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        if len(self.moves) >= self.max_moves:
            self._give_up_half(0)
        head = piece[:4]
        state, outputs = self.heads.get(head) or self._read(0, head)
        if len(piece) > 4:
            outputs = outputs[:]
            for at in range(4, len(piece), 1 << 16):
                if len(self.moves) >= self.max_moves:
                    self._give_up_half(state)
                state, more = self._read(state, piece[at : at + (1 << 16)])
                outputs += more
        out, at, length, same = [], len(piece), self.length, self.same
        while at:
            out.append(t := same[outputs[at - 1]])
            at -= length[t]
        return tuple(out[::-1])

    def _read(self, state: int, data: bytes) -> tuple[int, list[int]]:
        """The state after these bytes and the output of each; from the start state, four bytes at once when met again."""
        outputs, get, at = [], self.moves.get, state
        for byte in data:
            move = get(at | byte)
            if move is None:
                move = self._move(at, byte)
            at = move >> 20
            outputs.append(move & _LAST)
        if not state:
            if len(self.heads) >= self.max_heads:
                self.heads = {}
            self.heads[data] = at, outputs
        return at, outputs

    def piece(self, text: str) -> tuple[int, ...]:
        """The tokens of a piece that the younger generation may not have."""
        known = self.pieces.get(text)
        if known is None:
            known = self.older.get(text)
            if known is None:
                known = self.run(text.encode("utf-8", "replace"))
            if len(text) < 40:
                mark = hash(text) & len(self.met) - 1
                if not self.met[mark]:
                    self.met[mark] = 1
                    return known
                if len(self.pieces) >= self.max_pieces:
                    self.older, self.pieces, self.met = self.pieces, {}, bytearray(len(self.met))
                self.pieces[text] = known
        return known


_ACCEPT, _REJECT = 0, 8


def _next(state: int, byte: int) -> int:
    """The UTF-8 automaton.  1-3: so many continuation bytes to come; 4-7: the next byte is restricted."""
    if state == _ACCEPT:
        if byte < 0x80:
            return 0
        if 0xC2 <= byte <= 0xDF:
            return 1
        if 0xE1 <= byte <= 0xEC or byte in (0xEE, 0xEF):
            return 2
        if 0xF1 <= byte <= 0xF3:
            return 3
        return {0xE0: 4, 0xED: 5, 0xF0: 6, 0xF4: 7}.get(byte, _REJECT)
    low, high, then = {1: (0x80, 0xBF, 0), 2: (0x80, 0xBF, 1), 3: (0x80, 0xBF, 2), 4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2)}[state]
    return then if low <= byte <= high else _REJECT


def whole_tokens(tokens: dict[int, bytes]) -> frozenset[int]:
    """The tokens that take the automaton from between characters to between characters."""
    return frozenset(i for i, t in tokens.items() if t.isascii() or StreamDecoder._state(t) == _ACCEPT)


class StreamDecoder:
    """Token ids to bytes and text, as they come."""

    def __init__(self, tokens: dict[int, bytes], moves: dict[tuple[int, int], tuple[int, int]] | None = None, whole: frozenset[int] | None = None):
        self.tokens, self.moves = tokens, {} if moves is None else moves
        self.whole = whole_tokens(tokens) if whole is None else whole
        self.state, self.open = _ACCEPT, b""

    def _move(self, token: int) -> tuple[int, int]:
        """The state after a token, and after how many of its bytes a character last ended (-1: none)."""
        state, end = self.state, -1
        for i, byte in enumerate(self.tokens[token]):
            state = _next(state, byte)
            if state == _REJECT:
                break
            if state == _ACCEPT:
                end = i + 1
        out = self.moves[self.state, token] = (state, end)
        return out

    def feed(self, ids: Iterable[int]) -> str:
        """The text that these ids complete."""
        return self.feed_bytes(ids).decode("utf-8", "replace")

    def feed_bytes(self, ids: Iterable[int]) -> bytes:
        """The bytes up to the last character that these ids complete.

        Between characters, runs of ids whose tokens are whole characters are read at once.
        """
        ids = ids if isinstance(ids, list) else list(ids)
        ready, token, whole = [], self.tokens.__getitem__, self.whole
        for at in range(0, len(ids), 64):
            part = ids[at : at + 64]
            if self.state == _ACCEPT and whole.issuperset(part):
                ready += map(token, part)
            else:
                ready += self._walk(part)
        return b"".join(ready)

    def _walk(self, ids: list[int]) -> Iterator[bytes]:
        tokens, moves = self.tokens, self.moves
        whole = self.whole
        for token in ids:
            if self.state == _ACCEPT and token in whole:
                yield tokens[token]
                continue
            state, end = moves.get((self.state, token)) or self._move(token)
            if state == _REJECT:
                # What is open can't become a character any more: let it go, but for an end that may begin one.
                data = self.open + tokens[token]
                self.open = self._tail(data)
                self.state = self._state(self.open)
                yield data[: len(data) - len(self.open)]
                continue
            if end >= 0:
                yield self.open + tokens[token][:end]
                self.open = tokens[token][end:]
            else:
                self.open += tokens[token]
            self.state = state

    @staticmethod
    def _state(data: bytes) -> int:
        state = _ACCEPT
        for byte in data:
            if (state := _next(state, byte)) == _REJECT:
                break
        return state

    def _tail(self, data: bytes) -> bytes:
        """The longest end that may still begin a character."""
        for n in range(min(3, len(data)), 0, -1):
            if self._state(data[-n:]) not in (_ACCEPT, _REJECT):
                return data[-n:]
        return b""

    def finish(self) -> str:
        return self.finish_bytes().decode("utf-8", "replace")

    def finish_bytes(self) -> bytes:
        """What is still open at the end of the stream."""
        out = self.open
        self.state, self.open = _ACCEPT, b""
        return out


class Codec:
    """One vocabulary with its pattern; one a process, as states are kept."""

    def __init__(self, path: str, pattern: str):
        self.transducer = Transducer(read_ranks(path))
        self.find = regex.compile(pattern).findall
        self.names = {rank: str(rank) for rank in self.transducer.tokens}
        self.moves: dict[tuple[int, int], tuple[int, int]] = {}
        self.whole = whole_tokens(self.transducer.tokens)

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        return kept((cls, path, pattern), lambda: cls._lasting(path, pattern))

    @classmethod
    def _lasting(cls, path: str, pattern: str) -> Codec:
        out = cls(path, pattern)
        # These tables live for many tasks: no use in tracing them again and again.
        gc.collect()
        gc.freeze()
        gc.set_threshold(50_000, 20, 50)
        return out

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if text:
            get, one = self.transducer.pieces.get, self.transducer.piece
            for p in self.find(text):
                out += get(p) or one(p)
        return out

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        decoder = StreamDecoder(self.transducer.tokens, self.moves, self.whole)
        return decoder.feed_bytes(ids) + decoder.finish_bytes()

    def decode(self, ids: Iterable[int]) -> str:
        decoder = StreamDecoder(self.transducer.tokens, self.moves, self.whole)
        return decoder.feed(ids) + decoder.finish()

    def stream(self, parts: Iterable[Iterable[int]]) -> Iterator[str]:
        decoder = StreamDecoder(self.transducer.tokens, self.moves, self.whole)
        for part in parts:
            yield decoder.feed(part)
        yield decoder.finish()


def encode_table(docs: DataFrame, path: str, pattern: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids``: the tokens of every row."""
    kind = docs.schema[key].dataType.simpleString()

    def encode(part: pa.RecordBatch) -> pa.RecordBatch:
        codec = Codec.of(path, pattern)
        return pa.RecordBatch.from_arrays([part.column(0), pa.array([codec.encode(x) for x in part.column(1).to_pylist()], pa.list_(pa.int32()))], names=["key", "ids"])

    return text_table(docs, key, text).mapInArrow(per_chunk(encode, keeps=True), f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode_table(rows: DataFrame, path: str, pattern: str, *, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key, text``: the texts of rows of token ids (null ids: an empty text)."""
    kind = rows.schema[key].dataType.simpleString()

    def decode(part: pa.RecordBatch) -> pa.RecordBatch:
        codec = Codec.of(path, pattern)
        return pa.RecordBatch.from_arrays([part.column(0), pa.array([codec.decode(x or ()) for x in part.column(1).to_pylist()], pa.string())], names=["key", "text"])

    return rows.select(rows[key].alias("key"), rows[ids].cast("array<int>").alias("ids")).mapInArrow(per_chunk(decode, keeps=True), f"key {kind}, text string").withColumnRenamed("key", key)


def digest_table(docs: DataFrame, path: str, pattern: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256``: every row encoded and decoded again."""
    kind = docs.schema[key].dataType.simpleString()

    def digest(part: pa.RecordBatch) -> pa.RecordBatch:
        codec = Codec.of(path, pattern)
        n, coded, decoded = [], [], []
        for x in part.column(1).to_pylist():
            ids = codec.encode(x)
            n.append(len(ids))
            coded.append(hashlib.sha256(" ".join(map(codec.names.__getitem__, ids)).encode()).hexdigest())
            decoded.append(hashlib.sha256(codec.decode_bytes(ids)).hexdigest())
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    return text_table(docs, key, text).mapInArrow(per_chunk(digest, keeps=True), f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)
