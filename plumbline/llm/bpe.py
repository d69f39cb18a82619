"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming UTF-8 decoding.

The rank file is compiled into a nondeterministic transducer whose states are (last token, trie node of the token being
read). A token may follow another only if the merges leave the two as they are; a sequence in which that holds for every
neighbouring pair is the sequence the merges give, so of all readings of a prefix just one ends on a token boundary.
Determinising keeps the live readings together with the tokens they do not agree on yet; tokens common to all of them are
emitted. A reading dies once no token has its bytes, so the lookahead is at most the longest token. States and transitions
are made when first needed and are kept in a table that is dropped when it holds `most_states` states.

Defined results: a null or empty text has no tokens (sha256 of the empty string, twice). Repeated rows give repeated rows.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import math
import re
from array import array
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from plumbline.llm.common import in_batches, kept, no_cycles, text_rows


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file (base64, blank, rank a line)."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}


#: Keys of a state's readings and of what it owes at the end of a piece, beside the bytes it moves on.
READINGS, OWED = 256, 257


def pack(readings: list[tuple]) -> bytes:
    """(last token, trie node, tokens owed) of each live reading, as 32-bit numbers."""
    flat = array("i")
    for before, node, owed in readings:
        flat.extend((before, node, len(owed), *owed))
    return flat.tobytes()


def unpack(packed: bytes) -> list[tuple]:
    flat, at, out = memoryview(packed).cast("i").tolist(), 0, []
    while at < len(flat):
        to = at + 3 + flat[at + 2]
        out.append((flat[at], flat[at + 1], tuple(flat[at + 3 : to])))
        at = to
    return out


class Transducer:
    """Encodes one pretoken at a time."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = 300_000, most_pieces: int = 400_000):
        self.ranks, self.most_states, self.most_pieces = ranks, most_states, most_pieces
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.edges: dict[int, int] = {}  # node * 256 + byte: node
        self.token_at: dict[int, int] = {}
        nodes = 1
        for token, rank in ranks.items():
            at = 0
            for b in token:
                to = self.edges.get(at << 8 | b)
                if to is None:
                    to = self.edges[at << 8 | b] = nodes
                    nodes += 1
                at = to
            self.token_at[at] = rank
        self.spines: dict[tuple[int, int], tuple[int, ...] | None] = {}
        self.pieces = Pieces(self)
        self._forget()

    def _forget(self) -> None:
        """A state is a dict of its moves, with its readings packed beside them."""
        first = pack([(-1, 0, ())])
        self.start: dict = {READINGS: first}
        self.states = {first: self.start}
        gc.collect()  # the states dropped refer to each other

    def _parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge of a token joins; None for a byte; itself twice if no merges give it."""
        piece = self.bytes_of[token]
        if len(piece) == 1:
            return None
        for cut in range(1, len(piece)):
            left, right = self.ranks.get(piece[:cut]), self.ranks.get(piece[cut:])
            if left is not None and right is not None and left < token and right < token and self.may_follow(left, right, token):
                return left, right
        return token, token

    def _spine(self, token: int, side: int) -> tuple[int, ...] | None:
        """Tokens along one edge while the merges build a token, from byte to token; None if no merges build it."""
        key = (token, side)
        if key not in self.spines:
            parts = self._parts(token)
            if parts is None:
                found = (token,)
            elif parts == (token, token):
                found = None
            else:
                lower = self._spine(parts[side], side)
                found = lower and (*lower, token)
            self.spines[key] = found
        return self.spines[key]

    def may_follow(self, before: int, token: int, below: float = math.inf) -> bool:
        """Whether merges of ranks under `below` leave the two tokens as they are; before is -1 at the start.

        Both tokens grow along their facing edges; the neighbours x, y merge across the boundary if that has a lower rank
        than the next merge of either (the leftmost goes first among equals).
        """
        left = self._spine(before, 1) if before >= 0 else ()
        right = self._spine(token, 0)
        if left is None or right is None:
            return False
        if before < 0:
            return True
        i = j = 0
        while True:
            next_left = left[i + 1] if i + 1 < len(left) else math.inf
            next_right = right[j + 1] if j + 1 < len(right) else math.inf
            across = self.ranks.get(self.bytes_of[left[i]] + self.bytes_of[right[j]], math.inf)
            if across < below and across < next_left and across <= next_right:
                return False
            if next_left == next_right == math.inf:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    def _move(self, state: dict, byte: int) -> tuple[dict, tuple[int, ...]]:
        """The state after one more byte, and the tokens that are settled by it."""
        live = []
        edge, edges, token_at = byte, self.edges, self.token_at
        for before, node, owed in unpack(state[READINGS]):
            to = edges.get(node << 8 | edge)
            if to is None:
                continue
            live.append((before, to, owed))
            token = token_at.get(to)
            if token is not None and self.may_follow(before, token):
                live.append((token, 0, (*owed, token)))
        if not live:
            raise ValueError("the ranks do not cover every byte")
        first, n = live[0][2], 0
        if first:
            least = min(len(x[2]) for x in live)
            while n < least and all(x[2][n] == first[n] for x in live):
                n += 1
            if n:
                live = [(before, node, owed[n:]) for before, node, owed in live]
        readings = pack(live)
        after = self.states.get(readings)
        if after is None:
            after = self.states[readings] = {READINGS: readings}
        # The tokens' own numbers, so that none is held twice.
        state[byte] = move = (after, tuple(map(self.ranks.__getitem__, map(self.bytes_of.__getitem__, first[:n]))))
        return move

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one pretoken."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        if len(self.states) > self.most_states:
            self._forget()
        out: list[int] = []
        state = self.start
        for b in piece:
            move = state.get(b)
            if move is None:
                move = self._move(state, b)
            state, emitted = move
            if emitted:
                out += emitted
        rest = state.get(OWED)
        if rest is None:
            owed = next(owed for _, node, owed in unpack(state[READINGS]) if not node)
            rest = state[OWED] = tuple(map(self.ranks.__getitem__, map(self.bytes_of.__getitem__, owed)))
        return (*out, *rest)


class Pieces(dict):
    """Ids of pretokens as text, in two generations: when this one is full it becomes the older one, and what is used
    again moves back. So the frequent ones stay, and there are at most most_pieces."""

    def __init__(self, fst: Transducer):
        super().__init__()
        self.fst, self.older = fst, {}
        self.shown = {i: str(i) for i in fst.bytes_of}

    def __missing__(self, piece: str) -> str:
        found = self.older.get(piece)
        if found is None:
            found = " ".join(map(self.shown.__getitem__, self.fst.encode_piece(piece.encode("utf-8", "surrogatepass"))))
        if len(piece) <= 64:
            if len(self) >= self.fst.most_pieces // 2:
                self.older = dict(self)
                self.clear()
            self[piece] = found
        return found


class Utf8Stream:
    """Decodes token ids in any chunks; a character split between tokens comes out with its last byte.

    The states are the bytes of an unfinished character (three at most). Moves are made once for each state and token.
    """

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of, self.moves, self.pending = bytes_of, {b"": {}}, b""

    @staticmethod
    def step(pending: bytes, more: bytes) -> tuple[str, bytes]:
        """Text that is now complete, and the bytes of an unfinished character; bytes that no character has become U+FFFD."""
        data = pending + more
        tail = 0
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b >= 0xC0:
                need = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                tail = back if back < need and b < 0xF5 else 0
                break
            if b < 0x80:
                break
        if tail and data[-tail:].decode("utf-8", "ignore") == "" and tail > 1:
            try:  # E0 80, ED A0, F0 80 and F4 90 begin no character
                data[-tail:].decode("utf-8")
            except UnicodeDecodeError as e:
                if e.reason != "unexpected end of data":
                    tail = 0
        cut = len(data) - tail
        return data[:cut].decode("utf-8", "replace"), data[cut:]

    def feed(self, ids: Iterable[int]) -> str:
        out, pending = [], self.pending
        here = self.moves.setdefault(pending, {})
        for i in ids:
            move = here.get(i)
            if move is None:
                text, left = self.step(pending, self.bytes_of[i])
                move = here[i] = (text, left, self.moves.setdefault(left, {}))
            text, pending, here = move
            if text:
                out.append(text)
        self.pending = pending
        return "".join(out)

    def end(self) -> str:
        """What an unfinished character leaves: U+FFFD."""
        left, self.pending = self.pending, b""
        return left.decode("utf-8", "replace")


def ascii_twin(pattern: str) -> str | None:
    """The pattern for ASCII texts in the standard library's syntax; None if it has other properties than L and N."""
    out, inside, at = [], False, 0
    while at < len(pattern):
        part = next((p for p in (r"\p{L}", r"\p{N}") if pattern.startswith(p, at)), pattern[at : at + 1 + (pattern[at] == "\\")])
        at += len(part)
        if part in (r"\p", r"\P"):
            return None
        inside = part == "[" or inside and part != "]"
        own = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9"}.get(part)
        out.append(part if own is None else own if inside else f"[{own}]")
    return "".join(out)


class Codec:
    """Encoding and decoding of whole texts by a rank file and a pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, **tables: int):
        self.fst = Transducer(ranks, **tables)
        self.findall = regex.compile(pattern).findall
        twin = ascii_twin(pattern)
        self.findall_ascii = re.compile(twin, re.ASCII).findall if twin else self.findall
        self.stream = Utf8Stream(self.fst.bytes_of)

    def encode(self, text: str) -> tuple[list[int], str]:
        """Ids, and the ids as text."""
        if not (pieces := (self.findall_ascii if text.isascii() else self.findall)(text)):
            return [], ""
        shown = " ".join(map(self.fst.pieces.__getitem__, pieces))
        return np.fromstring(shown, np.int64, sep=" ").tolist(), shown

    def decode(self, ids: Iterable[int]) -> str:
        return self.stream.feed(ids) + self.stream.end()


def codec(path: str, pattern: str, **tables: int) -> Codec:
    """One for each Python worker, which is used for all its tasks. tables: the transducer's most_states, most_pieces."""
    return kept(("bpe", path, pattern, *sorted(tables.items())), lambda: Codec(read_ranks(path), pattern, **tables))


TOKENS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids and the text decoded from them, for every document; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        made = ((doc_id, (ids := c.encode(text or "")[0]), c.decode(ids)) for doc_id, text in text_rows(batches))
        with no_cycles():
            yield from in_batches(made, TOKENS, 256)

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(documents: DataFrame, path: str, pattern: str, **tables: int) -> DataFrame:
    """doc_id, n_tokens, and sha256 of the ids and of the decoded bytes; the ids stay in the worker.

    tables: most_states and most_pieces, which trade a worker's memory for time and change no result.
    """

    def rows(c: Codec, given: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in given:
            ids, shown = c.encode(text or "")
            back = c.decode(ids)
            yield doc_id, len(ids), hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with no_cycles():
            yield from in_batches(rows(codec(path, pattern, **tables), text_rows(batches)), DIGESTS)

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
