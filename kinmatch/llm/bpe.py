"""Byte-level BPE by a lazily determinised transducer, and streaming decoding.

A token sequence is the BPE encoding of its bytes exactly if each neighbouring pair is the encoding of its own bytes.
So every prefix of a text has one encoding, which ends in one last token, and a non-deterministic reader needs to hold
where a token may have begun: the token that ended there, and a node of the trie of tokens. A set of such readings is
a state. States and their arcs are made when first met and kept in bounded number. An arc emits the token that ends
the encoding of what is read so far; it stands once no reading reaches behind it, so never later than the longest
token of the vocabulary, and the tokens of a match are read back from its end.

Defined results: a null text is an empty one; an empty text has no tokens, an empty list of ids, and decodes to no
bytes. Repeated rows each give a row.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from kinmatch.llm.common import map_slices, per_process, text_slices
from kinmatch.llm.pretokens import Cutter, bounded

SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
#: Matches, arcs and pairs that a process keeps; beyond it a store starts anew, or loses its older half.
CACHE_MATCHES, CACHE_ARCS, CACHE_PAIRS = 400_000, 400_000, 1_000_000
#: Bytes of text that are cut at a time; a longer text is read in blocks of about so many.
BLOCK_BYTES = 1 << 20
#: Ids that the decoder gets at a time.
DECODE_IDS = 4096


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines)}


class Transducer:
    """encode() maps the bytes of one pattern match to token ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.step: dict[int, int] = {}
        self.token: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                node = self.step.setdefault(node << 8 | byte, len(self.token))
                if node == len(self.token):
                    self.token.append(-1)
            self.token[node] = rank
        self.inner = [False] * len(self.token)
        for key in self.step:
            self.inner[key >> 8] = True
        self.length = {rank: len(token) for token, rank in ranks.items()}
        self.halves: dict[int, list[int] | None] = {}
        self.edges: dict[int, tuple[list, list] | None] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self._forget_states()

    def _forget_states(self) -> None:
        """A state is a dict from a byte to its arc, (next state, token); at -1 it has its readings, (last token, node)."""
        for state in getattr(self, "states", {}).values():
            state.clear()  # states refer to each other, and the collector may be off
        self.states: dict[tuple, dict] = {}
        self.n_arcs = 0
        self.start = self._state(((-1, 0),))

    def _state(self, readings: tuple) -> dict:
        state = self.states.get(readings)
        if state is None:
            state = self.states[readings] = {-1: readings}
        return state

    def merged(self, text: bytes, until: int = 1) -> list[int]:
        """The definition: merge the pair of lowest rank, the leftmost of equals, until none, or so many parts, are left."""
        parts = [text[i : i + 1] for i in range(len(text))]
        ranks = self.ranks
        while len(parts) > until:
            best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[x] for x in parts]

    def _edges(self, token: int) -> tuple[list, list] | None:
        """For either end of a token, the parts that lie there while it is merged, each with the rank that ends it.

        None if merging never makes the token.
        """
        if token not in self.edges:
            left, right = [(self.bytes_of[token], 1 << 60)], [(self.bytes_of[token], 1 << 60)]
            for side, found in ((0, left), (-1, right)):
                at = token
                while len(self.bytes_of[at]) > 1:
                    if at not in self.halves:
                        halves = self.merged(self.bytes_of[at], 2)
                        self.halves[at] = halves if len(halves) == 2 else None
                    if self.halves[at] is None:
                        break
                    part = self.halves[at][side]
                    found.append((self.bytes_of[part], at))
                    at = part
                else:
                    continue
                left = None
                break
            self.edges[token] = (left, right) if left else None
        return self.edges[token]

    def _fits(self, last: int, token: int) -> bool:
        """Whether token may follow last (-1: begin a match): no merge across the border comes before both are made."""
        key = (last, token)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > CACHE_PAIRS:
                self.pairs.clear()
            known, edges = True, self._edges(token)
            if edges is None:
                known = False
            elif last >= 0:
                rank_of = self.ranks.get
                for a, until_a in self._edges(last)[1]:
                    for b, until_b in edges[0]:
                        rank = rank_of(a + b)
                        if rank is not None and rank < until_a and rank <= until_b:
                            known = False
                            break
                    if not known:
                        break
            self.pairs[key] = known
        return known

    def _arc(self, state: dict, byte: int) -> tuple[dict, int]:
        """The next state, and the token that ends the encoding of what is read now."""
        on, ended, step, tokens, inner, pairs = [], -1, self.step, self.token, self.inner, self.pairs
        for last, node in state[-1]:
            to = step.get(node << 8 | byte)
            if to is None:
                continue
            if inner[to]:
                on.append((last, to))
            if ended < 0:
                token = tokens[to]
                if token >= 0:
                    fits = pairs.get((last, token))
                    if self._fits(last, token) if fits is None else fits:
                        ended = token
        on.append((ended, 0))
        if self.n_arcs > CACHE_ARCS:
            self._forget_states()
        self.n_arcs += 1
        arc = (self._state(tuple(on)), ended)
        if state:
            state[byte] = arc
        return arc

    def encode(self, match: bytes) -> list[int]:
        whole = self.ranks.get(match)
        if whole is not None:
            return [whole]
        state, ends = self.start, []
        for byte in match:
            state, token = state.get(byte) or self._arc(state, byte)
            ends.append(token)
        out, at, lengths = [], len(ends), self.length
        while at:
            token = ends[at - 1]
            out.append(token)
            at -= lengths[token]
        out.reverse()
        return out


class Utf8Stream:
    """An incremental UTF-8 machine: feed() gives the text of the characters complete so far and holds back the rest."""

    def __init__(self):
        self.held = b""

    @staticmethod
    def _open(data: bytes) -> int:
        """How many bytes at the end begin a character that is not complete."""
        for back in range(1, min(4, len(data)) + 1):
            byte = data[-back]
            if byte < 0x80:
                return 0
            if byte >= 0xC0:
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                return back if back < need else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        back = self._open(data)
        self.held = data[len(data) - back :] if back else b""
        return data[: len(data) - back].decode("utf-8", "replace")

    def end(self) -> str:
        held, self.held = self.held, b""
        return held.decode("utf-8", "replace")


def decode(ids, bytes_of) -> str:
    """The text of ids, read in bounded steps."""
    stream, out = Utf8Stream(), []
    for at in range(0, len(ids), DECODE_IDS):
        out.append(stream.feed(b"".join(map(bytes_of.__getitem__, ids[at : at + DECODE_IDS]))))
    out.append(stream.end())
    return "".join(out)


def gathered(values: pa.Array, at: np.ndarray) -> bytes:
    """The bytes of the values at these places, one behind the other."""
    taken = values.take(pa.array(at))
    data = taken.buffers()[2]
    return data.to_pybytes()[: np.frombuffer(taken.buffers()[1], np.int32)[taken.offset + len(taken)]] if data else b""


class Encoder:
    """Encodes the distinct matches of many texts at a time, and keeps what matches became."""

    def __init__(self, path: str):
        self.machine = Transducer(read_ranks(path))
        self.cutter = Cutter()
        self.known: dict[bytes, bytes] = {}
        size = max(self.machine.bytes_of, default=-1) + 1
        #: By id: its decimal digits and a comma, and its bytes.
        self.decimal = pa.array([b"%d," % i for i in range(size)], pa.binary())
        self.bytes_of = pa.array([self.machine.bytes_of.get(i) for i in range(size)], pa.binary())

    def _ids(self, distinct: list[bytes]) -> list[bytes]:
        """The ids of each match, as bytes of 32-bit numbers."""
        known, encode, out = self.known, self.machine.encode, []
        if len(known) > CACHE_MATCHES:
            # the older half goes: frequent matches are soon there again
            for match in list(islice(known, CACHE_MATCHES // 2)):
                del known[match]
        for match in distinct:
            ids = known.get(match)
            if ids is None:
                ids = array("i", encode(match)).tobytes()
                if len(match) <= 40:
                    known[match] = ids
            out.append(ids)
        return out

    def encode_all(self, data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, whose bytes lie in data up to these ends, and where those of each text end."""
        if not data:
            return np.zeros(0, np.int32), np.zeros(len(ends), np.int64)
        begins = np.concatenate(([0], ends[:-1]))
        starts = self.cutter.starts(np.frombuffer(data, np.uint8), begins)
        borders = np.append(starts, len(data)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(borders), pa.py_buffer(data)]).dictionary_encode()
        parts = self._ids(coded.dictionary.to_pylist())
        code = coded.indices.to_numpy(zero_copy_only=False)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        each = sizes[code]
        until = np.cumsum(each)
        at = np.repeat((np.cumsum(sizes) - sizes)[code] - (until - each), each)
        at += np.arange(len(at))
        ids = np.frombuffer(b"".join(parts), np.int32)[at]
        return ids, np.concatenate(([0], until))[np.searchsorted(starts, ends)]

    def encode(self, text: str) -> list[int]:
        data = text.encode()
        return self.encode_all(data, np.array([len(data)]))[0].tolist()


class Digest:
    """Takes the ids of a text in parts: counts them, and digests them and the characters that they decode to."""

    def __init__(self, own: Encoder):
        self.own, self.n, self.stream, self.comma = own, 0, Utf8Stream(), b""
        self.ids, self.back = hashlib.sha256(), hashlib.sha256()

    def take(self, ids: np.ndarray) -> None:
        self.n += len(ids)
        for at in range(0, len(ids), DECODE_IDS):
            step = ids[at : at + DECODE_IDS]
            self.ids.update(self.comma + gathered(self.own.decimal, step)[:-1])
            self.comma = b","
            self.back.update(self.stream.feed(gathered(self.own.bytes_of, step)).encode())

    def end(self) -> tuple[int, str, str]:
        self.back.update(self.stream.end().encode())
        return self.n, self.ids.hexdigest(), self.back.hexdigest()


def encode_decode(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token count, and digests of the ids and of the bytes they decode to, of every text."""
    encoder = per_process(lambda: Encoder(ranks))

    def digest(part: pa.RecordBatch) -> pa.RecordBatch:
        own, out = encoder(), []
        for piece in text_slices([part], size=BLOCK_BYTES):
            texts = pc.fill_null(piece.column("text"), "")
            texts.validate(full=True)
            texts = texts.cast(pa.large_binary()).to_pylist()
            if len(texts) == 1:
                out.append(Digest(own))
                for block in bounded(texts[0], BLOCK_BYTES):
                    out[-1].take(own.encode_all(block, np.array([len(block)]))[0])
                continue
            ids, ends = own.encode_all(b"".join(texts), np.cumsum([len(x) for x in texts]))
            for begin, end in zip(np.concatenate(([0], ends[:-1])), ends, strict=True):
                out.append(Digest(own))
                out[-1].take(ids[begin:end])
        n, ids_hex, back_hex = zip(*[x.end() for x in out], strict=True)
        return pa.record_batch([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hex), pa.array(back_hex)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_slices(docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text"), digest, SCHEMA)
