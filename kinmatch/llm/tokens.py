"""Token counts: greedy word pieces counted by an automaton that never builds the pieces.

The vocabulary has pieces that begin a word and pieces that continue one. Both go into one trie with two roots.
Every node has a failure link to where matching goes on when no child fits, and the number of pieces that are
complete on the way there; both are computed once. Counting then reads each byte of a word once.

Defined results: a null or blank text has no words and no tokens. A word that no sequence of pieces covers counts as
one token and as one unknown. Repeated rows each give a row. Words are maximal runs without ASCII white space.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from kinmatch.llm.common import map_slices, per_process

SCHEMA = "doc_id bigint, n_words bigint, n_tokens bigint, n_unknown bigint"
#: Words whose counts a process keeps; beyond it the store starts anew.
CACHE_WORDS = 300_000


def rank_file_pieces(path: str) -> tuple[set[bytes], set[bytes]]:
    """Pieces from a file of base64 tokens and ranks: tokens with a leading space and single bytes begin words, others continue them."""
    begin, inside = set(), set()
    with open(path, "rb") as lines:
        for line in lines:
            token = base64.b64decode(line.split()[0])
            if token[:1] == b" ":
                if len(token) > 1:
                    begin.add(token[1:])
            else:
                inside.add(token)
                if len(token) == 1:
                    begin.add(token)
    return begin, inside


class PieceCounter:
    """The automaton. count() gives the number of pieces of a word, or -1 if pieces cannot cover it."""

    def __init__(self, begin: Iterable[bytes], inside: Iterable[bytes]):
        step: dict[int, int] = {}
        whole = [False, False]
        start, inner = 0, 1
        for root, pieces in ((start, begin), (inner, inside)):
            for piece in pieces:
                node = root
                for byte in piece:
                    key = node << 8 | byte
                    node = step.setdefault(key, len(whole))
                    if node == len(whole):
                        whole.append(False)
                whole[node] = True
        children: list[list[tuple[int, int]]] = [[] for _ in whole]
        for key, node in step.items():
            children[key >> 8].append((key & 255, node))
        link, popped = [-1] * len(whole), [0] * len(whole)
        queue = deque([start, inner])
        while queue:
            node = queue.popleft()
            for byte, child in children[node]:
                queue.append(child)
                if whole[child]:
                    link[child], popped[child] = inner, 1
                    continue
                at, n = link[node], popped[node]
                while at >= 0 and (at << 8 | byte) not in step:
                    n += popped[at]
                    at = link[at]
                if at >= 0:
                    link[child], popped[child] = step[at << 8 | byte], n
        self.step, self.link, self.popped, self.inner = step, link, popped, inner

    def count(self, word: bytes) -> int:
        step, link, popped = self.step, self.link, self.popped
        node, n = 0, 0
        for byte in word:
            while (to := step.get(node << 8 | byte)) is None:
                n += popped[node]
                node = link[node]
                if node < 0:
                    return -1
            node = to
        while node != self.inner:
            n += popped[node]
            node = link[node]
            if node < 0:
                return -1
        return n


def word_lists(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, and how many each text has; null texts have none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(text, ""))
    words = lists.flatten()
    parent = pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(words), 0)
    words, parent = words.filter(full), parent.filter(full)
    return words, np.bincount(parent.to_numpy(zero_copy_only=False), minlength=len(text))


def token_counts(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words, tokens and unknown words of every text under the word-piece vocabulary in the file vocab."""
    counter = per_process(lambda: (PieceCounter(*rank_file_pieces(vocab)), {}))

    def count(part: pa.RecordBatch) -> pa.RecordBatch:
        automaton, known = counter()
        words, per_doc = word_lists(part.column("text"))
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(known) > CACHE_WORDS:
            known.clear()
        for word in set(distinct).difference(known):
            known[word] = automaton.count(word.encode())
        each = np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy(zero_copy_only=False)] if len(distinct) else np.zeros(0, np.int64)
        ends = np.concatenate(([0], np.cumsum(per_doc)))
        tokens = np.concatenate(([0], np.cumsum(np.where(each < 0, 1, each))))
        unknown = np.concatenate(([0], np.cumsum(each < 0)))
        return pa.record_batch(
            [part.column("doc_id"), pa.array(per_doc, pa.int64()), pa.array(tokens[ends[1:]] - tokens[ends[:-1]], pa.int64()), pa.array(unknown[ends[1:]] - unknown[ends[:-1]], pa.int64())],
            names=["doc_id", "n_words", "n_tokens", "n_unknown"],
        )

    return map_slices(docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text"), count, SCHEMA)
