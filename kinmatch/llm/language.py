"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of up to three bytes is counted on a bounded sample of labelled documents.
A byte is coded in the longest context that the tree has; where it was not seen there, an escape is coded (method C:
as probable as the number of distinct bytes seen), the bytes seen are excluded and the next shorter context is tried,
down to equal probabilities for all bytes left. With the counts frozen, a byte's exact code length depends on its
context alone, so the lengths of all bytes in all contexts of the union of the trees are worked out once, and a text
costs one look-up a byte for all languages together. The language with the shortest code wins.

Defined results: a null text, or one without letters, is `und` with score 0, and so is any text if nothing was
learned. Equal code lengths go to the smaller language name. A text is read as if three line breaks came before it.
Repeated rows each give a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.llm.common import forget_stores, map_slices

#: Bytes of labelled text, in expectation, that each language is learned from.
LABELLED_BYTES = 4_000_000
#: A context belongs to the trees if it makes up this share of the sample, so there are at most 1 / CONTEXT_SHARE of a length.
CONTEXT_SHARE = 5e-5
UNDETERMINED = "und"
SCHEMA = "doc_id bigint, lang_pred string, score double"
_LETTER = re.compile(r"[^\W\d_]")
_PAD = b"\n\n\n"
#: Bytes whose codes are worked out at a time; the arrays for it take some 60 bytes each.
_STEP = 1 << 17


@dataclass
class LanguageModel:
    """langs; symbol: byte to symbol; state: three symbols to a context; cost: nats of context * symbols + symbol, a column a language."""

    langs: list[str]
    symbol: np.ndarray
    state: np.ndarray
    cost: np.ndarray
    symbols: int


def count_grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Four-byte strings as numbers, and how often each occurs, of one step of the texts after another."""
    data = np.frombuffer(_PAD + _PAD.join(x.encode() for x in texts), np.uint8)
    for lo in range(0, len(data) - 3, _STEP):
        step = data[lo : lo + _STEP + 3].astype(np.uint32)
        key, n = np.unique(step[:-3] << 24 | step[1:-2] << 16 | step[2:-1] << 8 | step[3:], return_counts=True)
        yield key.astype(np.int64), n.astype(np.int64)


def _gram_counts(labelled: DataFrame) -> dict[str, dict[int, int]]:
    def count(part: pa.RecordBatch) -> pa.RecordBatch | None:
        langs, grams, counts = [], [], []
        column = part.column("lang")
        for lang in pc.unique(column).to_pylist():
            for key, n in count_grams(part.column("text").filter(pc.equal(column, lang)).to_pylist()):
                langs += [lang] * len(key)
                grams.append(key)
                counts.append(n)
        return pa.record_batch([pa.array(langs, pa.string()), pa.array(np.concatenate(grams)), pa.array(np.concatenate(counts))], names=["lang", "gram", "n"])

    out: dict[str, dict[int, int]] = {}
    for lang, gram, n in map_slices(labelled, count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n")).collect():
        out.setdefault(lang, {})[gram] = n
    return out


def fit_languages(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", labelled_bytes: int = LABELLED_BYTES) -> LanguageModel | None:
    """Learns from rows with a language and a text, those with the smallest hashes of their ids up to the bound."""
    rows = labelled.where(f"`{lang_col}` is not null and `{text_col}` is not null").selectExpr(f"`{id_col}` id", f"`{text_col}` text", f"`{lang_col}` lang")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect() if r.n}
    if not sizes:
        return None
    bound = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, labelled_bytes / n))])
    place = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1_000_003)) / 1_000_003
    grams = _gram_counts(rows.where(place < F.element_at(bound, F.col("lang"))).select("text", "lang"))
    return build_model(grams) if grams else None


def build_model(grams: dict[str, dict[int, int]]) -> LanguageModel:
    langs = sorted(grams)
    keys = [np.fromiter(grams[x], np.int64) for x in langs]
    counts = [np.fromiter(grams[x].values(), np.int64) for x in langs]
    seen = np.zeros(256, bool)
    for key in keys:
        for shift in (24, 16, 8, 0):
            seen[key >> shift & 255] = True
    # symbol 0 stands for every byte that was not seen: all of those cost the same in any context
    symbol = np.where(seen, np.cumsum(seen), 0).astype(np.uint8 if seen.sum() < 256 else np.uint16)
    a = int(seen.sum()) + 1
    as_symbols = [[symbol[key >> shift & 255].astype(np.int64) for shift in (24, 16, 8, 0)] for key in keys]
    total = sum(int(x.sum()) for x in counts)

    contexts = [np.zeros(1, np.int64)]
    for order in (1, 2, 3):
        packed = [sum(s[3 - order + i] * a ** (order - 1 - i) for i in range(order)) for s in as_symbols]
        size = np.bincount(np.concatenate(packed), np.concatenate(counts), a**order)
        contexts.append(np.flatnonzero(size >= max(2, CONTEXT_SHARE * total)))
    first = np.cumsum([0, *map(len, contexts)])

    #: the state of every three symbols: the longest of their ends among the contexts
    state = np.zeros((a, a, a), np.int32)
    table = [np.zeros(1, np.int32)]
    for order in (1, 2, 3):
        own = np.zeros(a**order, np.int32)
        own[contexts[order]] = first[order] + np.arange(len(contexts[order]))
        table.append(own)
        wide = own.reshape((1,) * (3 - order) + (a,) * order)
        state = np.where(wide > 0, wide, state)

    cost = np.empty((first[-1], a, len(langs)), np.float32)
    for at, (symbols, n) in enumerate(zip(as_symbols, counts)):
        tree = []
        for order in range(4):
            own = np.zeros((len(contexts[order]), a), np.float64)
            ctx = sum((symbols[3 - order + i] * a ** (order - 1 - i) for i in range(order)), np.zeros(len(n), np.int64))
            row = table[order][ctx] - first[order]
            keep = row >= 0 if order else np.ones(len(n), bool)
            np.add.at(own, (row[keep], symbols[3][keep]), n[keep])
            tree.append(own)
        for order in range(4):
            rows = len(contexts[order])
            length, escape, excluded = np.zeros((rows, a)), np.zeros(rows), np.zeros((rows, a), bool)
            for k in range(order, -1, -1):
                suffix = table[k][contexts[order] % a**k] - first[k]
                here = np.where((suffix >= 0)[:, None] & ~excluded, tree[k][suffix], 0)
                n_here, distinct = here.sum(1), (here > 0).sum(1)
                whole = np.maximum(n_here + distinct, 1)[:, None]
                with np.errstate(divide="ignore"):
                    length += np.where(here > 0, escape[:, None] - np.log(here / whole), 0)
                    escape -= np.where(distinct > 0, np.log(distinct / whole[:, 0]), 0)
                excluded |= here > 0
            left = 256 - excluded.sum(1)
            length += np.where(excluded, 0, (escape + np.log(np.maximum(left, 1)))[:, None])
            cost[first[order] : first[order + 1], :, at] = length
    return LanguageModel(langs, symbol, state.ravel(), cost.reshape(-1, len(langs)), a)


def code_lengths(model: LanguageModel, texts: list[bytes]) -> np.ndarray:
    """Nats that each text takes in each language."""
    data = model.symbol[np.frombuffer(_PAD + _PAD.join(texts) + _PAD, np.uint8)]
    sizes = np.array([len(x) for x in texts], np.int64)
    begin = 3 + np.cumsum(sizes + 3) - sizes - 3
    bounds = np.stack([begin, begin + sizes], 1).ravel()
    before = np.zeros((len(bounds), len(model.langs)))
    running = np.zeros(len(model.langs))
    a, n = model.symbols, len(data) - 3
    for lo in range(3, n + 3, _STEP):
        hi = min(lo + _STEP, n + 3)
        tri = (data[lo - 3 : hi - 3].astype(np.int32) * a + data[lo - 2 : hi - 2]) * a + data[lo - 1 : hi - 1]
        cell = model.state[tri].astype(np.int32) * a + data[lo:hi]
        sums = np.cumsum(model.cost[cell], 0, np.float64)
        i, j = np.searchsorted(bounds, (lo, hi))
        at = bounds[i:j] - lo
        before[i:j] = running + np.where((at > 0)[:, None], sums[at - 1], 0)
        running += sums[-1]
    return before[1::2] - before[::2]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m[0].isalpha() for m in _LETTER.finditer(text))


def predict_languages(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language and its probability, were all languages equally frequent, of every text."""
    rows = docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text")
    if model is None:
        return rows.select("doc_id", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(part: pa.RecordBatch) -> pa.RecordBatch:
        forget_stores()
        lang, score = label(shared.value, part.column("text").to_pylist())
        return pa.record_batch([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return map_slices(rows, predict, SCHEMA)


def label(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    nats = code_lengths(model, [(x or "").encode() for x in texts])
    best = nats.argmin(1)
    score = 1 / np.exp(np.minimum(nats.min(1, keepdims=True) - nats, 0)).sum(1)
    known = np.array([has_letter(x) for x in texts], bool)
    return [model.langs[b] if k else UNDETERMINED for b, k in zip(best, known)], np.where(known, score, 0.0)


def with_language(docs: DataFrame, model: LanguageModel | None, text_col: str = "text", least_score: float = 0.5) -> DataFrame:
    """The rows, all columns kept, whose text has a language with at least that probability."""
    if model is None:
        return docs.limit(0)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(part: pa.RecordBatch) -> pa.RecordBatch:
        forget_stores()
        lang, score = label(shared.value, part.column(text_col).to_pylist())
        return part.filter(pa.array((np.array(lang) != UNDETERMINED) & (score >= least_score)))

    return map_slices(docs, keep, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), text_col)
