"""Language-model scores by a weighted backoff automaton.

Every word of the training documents is counted, over the whole corpus, and every pair of neighbours. Pairs seen
LEAST_PAIR times become arcs, absolutely discounted, of a state for their first word; the weight left goes to a failure
arc to the empty state, which gives any token its smoothed unigram probability. A text is traversed once from left to
right, with the end of a text as the state it begins in.

Nothing is gathered in one place: documents are dealt to chunks, a chunk asks for the counts of its own distinct words
and pairs and for the weights of its own states, and the answers come back to it by joins. Pairs are asked for by
64-bit hashes, in order and packed, so that an answer is a row of counts in the same order. Pairs with equal hashes
would count as one: of 10^9 pairs, 0.03 such cases are expected.

Defined results: a null or blank text is the single end token. Without training documents every count is 0. Rows
that share a doc_id each give a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.llm.common import map_slices, written

DISCOUNT = 0.75
#: Shares of the tokens that words and pairs must have to be modelled: none.
CORE_SHARE, PAIR_SHARE = 0.0, 0.0
#: Training occurrences from which on a pair is an arc.
LEAST_PAIR = 2
#: Bytes of text, in expectation, of a chunk that a task holds.
CHUNK_BYTES = 10 << 20
#: The end of a text, as a word; no real word is empty.
END = ""
SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _texts(column: pa.ChunkedArray) -> pa.Array:
    unpack = zstandard.ZstdDecompressor().decompress
    return pa.array([unpack(x).decode() for x in column.to_pylist()], pa.string())


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of all texts, in order, and how many each has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, parent = lists.flatten(), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(words), 0)
    words, parent = words.filter(full), parent.filter(full)
    return words, np.bincount(parent.to_numpy(zero_copy_only=False), minlength=len(texts))


def with_ends(values: np.ndarray, per_text: np.ndarray, end: int) -> np.ndarray:
    """Values of all words with one for the end after those of each text."""
    return np.insert(values, np.cumsum(per_text), end)


PACKED = "chunk int, doc_id array<bigint>, held_out array<boolean>, packed array<binary>"


def _pack_chunk(table: pa.Table) -> pa.Table:
    """A chunk as one row, so that later passes over chunks need no shuffle."""
    lists = {c: pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), table.column(c).combine_chunks()) for c in ("doc_id", "held_out", "packed")}
    return pa.table({"chunk": pa.array([table.column("chunk")[0].as_py()], pa.int32()), **lists})


def _documents(chunk: pa.RecordBatch | pa.Table) -> pa.Table:
    """The documents of the one chunk in a batch."""
    columns = {c: chunk.column(c) for c in ("doc_id", "held_out", "packed")}
    return pa.table({c: (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x).flatten() for c, x in columns.items()})


def _per_chunk(fn):
    """fn(chunk number, its documents) over rows that are chunks."""

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                yield from fn(one.column("chunk")[0].as_py(), _documents(one)).combine_chunks().to_batches()

    return run


def _chunk_words(chunk: int, table: pa.Table) -> pa.Table:
    """Distinct words of a chunk, with how often its training documents have each."""
    held = table.column("held_out").to_numpy()
    words, per_text = tokens(_texts(table.column("packed")))
    coded = words.dictionary_encode()
    counts = np.bincount(coded.indices.to_numpy(zero_copy_only=False)[np.repeat(~held, per_text)], minlength=len(coded.dictionary))
    n = len(counts) + 1
    return pa.table({"word": pa.concat_arrays([coded.dictionary, pa.array([END])]), "chunk": pa.array(np.full(n, chunk, np.int32)), "n": pa.array(np.append(counts, (~held).sum()).astype(np.int64))})


def _pack(x: np.ndarray) -> bytes:
    """Numbers as compressed planes of their bytes."""
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def _unpack(x: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


class _Neighbours:
    """The tokens of a chunk and its distinct pairs of neighbours, in the order of their hashes.

    words: distinct words, END last; at, before: the word of each token and of the one before it; hashes, each: distinct
    pairs and the pair of each token; one: a token of each pair.
    """

    def __init__(self, table: pa.Table):
        tokens_, self.per_text = tokens(_texts(table.column("packed")))
        coded = tokens_.dictionary_encode()
        self.words = pa.concat_arrays([coded.dictionary, pa.array([END])])
        self.at = with_ends(coded.indices.to_numpy(zero_copy_only=False), self.per_text, len(coded.dictionary)).astype(np.int64)
        self.before = np.concatenate(([len(coded.dictionary)], self.at[:-1]))
        of = np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in self.words.to_pylist()), np.uint64, len(self.words))
        x = of[self.before] * np.uint64(0x9E3779B97F4A7C15) + (of[self.at] ^ of[self.at] >> np.uint64(29))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        self.hashes, self.one, self.each = np.unique(x ^ (x >> np.uint64(31)), return_index=True, return_inverse=True)

    def answers(self, right: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        """Of what came back: the words in the order of words, and counts and ownership of pairs (0: no arc)."""
        own = right.filter(pc.is_null(right.column("bucket")))
        own = own.take(pc.index_in(self.words, own.column("word").combine_chunks()))
        packed = right.filter(pc.is_valid(right.column("bucket"))).sort_by("bucket")
        k, mine = (np.concatenate([_unpack(x, kind) for x in packed.column(c).to_pylist()]) for c, kind in (("k", np.int64), ("mine", np.bool_)))
        return own, k, mine


def _answer(table: pa.Table) -> pa.Table:
    """Sums over all chunks of the pairs of a bucket, for each chunk in its own order; one chunk owns a pair."""
    hashes = [np.cumsum(_unpack(x, np.uint64), dtype=np.uint64) for x in table.column("hashes").to_pylist()]
    n = np.concatenate([_unpack(x, np.int64) for x in table.column("n").to_pylist()])
    _, one, each = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    total = np.zeros(len(one), np.int64)
    np.add.at(total, each, n)
    k = np.where(total >= LEAST_PAIR, total, 0)[each]
    mine = np.zeros(len(n), np.bool_)
    mine[one] = True
    ends = np.cumsum([len(x) for x in hashes])[:-1]
    packed = [pa.array([_pack(x) for x in np.split(y, ends)], pa.binary()) for y in (k, mine)]
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "k": packed[0], "mine": packed[1]})


def language_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: str = "crc32(cast(doc_id as string)) % 7 = 2", discount: float = DISCOUNT, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Add-one unigram score and backoff score of every text; documents for which held_out is true are not learned from."""
    spark = docs.sparkSession
    rows = docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text").selectExpr("doc_id", f"coalesce({held_out}, false) held_out", "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))

    def compress(part: pa.RecordBatch) -> pa.RecordBatch:
        pack = zstandard.ZstdCompressor(level=1).compress
        packed = [pack((x or "").encode()) for x in part.column("text").to_pylist()]
        return pa.record_batch([part.column("doc_id"), part.column("held_out"), part.column("chunk"), pa.array(packed, pa.binary())], names=["doc_id", "held_out", "chunk", "packed"])

    placed = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(chunks)).cast("int"))
    dealt = written(map_slices(placed, compress, "doc_id bigint, held_out boolean, chunk int, packed binary").groupBy("chunk").applyInArrow(_pack_chunk, PACKED))

    of_word = Window.partitionBy("word")
    asked = dealt.mapInArrow(_per_chunk(_chunk_words), "word string, chunk int, n bigint")
    counts = written(asked.withColumn("total", F.sum("n").over(of_word)).withColumn("first", F.min("chunk").over(of_word) == F.col("chunk")).select("word", "chunk", "total", "first"))
    n, types = counts.where("first").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum((F.col("total") > 0).cast("int")), F.lit(0))).first()
    whole = float(n + types + 1)
    buckets = max(64, chunks // 2)

    def ask(chunk: int, table: pa.Table) -> pa.Table:
        near = _Neighbours(table)
        learned = np.repeat(~table.column("held_out").to_numpy(), near.per_text + 1)
        seen = np.bincount(near.each, learned, len(near.hashes)).astype(np.int64)
        bucket = (near.hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        filled, begin = np.unique(bucket, return_index=True)
        parts = [_pack(np.diff(x, prepend=np.uint64(0))) for x in np.split(near.hashes, begin[1:])]
        return pa.table({"chunk": pa.array(np.full(len(filled), chunk, np.int32)), "bucket": pa.array(filled.astype(np.int32)), "hashes": pa.array(parts, pa.binary()), "n": pa.array([_pack(x) for x in np.split(seen, begin[1:])], pa.binary())})

    asks = dealt.mapInArrow(_per_chunk(ask), "chunk int, bucket int, hashes binary, n binary")
    pairs = written(asks.groupBy("bucket").applyInArrow(_answer, "chunk int, bucket int, k binary, mine binary"))

    def with_pairs(words: DataFrame) -> DataFrame:
        return words.unionByName(pairs, allowMissingColumns=True).groupBy("chunk")

    def states(left: pa.Table, right: pa.Table) -> pa.Table:
        """What the arcs that a chunk owns add to their states."""
        if not left.num_rows:
            return pa.table({"word": pa.array([], pa.string()), "kept": pa.array([], pa.float64()), "below": pa.array([], pa.int64())})
        near = _Neighbours(_documents(left))
        own, k, mine = near.answers(right)
        arcs = np.flatnonzero(mine & (k > 0))
        first, second = near.before[near.one[arcs]], near.at[near.one[arcs]]
        kept = np.bincount(first, k[arcs] - discount, len(near.words)).astype(np.float64)
        below = np.zeros(len(near.words), np.int64)
        np.add.at(below, first, own.column("total").to_numpy()[second] + 1)
        some = np.flatnonzero(below)
        return pa.table({"word": near.words.take(pa.array(some)), "kept": pa.array(kept[some]), "below": pa.array(below[some])})

    word_totals = counts.select("chunk", "word", "total")
    weights = dealt.groupBy("chunk").cogroup(with_pairs(word_totals)).applyInArrow(states, "word string, kept double, below bigint")
    weights = written(weights.groupBy("word").agg(F.sum("kept").alias("kept"), F.sum("below").alias("below")))
    known = written(word_totals.join(weights, "word", "left").select("chunk", "word", "total", F.coalesce("kept", F.lit(0.0)).alias("kept"), F.coalesce("below", F.lit(0)).alias("below")))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({f.split()[0]: pa.array([], t) for f, t in zip(SCORES.split(", "), (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))})
        left = _documents(left)
        near = _Neighbours(left)
        own, k, _ = near.answers(right)
        total, kept, below = (own.column(c).to_numpy() for c in ("total", "kept", "below"))
        unigram = np.log10((total + 1) / whole)
        failure = np.log10((1 - kept / np.maximum(total, 1)) / (1 - below / whole))
        arc = k > 0
        weight = np.zeros(len(k))
        weight[arc] = np.log10((k[arc] - discount) / total[near.before[near.one[arc]]])
        each = np.where(arc[near.each], weight[near.each], failure[near.before] + unigram[near.at])
        begin = np.concatenate(([0], np.cumsum(near.per_text + 1)))[:-1]
        sums = lambda x: pa.array(np.add.reduceat(x, begin))
        return pa.table({
            "doc_id": left.column("doc_id"), "held_out": left.column("held_out"), "n_tokens": pa.array((near.per_text + 1).astype(np.int64)), "n_known": sums((total[near.at] > 0).astype(np.int64)),
            "train_tokens": pa.array(np.full(len(near.per_text), n, np.int64)), "base_score": sums(unigram[near.at]), "score": sums(each),
        })

    return dealt.groupBy("chunk").cogroup(with_pairs(known)).applyInArrow(score, SCORES)
