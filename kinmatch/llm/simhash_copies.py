"""Classes of near copies: texts whose sets of shingles have a Jaccard similarity high enough, and what links reach.

Fingerprints cannot bound this similarity: at 0.8 two of 64 bits differ in ten on average, at times in twenty. They
find the nearest copies first: the generalised pigeonhole probes of simhash.py propose texts within two bits, and what
they propose is compared on the shingles. That makes the classes of crowds of copies without looking at all their pairs.

No link may be missed, so an exact join finds the rest. If all sets are read in one order, two sets that similar share a
shingle among the first n - ceil(similarity * n) + 1 of each, so every pair to link meets in the cell of such a shingle.
Any order will do: rare shingles come first, so a text of which a fifth is its own meets none. Documents lie in chunks,
which ask how frequent their shingles are (exchange.py), and only first shingles that others have too become cells.
In a cell that holds several classes, the members outside of its largest class are compared with a few members of that,
over several rounds with other members; classes grow meanwhile. Only what is still apart then is compared with all of the cell.

Groups of copies: texts with equal sets are one node from the start, told by 96 bits.

Defined results: null and blank texts are equal to each other and near nothing else; a text of fewer words than a shingle
has one shingle. near_copies gives a row for every row, first_copies the rows that stay as they were, all columns kept,
whatever their names. Rows without a doc_id come after all others; of rows with one id and text one stays. Texts of any
length are read whole. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.llm import exchange as ex
from kinmatch.llm.common import SLICE_ROWS, Scratch, map_slices, shuffle_partitions, table_schema
from kinmatch.llm.components import connected_components
from kinmatch.llm.simhash import majority, near_pairs, shingle_digests

#: Shingles that are more frequent have no order by frequency among themselves.
MOST_COUNTED = 65_535
#: Rounds, at most, of comparisons with members of a cell's largest class, and how many members each.
ROUNDS, MEMBERS = 6, 4
#: Pairs, of 16 bytes each, that are sent to all tasks; more are joined by a shuffle.
PAIRS_SENT = 500_000
#: Bytes of text, in expectation, whose shingles a bucket of questions sees.
BUCKET_BYTES = 8 << 20
NO_ID = 2**63 - 1
NODE = "node bigint, hi bigint, lo bigint, least bigint, n bigint, fp bigint, cells array<bigint>, at array<int>, text binary"


def shingles(text: str | None, words_per_shingle: int) -> np.ndarray:
    """Hashes of the distinct shingles, in order."""
    return np.unique(shingle_digests(text, words_per_shingle).reshape(-1).view(">u8").astype(np.uint64))


def _keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    told = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in sets), ">u8").reshape(-1, 2).astype(np.uint64)
    return told[:, 0], told[:, 1] & ~np.uint64(0xFFFFFFFF)


class _Sets:
    """Of a chunk's rows the keys of their sets, and the question which are the first with theirs."""

    def __init__(self, row: dict):
        self.hi, self.lo = ex.unpack_all(row["more"])
        self.id = ex.unpack(row["ids"])
        at = np.arange(len(self.id))
        self.node = row["chunk"] * SLICE_ROWS + at
        self.ask = ex.FirstAsk(self.hi, (self.lo >> np.uint64(32)).astype(np.uint32), self.id, self.node)


def _nodes(chunks: DataFrame, similarity: float, text_col: str, words_per_shingle: int) -> DataFrame:
    """Rows of NODE, one for each distinct set: its first shingles that others have too, and their places; the text if any."""
    spark = chunks.sparkSession
    size = chunks.select(F.sum("n_bytes")).first()[0] or 0
    buckets = max(2 * shuffle_partitions(spark), size // BUCKET_BYTES, 1)

    def read(row: dict):
        """The first row of each set in the chunk: its place, text and set."""
        sets, texts = _Sets(row), ex.rows_of(row["payload"]).column(text_col)
        lead = np.sort(sets.ask.lead)
        return sets, texts, lead, [shingles(texts[k].as_py(), words_per_shingle) for k in lead.tolist()]

    def ask_sets(row: dict):
        yield _Sets(row).ask.asks(row["chunk"], buckets)

    def ask_shingles(row: dict):
        *_, own = read(row)
        keys, n = np.unique(np.concatenate(own) & ex.SHORT, return_counts=True)
        if len(keys):
            yield ex.asks(row["chunk"], buckets, keys, [np.minimum(n, MOST_COUNTED).astype(np.uint16)])

    def node_rows(row: dict, right: pa.Table) -> pa.Table:
        sets, texts, lead, own = read(row)
        is_set = np.array(right.column("is_set").to_pylist(), bool)
        first = sets.ask.firsts(ex.answer_of(right.filter(pa.array(is_set)), bool))[lead]
        _, each = np.unique(np.concatenate(own) & ex.SHORT, return_inverse=True)
        often = ex.answer_of(right.filter(pa.array(~is_set)), np.uint16)[each]
        ends = np.cumsum([len(x) for x in own])
        pack, out = zstandard.ZstdCompressor(level=3).compress, []
        for at, mine, end, new in zip(lead.tolist(), own, ends.tolist(), first.tolist()):
            if new:
                k = often[end - len(mine) : end]
                prefix = np.lexsort((mine, k))[: len(mine) - int(np.ceil(similarity * len(mine) - 1e-6)) + 1] if len(mine) else np.zeros(0, np.int64)
                met = np.flatnonzero(k[prefix] > 1)
                fp = int.from_bytes(majority(mine.astype(">u8").view(np.uint8).reshape(-1, 8)).tobytes(), "big", signed=True)
                text = pack((texts[at].as_py() or "").encode()) if len(met) else None
                out.append((int(sets.node[at]), int(sets.hi[at].view(np.int64)), int(sets.lo[at].view(np.int64)), int(sets.id[at]), len(mine), fp, mine[prefix[met]].view(np.int64), met.astype(np.int32), text))
        kinds = (pa.int64(),) * 6 + (pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
        return pa.table([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * len(kinds), kinds)], names=[x.split()[0] for x in NODE.split(", ")])

    asked = ex.answered(chunks.select("chunk", "ids", "more").mapInArrow(ex.per_chunk(ask_sets), ex.ASKS), ex.is_first).withColumn("is_set", F.lit(True))
    met = ex.answered(chunks.select("chunk", "ids", "more", "payload").mapInArrow(ex.per_chunk(ask_shingles), ex.ASKS), lambda keys, n: np.minimum(ex.totals(keys, n), MOST_COUNTED).astype(np.uint16)).withColumn("is_set", F.lit(False))
    return ex.with_answers(chunks.select("chunk", "ids", "more", "payload"), asked.union(met), node_rows, NODE)


def _may(similarity: float) -> F.Column:
    """Whether x and y can be similar enough by their sizes and, if this cell is the first that they share, its places."""
    needed = similarity / (1 + similarity) * (F.col("x.n") + F.col("y.n")) - 1e-6
    return (F.least("x.n", "y.n") >= similarity * F.greatest("x.n", "y.n") - 1e-6) & (F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) >= needed)


class _Classes:
    """The classes of nodes, made link by link."""

    def __init__(self, nodes: DataFrame, scratch: Scratch, similarity: float, words_per_shingle: int):
        self.scratch, self.similarity, self.words = scratch, similarity, words_per_shingle
        self.texts = nodes.where("text is not null").select("node", "text")
        members = nodes.select("node", "n", "fp", F.explode(F.arrays_zip("cells", "at")).alias("c")).select("node", "n", "fp", "c.cells", "c.at")
        several = members.groupBy("cells").agg(F.count("*").alias("k")).where("k > 1").select("cells")
        self.cells = scratch.written(members.join(several, "cells").select(F.col("cells").alias("cell"), "node", "n", "at", "fp"))
        self.links: DataFrame | None = None

    def _compare(self, pairs: DataFrame, *made_from: DataFrame) -> bool:
        """Adds the pairs (a, b) whose shingles are similar enough to the links; whether there are any. Drops the tables that they were made from."""
        words, similarity = self.words, self.similarity
        pairs = self.scratch.written(pairs.selectExpr("least(a, b) a", "greatest(a, b) b").where("a <> b").distinct())
        self.scratch.drop(*made_from)

        def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
            unpack, keep = zstandard.ZstdDecompressor().decompress, []
            for x, y in zip(batch.column("text").to_pylist(), batch.column("text_b").to_pylist()):
                p, q = (shingles(unpack(t).decode(), words) for t in (x, y))
                shared = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(shared > 0 and shared >= similarity * (len(p) + len(q) - shared) - 1e-9)
            return batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

        few = pairs.count() <= PAIRS_SENT
        sent = F.broadcast(pairs) if few else pairs
        with_a = self.texts.withColumnRenamed("node", "a").join(sent, "a")
        with_b = self.texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")).join(sent, "b")
        found = self.scratch.written(map_slices(with_a.join(with_b, ["a", "b"]).select("a", "b", "text", "text_b"), compare, "a bigint, b bigint"))
        self.scratch.drop(pairs)
        self.links = found if self.links is None else self.links.union(found)
        return not found.isEmpty()

    def _placed(self) -> DataFrame:
        """(cell, main, x): members of cells with several classes, and the largest of these; x: node, n, at, component."""
        named = connected_components(self.links)
        placed = self.cells.join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
        sizes = placed.groupBy("cell", "component").agg(F.count("*").alias("k"))
        mixed = sizes.groupBy("cell").agg(F.count("*").alias("classes"), F.max(F.struct("k", "component")).getField("component").alias("main")).where("classes > 1").select("cell", "main")
        return self.scratch.written(placed.join(mixed, "cell").select("cell", "main", F.struct("node", "n", "at", "component").alias("x")))

    def near_fingerprints(self) -> None:
        """Nodes of one fingerprint with the least of them, and the least ones of fingerprints within two bits."""
        fps = self.cells.select("fp", "node").distinct()
        least = self.scratch.written(fps.groupBy("fp").agg(F.min("node").alias("least")))
        equal = fps.join(least, "fp").select(F.col("node").alias("a"), F.col("least").alias("b"))
        first, other = (least.select(F.col("fp").alias(c), F.col("least").alias(f"least_{c}")) for c in "ab")
        near = near_pairs(least.select("fp")).join(first, "a").join(other, "b")
        self._compare(equal.union(near.select("least_a", "least_b")), least)

    def with_members(self, number: int) -> bool:
        """What is outside of a cell's largest class with some members of that, other ones for each number; whether links come of it."""
        placed = self._placed()
        chosen = [F.min(F.struct(F.xxhash64("x.node", F.lit(number * MEMBERS + k)).alias("place"), F.col("x"))).getField("x").alias(f"y{k}") for k in range(MEMBERS)]
        hubs = placed.where("x.component = main").groupBy("cell").agg(*chosen).select("cell", F.array_distinct(F.array(*[f"y{k}" for k in range(MEMBERS)])).alias("ys"))
        met = placed.where("x.component <> main").join(hubs, "cell").select("x", F.explode("ys").alias("y")).where(_may(self.similarity))
        return self._compare(met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")), placed)

    def with_all(self) -> None:
        """What is still outside of a cell's largest class with all of other classes there."""
        placed = self._placed()
        asks = placed.where("x.component <> main").select("cell", "x")
        met = asks.join(placed.select("cell", F.col("x").alias("y")), "cell").where("x.component <> y.component").where(_may(self.similarity))
        self._compare(met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")), placed)


def _classes(docs: DataFrame, scratch: Scratch, similarity: float, id_col: str, text_col: str, words_per_shingle: int) -> tuple[DataFrame, DataFrame]:
    """(chunks, nodes with component): both written."""

    def keys(texts: list[bytes]) -> bytes:
        return ex.pack_all(_keys([shingles(x.decode(), words_per_shingle) for x in texts]))

    chunks = scratch.written(ex.chunks_of(docs, id_col, text_col, keys))
    nodes = scratch.written(_nodes(chunks, similarity, text_col, words_per_shingle))
    classes = _Classes(nodes, scratch, similarity, words_per_shingle)
    classes.near_fingerprints()
    number = 0
    while number < ROUNDS and classes.with_members(number):
        number += 1
    classes.with_all()
    named = nodes.select("node", "hi", "lo", "least").join(connected_components(classes.links), "node", "left")
    named = scratch.written(named.withColumn("component", F.coalesce("component", "node")))
    scratch.drop_others(chunks, named)
    return chunks, named


def near_copies(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5) -> DataFrame:
    """(doc_id, component_id) of every row; component_id is the smallest doc_id that links reach, null if there is none."""
    rows = docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text")
    chunks, named = _classes(rows, Scratch(docs.sparkSession), similarity, "doc_id", "text", words_per_shingle)

    def told(row: dict):
        sets = _Sets(row)
        yield pa.record_batch([pa.array(x) for x in (sets.id, sets.hi.view(np.int64), sets.lo.view(np.int64))], names=["doc_id", "hi", "lo"])

    known = lambda c: F.when(F.col(c) < NO_ID, F.col(c)).alias(c)
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_set = named.join(least, "component").select("hi", "lo", "component_id")
    return chunks.select("chunk", "ids", "more").mapInArrow(ex.per_chunk(told), "doc_id bigint, hi bigint, lo bigint").join(of_set, ["hi", "lo"]).select(known("doc_id"), known("component_id"))


def first_copies(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5) -> DataFrame:
    """One row of each class, all columns kept: one with the smallest doc_id, or any if the class has null ids only."""
    chunks, named = _classes(docs, Scratch(docs.sparkSession), similarity, id_col, text_col, words_per_shingle)
    first = named.groupBy("component").agg(F.min(F.struct("least", "node")).getField("node").alias("node"))
    kept = first.select(F.shiftright("node", SLICE_ROWS.bit_length() - 1).alias("chunk"), F.col("node").bitwiseAND(F.lit(SLICE_ROWS - 1)).cast("int").alias("row"))

    def keep(row: dict, right: pa.Table) -> pa.Table:
        rows = ex.rows_of(row["payload"])
        return pa.Table.from_batches([rows.take(pa.array(np.sort(right.column("row").to_numpy())))])

    return ex.with_answers(chunks.select("chunk", "payload"), kept, keep, table_schema(docs))
