"""SimHash fingerprints and the classes that near fingerprints form, by the generalised pigeonhole principle.

The 64 bits are grouped into parts of bits that tend to agree together. If a pair differs in at most t bits and the
parts' thresholds add up to t - parts + 1, it differs in some part by no more than that part's threshold. A dynamic
programme over parts allots the thresholds (-1: the part is not probed) so that the number of probes and estimated
candidates, worked out from bit statistics of all fingerprints, is smallest. Fingerprints are then probed part by part
and the candidates verified.

Equal fingerprints are one node from the start. A probed value that few fingerprints share gives the pairs among them.
One that many share gives no pairs: its fingerprints are dealt again by parts of the bits left, and where still many
agree, they are joined through the fingerprints within one bit of them, which two of them have in common exactly if they
differ in at most two bits, so that the work stays linear in a group's size.

Defined results: null, empty and blank texts have fingerprint zero and are linked like any other; texts of one or two
words have one shingle. Rows that share a doc_id with unlike texts each give a row, and the smallest doc_id counts.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmatch.llm.common import cut_lineage, map_slices
from kinmatch.llm.components import connected_components

BITS, SEED = 64, 42
#: Fingerprints that share a probed value and still are compared pair by pair.
PAIRED_AT_MOST = 24


def shingle_digests(text: str | None, words_per_shingle: int) -> np.ndarray:
    """The big-endian XXH64 of every shingle, one row of 8 bytes each; none for a text without words."""
    words = (text or "").encode().lower().split()
    k = words_per_shingle
    joined = b" ".join(words)
    if len(words) <= k:
        return np.frombuffer(xxhash.xxh64_digest(joined, SEED) if words else b"", np.uint8).reshape(-1, 8)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begin = np.concatenate(([0], ends[: len(words) - k])).tolist()
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(begin, (ends[k - 1 :] - 1).tolist())]), np.uint8).reshape(-1, 8)


def majority(rows: np.ndarray) -> np.ndarray:
    """Of every bit of the rows' bytes, whether it is set in over half of them; packed again."""
    ones = np.zeros(rows.shape[1] * 8, np.int64)
    for at in range(0, len(rows), 4096):
        ones += np.unpackbits(rows[at : at + 4096], axis=1).sum(0, dtype=np.int32)
    return np.packbits(2 * ones > len(rows))


def fingerprint(text: str | None, words_per_shingle: int = 3) -> int:
    return int.from_bytes(majority(shingle_digests(text, words_per_shingle)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed number."""

    def compute(part: pa.RecordBatch) -> pa.RecordBatch:
        out = np.array([fingerprint(x, words_per_shingle) for x in part.column("text").to_pylist()], np.uint64).view(np.int64)
        return pa.record_batch([part.column("doc_id"), pa.array(out)], names=["doc_id", "fp"])

    return map_slices(docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text"), compute, "doc_id bigint, fp bigint")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and for every two bits in how many both are set (64 x 64, summed in the tasks)."""

    def count(batches):
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            bits = ((fp[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
            both += (bits.T @ bits).astype(np.float64)
            n += len(fp)
        yield pa.record_batch([pa.array(np.arange(BITS * BITS + 1), pa.int32()), pa.array(np.append(both.ravel(), n))], names=["k", "v"])

    got = fps.select("fp").mapInArrow(count, "k int, v double").groupBy("k").agg(F.sum("v")).collect()
    values = np.zeros(BITS * BITS + 1)
    for k, v in got:
        values[k] = v
    return int(values[-1]), values[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Parts of nearly equal width, each grown by the bit that correlates most with those it has."""
    share = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-9))
    correlation = np.abs((both / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread))
    np.fill_diagonal(correlation, 0)
    left, out = set(range(BITS)), []
    for part in range(parts):
        width = BITS // parts + (part < BITS % parts)
        grown = [max(sorted(left), key=lambda b: correlation[b, sorted(left)].sum())]
        left -= set(grown)
        while len(grown) < width:
            grown.append(max(sorted(left), key=lambda b: correlation[b, grown].sum()))
            left.discard(grown[-1])
        out.append(sorted(grown))
    return out


def probes(width: int, threshold: int) -> int:
    """Values within threshold bits of one value, for thresholds up to 2."""
    return 0 if threshold < 0 else 1 + (threshold >= 1) * width + (threshold >= 2) * width * (width - 1) // 2


def part_costs(n: int, both: np.ndarray, bits: list[int], most: int) -> list[float]:
    """Probes plus estimated candidates with threshold -1, 0, ... most: how often two fingerprints differ in so few bits."""
    share = np.diag(both)[bits] / max(n, 1)
    differing = np.zeros(len(bits) + 1)
    differing[0] = 1
    for p in 2 * share * (1 - share):
        differing[1:] = differing[1:] * (1 - p) + differing[:-1] * p
        differing[0] *= 1 - p
    return [0.0] + [n * probes(len(bits), e) + n * (n - 1) / 2 * differing[: e + 1].sum() for e in range(most + 1)]


def allot(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds of -1 or more that add up to total at the least sum of costs."""

    @lru_cache(maxsize=None)
    def best(part: int, rest: int) -> tuple[float, tuple[int, ...]]:
        if part == len(costs):
            return (0.0, ()) if rest == 0 else (float("inf"), ())
        options = []
        for e, cost in enumerate(costs[part], -1):
            further, chosen = best(part + 1, rest - e)
            options.append((cost + further, (e, *chosen)))
        return min(options)

    cost, chosen = best(0, total)
    return cost, list(chosen)


def plan(n: int, both: np.ndarray, most: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the parts to probe: of two to six parts, whichever costs least."""
    found = []
    for parts in range(2, 7):
        groups = group_bits(n, both, parts)
        cost, chosen = allot([part_costs(n, both, g, most) for g in groups], most - parts + 1)
        found.append((cost, parts, [(g, e) for g, e in zip(groups, chosen) if e >= 0]))
    return min(found)[2]


def _part(fp: Column, bits: list[int]) -> Column:
    mask = sum(1 << b for b in bits)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("bigint"))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _flips(bits: list[int], threshold: int) -> list[int]:
    out = [0]
    if threshold >= 1:
        out += [1 << b for b in bits]
    if threshold >= 2:
        out += [1 << a | 1 << b for i, a in enumerate(bits) for b in bits[:i]]
    return [_signed(x) for x in out]


def _paired(there: DataFrame, asks: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Links (a, b) among fingerprints at one value: those that stand there with those that ask there."""
    both = there.join(asks.withColumnRenamed("fp", "other"), keys).where((F.col("fp") < F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= most))
    return both.select(F.col("fp").alias("a"), F.col("other").alias("b"))


def _meeting(flipped: DataFrame) -> DataFrame:
    """Links among fingerprints fp that meet at a place within one bit of them, each with the least there."""
    places = flipped.select("fp", F.explode("flips").alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("place"))
    least = places.groupBy("place").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1")
    return places.join(least, "place").where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b"))


def _numbers(values) -> Column:
    """Numbers, or lists of lists of them, as a column."""
    return F.array(*map(_numbers, values)) if isinstance(values, list) else F.lit(values).cast("bigint")


def near_pairs(fps: DataFrame, most: int = 2) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct fingerprints fp that differ in at most two bits.

    All parts are probed in one join. Crowded values of parts that are probed without flips are dealt again: two
    fingerprints that differ in at most two of the other bits agree in one of three parts of those too, so each is dealt
    once for each such part; values still crowded then are joined by flips of the bits that are left.
    """
    if most != 2:
        raise ValueError("links are worked out for two differing bits")
    n, both = bit_statistics(fps)
    parts = plan(n, both, most)
    value = lambda bits: _part(F.col("fp"), bits)
    own = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("part"), value(bits).alias("value")) for k, (bits, _) in enumerate(parts)])).alias("p")).select("fp", "p.*")

    def near(k: int, bits: list[int], threshold: int) -> Column:
        return F.transform(_numbers(_flips(bits, threshold)), lambda x: F.struct(F.lit(k).alias("part"), value(bits).bitwiseXOR(x).alias("value")))

    flipped = [near(k, *part) for k, part in enumerate(parts)]
    # each fingerprint stands at its own values; where a part has a threshold it also asks at the values near them
    asked = fps.select("fp", F.explode(F.flatten(F.array(*flipped))).alias("p")).select("fp", "p.*")
    sizes = asked.groupBy("part", "value").agg(F.count("*").alias("n"))
    few, many = sizes.where(f"n > 1 and n <= {PAIRED_AT_MOST}").drop("n"), sizes.where(f"n > {PAIRED_AT_MOST}").drop("n")
    links = _paired(own.join(few, ["part", "value"]), asked.join(few, ["part", "value"]), ["part", "value"], most)

    left = [[b for b in range(BITS) if b not in bits] for bits, _ in parts]
    again = [[bits + others[j :: most + 1] for j in range(most + 1)] for (bits, _), others in zip(parts, left)]
    masks = _numbers([[_signed(sum(1 << b for b in fixed)) for fixed in x] for x in again])
    rest = [[_flips([b for b in range(BITS) if b not in fixed], 1) for fixed in x] for x in again]
    crowd = asked.join(many, ["part", "value"])
    probed = [k for k, (_, t) in enumerate(parts) if t]
    plain = crowd.where(~F.col("part").isin(probed)) if probed else crowd
    dealt = plain.select("fp", "part", F.posexplode(F.get(masks, F.col("part"))).alias("again", "mask")).select("fp", "part", "again", F.col("fp").bitwiseAND(F.col("mask")).alias("value"))
    keys = ["part", "again", "value"]
    sizes = dealt.groupBy(*keys).agg(F.count("*").alias("n"))
    few_dealt = dealt.join(sizes.where(f"n > 1 and n <= {PAIRED_AT_MOST}").drop("n"), keys)
    links = links.union(_paired(few_dealt, few_dealt, keys, most))
    crowded = dealt.join(sizes.where(f"n > {PAIRED_AT_MOST}").drop("n"), keys).select("fp", F.get(F.get(_numbers(rest), F.col("part")), F.col("again")).alias("flips"))
    if probed:
        crowded = crowded.union(crowd.where(F.col("part").isin(probed)).select("fp").distinct().select("fp", _numbers(_flips(list(range(BITS)), 1)).alias("flips")))
    return links.union(_meeting(crowded)).distinct()


def near_duplicates(docs: DataFrame, most: int = 2, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; component_id is the smallest doc_id that links reach."""
    rows = cut_lineage(fingerprints(docs, id_col, text_col, words_per_shingle))
    nodes = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    classes = connected_components(near_pairs(nodes, most))
    # the class of a fingerprint, named by the least doc_id of all its fingerprints
    named = nodes.join(classes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = named.join(least, "component").select("fp", "component_id")
    hexadecimal = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(of_fp, "fp").select("doc_id", hexadecimal.alias("fingerprint"), "component_id")
