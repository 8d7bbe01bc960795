"""Near-duplicates by SimHash, compared on bit planes.

Fingerprints: each of the ``64 * words`` bits is the majority of that bit over the hashes of a text's
word shingles, repeats included. Candidates share a *band*, a fixed choice of bits; for 64 bits and a
small radius the bands are complete: any two within the radius share one. For similarities of shingle
sets they share a shingle of a *prefix*, which is complete too. Inside a band or below a shingle,
``bitslice.forest`` compares all members exactly.

Defined results: a null text counts as empty; a text without words has fingerprint zero and is linked
like any other; equal fingerprints are one node, so copies are never compared with one another; a null
id is ignored when the smallest id of a component is taken (null, if all are); no rows give no rows.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from parcelflow.llm.arrow import free_name, with_arrow_columns
from parcelflow.llm.bitslice import forest
from parcelflow.llm.components import components
from parcelflow.session import cut

SEED = 42
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CHUNK = 2048
_SPREAD = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)


def shingle_hashes(text: str | None, size: int, normal: bool = False) -> list[int]:
    """XXH64 of the shingles of ``size`` words, in order, repeats included.

    Words are runs without the six ASCII spaces, A-Z in lower case; ``normal`` also drops ASCII
    punctuation. Fewer words than ``size`` make one shingle, no words none.
    """
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    words = (raw.translate(None, PUNCTUATION) if normal else raw).split()
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(line, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-size].tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(line[s:e], SEED) for s, e in zip(starts, (ends[size - 1:] - 1).tolist())]


def _mixed(h: np.ndarray, turn: int) -> np.ndarray:
    """Further hash words of a shingle, from its first one (the finaliser of SplitMix64)."""
    z = h + np.uint64(turn * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For consecutive groups of ``sizes`` hashes: the word of bits set in over half of a group."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    counts = sizes[full]
    starts = np.cumsum(counts) - counts
    pieces = -(-counts // 255)  # byte counters hold 255
    first = np.cumsum(pieces) - pieces
    owner = np.repeat(np.arange(len(full)), pieces)
    cuts = starts[owner] + 255 * (np.arange(len(owner)) - first[owner])
    for byte in range(8):
        lanes = _SPREAD[(hashes >> np.uint64(8 * byte)).astype(np.uint8)]
        part = np.add.reduceat(lanes, cuts).view(np.uint8).reshape(-1, 8).astype(np.int64)
        set_ = np.add.reduceat(part, first, axis=0)
        bits = (2 * set_ > counts[:, None]).astype(np.uint64)
        out[full] |= (bits << (np.arange(8, dtype=np.uint64) + np.uint64(8 * byte))).sum(axis=1, dtype=np.uint64)
    return out


def fingerprint_texts(texts: list, size: int, words: int, normal: bool) -> list[np.ndarray]:
    """Fingerprints of many texts: ``words`` arrays of 64-bit words."""
    groups = [shingle_hashes(t, size, normal) for t in texts]
    sizes = np.array([len(g) for g in groups], np.int64)
    flat = np.fromiter((h for g in groups for h in g), np.uint64, int(sizes.sum()))
    return [majority(flat if not i else _mixed(flat, i), sizes) for i in range(words)]


def with_fingerprints(df: DataFrame, text: str = "text", size: int = 4, words: int = 1, normal: bool = False,
                      names: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Adds the fingerprint's 64-bit words as long columns ``names``; one pass, no shuffle."""
    names = names or [free_name(df, f"f{i}") for i in range(words)]

    def make():
        return lambda texts: [pa.array(w.view(np.int64)) for w in fingerprint_texts(texts, size, words, normal)]

    return with_arrow_columns(df, text, [(n, T.LongType()) for n in names], make, keep)


def complete_bands(radius: int, spare: int = 2) -> list[list[int]]:
    """Masks of one 64-bit word: any two words within ``radius`` agree on all bits of at least one.

    The word is cut into ``radius + spare`` pieces; ``radius`` differing bits spoil at most that many
    pieces, so ``spare`` pieces agree: every choice of ``spare`` pieces is a band.
    """
    pieces = radius + spare
    edges = [round(64 * i / pieces) for i in range(pieces + 1)]
    masks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    return [[sum(c)] for c in combinations(masks, spare)]


def radius_of(similarity: float, words: int, deviations: float = 6.0) -> int:
    """Expected differing bits of two shingle sets with that Jaccard similarity, plus ``deviations`` standard deviations."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = 64 * words
    return round(bits * share + deviations * math.sqrt(bits * share * (1 - share)))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted hashes of the different shingles of a text, without case and punctuation."""
    return np.unique(np.array(shingle_hashes(text, size, True), np.uint64))


def prefix_length(count: int, similarity: float) -> int:
    """Two sets at ``similarity`` or more share one of this many first members, in any order common to both."""
    return count - math.ceil(similarity * count - 1e-9) + 1 if count else 0


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(prints: DataFrame, names: list[str], bands: list[list[int]], radius: int, chunk: int = CHUNK) -> DataFrame:
    """Links (u, v) between the node numbers of distinct fingerprints, enough to connect every pair that
    shares a band and lies within ``radius``. ``prints`` has a unique long ``node`` and the words ``names``."""
    keys = [F.struct(F.lit(i).alias("band"), *[F.col(n).bitwiseAND(F.lit(_signed(m))).alias(f"k_{n}")
                                                for n, m in zip(names, b)]) for i, b in enumerate(bands)]
    rows = prints.select("node", *names, F.explode(F.array(*keys)).alias("key"))
    rows = rows.select("node", *names, F.xxhash64("key").alias("h"), "key.*")
    return links_below(rows, names, ["band", *[f"k_{n}" for n in names]], radius, chunk)


def links_below(rows: DataFrame, names: list[str], key: list[str], radius: int, chunk: int = CHUNK) -> DataFrame:
    """Links (u, v) that connect every pair of ``rows`` with equal ``key`` within ``radius``.

    A key with more than ``chunk`` members is cut into parts by hash and every pair of parts is a cell
    of its own, so no task holds a crowded key whole; a cell emits at most one link per member.
    """
    crowded = cut(rows.groupBy(*key).count().where(F.col("count") > chunk))
    rows = rows.join(crowded, key, "left")
    parts = F.ceil(F.coalesce("count", F.lit(1)) / chunk)
    rows = rows.withColumn("n", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("n")))
    # a part meets every other part; alone, itself
    other = F.when(F.col("n") == 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.filter(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda x: x != F.col("part")))
    rows = rows.withColumn("other", F.explode(other))
    rows = rows.withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other"))
    cell = [*key, "lo", "hi"]
    rows = rows.select("node", *names, *cell).repartition(*cell).sortWithinPartitions(*cell, "node")
    width = len(names)

    def compare(node, words, run):
        child, root = forest(words, run, radius)
        pairs = np.unique(np.stack([node[child], node[root]], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, i])) for i in (0, 1)], names=["u", "v"])

    def run_cells(batches):
        held = None
        number = 0
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            changed = np.zeros(batch.num_rows, bool)
            for c in columns[1 + width:]:
                changed[1:] |= c[1:] != c[:-1]
            changed[0] = last is not None and last != tuple(c[0] for c in columns[1 + width:])
            run = number + np.cumsum(changed)
            number, last = int(run[-1]), tuple(c[-1] for c in columns[1 + width:])
            words = np.stack(columns[1:1 + width], axis=1).astype(np.int64).view(np.uint64)
            part = (columns[0], words, run)
            held = part if held is None else tuple(np.concatenate(x) for x in zip(held, part))
            ready = int(np.searchsorted(held[2], number))  # the last cell may go on in the next batch
            if ready:
                yield compare(*[x[:ready] for x in held])
                held = tuple(x[ready:] for x in held)
        if held is not None and len(held[0]):
            yield compare(*held)

    return rows.mapInArrow(run_cells, "u long, v long")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = 4, radius: int = 4) -> DataFrame:
    """One row per document: id, ``fingerprint`` (long) and ``component_id``, the smallest id reachable
    over fingerprints at ``radius`` or fewer differing bits of 64. Exact: the bands are complete."""
    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    prints = cut(with_fingerprints(narrow, "text", size, 1, names=["f0"], keep=["doc_id"]))
    nodes = cut(prints.groupBy("f0").agg(F.min("doc_id").alias("least")))
    found = links(nodes.select(F.col("f0").alias("node"), "f0"), ["f0"], complete_bands(radius), radius)
    roots = components(found)
    rooted = nodes.join(roots, nodes.f0 == roots.u, "left").select(nodes.f0.alias("node"), "least", F.coalesce("root", "f0").alias("root"))
    rooted = cut(rooted)
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("node", "component_id")
    return prints.join(named, prints.f0 == named.node).select("doc_id", F.col("f0").alias("fingerprint"), "component_id")


def linked_sets(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links (member, first member of its set) that connect all pairs of sets at Jaccard ``similarity`` or more.

    Breadth-first: each set reached is compared with all that are not, by a table of its members.
    """
    counts = np.array([len(s) for s in sets], np.int64)
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(counts)
    ids = [ids[e - c:e] for e, c in zip(ends, counts)]
    mark = np.zeros(len(values), bool)
    left, found = np.arange(len(sets)), []
    while len(left) > 1:
        start, front, left = left[0], [left[0]], left[1:]
        while front and len(left):
            pivot = front.pop()
            size = counts[pivot]
            able = left[np.minimum(counts[left], size) >= similarity * np.maximum(counts[left], size) - 1e-9]
            if not len(able):
                continue
            mark[ids[pivot]] = True
            shared = np.add.reduceat(mark[np.concatenate([ids[i] for i in able])], np.cumsum(counts[able]) - counts[able], dtype=np.int64)
            mark[ids[pivot]] = False
            hit = able[shared >= similarity * (counts[able] + size - shared) - 1e-9]
            found += [(int(i), int(start)) for i in hit]
            front += hit.tolist()
            left = left[~np.isin(left, hit)]
    return found


def verified_links(members: DataFrame, size: int, similarity: float, chunk: int = CHUNK // 4, most: int = 1 << 19) -> DataFrame:
    """Links (u, v) that connect all pairs of a candidate group at Jaccard ``similarity`` or more of their shingles.

    ``members`` has ``node``, ``root`` (the group), ``n`` (its different shingles, not 0) and ``text``. A group of more than
    ``chunk`` members or ``most`` shingles is cut into parts, and every pair of parts is a cell, as in ``links_below``.
    """
    large = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / chunk), F.ceil(F.sum("n") / most)).alias("parts"))
    rows = members.join(cut(large.where("parts > 1")), "root", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    other = F.when(F.col("parts") == 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.filter(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda x: x != F.col("part")))
    rows = rows.withColumn("other", F.explode(other)).withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other"))
    cell = ["root", "lo", "hi"]
    rows = rows.select("node", "text", *cell).repartition(*cell).sortWithinPartitions(*cell, "node")

    def compare(nodes, sets):
        pairs = linked_sets(sets, similarity) if len(sets) > 1 else []
        return pa.RecordBatch.from_pydict({"u": [nodes[a] for a, _ in pairs], "v": [nodes[b] for _, b in pairs]},
                                          pa.schema([("u", pa.int64()), ("v", pa.int64())]))

    def run_cells(batches):
        last, nodes, sets = None, [], []
        for batch in batches:
            for node, text, *at in zip(*[c.to_pylist() if i != 1 else c for i, c in enumerate(batch.columns)]):
                if at != last:
                    if len(sets) > 1:
                        yield compare(nodes, sets)
                    last, nodes, sets = at, [], []
                nodes.append(node)
                sets.append(shingle_set(text.as_py(), size))
        if len(sets) > 1:
            yield compare(nodes, sets)

    return rows.mapInArrow(run_cells, "u long, v long")


def with_sets(df: DataFrame, text: str, size: int, words: int, similarity: float, names: list[str]) -> DataFrame:
    """Adds of the set of different shingles: the fingerprint's words, a 128-bit hash in two longs, its size and its prefix."""

    def make():
        def work(texts):
            sets = [shingle_set(t, size) for t in texts]
            counts = np.array([len(s) for s in sets], np.int64)
            flat = np.concatenate(sets)
            prints = [majority(flat if not i else _mixed(flat, i), counts) for i in range(words)]
            whole = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes(), SEED) for s in sets), np.int64).reshape(-1, 2)
            heads = [s[:prefix_length(len(s), similarity)] for s in sets]
            offsets = np.cumsum([0, *[len(h) for h in heads]]).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(heads).view(np.int64)))
            return [*[pa.array(w.view(np.int64)) for w in prints], *[pa.array(whole[:, i].copy()) for i in (0, 1)], pa.array(counts), prefix]

        return work

    kinds = [*[T.LongType()] * (words + 3), T.ArrayType(T.LongType())]
    return with_arrow_columns(df, text, list(zip(names, kinds)), make)


def keep_one_per_group(docs: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = 5, words: int = 4,
                       similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` with one row of each near-duplicate group: that of the smallest id, ids before null.

    Groups are single-linkage over pairs whose sets of ``size``-word shingles, without case and punctuation, have a Jaccard
    similarity of ``similarity`` or more; equal sets are one node. Candidates share a shingle of their prefixes (no pair
    at ``similarity`` is without one) and lie within ``radius_of`` bits of ``64 * words``, six deviations beyond
    the distance expected; every link is then decided by the sets themselves. Repeated rows are one group.
    """
    row = free_name(docs, "_row")
    inner = [*[f"f{i}" for i in range(words)], "s0", "s1", "n", "prefix"]
    names = [free_name(docs, f"_{i}") for i in inner]
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    stored = cut(with_sets(numbered, text, size, words, similarity, names))
    prints = stored.select(F.col(row).alias("row"), F.col(id_column).alias("id"), *[F.col(n).alias(i) for n, i in zip(names, inner)])
    fields = inner[:words]
    best = F.struct(F.col("id").isNull().alias("a"), F.col("id").alias("b"), F.col("row").alias("c"))
    nodes = cut(prints.groupBy("s0", "s1", *fields, "n").agg(F.min(best).alias("best"), F.min("row").alias("node")))
    heads = prints.select(F.col("row").alias("node"), "prefix").join(nodes.select("node"), "node", "left_semi")
    tokens = cut(heads.select("node", F.explode("prefix").alias("token")))
    shared = tokens.groupBy("token").count().where("count > 1").select("token")
    met = cut(tokens.join(shared, "token", "left_semi"))
    found = links_below(met.join(nodes.select("node", *fields), "node"), fields, ["token"], radius_of(similarity, words))
    groups = cut(components(found))
    members = groups.select(F.col("u").alias("node"), "root").union(groups.select("root", "root").distinct())
    members = members.join(nodes.select("node", "n"), "node").join(
        stored.select(F.col(row).alias("node"), F.col(text).cast("string").alias("text")), "node")
    roots = components(verified_links(members, size, similarity))
    rooted = nodes.join(roots, nodes.node == roots.u, "left").select("best", F.coalesce("root", "node").alias("root"))
    chosen = rooted.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.c").alias(row))
    return stored.join(chosen, row, "left_semi").select(*[f"`{c}`" for c in docs.columns])
