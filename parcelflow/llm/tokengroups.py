"""Jaccard join of shingle sets by a token-group matrix.

Similar documents form groups of bounded size; a group stores the union of its members' tokens, and each member as
positions in it. A query can only be similar to a member if nearly all its tokens are in the union, so the overlap of
query and union bounds every similarity below it, and only groups that pass are opened: the positions of
the query's tokens in the union give its exact overlap with all members at once.

The steps, each a join or a grouped aggregate over all documents:

1. Every text becomes the sorted 64-bit hashes of its shingles. Equal sets are one node.
2. Which queries meet which groups: two sets at the threshold share one of the first few tokens in any order common to
   both (as many as may be missing, and one). The order here: hashes of the lowest quarter first, those by
   how many nodes hold them, counted exactly; then the others by hash. So crowded tokens come last.
3. Grouping: each node is compared with the smallest node of each of its first tokens. Linked nodes form a
   component, and nothing inside a component needs comparing again. A component, or the single nodes that share
   a smallest node, is cut into groups of at most ``members`` nodes.
4. Groups that share a first token and are not of one component meet; those of their nodes that hold the token are
   the queries. Tokens that many nodes hold are keyed by the smallest of these, so near copies that share a hundred
   crowded tokens meet over a few keys, group by group. A first bound comes from the sets hashed to
   1,024 bits, by bit counts; the exact one from the union. A group that many queries meet is dealt to several tasks.

Links are decided by the hashes of the sets, whole and exact. Defined results: null and empty texts and texts without
words have empty sets, linked with nothing, each its own component; equal sets are linked; a null id is ignored when
the smallest id of a component is taken (null, if all are); repeated rows come back as often as they are. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from parcelflow.llm.arrow import with_arrow_columns
from parcelflow.llm.components import components
from parcelflow.session import cut

SEED = 42
LOW = np.uint64(1 << 62)
WORDS = 16
CACHED = 1 << 18
FILTER_BITS = 24
LONG, LONGS, INTS = T.LongType(), T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())


def _mixed(z: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word, SEED)
        return value


class Shingles:
    """Sets of hashed shingles: words are hashed once each, a shingle's hash is mixed from those of its words in order."""

    def __init__(self, size: int):
        self.size, self.words = size, _WordHashes()

    def of(self, text: str | None) -> np.ndarray:
        """Sorted hashes of the different shingles; fewer words than ``size`` make one shingle, no words none."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        hashes = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        size = min(self.size, len(words))
        mixed = np.full(len(words) - size + 1, size, np.uint64)
        for i in range(size):
            mixed = _mixed(mixed + hashes[i:len(words) - size + 1 + i])
        return np.unique(mixed)


def allowed_misses(n, percent: int):
    """How many tokens of a set of ``n`` a set at the threshold may lack (ints or arrays)."""
    return n * (100 - percent) // 100


def bitmap(tokens: np.ndarray) -> np.ndarray:
    bits = np.zeros(64 * WORDS, np.uint8)
    bits[(tokens >> np.uint64(40)) % np.uint64(64 * WORDS)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def _lists(arrays: list[np.ndarray], kind=np.int64) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, kind), *[a.view(kind) for a in arrays]])))


def signatures(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Of (doc_id, k0, k1, text): doc_id, k0, k1, and of the set its size ``n``, a 128-bit hash, the first tokens in hash order and its bitmap."""

    def make():
        shingles = Shingles(size)

        def work(texts):
            sets = [shingles.of(t) for t in texts]
            n = np.array([len(s) for s in sets], np.int64)
            whole = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes(), SEED) for s in sets), np.int64).reshape(-1, 2)
            heads = [s[:max(int(m) + 1, int(np.searchsorted(s, LOW)))] for s, m in zip(sets, allowed_misses(n, percent))]
            return [pa.array(n), *[pa.array(whole[:, i].copy()) for i in (0, 1)], _lists(heads), _lists([bitmap(s) for s in sets])]

        return work

    return with_arrow_columns(docs, "text", [("n", LONG), ("s0", LONG), ("s1", LONG), ("head", LONGS), ("bits", LONGS)], make, ["doc_id", "k0", "k1"])


def first_tokens(nodes: DataFrame, percent: int) -> DataFrame:
    """(token, node, n): of each node's first tokens in the common order those that other nodes hold too."""
    tokens = nodes.select("node", "n", F.size("head").alias("h"), F.explode("head").alias("token"))
    held = tokens.groupBy("token").agg(F.count("*").alias("nodes")).where("nodes > 1")
    own = Window.partitionBy("node")
    beyond = (F.col("token") < 0) | (F.col("token") >= int(LOW))
    ranked = tokens.join(held, "token").withColumn("met", F.count("*").over(own)).withColumn(
        "rank", F.row_number().over(own.orderBy(beyond, "nodes", "token")))
    # tokens that no other node holds come before all others that were counted
    alone = F.col("h") - F.col("met")
    return ranked.where(F.col("rank") <= F.expr(f"n * {100 - percent} div 100") + 1 - alone).select("token", "node", "n")


def _near(n: Column, m: Column, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _missing(bits: str, other: str) -> Column:
    """Tokens of the first that the second must lack, by their bitmaps."""
    return sum((F.bit_count(F.col(bits)[i].bitwiseAND(F.bitwise_not(F.col(other)[i]))) for i in range(WORDS)), F.lit(0))


def sifted(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``docs`` that may have a key of ``wanted``: a Bloom filter over ``k0``, of fixed size, looked up where the texts are read."""
    last = (1 << FILTER_BITS) - 1
    spots = F.array(F.col("k0").bitwiseAND(F.lit(last)), F.shiftrightunsigned("k0", 32).bitwiseAND(F.lit(last)))
    bit = lambda spot: F.expr(f"shiftleft(1L, cast({spot} & 63 as int))")
    words = wanted.select(F.explode(spots).alias("spot")).groupBy(F.shiftright("spot", 6).alias("word")).agg(F.bit_or(bit("spot")).alias("word_bits"))
    every = docs.sparkSession.range(1 << (FILTER_BITS - 6)).join(words, F.col("id") == F.col("word"), "left")
    ordered = F.array_sort(F.collect_list(F.struct("id", F.coalesce("word_bits", F.lit(0).cast("long")).alias("w"))))  # as many as the filter has words
    sieve = every.agg(F.transform(ordered, lambda x: x["w"]).alias("sieve"))
    one = lambda spot: F.get(F.col("sieve"), F.shiftright(spot, 6).cast("int")).bitwiseAND(
        F.call_function("shiftleft", F.lit(1).cast("long"), spot.bitwiseAND(F.lit(63)).cast("int"))) != 0
    return docs.join(sieve, one(F.get(spots, F.lit(0))) & one(F.get(spots, F.lit(1))), "left_semi")


def token_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, tokens) of the nodes in ``wanted`` (node, k0, k1), from their texts; hardly any others are shuffled."""
    wanted = cut(wanted)
    texts = sifted(docs, wanted).groupBy("k0", "k1").agg(F.min("text").alias("text"))
    rows = texts.join(wanted, ["k0", "k1"]).select("node", "text")

    def make():
        shingles = Shingles(size)
        return lambda values: [_lists([shingles.of(t) for t in values])]

    return with_arrow_columns(rows, "text", [("tokens", LONGS)], make, ["node"])


def _rows(batches, lists: list[str]) -> Iterator[dict]:
    """Rows of Arrow batches; the named list columns as numpy arrays, without copies."""
    for batch in batches:
        flat = {}
        for name in lists:
            column = batch.column(batch.schema.names.index(name))
            ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            flat[name] = (column.flatten().to_numpy(zero_copy_only=False), ends.tolist())
        plain = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names) if n not in flat}
        for r in range(batch.num_rows):
            row = {n: v[r] for n, v in plain.items()}
            for name, (values, ends) in flat.items():
                row[name] = values[ends[r - 1] if r else 0:ends[r]]
            yield row


MATRIX = T.StructType([T.StructField("group", LONG), T.StructField("tokens", LONGS), T.StructField("nodes", LONGS), T.StructField("comps", LONGS),
                       T.StructField("sizes", INTS), T.StructField("positions", INTS)])


def matrix(members: DataFrame, sets: DataFrame) -> DataFrame:
    """The token-group matrix, a row per group of (group, node, comp): the union of tokens, and the members' positions in it one after the other."""
    rows = members.join(sets, "node").select("group", "node", "comp", "tokens").repartition("group").sortWithinPartitions("group", "node")

    def build(group, nodes, comps, held):
        tokens, positions = np.unique(np.concatenate(held), return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array([group]), _lists([tokens]), _lists([np.array(nodes, np.int64)]), _lists([np.array(comps, np.int64)]),
                                           _lists([np.array([len(h) for h in held], np.int32)], np.int32), _lists([positions.astype(np.int32)], np.int32)],
                                          names=MATRIX.names)

    def run(batches):
        last, nodes, comps, held = None, [], [], []
        for row in _rows(batches, ["tokens"]):
            if row["group"] != last and nodes:
                yield build(last, nodes, comps, held)
                nodes, comps, held = [], [], []
            last = row["group"]
            nodes.append(row["node"])
            comps.append(row["comp"])
            held.append(row["tokens"].view(np.uint64))
        if nodes:
            yield build(last, nodes, comps, held)

    return rows.mapInArrow(run, MATRIX)


def opened(groups: DataFrame, queries: DataFrame, sets: DataFrame, percent: int, spread: int = 256) -> DataFrame:
    """Links (u, v) of queries (group, node) with members of their group at the threshold, one for each component of members.

    ``groups`` is a ``matrix``. More than ``spread`` queries of one group are dealt to several tasks, each with a copy of the group's row.
    """
    crowded = cut(queries.groupBy("group").count().where(F.col("count") > spread).select("group", F.ceil(F.col("count") / spread).alias("parts")))
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    empty = [F.lit(None).cast(T.ArrayType(t)).alias(n) for n, t in (("nodes", LONG), ("comps", LONG), ("sizes", T.IntegerType()), ("positions", T.IntegerType()))]
    asked = queries.join(crowded, "group", "left").select("group", F.pmod(F.xxhash64("node"), parts).alias("part"), F.lit(1).alias("kind"), "node")
    asked = asked.join(sets, "node").select("group", "part", "kind", "node", "tokens", *empty)
    stored = groups.join(crowded, "group", "left").select(
        "group", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("node"),
        "tokens", "nodes", "comps", "sizes", "positions")
    cells = stored.union(asked).repartition("group", "part").sortWithinPartitions("group", "part", "kind")

    def run(batches):
        group, found = None, []
        for row in _rows(batches, ["tokens", "nodes", "comps", "sizes", "positions"]):
            if not row["kind"]:
                group = row
                union, sizes = row["tokens"].view(np.uint64), row["sizes"].astype(np.int64)
                starts = np.cumsum(sizes) - sizes
                continue
            if group is None or group["group"] != row["group"] or group["part"] != row["part"]:
                continue
            tokens = row["tokens"].view(np.uint64)
            n = len(tokens)
            at = np.minimum(np.searchsorted(union, tokens), len(union) - 1)
            at = at[union[at] == tokens]
            if len(at) < n - allowed_misses(n, percent):
                continue  # no member can hold enough of the query
            mark = np.zeros(len(union), np.int32)
            mark[at] = 1
            shared = np.add.reduceat(mark[group["positions"]], starts, dtype=np.int64)
            hit = np.flatnonzero((shared * (100 + percent) >= percent * (n + sizes)) & (group["nodes"] != row["node"]))
            if len(hit):
                one = np.unique(group["comps"][hit], return_index=True)[1]
                found += [(row["node"], v) for v in group["nodes"][hit[one]].tolist()]
            if len(found) >= 1 << 14:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["u", "v"])
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["u", "v"])

    return cells.mapInArrow(run, "u long, v long")


def _labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Adds ``comp``, the smallest node that links reach from ``node``."""
    roots = components(links)
    return nodes.join(roots.withColumnRenamed("u", "node"), "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")


def join_components(docs: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = 3, percent: int = 90, members: int = 64,
                    most: int = 1 << 18, crowd: int = 16) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links of ``percent`` or more).

    A group holds at most about ``members`` nodes and ``most`` tokens; tokens of more than ``crowd`` nodes are keyed by the smallest.
    These bound memory and work and change no result.
    """
    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    keyed = narrow.select("doc_id", F.xxhash64("doc_id", "text").alias("k0"), F.xxhash64("text", "doc_id").alias("k1"), "text")
    prints = cut(signatures(keyed, size, percent))
    nodes = prints.where("n > 0").groupBy("s0", "s1", "n").agg(
        F.min("doc_id").alias("least"), F.min(F.struct("k0", "k1")).alias("k"), F.first("head").alias("head"), F.first("bits").alias("bits"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    about = nodes.select("node", "n", "bits")
    misses = lambda n: F.expr(f"{n} * {100 - percent} div 100")

    held = cut(first_tokens(nodes, percent))
    pivots = held.groupBy("token").agg(F.count("*").alias("nodes"), F.min(F.struct("node", "n")).alias("pivot")).where("nodes > 1")
    key = F.when(F.col("nodes") > crowd, F.col("pivot.node")).otherwise(F.col("token"))
    held = cut(held.join(pivots, "token").select(key.alias("key"), "node", "n", "pivot"))
    active = cut(held.groupBy("node").agg(F.min("pivot.node").alias("home")))
    sets = cut(token_sets(keyed, nodes.join(active, "node").select("node", "k.k0", "k.k1"), size))

    # groups of one: the smallest node of each token
    star = held.where((F.col("node") != F.col("pivot.node")) & _near(F.col("n"), F.col("pivot.n"), percent)).select("node", F.col("pivot.node").alias("group")).distinct()
    star = star.join(about, "node").join(about.select(F.col("node").alias("group"), F.col("n").alias("m"), F.col("bits").alias("union")), "group")
    star = cut(star.where((_missing("bits", "union") <= misses("n")) & (_missing("union", "bits") <= misses("m"))).select("group", "node"))
    alone = matrix(star.select("group").distinct().select("group", F.col("group").alias("node"), F.col("group").alias("comp")), sets)
    first = cut(opened(alone, star, sets, percent))

    # components, or single nodes of one home, cut into groups
    labelled = cut(_labelled(about.join(active, "node"), first))
    linked = labelled.groupBy("comp").agg((F.count("*") > 1).alias("linked"))
    labelled = labelled.join(linked, "comp").withColumn("home", F.when(F.col("linked"), F.col("comp")).otherwise(F.col("home")))
    parts = labelled.groupBy("linked", "home").agg(F.greatest(F.ceil(F.count("*") / members), F.ceil(F.sum("n") / most)).alias("parts"))
    labelled = cut(labelled.join(parts, ["linked", "home"]).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("parts"))))
    union = F.array(*[F.bit_or(F.col("bits")[i]) for i in range(WORDS)])
    grouped = cut(labelled.groupBy("linked", "home", "chunk").agg(
        F.min("node").alias("group"), F.min("n").alias("low"), F.max("n").alias("high"), union.alias("union")))
    grouping = cut(labelled.join(grouped.select("linked", "home", "chunk", "group"), ["linked", "home", "chunk"]).select("node", "n", "comp", "group"))

    # groups that meet over a key, and the nodes of the one that query the other
    placed = cut(held.select("key", "node").distinct().join(grouping, "node"))
    sides = placed.groupBy("key", "group").agg(F.min("comp").alias("c"), F.max("comp").alias("d"), F.min("n").alias("l"), F.max("n").alias("h"))
    mixed = sides.groupBy("key").agg(F.min("c").alias("c"), F.max("d").alias("d")).where("c < d").select("key")
    sides = cut(sides.join(mixed, "key", "left_semi"))
    others = sides.toDF("key", "other", "e", "f", "low", "high")
    apart = (F.col("c") < F.col("d")) | (F.col("e") < F.col("f")) | (F.col("c") != F.col("e"))
    near = (100 * F.col("h") >= percent * F.col("low")) & (100 * F.col("high") >= percent * F.col("l"))
    met = sides.join(others, "key").where((F.col("group") <= F.col("other")) & apart & near).select("key", "group", "other")
    asking = met.join(placed.select("key", "group", "node"), ["key", "group"]).select(F.col("other").alias("group"), "node").distinct()
    able = (100 * F.col("n") >= percent * F.col("low")) & (percent * F.col("n") <= 100 * F.col("high")) & (_missing("bits", "union") <= misses("n"))
    queries = cut(asking.join(grouped.select("group", "low", "high", "union"), "group").join(about, "node").where(able).select("group", "node"))
    unions = matrix(grouping.join(queries.select("group").distinct(), "group", "left_semi").select("group", "node", "comp"), sets)
    second = opened(unions, queries, sets, percent)

    links = grouping.where("node <> comp").select(F.col("node").alias("u"), F.col("comp").alias("v")).union(second)
    rooted = cut(_labelled(nodes.select("node", "s0", "s1", "n", "least"), links))
    smallest = rooted.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "comp").select("s0", "s1", "n", "component_id")
    found = prints.select("doc_id", "s0", "s1", "n").join(named, ["s0", "s1", "n"], "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
