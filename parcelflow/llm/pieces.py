"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

A text's segmentations are the paths of a lattice: nodes are its characters, edges the pieces of the
vocabulary (characters without a piece: one edge of byte pieces). An edge weighs ``-log(rank + 1)``; a path's
chance is proportional to the product of its weights, so backward sums give every node the exact chance of
each edge. Sampling k paths without replacement is taking the k largest of their Gumbel-perturbed
log-chances, and a best-first (A-star) search finds them without listing paths: a queue node stands for all paths
that follow a sampled path up to some position and leave it there; its bound, the largest perturbed value
below it, is drawn as a Gumbel variable truncated at its parent's value, and so is exact. Popping the
best node yields the next path. Its inclusion score is the log-chance that a path of its probability exceeds
the (k + 1)-th value.

Texts are cut where no piece can span (before spaces, around line feeds). The lattices of a slice's different
parts are built together, and all texts of a slice are sampled together, by numpy. Random numbers are a
function of the seed, the row's key, the sample and the character, so a repeated task repeats its samples.

Defined results: an empty text has one segmentation, without pieces, certain to be included; a null text has
none; fewer than k segmentations give as many samples, each included for sure. Equal rows give equal samples.
Decoding the ids restores every text exactly, line feeds, runs of spaces and U+2581 included.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from parcelflow.llm.arrow import free_name, with_arrow_columns

MODEL = "file:///opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_PART = re.compile(r" *[^ \n]+| +|\n")
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_ALL = (1 << 64) - 1
_LITERAL = 0x110000  # stands for a U+2581 of the text itself, which no piece may cover
SLOTS = 18
SLICE = 768 << 10


@dataclass
class Vocabulary:
    """Pieces of a model. ``ids`` and ``weights`` belong to the pieces that texts are matched with, ``byte_ids`` to bytes."""

    pieces: list[str]
    ids: np.ndarray
    weights: np.ndarray
    byte_ids: np.ndarray
    byte_weight: float
    as_bytes: list[bytes]

    @classmethod
    def of(cls, model: bytes) -> Vocabulary:
        import sentencepiece

        made = sentencepiece.SentencePieceProcessor(model_proto=model)
        total = made.get_piece_size()
        pieces, ids, byte_ids, as_bytes = [], [], np.zeros(256, np.int32), [b""] * total
        for i in range(total):
            piece = made.id_to_piece(i)
            if made.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                as_bytes[i] = bytes([int(piece[3:5], 16)])
            elif not (made.is_control(i) or made.is_unknown(i) or made.is_unused(i)):
                as_bytes[i] = piece.replace(SPACE, " ").encode()
                # a piece that spans a cut can't occur
                if "\n" not in piece and SPACE not in piece.lstrip(SPACE):
                    pieces.append(piece)
                    ids.append(i)
        rank = np.argsort(np.argsort([-made.get_score(i) for i in ids], kind="stable"), kind="stable")
        return cls(pieces, np.array(ids, np.int32), -np.log(rank + 2.0), byte_ids, float(-np.log(len(ids) + 2.0)), as_bytes)

    def decode(self, ids) -> str:
        """The text of piece ids: pieces and bytes joined, without the space put in front."""
        return b"".join(map(self.as_bytes.__getitem__, ids))[1:].decode("utf-8", "replace")


def read_model(spark: SparkSession, path: str = MODEL) -> bytes:
    """The model file's content, read by Spark, so any store that Spark reads will do."""
    return bytes(spark.read.format("binaryFile").load(path).first()["content"])


class Matcher:
    """Finds all pieces at all positions of many texts: a hash table over rolling hashes of characters."""

    def __init__(self, vocabulary: Vocabulary):
        self.longest = max(map(len, vocabulary.pieces))
        keys = np.empty(len(vocabulary.pieces), np.uint64)
        for i, piece in enumerate(vocabulary.pieces):
            h = 0
            for c in piece:
                h = (h * _MULTIPLIER + ord(" " if c == SPACE else c) + 1) & _ALL
            keys[i] = h
        assert len(np.unique(keys)) == len(keys)
        slot = self._slot(keys)
        self.head = np.full(1 << SLOTS, -1, np.int32)
        self.next = np.full(len(keys), -1, np.int32)
        for i, s in enumerate(slot.tolist()):
            self.next[i], self.head[s] = self.head[s], i
        self.keys = keys

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - SLOTS)).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of ``h`` that are pieces' hashes, and the pieces' numbers."""
        entry = self.head[self._slot(h)]
        open_ = np.flatnonzero(entry >= 0)
        found, numbers = [], []
        while len(open_):
            e = entry[open_]
            hit = self.keys[e] == h[open_]
            found.append(open_[hit])
            numbers.append(e[hit])
            open_, e = open_[~hit], self.next[e[~hit]]
            open_, e = open_[e >= 0], e[e >= 0]
            entry[open_] = e
        return (np.concatenate(found), np.concatenate(numbers)) if found else (open_, entry[:0])


class Lattices:
    """The lattices of many parts of texts, laid end to end: position p is a character of some part."""

    def __init__(self, parts: list[str], vocabulary: Vocabulary, matcher: Matcher):
        self.vocabulary = vocabulary
        chars = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        chars[chars == ord(SPACE)] = _LITERAL
        sizes = np.array([len(p) for p in parts], np.int64)
        n = len(chars)
        self.chars, self.first = chars, np.cumsum(sizes) - sizes
        self.sizes = sizes
        room = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)  # characters to the part's end
        width = matcher.longest
        # a position holds as many edges as it has room for; positions of equal room form one block of a table
        order = np.argsort(room.astype(np.int16) if n and room.max() < 1 << 15 else room, kind="stable")
        sorted_room = room[order]
        reach = np.minimum(sorted_room, width)
        self.base = np.empty(n, np.int64)
        ends = np.cumsum(reach)
        self.base[order] = ends - reach
        total = int(ends[-1]) if n else 0
        weight, self.piece = np.full(total, -np.inf), np.full(total, -1, np.int32)
        at, h = np.arange(n), np.zeros(n, np.uint64)
        for length in range(1, width + 1):
            stay = room[at] >= length
            at, h = at[stay], h[stay]
            h = h * np.uint64(_MULTIPLIER) + chars[at + length - 1] + np.uint64(1)
            where, number = matcher.find(h)
            edge = self.base[at[where]] + length - 1
            weight[edge] = vocabulary.weights[number]
            self.piece[edge] = number
        alone = np.flatnonzero(self.piece[self.base] < 0)
        held = np.where(chars[alone] == _LITERAL, ord(SPACE), chars[alone])
        count = 1 + (held > 0x7F).astype(int) + (held > 0x7FF) + (held > 0xFFFF)
        weight[self.base[alone]] = count * vocabulary.byte_weight
        # backward sums, by distance from the part's end; beta is 0 at the end itself
        beta = np.zeros(n + 1)
        self.cumulative = np.empty(total)
        starts = np.searchsorted(sorted_room, np.arange(1, int(sorted_room[-1]) + 2 if n else 1))
        for distance in range(1, len(starts)):
            lo, hi = starts[distance - 1:distance + 1]
            if lo == hi:
                continue
            p, wide = order[lo:hi], min(distance, width)
            block = slice(int(self.base[p[0]]), int(self.base[p[0]]) + (hi - lo) * wide)
            mass = weight[block].reshape(-1, wide)
            for length in range(1, wide + 1 - (distance <= width)):
                mass[:, length - 1] += beta[p + length]
            top = mass.max(axis=1)
            mass -= top[:, None]
            np.exp(mass, out=mass)
            sums = self.cumulative[block].reshape(-1, wide)
            np.cumsum(mass, axis=1, out=sums)
            whole = sums[:, -1].copy()
            beta[p] = top + np.log(whole)
            mass /= whole[:, None]
            sums /= whole[:, None]  # the last edge with a chance ends at exactly 1
        self._chance, self.reach = weight, np.minimum(room, width)

    def chances(self, p: int) -> np.ndarray:
        """Chances of the lengths 1, 2, ... at a position."""
        return self._chance[self.base[p]:self.base[p] + self.reach[p]]

    def log_chance(self, p: np.ndarray, length: np.ndarray) -> np.ndarray:
        return np.log(self._chance[self.base[p] + length - 1])

    def draw(self, p: np.ndarray, u: np.ndarray) -> np.ndarray:
        """A length for each position, by its chances."""
        edge = self.base[p]
        first, open_ = edge, np.arange(len(p))
        edge = edge.copy()
        while len(open_):
            open_ = open_[self.cumulative[edge[open_]] <= u[open_]]
            edge[open_] += 1
        return edge - first + 1

    def ids(self, p: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of consecutive decisions, end to end, and how many each gives: one, or a character's bytes."""
        number = self.piece[self.base[p] + length - 1]
        counts = np.ones(len(p), np.int64)
        loose = np.flatnonzero(number < 0)
        if not len(loose):
            return self.vocabulary.ids[number], counts
        chars, which = np.unique(self.chars[p[loose]], return_inverse=True)
        as_ids = [self.vocabulary.byte_ids[list(chr(ord(SPACE) if c == _LITERAL else c).encode("utf-8", "surrogatepass"))] for c in chars.tolist()]
        counts[loose] = np.array([len(x) for x in as_ids])[which]
        out = np.repeat(self.vocabulary.ids[np.maximum(number, 0)], counts)
        starts = np.cumsum(counts) - counts
        for k, ids in enumerate(as_ids):
            at = starts[loose[which == k]]
            for i, x in enumerate(ids.tolist()):
                out[at + i] = x
        return out, counts


def uniform(seed: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1), a fixed function of 64-bit seeds and indexes (SplitMix64)."""
    z = seed + index.astype(np.uint64) * np.uint64(_MULTIPLIER)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def _stream(key: np.ndarray, number: int) -> np.ndarray:
    z = (key ^ np.uint64(number * 0xD1342543DE82EF95 & _ALL)) * np.uint64(0xFF51AFD7ED558CCD)
    return z ^ (z >> np.uint64(33))


def truncated_gumbel(location: np.ndarray, limit, u: np.ndarray) -> np.ndarray:
    """Gumbel variables of these locations, given that they are at most ``limit``; minus infinity stays."""
    with np.errstate(divide="ignore", over="ignore"):
        return location - np.log(-np.log(u) + np.exp(location - limit))


class _Numbers(dict):
    """Numbers its keys in the order of their first use."""

    def __missing__(self, key: str) -> int:
        found = self[key] = len(self)
        return found


@dataclass
class _Path:
    """A sampled segmentation of every text of a slice: decisions in order, ``bounds`` their ranges by text."""

    p: np.ndarray
    length: np.ndarray
    part: np.ndarray  # the part (by position in the slice) that a decision belongs to
    bounds: np.ndarray


@dataclass
class Sample:
    ids: np.ndarray
    log_chance: float
    perturbed: float
    log_inclusion: float


class Sampler:
    """Samples the texts of a slice together."""

    def __init__(self, vocabulary: Vocabulary, seed: int = 0):
        self.vocabulary, self.matcher, self.seed = vocabulary, Matcher(vocabulary), seed

    def sample(self, texts: list[str | None], keys: list, k: int) -> list[list[Sample]]:
        rows = [i for i, t in enumerate(texts) if t]
        out: list[list[Sample]] = [[Sample(np.zeros(0, np.int32), 0.0, 0.0, 0.0)] if t == "" else [] for t in texts]
        if rows:
            for i, found in zip(rows, self._sample([texts[i] for i in rows], [keys[i] for i in rows], k)):
                out[i] = found
        return out

    def _sample(self, texts: list[str], keys: list, k: int) -> list[list[Sample]]:
        number = _Numbers()
        parts_of = [list(map(number.__getitem__, _PART.findall(f" {t}"))) for t in texts]
        lattice = Lattices(list(number), self.vocabulary, self.matcher)
        counts = np.array([len(x) for x in parts_of], np.int64)
        part = np.fromiter(chain.from_iterable(parts_of), np.int64, int(counts.sum()))
        text = np.repeat(np.arange(len(texts)), counts)
        ends = np.cumsum(counts)
        sizes = lattice.sizes[part]
        offset = np.cumsum(sizes) - sizes
        offset -= np.repeat(offset[ends - counts], counts)  # characters of the text before a part
        key = np.array([xxhash.xxh64_intdigest(repr(x).encode(), self.seed) for x in keys], np.uint64)
        n = len(texts)
        paths: list[_Path] = []
        logs: list[np.ndarray] = []
        found: list[list[Sample]] = [[] for _ in range(n)]
        queues: list[list[tuple]] = [[] for _ in range(n)]
        # the first path is a plain draw; its value is the largest of all, a Gumbel variable of location 0
        value = -np.log(-np.log(uniform(_stream(key, 1), np.zeros(n))))
        taken: list[tuple | None] = [(-v, -1, 0, (), 0.0) for v in value.tolist()]
        for turn in range(k):
            if not any(t is not None for t in taken):
                break
            path = self._draw(lattice, part, text, offset, counts, key, turn, taken, paths)
            log = lattice.log_chance(path.p, path.length)
            paths.append(path)
            logs.append(log)
            before = np.cumsum(log) - log
            before -= np.repeat(before[np.minimum(path.bounds[:-1], max(0, len(log) - 1))], np.diff(path.bounds))
            owner = text[path.part]
            character = offset[path.part] + path.p - lattice.first[part[path.part]]
            limit = np.array([np.nan if t is None else -t[0] for t in taken])
            with np.errstate(divide="ignore"):
                aside = before + np.log1p(-np.minimum(np.exp(log), 1.0))
            # decisions before the branch are shared with the path branched from: their nodes are in the queue already
            first = path.bounds[:-1] + np.array([0 if t is None else t[2] + (t[1] >= 0) for t in taken])
            fresh = np.arange(len(log)) >= first[owner]
            aside[~fresh] = -np.inf
            bound = truncated_gumbel(aside, limit[owner], uniform(_stream(key, 4 * turn + 2)[owner], character))
            for i in range(n):
                node = taken[i]
                if node is None:
                    continue
                lo, hi = int(path.bounds[i]), int(path.bounds[i + 1])
                found[i].append((turn, -node[0], float(log[lo:hi].sum())))
                queue = queues[i]
                want = k + 1 - len(found[i])
                top = lo + (np.argpartition(-bound[lo:hi], want)[:want] if hi - lo > want else np.arange(hi - lo))
                for j in top.tolist():
                    if bound[j] > -np.inf:
                        heapq.heappush(queue, (-float(bound[j]), turn, j - lo, (int(path.length[j]),), float(before[j])))
                if node[1] >= 0:  # the node branched from, without what it has now given
                    self._again(lattice, path, lo, node, queue, key[i], turn, float(before[lo + node[2]]))
                taken[i] = heapq.heappop(queue) if queue and len(found[i]) < k else None
        encoded = []
        for path in paths:
            ids, count = lattice.ids(path.p, path.length)
            encoded.append((ids, np.append(0, np.cumsum(count))[path.bounds]))
        return [self._samples(encoded, i, found[i], queues[i]) for i in range(n)]

    @staticmethod
    def _again(lattice, path, lo, node, queue, key, turn, before):
        at = lo + node[2]
        excluded = (*node[3], int(path.length[at]))
        rest = float(np.delete(lattice.chances(path.p[at]), [x - 1 for x in excluded]).sum())
        if rest > 0:
            u = uniform(_stream(np.array([key]), 4 * turn + 3), np.array([node[2]]))
            bound = truncated_gumbel(np.array([before + np.log(rest)]), -node[0], u)[0]
            heapq.heappush(queue, (-float(bound), turn, node[2], excluded, before))

    def _draw(self, lattice, part, text, offset, counts, key, turn, taken, paths) -> _Path:
        """One path for each text with a queue node: the old path up to the branch, another length there, then free draws."""
        n = len(counts)
        first_part = np.cumsum(counts) - counts
        start = np.full(len(part), -1)  # where free drawing starts inside a part; -1: not drawn
        head_p, head_length, head_part = [], [], []
        for i, node in enumerate(taken):
            if node is None:
                continue
            if node[1] < 0:
                start[first_part[i]:first_part[i] + counts[i]] = 0
                continue
            old = paths[node[1]]
            lo = int(old.bounds[i])
            at = lo + node[2]
            p, branch = int(old.p[at]), int(old.part[at])
            chance = lattice.chances(p).copy()
            chance[[x - 1 for x in node[3]]] = 0.0
            sums = np.cumsum(chance)
            u = uniform(_stream(key[i:i + 1], 4 * turn + 4), np.array([node[2]]))[0]
            length = min(1 + int((sums <= u * sums[-1]).sum()), 1 + int(np.flatnonzero(chance)[-1]))
            head_p += [old.p[lo:at], [p]]
            head_length += [old.length[lo:at], [length]]
            head_part += [old.part[lo:at], [branch]]
            start[branch] = p + length - lattice.first[part[branch]]
            start[branch + 1:first_part[i] + counts[i]] = 0
        live = np.flatnonzero(start >= 0)
        at = start[live]
        steps = [(np.asarray(a, np.int64)) for a in (np.concatenate(head_p) if head_p else [], np.concatenate(head_length) if head_length else [],
                                                    np.concatenate(head_part) if head_part else [])]
        all_p, all_length, all_part = [steps[0]], [steps[1]], [steps[2]]
        stream = _stream(key, 4 * turn + 5)
        while True:
            stay = at < lattice.sizes[part[live]]
            live, at = live[stay], at[stay]
            if not len(live):
                break
            p = lattice.first[part[live]] + at
            length = lattice.draw(p, uniform(stream[text[live]], offset[live] + at))
            all_p.append(p)
            all_length.append(length)
            all_part.append(live)
            at = at + length
        p, length, of = (np.concatenate(x) for x in (all_p, all_length, all_part))
        # every list is in order inside a part, so a stable sort by part gives the texts' order
        order = np.argsort(of, kind="stable")
        of = of[order]
        ends = np.searchsorted(of, np.append(first_part, len(part)))
        return _Path(p[order], length[order], of, ends)

    @staticmethod
    def _samples(encoded, i, found, queue) -> list[Sample]:
        threshold = -queue[0][0] if queue else -np.inf
        out = []
        for turn, value, log in found:
            ids, bounds = encoded[turn]
            gap = log - threshold
            inclusion = gap if gap < -30 else math.log(-math.expm1(-math.exp(min(gap, 700.0))))
            out.append(Sample(ids[bounds[i]:bounds[i + 1]], log, value, inclusion))
        return out


SAMPLES = T.ArrayType(T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("log_chance", T.DoubleType()),
                                    T.StructField("perturbed", T.DoubleType()), T.StructField("log_inclusion", T.DoubleType())]))
_ARROW = pa.list_(pa.struct([("ids", pa.list_(pa.int32())), ("log_chance", pa.float64()), ("perturbed", pa.float64()), ("log_inclusion", pa.float64())]))


def with_samples(docs: DataFrame, k: int = 2, id_column: str = "doc_id", text: str = "text", seed: int = 0, model: str = MODEL,
                 name: str | None = None, keep: list[str] | None = None, checksum: bool = False) -> DataFrame:
    """Adds an array of up to ``k`` distinct segmentations of every whole text, best first; one pass, no shuffle.

    ``checksum``: every segmentation also has ``text_crc32`` of the text that its ids decode to, computed in the same task.
    """
    vocabulary = Vocabulary.of(read_model(docs.sparkSession, model))
    name, key = name or free_name(docs, "samples"), free_name(docs, "_key")
    keyed = docs.withColumn(key, F.struct(F.col(id_column).cast("string").alias("k"), F.col(text).cast("string").alias("t")))

    kind, arrow = SAMPLES, list(_ARROW.value_type)
    if checksum:
        kind = T.ArrayType(T.StructType([*SAMPLES.elementType.fields, T.StructField("text_crc32", T.LongType())]))
        arrow = [*arrow, pa.field("text_crc32", pa.int64())]

    def make():
        sampler = Sampler(vocabulary, seed)
        spell = vocabulary.as_bytes.__getitem__

        def work(values):
            found = sampler.sample([v["t"] for v in values], [v["k"] for v in values], k)
            flat = [s for f in found for s in f]
            ids = pa.ListArray.from_arrays(np.cumsum([0, *[len(s.ids) for s in flat]]).astype(np.int32),
                                           np.concatenate([np.zeros(0, np.int32), *[s.ids for s in flat]]))
            fields = [ids, *[pa.array([getattr(s, f) for s in flat], pa.float64()) for f in ("log_chance", "perturbed", "log_inclusion")]]
            if checksum:
                fields.append(pa.array([zlib.crc32(b"".join(map(spell, s.ids.tolist()))[1:]) for s in flat], pa.int64()))
            items = pa.StructArray.from_arrays(fields, fields=arrow)
            return [pa.ListArray.from_arrays(np.cumsum([0, *map(len, found)]).astype(np.int32), items)]

        return work

    return with_arrow_columns(keyed, key, [(name, kind)], make, keep or docs.columns, SLICE)


def encode(docs: DataFrame, k: int = 2, id_column: str = "doc_id", text: str = "text", seed: int = 0, model: str = MODEL,
           checksum: bool = False) -> DataFrame:
    """doc_id, rank (from 1), ids, log_chance, perturbed, log_inclusion (and text_crc32): one row per sample. Null texts give no row."""
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text).cast("string").alias("text"))
    sampled = with_samples(narrow, k, "doc_id", "text", seed, model, "samples", ["doc_id"], checksum)
    return sampled.select("doc_id", F.posexplode("samples").alias("at", "s")).select("doc_id", (F.col("at") + 1).alias("rank"), "s.*")


def with_decoded(df: DataFrame, ids: str = "ids", name: str = "text", model: str = MODEL) -> DataFrame:
    """Adds the text of an array of piece ids; null ids give null."""
    as_bytes = Vocabulary.of(read_model(df.sparkSession, model)).as_bytes

    def run(batches):
        for batch in batches:
            column = batch.column(ids)
            lists = (None if not v.is_valid else v.values.to_numpy(zero_copy_only=False).tolist() for v in column)
            texts = [None if v is None else b"".join(map(as_bytes.__getitem__, v))[1:].decode("utf-8", "replace") for v in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.StringType())]))


def digests(docs: DataFrame, k: int = 2, id_column: str = "doc_id", text: str = "text", seed: int = 0, model: str = MODEL) -> DataFrame:
    """``encode`` without the ids: doc_id, rank, pieces, ids_crc32, text_crc32 (of the decoded ids), and the three scores.

    For large corpora whose ids nobody reads: they are encoded and decoded in the task and not written.
    """
    vocabulary = Vocabulary.of(read_model(docs.sparkSession, model))
    narrow = docs.select(F.struct(F.col(id_column).cast("string").alias("k"), F.col(text).cast("string").alias("t")).alias("key"),
                         F.col(id_column).alias("doc_id"))
    item = T.StructType([T.StructField("pieces", T.IntegerType()), T.StructField("ids_crc32", T.LongType()), T.StructField("text_crc32", T.LongType()),
                         T.StructField("log_chance", T.DoubleType()), T.StructField("perturbed", T.DoubleType()), T.StructField("log_inclusion", T.DoubleType())])
    arrow = pa.list_(pa.struct([("pieces", pa.int32()), ("ids_crc32", pa.int64()), ("text_crc32", pa.int64()), ("log_chance", pa.float64()),
                                ("perturbed", pa.float64()), ("log_inclusion", pa.float64())]))

    def make():
        sampler = Sampler(vocabulary, seed)

        def work(values):
            found = sampler.sample([v["t"] for v in values], [v["k"] for v in values], k)
            return [pa.array([[{"pieces": len(s.ids), "ids_crc32": zlib.crc32(s.ids.astype("<i4").tobytes()),
                                "text_crc32": zlib.crc32(vocabulary.decode(s.ids.tolist()).encode("utf-8", "surrogatepass")),
                                "log_chance": s.log_chance, "perturbed": s.perturbed, "log_inclusion": s.log_inclusion} for s in f] for f in found], arrow)]

        return work

    out = with_arrow_columns(narrow, "key", [("samples", T.ArrayType(item))], make, ["doc_id"], SLICE)
    return out.select("doc_id", F.posexplode("samples").alias("at", "s")).select("doc_id", (F.col("at") + 1).alias("rank"), "s.*")
