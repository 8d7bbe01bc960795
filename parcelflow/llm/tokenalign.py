"""Alignment of two tokenizers' encodings of the same texts, by lockstep merging.

Both encodings of a text cover the same bytes, so two pointers that walk over the token ends meet every pair of
overlapping tokens: the pointer at the smaller end moves on, both move where the ends agree, which is a cut between
groups. All documents of a batch are walked at once: the pointers are two numpy vectors, every step emits one link
for each live document and the cuts reached, and documents that end are dropped from the vectors.

A link's weight is how many documents of the whole corpus hold its id pair linked. Every batch counts its own
documents a pair first, so what is shuffled is one row per batch and pair; the counts come back to the batches by a
join and meet the documents by batch. A pair that every document holds is one row a batch. Texts are encoded once.

Defined results: null and empty texts, and texts that a tokenizer does not restore byte by byte (U+2581 for the piece
model, for one), have no tokens: zeros, no groups, and they count for no pair. Special tokens' strings are plain
text. Every row counts as a document, repeated ones too; a null id is kept. No rows give no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from parcelflow.llm.arrow import free_name, slices, with_arrow_columns
from parcelflow.llm.pieces import read_model
from parcelflow.session import cut

BYTE_MODEL = "file:///opt/tokenizers/byte_bpe_50k.json"
PIECE_MODEL = "file:///opt/tokenizers/piece_bpe_32k.model"
BATCH = 4 << 20
ENCODED = 256 << 10


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 as it is, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass
class Side:
    """A tokenizer: the bytes of each id, and the ids of texts."""

    as_bytes: list[bytes]
    encode: Callable[[list[str]], list[np.ndarray]]

    def __post_init__(self):
        self.lengths = np.array([len(b) for b in self.as_bytes], np.int64)

    def ids_of(self, text: str, raw: bytes, ids: np.ndarray) -> np.ndarray | None:
        """``ids``, if they spell ``raw`` without empty tokens."""
        if int(self.lengths[ids].sum()) != len(raw) or not self.lengths[ids].all():
            return None
        return ids if b"".join(map(self.as_bytes.__getitem__, ids.tolist())) == raw else None


#: Fixed value: how byte-level vocabularies of this kind cut a text before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_side(model: bytes) -> Side:
    """A byte-level vocabulary in the JSON format of ``tokenizers``; it reads a space and the text.

    Where the n-th merge makes the n-th id after the bytes, merge ranks are ids, and ``tiktoken`` gives the same ids in a
    quarter of the time; any other vocabulary is encoded by ``tokenizers``.
    """
    import tiktoken
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
    said = json.loads(model)
    letters = byte_letters()
    spelt = lambda e: bytes(map(letters.__getitem__, e))
    special = {t["id"]: t["content"].encode() for t in said.get("added_tokens", [])}
    table: list[bytes] = [b""] * (1 + max([*said["model"]["vocab"].values(), *special]))
    for entry, i in said["model"]["vocab"].items():
        table[i] = special[i] if i in special else spelt(entry)
    for i, content in special.items():
        table[i] = content
    merges = [spelt("".join(m) if isinstance(m, list) else m.replace(" ", "", 1)) for m in said["model"]["merges"]]
    first = len(table) - len(special) - len(merges)
    if first == 256 and merges == table[256:256 + len(merges)] and said.get("pre_tokenizer", {}).get("type") == "ByteLevel" and not said.get("normalizer"):
        ranks = {table[i]: i for i in range(len(table)) if i not in special}
        coded = tiktoken.Encoding("bytes", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        return Side(table, lambda texts: [np.array(coded.encode_ordinary(f" {t}"), np.int32) for t in texts])
    made = Tokenizer.from_str(model.decode("utf-8"))
    made.encode_special_tokens = True
    return Side(table, lambda texts: [np.array(f.ids, np.int32) for f in made.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)])


def piece_side(model: bytes) -> Side:
    """A SentencePiece model; it puts the space in front by itself."""
    import sentencepiece

    made = sentencepiece.SentencePieceProcessor(model_proto=model)
    spelt = lambda i: bytes([int(made.id_to_piece(i)[3:5], 16)]) if made.is_byte(i) else made.id_to_piece(i).replace("▁", " ").encode()
    return Side([spelt(i) for i in range(made.get_piece_size())],
                lambda texts: [np.array(ids, np.int32) for ids in made.encode(texts, num_threads=1)])


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, a_first: np.ndarray, b_first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links and cuts of many documents, whose tokens lie one after the other in the two arrays of byte ends.

    Document d has the tokens ``a_first[d]:a_first[d + 1]`` and ``b_first[d]:b_first[d + 1]``, both ending at the same byte.
    → links (2 rows: positions in the arrays), and for every A and every B token whether a cut follows it.
    """
    links = np.empty((2, len(a_ends) + len(b_ends)), np.int64)
    a_cut, b_cut = np.zeros(len(a_ends), bool), np.zeros(len(b_ends), bool)
    live = a_first[:-1] < a_first[1:]
    a, b, last = a_first[:-1][live], b_first[:-1][live], a_first[1:][live]
    filled = 0
    while len(a):
        links[0, filled:filled + len(a)] = a
        links[1, filled:filled + len(a)] = b
        filled += len(a)
        a_end, b_end = a_ends[a], b_ends[b]
        a_on, b_on = a_end <= b_end, b_end <= a_end
        both = a_on & b_on
        a_cut[a[both]] = True
        b_cut[b[both]] = True
        a, b = a + a_on, b + b_on
        live = a < last
        if not live.all():
            a, b, last = a[live], b[live], last[live]
    return links[:, :filled], a_cut, b_cut


@dataclass
class Alignment:
    """A batch: ids of both sides one document after the other, where documents start, links by position, cuts after tokens."""

    a: np.ndarray
    b: np.ndarray
    a_first: np.ndarray
    b_first: np.ndarray
    links: np.ndarray
    a_cut: np.ndarray
    b_cut: np.ndarray

    def a_document(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.a_first) - 1), np.diff(self.a_first))

    def per_document(self, flags: np.ndarray) -> np.ndarray:
        """Sums of a value of every A token."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.a_first[1:]] - total[self.a_first[:-1]]

    def interleaved(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each A and each B token stands when every group's A tokens are followed by its B tokens; where documents start."""
        a_group, b_group = (np.cumsum(c) - c for c in (self.a_cut, self.b_cut))
        a_end, b_end = np.flatnonzero(self.a_cut) + 1, np.flatnonzero(self.b_cut) + 1
        b_start = np.concatenate([[0], b_end[:-1]]) if len(b_end) else b_end
        return np.arange(len(self.a)) + b_start[a_group], np.arange(len(self.b)) + a_end[b_group], self.a_first + self.b_first


class Aligner:
    def __init__(self, a: Side, b: Side):
        self.a, self.b = a, b

    def align(self, texts: list[str | None]) -> Alignment:
        rows = [i for i, t in enumerate(texts) if t]
        none = np.zeros(0, np.int32)
        sides: list[list[np.ndarray]] = [[none] * len(texts), [none] * len(texts)]
        start = held = 0
        for n, i in enumerate(rows):
            held += len(texts[i])
            if held < ENCODED and n + 1 < len(rows):
                continue
            part = rows[start:n + 1]
            start, held = n + 1, 0
            values = [texts[i] for i in part]
            for i, text, x, y in zip(part, values, self.a.encode(values), self.b.encode(values)):
                raw = f" {text}".encode("utf-8", "surrogatepass")
                x, y = self.a.ids_of(text, raw, x), self.b.ids_of(text, raw, y)
                if x is not None and y is not None:
                    sides[0][i], sides[1][i] = x, y
        first = [np.concatenate([[0], np.cumsum([len(x) for x in s], dtype=np.int64)]).astype(np.int64) for s in sides]
        flat = [np.concatenate([none, *s]) for s in sides]
        ends = []
        for ids, at, side in zip(flat, first, (self.a, self.b)):
            reached = np.concatenate([[0], np.cumsum(side.lengths[ids])])
            ends.append(reached[1:] - np.repeat(reached[at[:-1]], np.diff(at)))
        return Alignment(*flat, *first, *lockstep(*ends, *first))

    def spelled_groups(self, found: Alignment) -> list[bytes]:
        """Every document's groups as ``a1,a2|b1;a3|b2,b3``; empty without tokens."""
        if not hasattr(self, "_spelled"):
            self._spelled = [b"%d%b" % (i, s) for size, cut_by in ((len(self.a.as_bytes), b"|"), (len(self.b.as_bytes), b";")) for i in range(size) for s in (b",", cut_by)]
        a_at, b_at, first = found.interleaved()
        codes = np.empty(len(found.a) + len(found.b), np.int64)
        codes[a_at] = 2 * found.a.astype(np.int64) + found.a_cut
        codes[b_at] = 2 * len(self.a.as_bytes) + 2 * found.b.astype(np.int64) + found.b_cut
        spell = self._spelled.__getitem__
        return [b"".join(map(spell, codes[s:e].tolist()))[:-1] for s, e in zip(first[:-1].tolist(), first[1:].tolist())]

    def pairs(self, found: Alignment) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different linked id pairs of each document: document, pair (A id * size of B + B id), times linked; by document."""
        wide = len(self.b.as_bytes)
        pair = found.a[found.links[0]].astype(np.int64) * wide + found.b[found.links[1]]
        most = len(self.a.as_bytes) * wide
        keys, times = np.unique(found.a_document()[found.links[0]] * most + pair, return_counts=True)
        return keys // most, keys % most, times


GROUPS = T.ArrayType(T.StructType([T.StructField("a", T.ArrayType(T.IntegerType())), T.StructField("b", T.ArrayType(T.IntegerType()))]))
LINKS = T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())]))


def with_alignment(docs: DataFrame, text: str = "text", a_model: str = BYTE_MODEL, b_model: str = PIECE_MODEL,
                   groups: str | None = None, links: str | None = None) -> DataFrame:
    """Adds ``groups`` (the ids of both sides between cuts) and ``links`` (token numbers from 0, in byte order); one pass, no shuffle."""
    models = read_model(docs.sparkSession, a_model), read_model(docs.sparkSession, b_model)
    groups, links = groups or free_name(docs, "groups"), links or free_name(docs, "links")

    def make():
        aligner = Aligner(byte_side(models[0]), piece_side(models[1]))

        def work(texts):
            found = aligner.align(texts)
            count = found.per_document(found.a_cut)
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.flatnonzero(c) + 1]).astype(np.int32)), pa.array(ids))
                     for ids, c in ((found.a, found.a_cut), (found.b, found.b_cut))]
            offsets = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            document = found.a_document()[found.links[0]]
            order = np.lexsort((found.links[1], found.links[0]))
            document, at = document[order], found.links[:, order]
            numbers = [pa.array((at[0] - found.a_first[document]).astype(np.int32)), pa.array((at[1] - found.b_first[document]).astype(np.int32))]
            return [pa.ListArray.from_arrays(offsets(count), pa.StructArray.from_arrays(lists, ["a", "b"])),
                    pa.ListArray.from_arrays(offsets(np.bincount(document, minlength=len(texts))), pa.StructArray.from_arrays(numbers, ["a", "b"]))]

        return work

    return with_arrow_columns(docs, text, [(groups, GROUPS), (links, LINKS)], make)


_STORED = T.StructType([T.StructField(n, T.LongType()) for n in ("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links")] + [
    T.StructField("groups_sha256", T.StringType()), T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("times", T.ArrayType(T.IntegerType())),
    T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("documents", T.ArrayType(T.IntegerType()))])


def aligned_batches(docs: DataFrame, id_column: str, text: str, a_model: str, b_model: str, batch: int) -> DataFrame:
    """One row per document: counts, the groups' checksum, and its linked pairs as (code, times). Codes are positions in the pairs
    of its chunk, which the chunk's first row carries, with the number of the chunk's documents that hold each."""
    models = read_model(docs.sparkSession, a_model), read_model(docs.sparkSession, b_model)
    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches):
        aligner = Aligner(byte_side(models[0]), piece_side(models[1]))
        number = TaskContext.get().partitionId() << 32
        lists = lambda counts, values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)
        for rows in batches:
            for part in slices(rows, "text", batch):
                found = aligner.align(part.column("text").to_pylist())
                n = part.num_rows
                document, pair, times = aligner.pairs(found)
                pairs, codes, holders = np.unique(pair, return_inverse=True, return_counts=True)
                spelled = aligner.spelled_groups(found)
                links = np.bincount(found.a_document()[found.links[0]], minlength=n)
                held = np.bincount(document, minlength=n)
                leads = np.zeros(n, np.int64)
                leads[0] = len(pairs)
                none = pa.array(np.arange(n) > 0)
                lead = lambda values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(leads)]).astype(np.int32)), values, mask=none)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, number)), part.column("doc_id"), pa.array(np.diff(found.a_first)), pa.array(np.diff(found.b_first)),
                    pa.array(found.per_document(found.a_cut)), pa.array(links.astype(np.int64)),
                    pa.array([hashlib.sha256(s).hexdigest() if s else "" for s in spelled], pa.string()),
                    lists(held, pa.array(codes.astype(np.int32))), lists(held, pa.array(times.astype(np.int32))),
                    lead(pa.array(pairs)), lead(pa.array(holders.astype(np.int32)))], names=_STORED.names)
                number += 1

    return narrow.mapInArrow(run, _STORED)


def align_documents(docs: DataFrame, id_column: str = "doc_id", text: str = "text", a_model: str = BYTE_MODEL, b_model: str = PIECE_MODEL,
                    batch: int = BATCH) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A link counts the documents that hold its id pair linked; ``count_sum`` adds this over the document's links, ``n_best``
    counts its links whose count is the highest of their A id.
    """
    spark = docs.sparkSession
    wide = len(piece_side(read_model(spark, b_model)).as_bytes)
    stored = cut(aligned_batches(docs, id_column, text, a_model, b_model, batch))
    listed = stored.where("pairs is not null").select("chunk", F.posexplode(F.arrays_zip("pairs", "documents")).alias("code", "p"))
    listed = listed.select("chunk", "code", F.col("p.pairs").alias("pair"), F.col("p.documents").alias("documents"))
    counts = cut(listed.groupBy("pair").agg(F.sum("documents").alias("count")).withColumn("a", F.expr(f"pair div {wide}")))
    best = counts.groupBy("a").agg(F.max("count").alias("best"))
    weights = counts.join(best, "a").select("pair", "count", (F.col("count") == F.col("best")).alias("is_best"))
    weights = listed.join(weights, "pair").select(F.col("chunk").alias("of"), "code", "count", "is_best")
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    schema = T.StructType([*[T.StructField(n, T.LongType()) for n in (*kept, "n_best", "count_sum")], T.StructField("groups_sha256", T.StringType())])

    def weigh(documents: pa.Table, weights: pa.Table) -> pa.Table:
        code = weights.column("code").to_numpy()
        count, is_best = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
        count[code] = weights.column("count").to_numpy()
        is_best[code] = weights.column("is_best").to_numpy()
        codes, times = (documents.column(c).combine_chunks() for c in ("codes", "times"))
        ends = np.cumsum(codes.value_lengths().to_numpy(zero_copy_only=False))
        codes, times = codes.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        summed = []
        for value in (is_best, count):
            total = np.concatenate([[0], np.cumsum(value[codes] * times)])
            summed.append(pa.array(total[ends] - total[np.concatenate([[0], ends[:-1]])]))
        return pa.table([*[documents.column(c) for c in kept], *summed, documents.column("groups_sha256")], names=schema.names)

    documents = stored.drop("pairs", "documents")
    return documents.groupBy("chunk").cogroup(weights.groupBy("of")).applyInArrow(weigh, schema)
