"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

Tokens are runs of letters and digits in lower case. A *leak* is a window of 13 tokens of a benchmark item
that a text repeats with at most two tokens substituted; an item of 5 to 12 tokens must be repeated as a
whole and exactly, a shorter one is no evidence. A spaced seed hashes the tokens at some offsets and ignores
those between. The two masks are lossless: however two of 13 tokens are substituted, one of the masks fits
somewhere between (``tests/llm`` tries all cases). So joining the seeds of texts and items finds every
leak, and comparing the tokens around a hit, position by position, decides it.

Most positions of a text match nothing. A Bloom filter of the items' seeds, an array of fixed size, is
tested in the pass that makes the seeds; only positions that pass are shuffled. The filter changes cost, not results.

Defined results: null and empty texts have no tokens; repeated rows and equal ids give one row per (document id,
item id), with the best window; null ids are values like any other; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parcelflow.session import cut

WINDOW, NEEDED, LEAST = 13, 11, 5
#: Offsets of the tokens that a seed hashes. The last mask is for short items, at their start.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8), (0, 1, 2, 3, 4))
SHORT = 2
REACH = max(m[-1] for m in MASKS) + WINDOW - 1
FILTER_BITS = 22
SEPARATOR = r"[^\p{L}\p{N}]+"


def token_hashes(text: Column) -> Column:
    """Hashes of a text's tokens, in order; an empty array if there is none."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATOR)
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _positions(hashes: Column) -> Column:
    """0-based positions at which the shortest mask fits."""
    return F.when(F.size(hashes) >= LEAST, F.sequence(F.lit(0), F.size(hashes) - LEAST)).otherwise(F.array().cast("array<int>"))


def _seed(hashes: Column, at: Column, number: int) -> Column:
    mask = MASKS[number]
    fits = at + mask[-1] < F.size(hashes)
    return F.when(fits, F.xxhash64(F.lit(number), *[F.get(hashes, at + o) for o in mask]))


def _around(hashes: Column, at: Column) -> Column:
    """Tokens from ``WINDOW - 1`` before a position to ``REACH`` after it; null beyond the ends."""
    return F.array(*[F.get(hashes, at + o) for o in range(1 - WINDOW, REACH + 1)])


def _filter_words(seeds: DataFrame) -> DataFrame:
    """One row: a Bloom filter of the column ``seed`` as an array of ``2 ** FILTER_BITS / 64`` longs."""
    spots = seeds.select(F.explode(F.array(*_spots(F.col("seed")))).alias("spot"))
    words = spots.groupBy(F.shiftright("spot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("bits"))
    every = seeds.sparkSession.range(1 << (FILTER_BITS - 6)).withColumnRenamed("id", "every")
    filled = every.join(words, every.every == words.word, "left").select("every", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    ordered = F.array_sort(F.collect_list(F.struct("every", "bits")))  # as many as the filter has words
    return filled.agg(F.transform(ordered, lambda x: x["bits"]).alias("filter"))


def _spots(seed: Column) -> list[Column]:
    size = (1 << FILTER_BITS) - 1
    return [seed.bitwiseAND(F.lit(size)), F.shiftrightunsigned(seed, 32).bitwiseAND(F.lit(size))]


def _may_hold(words: Column, seed: Column) -> Column:
    bit = lambda s: F.call_function("shiftright", F.get(words, F.shiftright(s, 6).cast("int")), s.bitwiseAND(F.lit(63)).cast("int"))
    first, second = (bit(s).bitwiseAND(F.lit(1)) == 1 for s in _spots(seed))
    return first & second


def item_seeds(items: DataFrame, id_column: str = "item_id", text: str = "text") -> DataFrame:
    """seed, item_id, at, length and the tokens around, one row for each mask and position of an item."""
    hashed = items.select(F.col(id_column).alias("item_id"), token_hashes(F.col(text)).alias("h")).where(F.size("h") >= LEAST).distinct()
    at = hashed.select("item_id", "h", F.explode(_positions(F.col("h"))).alias("at"))
    long_ = [F.when(F.size("h") >= WINDOW, _seed(F.col("h"), F.col("at"), m)) for m in range(len(MASKS)) if m != SHORT]
    short = F.when((F.size("h") < WINDOW) & (F.col("at") == 0), _seed(F.col("h"), F.col("at"), SHORT))
    seeds = at.select("item_id", F.size("h").alias("length"), _around(F.col("h"), F.col("at")).alias("item"),
                      F.explode(F.array(*long_, short)).alias("seed"))
    return seeds.where("seed is not null")


def text_seeds(texts: DataFrame, words: Column) -> DataFrame:
    """seed, key and the tokens around for positions of ``texts`` (key, h) whose seed the filter may hold.

    Seeds are generated as rows, so that the test stands once in the generated code: repeated for every
    mask, it makes a method that the JVM no longer compiles, ten times slower.
    """
    at = texts.select("key", "h", F.explode(_positions(F.col("h"))).alias("at"))
    seeds = F.array(*[_seed(F.col("h"), F.col("at"), m) for m in range(len(MASKS))])
    passed = at.select("key", "h", "at", F.explode(seeds).alias("seed")).where(_may_hold(words, F.col("seed")))
    return passed.select("key", "seed", _around(F.col("h"), F.col("at")).alias("tokens"))


def _best_window(a: Column, b: Column) -> Column:
    """Largest number of equal tokens in any window of two aligned neighbourhoods."""
    equal = F.zip_with(a, b, lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0)))
    width = WINDOW + REACH
    sums = F.transform(F.sequence(F.lit(1), F.lit(width - WINDOW + 1)),
                       lambda s: F.aggregate(F.slice(equal, s, WINDOW), F.lit(0), lambda t, x: t + x))
    return F.array_max(sums)


def leaks(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id",
          item_text: str = "text") -> DataFrame:
    """key (MD5 of the text), item_id, matched: the best window of each leaked item in each different text."""
    seeds = cut(item_seeds(items, item_id, item_text))
    words = _filter_words(seeds).scalar()
    body = F.col(text).cast("string")
    texts = docs.select(F.md5(F.encode(body, "UTF-8")).alias("key"), token_hashes(body).alias("h"))
    hits = text_seeds(texts, words).join(seeds, "seed")
    judged = hits.select("key", "item_id", "length", _best_window(F.col("tokens"), F.col("item")).alias("matched"))
    enough = F.when(F.col("length") >= WINDOW, F.lit(NEEDED)).otherwise(F.col("length"))
    return judged.where(F.col("matched") >= enough).groupBy("key", "item_id").agg(F.max("matched").alias("matched"))


def contaminated(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text: str = "text", **names: str) -> DataFrame:
    """doc_id, item_id, matched of every leak, one row per pair of ids."""
    found = leaks(docs, items, id_column, text, **names)
    keyed = docs.select(F.col(id_column).alias("doc_id"), F.md5(F.encode(F.col(text).cast("string"), "UTF-8")).alias("key"))
    return keyed.join(found, "key").groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"))


def clean_documents(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text: str = "text", **names: str) -> DataFrame:
    """The rows of ``docs``, all columns, whose text leaks no item. Null texts stay."""
    keys = leaks(docs, items, id_column, text, **names).select(F.col("key").alias("_leaked")).distinct()
    same = F.md5(F.encode(docs[text].cast("string"), "UTF-8")) == keys._leaked
    return docs.join(keys, same, "left_anti")
