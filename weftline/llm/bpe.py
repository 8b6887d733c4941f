"""Byte-level BPE of a whole corpus with a public vocabulary, on the JVM.

Texts are split into words by the vocabulary's pattern.  The merges of a word
are a fold over its bytes: each step joins the adjacent pair of lowest rank
until no pair has one.  The words that stand for most of the corpus are counted
over all of it and folded once; the rest are folded where they stand, as joining
their ids back would shuffle the corpus.  Words of over ``LONG_BYTES`` (long runs
of one class of characters without a blank), for which the fold is quadratic,
take the same merges with a heap in Arrow batches.
"""

from __future__ import annotations

import base64
import heapq

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.literals import array_literal, lookup, map_literal
from weftline.sources.tables import cut, release

#: Folder of the tokenizer files, and the vocabulary.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern of byte_bpe_50k; ``(?U)`` gives \\s its Unicode meaning.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: About so many of the most frequent words are kept with their ids in the plan, whatever the corpus' size.
HEAD_WORDS = 65_536
LONG_BYTES = 128
#: Steps of the histogram of word counts for every doubling.
COUNT_STEPS = 8
#: Over all places in a word that is folded, a power of two.
_STARTS = 1 << LONG_BYTES.bit_length()
_SLOT = 1 << 16
_HIGH = 1 << 32


def load_ranks(path: str) -> dict[bytes, int]:
    """Byte strings of a rank file with their ids."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merge_bytes(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: ranked merges with a heap over a linked list, n log n."""
    n = len(word)
    ends = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = ends[i]
        if j < n and (r := ranks.get(word[i : ends[j]])) is not None:
            heapq.heappush(heap, (r, i, ends[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or ends[i] >= n or ends[ends[i]] != end:
            continue
        j = ends[i]
        alive[j] = False
        ends[i] = end
        if end < n:
            before[end] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : ends[i]]])
        i = ends[i]
    return out


def _fold(word: Column, rank, none: int) -> Column:
    """Ids of a word (string column of 2 to ``LONG_BYTES`` bytes) by a fold over its bytes.

    The state is one array of ints: for every part the rank of the pair that it
    begins (``none``, above all ranks, without one) times ``_STARTS`` plus the
    byte at which it begins, so the least is the leftmost of the lowest rank.
    Parts that begin at the word's end fill it up.  A merge moves the parts
    behind it up by one and looks up the two pairs that it changes.
    """
    if (none + 1) * _STARTS > 1 << 31:
        raise ValueError("ids too large for the state of the fold")
    raw, n, one = word.cast("binary"), F.octet_length(word), F.lit(1)
    done = F.lit(none * _STARTS)

    def bind(value: Column, body) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def start(x: Column) -> Column:
        return x.bitwiseAND(F.lit(_STARTS - 1))

    def of(begin: Column, size: Column) -> Column:
        return rank(F.substring(raw, begin + one, size))

    def pair(begin: Column, size: Column) -> Column:
        return F.coalesce(of(begin, size), F.lit(none)) * F.lit(_STARTS) + begin

    pairs = F.transform(F.sequence(F.lit(0), n - F.lit(2)), lambda i: pair(i, F.lit(2)))
    first = F.concat(pairs, F.array(done + n - one, done + n, done + n))

    def merged(v: Column, h: Column, i: Column) -> Column:
        end = start(F.get(v, i + F.lit(2)))
        new = lambda x: F.when(end < n, pair(start(x), start(F.get(v, i + F.lit(3))) - start(x))).otherwise(done + start(x))
        left = lambda x: pair(start(x), end - start(x))
        behind = lambda x, j: F.coalesce(F.get(v, j + one), x)
        return F.transform(v, lambda x, j: F.when(j < h, x).when(j > i, behind(x, j)).when(j == i, new(x)).otherwise(left(x)))

    def step(v: Column, _: Column) -> Column:
        least = F.array_min(v)
        at = F.array_position(v, least).cast("int") - one
        go = bind(at, lambda i: bind(i - one, lambda h: merged(v, h, i)))
        return F.when(least >= done, v).otherwise(go)

    def ids(v: Column) -> Column:
        parts = F.filter(v, lambda x: start(x) < n)
        return F.transform(parts, lambda x, i: of(start(x), start(F.get(v, i + one)) - start(x)))

    return F.aggregate(F.sequence(F.lit(2), n), first, step, ids)


def words(text: Column) -> Column:
    """The words of a text by the split pattern, in order; none for null and empty."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATTERN), F.lit(0))


class Encoder:
    """Encodes and decodes columns with one rank file."""

    def __init__(self, spark: SparkSession, path: str = f"{TOKENIZERS}/{VOCABULARY}"):
        self.spark, self.ranks = spark, load_ranks(path)
        keys = list(self.ranks)
        table = map_literal(spark, keys, pa.array([self.ranks[k] for k in keys], pa.int32()))
        self._rank = lambda x: lookup(table, x)

    def _word(self, word: Column) -> Column:
        """Ids (int) of a short word: itself if it is one token, else the fold."""
        whole = self._rank(word.cast("binary"))
        return F.when(whole.isNotNull(), F.array(whole)).otherwise(_fold(word, self._rank, max(self.ranks.values()) + 1))

    def _head(self, words_: DataFrame) -> Column:
        """Ids of the most frequent words of the column ``w`` as a literal, folded once.

        About HEAD_WORDS of them: all of the higher steps of the histogram of
        counts, of the step where they end a share by hash.  The choice decides
        where a word is folded, not what its ids are.
        """
        counts = cut(words_.groupBy("w").agg(F.count("*").alias("n")).where((F.col("n") > 1) & (F.octet_length("w") <= LONG_BYTES)))
        level = F.floor(F.log2("n") * COUNT_STEPS).cast("int")
        left, last, part = HEAD_WORDS, -1, 0
        for step, n in sorted(((r["s"], r["c"]) for r in counts.groupBy(level.alias("s")).agg(F.count("*").alias("c")).collect()), reverse=True):
            if n > left:
                last, part = step, left * _SLOT // n
                break
            left -= n
        chosen = (level > last) | ((level == last) & (F.pmod(F.xxhash64("w"), F.lit(_SLOT)) < part))
        head = counts.where(chosen).select("w", self._word(F.col("w")).alias("ids")).toArrow()
        release(counts)
        return map_literal(self.spark, [w.encode() for w in head["w"].to_pylist()], head["ids"].combine_chunks())

    def encode(self, df: DataFrame, text: str, ids: str = "ids") -> DataFrame:
        """``df`` with a column ``ids`` (array<int>) of the text's ids, without special tokens.

        Null, empty texts: the empty list.  Blank texts are encoded like any
        other.  Rows, order of columns and repeated rows stay as they are.
        """
        docs = df.withColumn("__words", words(F.col(text)))
        table = self._head(docs.select(F.explode("__words").alias("w")))
        ranks = self.ranks
        long = lambda w: F.octet_length(w) > LONG_BYTES

        @F.pandas_udf("array<array<int>>")
        def merge_long(column: pd.Series) -> pd.Series:
            return column.map(lambda xs: None if xs is None else [None if x is None else merge_bytes(x.encode(), ranks) for x in xs])

        sparse = F.when(F.exists("__words", long), F.transform("__words", lambda w: F.when(long(w), w)))
        docs = docs.withColumn("__long", merge_long(sparse))

        def of(w: Column, i: Column) -> Column:
            return F.coalesce(lookup(table, w.cast("binary")), F.get("__long", i), self._word(w))

        return docs.withColumn(ids, F.flatten(F.transform("__words", of))).drop("__words", "__long")

    def tokens_within(self, ids: Column, n_bytes: Column) -> Column:
        """Number of leading ids whose bytes all lie in the first ``n_bytes`` of the text.

        The state is one bigint, bytes left times ``_HIGH`` plus ids so far; at
        the first id that doesn't fit, nothing is left.
        """
        lengths = [0] * (max(self.ranks.values()) + 1)
        for k, v in self.ranks.items():
            lengths[v] = len(k) * _HIGH
        table = array_literal(self.spark, pa.array(lengths, pa.int64()))

        def step(acc: Column, i: Column) -> Column:
            fits = F.get(table, i) <= acc
            return F.when(acc < F.lit(_HIGH), acc).when(fits, acc - F.get(table, i) + F.lit(1)).otherwise(acc.bitwiseAND(F.lit(_HIGH - 1)))

        # Every id has a byte or more, so the first n_bytes ids are enough.
        start = n_bytes.cast("bigint") * F.lit(_HIGH)
        return F.aggregate(F.slice(ids, F.lit(1), n_bytes), start, step, lambda acc: acc.bitwiseAND(F.lit(_HIGH - 1)).cast("int"))

    def decode(self, ids: Column) -> Column:
        """The text of a list of ids: binary pieces concatenated; '' for the empty list, null for null."""
        size = max(self.ranks.values()) + 1
        pieces: list[str] = [""] * size
        for k, v in self.ranks.items():
            pieces[v] = k.hex()
        table = array_literal(self.spark, pa.array(pieces, pa.string()))
        return F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), "")), "UTF-8")
