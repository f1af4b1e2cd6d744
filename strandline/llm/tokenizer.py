"""Byte-level BPE over a whole corpus in Spark expressions.

A text is cut into words by the tokenizer's pattern, each word into bytes; a fold merges the adjacent pair of
lowest rank until none is left.  Ranks come from a literal hash table that Catalyst folds into the plan.
The most frequent items of the corpus (words, or runs between spaces; a bounded number) are merged once and
looked up by hash; every other word is merged where it stands.  No text is shuffled and no Python worker runs.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Callable, Iterable
from functools import cache

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.exprs import let

TOKENIZER_DIR = "/opt/tokenizers"
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"

#: The pattern that cuts a text into words, in Java's syntax; white space is Unicode's White_Space.
#: Words come first, being the most frequent; no alternative before theirs could match where they do.
WORD_PATTERN = r" ?\p{L}+|'s|'t|'re|'ve|'m|'ll|'d| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"

#: A text can be cut before each of its spaces, and its parts be encoded by themselves, unless a space stands
#: between white space (or white space and the end): such runs are words that a cut would break.
UNCUTTABLE = r"\p{IsWhite_Space} (?:\p{IsWhite_Space}|\z)"

#: Items merged once for the corpus: at most so many, each of at most so many bytes.  At 100 bytes an item with
#: its ids this bounds the table to some 3 MB whatever the corpus.
HOT_ITEMS = 16_384
HOT_ITEM_BYTES = 64
RANK_SLOTS = 16_384


@cache
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id, of a rank file (one base64 token and its rank a line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _literal(value: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value, separators=(",", ":"))), kind)


#: The seed of Spark's xxhash64.
_SEED = 42


def _slots(pairs: Iterable[tuple[str, object]], slots: int) -> list[dict]:
    """A hash table as a list of small maps; the number of slots is a power of 2."""
    table: list[dict] = [{} for _ in range(slots)]
    for key, value in pairs:
        table[xxhash.xxh64_intdigest(key.encode(), seed=_SEED) & (slots - 1)][key] = value
    return table


def _find(table: Column, slots: int, key: Column) -> Column:
    return F.try_element_at(F.get(table, F.xxhash64(key).bitwiseAND(F.lit(slots - 1)).cast("int")), key)


def _rank_table(path: str) -> Column:
    """Ranks as a literal table; a byte string is written with one character of Latin-1 a byte."""
    return _literal(_slots(((t.decode("latin-1"), r) for t, r in load_ranks(path).items()), RANK_SLOTS), "array<map<string,int>>")


def _token_table(path: str) -> Column:
    ranks = load_ranks(path)
    tokens: list = [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = base64.b64encode(token).decode()
    return _literal(tokens, "array<binary>")


#: The rank of a pair that can't be merged.
NO_MERGE = 2_147_483_647


def _merge(pieces: Column, ranks: Column, at: Column, rank: Callable[[Column], Column]) -> Column:
    """One merge of the pieces at ``at`` and at + 1 (from 1); only the two pairs beside it get new ranks."""
    merged = F.concat(F.get(pieces, at - 1), F.get(pieces, at))
    left = F.coalesce(rank(F.concat(F.get(pieces, at - 2), merged)), F.lit(NO_MERGE))
    right = F.coalesce(rank(F.concat(merged, F.get(pieces, at + 1))), F.lit(NO_MERGE))
    empty = F.array().cast("array<int>")
    return F.struct(
        F.concat(F.slice(pieces, F.lit(1), at - 1), F.array(merged), F.slice(pieces, at + 2, F.size(pieces))).alias("pieces"),
        F.concat(
            F.when(at > 1, F.concat(F.slice(ranks, F.lit(1), at - 2), F.array(left))).otherwise(empty),
            F.when(at + 1 < F.size(pieces), F.concat(F.array(right), F.slice(ranks, at + 2, F.size(ranks)))).otherwise(empty),
        ).alias("ranks"),
    )


def merge_word(word: Column, table: Column) -> Column:
    """The ids of one word: a fold of ranked merges over its bytes (one character of Latin-1 each).

    The pair of lowest rank, the leftmost of equals, is merged first, until no pair has a rank.  A word that is
    a token by itself needs no fold.  An empty word has no ids.
    """

    def rank(piece: Column) -> Column:
        return _find(table, RANK_SLOTS, piece)

    def start(p: Column) -> Column:
        pairs = F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda a, b: F.coalesce(rank(F.concat(a, b)), F.lit(NO_MERGE)))
        return F.struct(p.alias("pieces"), F.slice(pairs, F.lit(1), F.size(p) - 1).alias("ranks"))

    def step(state: Column, _: Column) -> Column:
        best = F.array_min(state["ranks"])
        at = F.array_position(state["ranks"], best).cast("int")
        return F.when(best < NO_MERGE, _merge(state["pieces"], state["ranks"], at, rank)).otherwise(state)

    def fold(p: Column) -> Column:
        return F.aggregate(p, start(p), step, lambda state: F.transform(state["pieces"], rank))

    def ids(latin: Column) -> Column:
        whole = rank(latin)
        return F.when(whole.isNotNull(), F.array(whole)).otherwise(let(F.split(latin, "", -1), fold))

    empty = F.array().cast("array<int>")
    return F.when(word == "", empty).otherwise(let(F.decode(word.cast("binary"), "ISO-8859-1"), ids))


def words(text: Column) -> Column:
    """The words of a text; all of them in a row are the text again."""
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))


def frequent_items(texts: DataFrame, column: str, limit: int = HOT_ITEMS) -> DataFrame:
    """The most frequent items of all texts (item, n), counted over the whole corpus; ``limit`` rows at most.

    The parts after each space are counted first, combined before the shuffle; the words in them are counted
    from the distinct parts.  Uncuttable texts and the part before the first space give their words.
    """
    text = F.col(f"`{column}`")
    parts = texts.where(~text.rlike(UNCUTTABLE)).select(F.split(text, " ", -1).alias("parts"))
    tails = parts.select(F.explode(F.slice("parts", F.lit(2), F.greatest(F.size("parts"), F.lit(1)))).alias("part"))
    heads = parts.select(F.get("parts", F.lit(0)).alias("item")).unionAll(texts.where(text.rlike(UNCUTTABLE)).select(text.alias("item")))
    counted = tails.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit(" "), "part").alias("item"), "n")
    items = counted.select(F.explode(F.array_distinct(F.concat(F.array("item"), words(F.col("item"))))).alias("item"), "n")
    items = items.unionAll(heads.select(F.explode(words(F.col("item"))).alias("item"), F.lit(1).cast("bigint").alias("n")))
    summed = items.groupBy("item").agg(F.sum("n").alias("n"))
    return summed.where((F.octet_length("item") <= HOT_ITEM_BYTES) & (F.col("item") != "")).orderBy(F.desc("n"), "item").limit(limit)


def _hot_tables(texts: DataFrame, column: str, ranks: Column, limit: int) -> tuple[Column, Column, int]:
    """The frequent items with their ids as two literal tables: those with a space before them, named without it,
    and all.  The driver gets at most ``limit`` rows."""
    top = frequent_items(texts, column, limit).repartition(max(1, min(8, limit // 2048)))
    ids = let(ranks, lambda table: F.flatten(F.transform(words(F.col("item")), lambda word: merge_word(word, table))))
    rows = top.select("item", ids.alias("ids")).collect()
    slots = 1 << max(4, (len(rows) // 2).bit_length())
    kind = "array<map<string,array<int>>>"
    after = [(item[1:], found) for item, found in rows if item[0] == " "]
    return _literal(_slots(after, slots), kind), _literal(_slots(map(tuple, rows), slots), kind), slots


def encode(texts: DataFrame, column: str = "text", out: str = "ids", path: str | None = None, hot_items: int = HOT_ITEMS) -> DataFrame:
    """Adds the token ids of ``column`` as ``out`` (array<int>, never null), without special tokens.

    Null and empty texts get an empty list; blank texts are encoded like any other.  Texts may be of any length,
    but a single word of n bytes costs about n * n / 2 byte copies, so a megabyte without a break is slow.
    An existing column ``out`` is replaced, other columns pass through.  The result doesn't depend on
    ``hot_items``, which only bounds the table of items that are merged in advance.
    """
    ranks = _rank_table(path or os.path.join(TOKENIZER_DIR, BYTE_BPE_50K))
    here = F.col(f"`{column}`")
    parts, hot, slots = _hot_tables(texts.where(here != ""), column, ranks, max(1, hot_items))

    def of_text(tables: Column) -> Column:
        def word_ids(text: Column) -> Column:
            return F.flatten(F.transform(words(text), lambda word: F.coalesce(_find(tables["words"], slots, word), merge_word(word, tables["ranks"]))))

        def unit_ids(unit: Column, i: Column) -> Column:
            return F.coalesce(F.when(i > 0, _find(tables["parts"], slots, unit)), word_ids(F.when(i > 0, F.concat(F.lit(" "), unit)).otherwise(unit)))

        return F.flatten(F.transform(F.when(here.rlike(UNCUTTABLE), F.array(here)).otherwise(F.split(here, " ", -1)), unit_ids))

    ids = let(F.struct(ranks.alias("ranks"), parts.alias("parts"), hot.alias("words")), of_text)
    return texts.withColumn(out, F.when(here != "", ids).otherwise(F.array().cast("array<int>")))


def decode(encoded: DataFrame, column: str = "ids", out: str = "text", path: str | None = None) -> DataFrame:
    """Adds the text of a list of ids as ``out``: the tokens' bytes one after the other.

    An empty list gives an empty text, a null list null; an id that the vocabulary lacks makes the text null.
    """
    tokens = _token_table(path or os.path.join(TOKENIZER_DIR, BYTE_BPE_50K))
    pieces = let(tokens, lambda table: F.transform(F.col(f"`{column}`"), lambda i: F.hex(F.get(table, i))))
    whole = F.when(F.exists(pieces, lambda p: p.isNull()), F.lit(None)).otherwise(F.unhex(F.array_join(pieces, "")))
    return encoded.withColumn(out, whole.cast("string"))
