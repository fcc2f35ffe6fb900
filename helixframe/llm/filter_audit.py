"""Filter interaction audit: what each filter removes in every order, alone and together, by part and label.

A document's failed filters decide which subsets of filters it survives: with five
filters there are 32 subsets, so a 32-bit word with a bit for each subset holds the
document's whole truth table. Positional popcounts of the words (how many have bit S)
are the survivors of each subset S, by part and label class. They are taken in every
task with carry-save adders, which add 63 words at once in bit planes, and the tasks'
counts are summed. All orders follow from the 32 numbers: with the filters before it P,
filter f removes survivors(P) - survivors(P with f).

The documents' texts are read once. What moves is a digest, an id and a mask for each
document (24 to 60 bytes), then 32 rows for each part and task.

Null text counts as empty; null or absent labels as neither good nor toxic; several label
rows of an id count if one of them is 1. A row with a null id is identical to no smaller
id's text, and none is smaller. Rows that share id and text are documents each, neither
the smaller. Very long texts are read whole. A null part is the empty string. An empty
table has no parts and so gives no rows. Other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_side

#: Filters of a word at most, so that its subsets fit 32 bits.
MOST = 5
#: Words that one lane of the adders takes; parts that a task counts before it hands them on.
LANE, PARTS = 63, 4096
SPACES = "[\\x20\\x09-\\x0D]+"


def survival_words(filters: int) -> list[int]:
    """The word of each failure mask: bit S is set if no filter of the subset S fails."""
    return [sum(1 << s for s in range(1 << filters) if not s & mask) for mask in range(1 << filters)]


def positional_counts(words: np.ndarray) -> np.ndarray:
    """How many 32-bit words have each bit, by carry-save adders: three planes of one weight become a sum and a carry."""
    lanes = -(-len(words) // LANE) or 1
    rows = np.zeros(LANE * lanes, np.uint32)
    rows[: len(words)] = words
    planes = {0: list(rows.reshape(LANE, lanes))}
    counts = np.zeros(32, np.int64)
    weight = 0
    while weight in planes:
        waiting = planes[weight]
        while len(waiting) >= 3:
            a, b, c = waiting.pop(), waiting.pop(), waiting.pop()
            half = a ^ b
            planes.setdefault(weight + 1, []).append((half & c) | (a & b))
            waiting.insert(0, half ^ c)
        for plane in waiting:
            counts += np.unpackbits(plane.view(np.uint8), bitorder="little").reshape(-1, 32).sum(0, dtype=np.int64) << weight
        weight += 1
    return counts


def survivors(words: DataFrame) -> DataFrame:
    """(part, subset, n, good, toxic): survivors of each subset. words: (part, word, good, toxic), a row a document."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}

        def told() -> pa.RecordBatch:
            parts = list(found)
            table = np.concatenate([found[p] for p in parts], axis=1) if parts else np.zeros((3, 0), np.int64)
            parts = np.repeat(np.array(parts, object), 32)
            subsets = np.tile(np.arange(32, dtype=np.int32), len(found))
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), pa.array(subsets, pa.int32()), *(pa.array(x, pa.int64()) for x in table)], names=["part", "subset", "n", "good", "toxic"])

        for batch in batches:
            codes = pc.dictionary_encode(batch.column(0))
            which, word = codes.indices.to_numpy(), batch.column(1).to_numpy().astype(np.uint32)
            classes = [np.ones(len(word), bool), *(batch.column(c).to_numpy(zero_copy_only=False) for c in (2, 3))]
            order = np.argsort(which, kind="stable")
            starts = np.searchsorted(which[order], np.arange(len(codes.dictionary) + 1))
            for k, part in enumerate(codes.dictionary.to_pylist()):
                own = order[starts[k] : starts[k + 1]]
                counts = np.stack([positional_counts(word[own[c[own]]]) for c in classes])
                found[part] = found[part] + counts if part in found else counts
                if len(found) >= PARTS:
                    yield told()
        yield told()

    rows = words.mapInArrow(each, "part string, subset int, n long, good long, toxic long")
    return rows.groupBy("part", "subset").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def audit(words: DataFrame, names: str) -> DataFrame:
    """Every part, order and step: filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    names: a letter a filter, in the order of the mask's bits, five at most.
    """
    k = len(names)
    if not 0 < k <= MOST:
        raise ValueError(f"1 to {MOST} filters")
    every = (1 << k) - 1
    bit = {x: 1 << i for i, x in enumerate(names)}
    steps = [{"o": "".join(o), "s": i + 1, "p": sum(bit[x] for x in o[:i]), "f": bit[o[i]]} for o in permutations(names) for i in range(k)]
    plan = F.from_json(F.lit(json.dumps(steps)), "array<struct<o:string,s:int,p:int,f:int>>")
    counted = survivors(words).filter(F.col("subset") <= every)
    by = counted.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("subset", "n", "good", "toxic"))).alias("t"))  # 32 rows a part

    def left(subset: Column | int, name: str = "n") -> Column:
        return F.get("t", subset if isinstance(subset, Column) else F.lit(subset))[name]

    def share(f: int) -> Column:
        others = [s for s in range(every + 1) if not s & f]
        orders = {s: factorial(s.bit_count()) * factorial(k - 1 - s.bit_count()) for s in others}
        return sum((F.lit(orders[s]) * (left(s) - left(s | f)) for s in others), F.lit(0).cast("long"))

    shares = F.create_map(*(x for f in bit.values() for x in (F.lit(f), share(f))))
    rows = by.withColumn("shares", shares).select("part", "t", "shares", F.explode(plan).alias("x")).select("part", "t", "shares", "x.*")
    after, alone = F.col("p").bitwiseOR(F.col("f")), F.lit(every).bitwiseXOR(F.col("f"))
    removed = left(F.col("p")) - left(after)
    return rows.select(
        "part", F.col("o").alias("filter_order"), F.col("s").alias("step"), left(after).alias("kept"), removed.alias("removed"),
        (left(0) - left(F.col("f")) - removed).alias("redundant"), (left(alone) - left(every)).alias("unique_fails"),
        (left(F.col("p"), "good") - left(after, "good")).alias("good_lost"), (left(F.col("p"), "toxic") - left(after, "toxic")).alias("toxic_lost"),
        F.col("shares")[F.col("f")].alias("shapley"),
    )


def document_failures(text: Column) -> list[Column]:
    """Whether a text is short, repeats its words, has many capitals, or holds a sign of code: filters A to D."""
    words = F.array_remove(F.split(text, SPACES), "")
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]", ""))
    return [
        F.size(words) < 200,
        100 * F.size(F.array_distinct(words)).cast("long") < 50 * F.size(words).cast("long"),
        100 * capitals.cast("long") > 3 * F.char_length(text).cast("long"),
        text.rlike("[#$%&*|]"),
    ]


def document_words(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, word, good, toxic) of every document, by filters A to D and E: identical to the text of a smaller id."""
    body = F.coalesce(F.col(text), F.lit(""))
    mask = sum((F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)) for i, fails in enumerate(document_failures(body))), F.lit(0))
    slim = cut(docs.select(F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(body, 256)).alias("h"), mask.alias("mask")))
    again = slim.groupBy("h").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("h", "first")
    again = cut(again)
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("label_id"))
    marks = marks.agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))))
    joined = slim.join(small_side(again, again.count(), 64), "h", "left").join(marks, F.col("id") == F.col("label_id"), "left")
    copy = F.when(F.coalesce(F.col("id") > F.col("first"), F.lit(False)), F.lit(16)).otherwise(F.lit(0))
    word = F.get(F.array(*(F.lit(w).cast("long") for w in survival_words(5))), F.col("mask") + copy)
    return joined.select("part", word.alias("word"), *(F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")))


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E over documents, by language."""
    return audit(document_words(docs, labels), "ABCDE")
