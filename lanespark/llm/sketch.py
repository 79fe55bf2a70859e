"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, by
one rule for texts of every length. What is kept does not depend on the rest
of the document, so sketches of parts merge by union, and the share of one
sketch's hashes that another one holds estimates containment between documents
of very unequal length. Built from DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanespark.session import cut_lineage

from .common import is_empty

#: White space: space and 0x09 to 0x0D.
_WHITE = r"\x20\x09-\x0D"
#: Scripts written without spaces between words; each of their characters is a word.
_SINGLE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}"
#: Other words: up to 16 code points without white space (longer ones are cut into pieces from their start).
#: Visible ASCII stands first, so that it needs no look at the scripts.
_WORD = rf"[\x21-\x7E[^{_WHITE}{_SINGLE}]]{{1,16}}|[{_SINGLE}]"


def sketch(text: Column, shingle: int = 5, fraction: float = 1 / 2) -> Column:
    """Sorted distinct shingle hashes (array of int, 0 to 2^31 - 1) below ``fraction`` (at most 1/2) of 32 bits.

    Words are pieces of up to 16 code points without white space, or single
    characters of scripts without spaces; case is kept. ``shingle - 1`` empty
    words stand at either end, so a text of n words has n + shingle - 1
    shingles and a short one still keeps some. A text that keeps none has one
    negative mark made from the whole text, so that it is like equal texts
    only; null is an empty text.
    """
    if not 0 < fraction <= 0.5:
        raise ValueError("fraction must be above 0 and at most 1/2")
    text = F.coalesce(text, F.lit(""))
    limit = F.lit(int(fraction * 2 ** 32) - 1)
    words = F.transform(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), lambda w: F.xxhash64(w))
    edge = F.array_repeat(F.lit(0).cast("long"), shingle - 1)
    high = lambda x: F.shiftrightunsigned(x, 32)

    def shingles(h):
        runs = F.transform(F.sequence(F.lit(1), F.size(h) - shingle + 1),
                           lambda i: high(F.xxhash64(*[F.element_at(h, i + k) for k in range(shingle)])))
        return F.when(F.size(h) > 2 * (shingle - 1), runs).otherwise(F.array().cast("array<bigint>"))

    # what a lambda uses more than once is bound by a one-element array: it would be evaluated anew at each use
    kept = F.transform(F.array(F.concat(edge, words, edge)), lambda h: F.array_sort(F.array_distinct(
        F.transform(F.filter(shingles(h), lambda x: x <= limit), lambda x: x.cast("int")))))
    mark = F.array((-1 - F.shiftrightunsigned(F.xxhash64(text), 33)).cast("int"))
    return F.element_at(F.transform(kept, lambda s: F.when(F.size(s) > 0, s).otherwise(mark)), 1)


def merge(a: Column, b: Column) -> Column:
    """Sketch of two documents together: the union; a mark stays only if neither keeps a shingle."""
    both = F.array_sort(F.array_union(a, b))
    return F.element_at(F.transform(F.array(both), lambda s: F.when(
        F.element_at(s, -1) >= 0, F.filter(s, lambda x: x >= 0)).otherwise(s)), 1)


def as_string(s: Column) -> Column:
    """Hashes in 8 hexadecimal digits each, in order, joined by commas (a mark has its first bit set)."""
    return F.array_join(F.transform(s, lambda x: F.lower(F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(2 ** 32 - 1))),
                                                                8, "0"))), ",")


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b holds, 0 to 1; a text without kept shingles is like equal ones only."""
    return F.size(F.array_intersect(a, b)) / F.size(a).cast("double")


def following(keys: DataFrame, rows_per_part: int = 50_000) -> DataFrame:
    """Each key with the next one in descending order; the last is followed by the first.

    ``keys`` holds distinct rows; all its columns are the key. Returns them and
    ``next_<column>``. The keys are cut into ranges whose number follows the
    data; the neighbours across a cut come from one row for each range.
    """
    names = keys.columns
    order = [F.col(c).desc_nulls_last() for c in names]
    n_parts = max(1, -(-keys.count() // rows_per_part))
    placed = cut_lineage(keys.repartitionByRange(n_parts, *order).withColumn("part", F.spark_partition_id()))
    whole = F.struct(*names)
    w = Window.partitionBy("part").orderBy(*order)
    inside = placed.withColumn("next", F.lead(whole).over(w)).withColumn("nth", F.row_number().over(w))
    inside = cut_lineage(inside)
    firsts = inside.where("nth = 1").select("part", whole.alias("head"))  # one row for each range
    ring = Window.orderBy(F.col("part"))
    every = Window.orderBy(F.col("part")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = firsts.select("part", F.coalesce(F.lead("head").over(ring), F.first("head").over(every)).alias("head"))
    inner = inside.where(F.col("next").isNotNull())
    ends = inside.where(F.col("next").isNull()).drop("next").join(heads, "part").withColumnRenamed("head", "next")
    pick = [*names, *[F.col("next")[c].alias("next_" + c) for c in names]]
    return inner.select(*pick).unionByName(ends.select(*pick))


def edited(docs: DataFrame, shingle: int = 5, fraction: float = 1 / 2, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text.

    The edited text replaces the last floor(n_chars / 3) code points by the
    first as many (or all) of the next document in descending order of
    doc_id. A null text is empty. Rows that repeat a doc_id follow one another
    by their texts' hashes; equal rows count as one document and each get its
    result; null ids come last. An empty table gives no rows; one document
    follows itself.

    ``near_edited`` and ``near_next`` are the containment of the document's
    sketch in that of its edited text and of the next document.

    Each text crosses the network once; a neighbour's prefix and sketch cross
    a second time. The order itself is found on the ids alone.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    keyed = base.withColumn("text_hash", F.xxhash64("text"))
    light = cut_lineage(keyed.groupBy("doc_id", "text_hash").agg(
        F.max(F.char_length("text")).alias("n_chars"), (F.count("*") > 1).alias("repeated")))
    order = following(light.select("doc_id", "text_hash"))
    size = light.select(F.col("doc_id").alias("s_id"), F.col("text_hash").alias("s_hash"), "n_chars")
    before = cut_lineage(order.join(size, F.col("doc_id").eqNullSafe(F.col("s_id"))
                                    & (F.col("text_hash") == F.col("s_hash")))
                         .select(F.col("next_doc_id").alias("k_id"), F.col("next_text_hash").alias("k_hash"),
                                 F.col("doc_id").alias("to_id"), F.col("text_hash").alias("to_hash"),
                                 F.floor(F.col("n_chars") / 3).cast("int").alias("cut")))
    hit = F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("text_hash") == F.col("k_hash"))
    heads = keyed.join(before, hit).select(
        "to_id", "to_hash", F.substring("text", F.lit(1), F.col("cut")).alias("head"),
        sketch(F.col("text"), shingle, fraction).alias("next_sketch"))
    if not is_empty(light.where("repeated")):
        heads = heads.dropDuplicates(["to_id", "to_hash"])
    both = keyed.join(heads, F.col("doc_id").eqNullSafe(F.col("to_id")) & (F.col("text_hash") == F.col("to_hash")))
    n = F.char_length("text")
    new = F.concat(F.substring("text", F.lit(1), n - F.floor(n / 3).cast("int")), F.col("head"))
    out = both.select("doc_id", "text", "next_sketch", n.cast("long").alias("n_chars"), new.alias("edited_text"))
    out = out.withColumns({"sketch": sketch(F.col("text"), shingle, fraction),
                           "edited_sketch": sketch(F.col("edited_text"), shingle, fraction)})
    return out.withColumns({"near_" + name: containment(F.col("sketch"), F.col(name + "_sketch"))
                            for name in ("edited", "next")})
