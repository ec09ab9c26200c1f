"""SimHash near-duplicates, found by one-wildcard variants of two segments.

A fingerprint has 64 bits; two documents are linked where at most two of them differ. Cut into two segments of 32 bits, two
such fingerprints have one segment that differs by at most one bit: either the upper ones differ by one bit at most, or
they differ by two and the lower ones are equal. So the index holds, for each different fingerprint, the 32 variants of
its upper segment in which one bit is a wildcard, and its lower segment as it is: 33 keys, joined by equality and verified
on all bits. A pair whose upper segments are equal would share all 32 variants; it counts at the first alone.

Hot keys. Documents with equal fingerprints are one class, so a group of copies is one row of the index, and keys are
counted before anything meets. A key of up to `few` fingerprints compares them; those of larger groups are met in an
exact way without pairs: fingerprints within two bits of each other are both within one bit of some third value, so each
is dealt to the 65 values within one bit of it. At most 65 different fingerprints can be there, any two of them linked,
and a star on the smallest links them all.
"""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrecon.llm.components import connected_components
from docrecon.llm.storage import Scratch, broadcast_if_small, keep, map_batches

SEED, BITS, HALF = 42, 64, 32
#: Shingles whose hashes are held at once.
BLOCK = 1 << 16
#: A fingerprint of more than 1 / OFTEN of all rows is broadcast to them, so fewer than OFTEN are.
OFTEN = 1000


@dataclass(frozen=True)
class SimHash:
    """words: in a shingle. few: fingerprints of one key that are compared directly; larger groups are met by values within
    one bit, with the same links. max_broadcast: keys of several fingerprints that are broadcast; more are joined in the
    ordinary way."""

    words: int = 3
    few: int = 16
    max_broadcast: int = 500_000


def fingerprint(text: str | None, words: int = 3) -> int:
    """Unsigned. A bit is set if it is in over half of the hashes of the text's word shingles, repeats counted; A-Z count
    as a-z, words end at the six ASCII blanks, fewer words than a shingle has are one shingle, none give zero."""
    from xxhash import xxh64_intdigest

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined, size = memoryview(b" ".join(found)), min(words, len(found))
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(found) - size + 1]
    ends = ends[size - 1 :]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), BLOCK):
        pieces = zip(starts[at : at + BLOCK].tolist(), ends[at : at + BLOCK].tolist(), strict=True)
        hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in pieces), "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(i) for i in np.flatnonzero(2 * ones > len(starts)))


def fingerprints(docs: DataFrame, how: SimHash, id_column: str, text: str) -> DataFrame:
    """Per row: _id and _print, the fingerprint's bits as a signed number."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = np.array([fingerprint(x.as_py(), how.words) for x in batch.column("_text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(found.view(np.int64))], ["_id", "_print"])

    return map_batches(docs.select(F.col(id_column).cast("long").alias("_id"), F.col(text).alias("_text")), run, "_id long, _print long")


def variants(heads: DataFrame) -> DataFrame:
    """heads(_print) -> _print, _key: the upper segment with one bit of 32 left out, and the lower one as it is."""
    keys = heads.select("_print", F.explode(F.sequence(F.lit(0), F.lit(HALF))).alias("_at"))
    part = F.expr(f"if(_at = {HALF}, _print & {(1 << HALF) - 1}L, shiftrightunsigned(_print, {HALF}) & ~shiftleft(1L, _at))")
    return keys.select("_print", part.bitwiseOR(F.expr(f"shiftleft(cast(_at as bigint), {HALF})")).alias("_key"))


def _near(a: str, b: str):
    """Whether two fingerprints link; where their upper segments are equal, at the variants' first place alone."""
    return F.expr(f"{a} <> {b} and bit_count({a} ^ {b}) <= 2 and (shiftrightunsigned(_key, {HALF}) in (0, {HALF}) or shiftrightunsigned({a} ^ {b}, {HALF}) <> 0)")


def links(heads: DataFrame, how: SimHash, keep) -> DataFrame:
    """heads(_print), all different -> a, b: fingerprints that link, enough of them to connect all that do."""
    keys = variants(heads)
    met = keep(keys.groupBy("_key").agg(F.count("*").alias("_n"), F.min("_print").alias("a"), F.max("_print").alias("b")).filter("_n > 1"), "keys")
    two = met.filter("_n = 2").filter(_near("a", "b")).select("a", "b")
    some = keep(keys.join(broadcast_if_small(met.filter("_n > 2").select("_key", "_n"), how.max_broadcast), "_key"), "members")
    # no more than `few` are gathered, as the count says
    groups = some.filter(F.col("_n") <= how.few).groupBy("_key").agg(F.collect_list("_print").alias("_all"))
    pairs = groups.select("_key", "_all", F.explode("_all").alias("a")).select("_key", "a", F.explode("_all").alias("b")).filter("a < b").filter(_near("a", "b")).select("a", "b")
    # no more than 65 are gathered, as no more different values are within one bit of one
    many = some.filter(F.col("_n") > how.few).select("_print").distinct()
    around = many.select("_print", F.explode(F.expr(f"concat(array(_print), transform(sequence(0, {BITS - 1}), i -> _print ^ shiftleft(1L, i)))")).alias("_centre"))
    stars = around.groupBy("_centre").agg(F.collect_list("_print").alias("_all")).filter("size(_all) > 1")
    star = stars.select(F.array_min("_all").alias("a"), F.explode("_all").alias("b")).filter("a <> b")
    return keep(two.unionAll(pairs).unionAll(star).distinct(), "links")


def simhash_components(docs: DataFrame, how: SimHash = SimHash(), id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, fingerprint (16 hexadecimal digits), component_id.

    component_id is the smallest id that a row reaches by links, its own included. A null or empty text, or one of blanks
    alone, has the fingerprint zero and links like any other. Rows link by their fingerprints alone: rows that repeat an id
    are linked only if these are near. A row with a null id links with nothing and has a null component. An empty table gives
    no rows; other columns are not read. Ids are whole numbers, as the smallest names a component: others raise
    ValueError. A text of any length is read whole.
    """
    if docs.schema[id_column].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{id_column} holds no whole numbers")
    with Scratch(docs.sparkSession) as scratch:
        marks = scratch.keep(fingerprints(docs, how, id_column, text), "fingerprints")
        own = marks.filter("_id is not null")
        heads = scratch.keep(own.groupBy("_print").agg(F.min("_id").alias("_least"), F.count("*").alias("_rows")), "heads")
        parts = scratch.keep(connected_components(links(heads.select("_print"), how, scratch.keep), keep=scratch.keep), "components").withColumnRenamed("_node", "_print")
        least = parts.join(heads, "_print").groupBy("_component").agg(F.min("_least").alias("_first"))
        reached = scratch.keep(heads.join(parts.join(least, "_component").select("_print", "_first"), "_print", "left").select("_print", F.coalesce("_first", "_least").alias("_first"), "_rows"), "reached")
        total = reached.agg(F.sum("_rows")).head()[0] or 0
        often = F.broadcast(reached.filter(F.col("_rows") * OFTEN > total).drop("_rows"))
        found = own.join(often, "_print").unionByName(own.join(often, "_print", "left_anti").join(reached.drop("_rows"), "_print")).unionByName(marks.filter("_id is null").withColumn("_first", F.lit(None).cast("long")))
        return keep(found.select(F.col("_id").alias(id_column), F.lpad(F.lower(F.hex("_print")), 16, "0").alias("fingerprint"), F.col("_first").alias("component_id")), "simhash")
