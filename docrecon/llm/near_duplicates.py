"""Near-duplicates by HyperMinHash.

A document's signature has one register per bucket: of the smallest hash that its shingles have there, the count of
leading zeros (6 bits) and the mantissa bits that follow (10 bits). A shingle falls into one bucket; a bucket that stays
empty is filled in a further turn, in which all shingles are dealt anew, so that it agrees with another document's just
as often as the sets do, however short the text. Registers stand in bands of six, and documents that agree in a band are
candidates. At a similarity of 0.8 a band agrees with probability 0.26, so 42 bands miss a pair three times in a million;
at 0.3 a pair is a candidate three times in a hundred, which keeps what shares a passage apart. Of a candidate's
registers the share that agrees, corrected for equal registers of different hashes, estimates the similarity; pairs far
below the threshold go, and the others are confirmed on their full sets.

Groups of copies. Documents with the same set are one class, found by grouping on a digest of the set, and only its
smallest id goes on. In a group (the documents that agree in a band) everyone meets one centre, the member with most
candidates, instead of everyone else. Groups whose members are then connected are done, which ends most groups of near
copies. In the others no link between two parts may be lost:

* a group of few members compares those of different parts;
* a group of many members is met by what sets it apart from its body, the shingles that most members hold. If A differs
  from the body by a shingles and B by b, of which they share s, A and B differ by a + b - 2 s. So a pair either is
  similar whatever it shares, and then both are similar to the member nearest to the body, or must share a number of
  differences. These are met by prefix: in the order of how many members have them, the rarest first, the place of the
  first shared one bounds how many two members can share. So members that have only the body in common are never paired,
  whichever of them is the centre. Those that share a difference within the bound meet the one of them with most left to
  share; what is then still apart is compared.
"""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docrecon.llm.components import connected_components
from docrecon.llm.storage import Scratch, broadcast_if_small, keep, map_batches

MANTISSA_BITS, ROWS = 10, 6
#: Chance that registers of different smallest hashes are equal, for sets of like size: 0.1699 / 2^mantissa bits.
COLLISION = 0.169919487159739 / (1 << MANTISSA_BITS)


@dataclass(frozen=True)
class Similarity:
    """words: in a shingle. percent: least 100 * intersection / union. bands: of six registers each. margin: how far
    below the threshold an estimate may lie (at 0.8 and 252 registers one deviation is 0.025). few: members of a group
    that are compared directly once the centre has met them; larger groups are met by prefix, with the same links.
    max_broadcast: ids of documents whose sets are needed that are broadcast; more are joined in the ordinary way."""

    words: int = 5
    percent: int = 80
    bands: int = 42
    margin: float = 0.25
    few: int = 16
    max_broadcast: int = 2_000_000

    @property
    def buckets(self) -> int:
        return self.bands * ROWS


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def shingle_hashes(text: str | None, words: int, known: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles. A-Z count as a-z and words end at the six ASCII blanks;
    fewer words than a shingle has are one shingle, none give an empty set."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    size = min(words, len(found))
    made = np.full(len(found) - size + 1, size, np.uint64)
    for i in range(size):
        made = made * np.uint64(0x9E3779B97F4A7C15) + ids[i : len(ids) - size + 1 + i]
    return np.unique(_mix(made))


def bucket_minima(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The smallest hash in each bucket, 32 bits each, in the first turn that deals the bucket a hash; of sorted distinct
    hashes. Turns are made as many at a time as will mostly fill all buckets."""
    least, empty = np.full(buckets, 0xFFFFFFFF, np.uint64), np.ones(buckets, bool)
    at_once = -(-8 * buckets // max(1, len(hashes)))
    for first in range(0, 1 << 16, at_once):
        if not len(hashes) or not empty.any():
            break
        turns = np.arange(first, min(first + at_once, 1 << 16), dtype=np.uint64)
        dealt = _mix(hashes[None, :] + ((turns + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))[:, None])
        # bucket (16 bits), turn (16), hash (32): in order, a bucket's first is its smallest of its first turn
        low = np.uint64(0xFFFFFFFF)
        keys = np.sort((((dealt >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32) << np.uint64(48)) | turns[:, None] << np.uint64(32) | dealt & low).ravel())
        bucket = (keys >> np.uint64(48)).astype(np.int64)
        heads = np.flatnonzero(np.diff(bucket, prepend=-1))
        heads = heads[empty[bucket[heads]]]
        least[bucket[heads]] = keys[heads] & low
        empty[bucket[heads]] = False
    return least << np.uint64(32)


def registers(least: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of smallest hashes, 16 bits each."""
    exponent = np.minimum(np.frexp(least.astype(np.float64))[1].astype(np.int64), 64)
    exponent -= (exponent > 0) & (least < np.left_shift(np.uint64(1), np.maximum(exponent - 1, 0).astype(np.uint64)))
    zeros = (64 - exponent).astype(np.uint64)
    shifted = np.left_shift(np.left_shift(least, np.minimum(zeros, np.uint64(63))), np.uint64(1))
    return ((np.minimum(zeros, np.uint64(63)) << np.uint64(MANTISSA_BITS)) | (shifted >> np.uint64(64 - MANTISSA_BITS))).astype("<u2")


def signatures(docs: DataFrame, how: Similarity, id_column: str, text: str) -> DataFrame:
    """Per document: _id, _class (digest of its set, null if that is empty), _size and _registers (2 bytes each)."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        known = _Words()
        for batch in batches:
            classes, sizes, marks = [], [], []
            for content in batch.column("_text"):
                hashes = shingle_hashes(content.as_py(), how.words, known)
                sizes.append(len(hashes))
                classes.append(xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None)
                marks.append(registers(bucket_minima(hashes, how.buckets)).tobytes() if len(hashes) else None)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(classes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary())], ["_id", "_class", "_size", "_registers"])

    chosen = docs.select(F.col(id_column).cast("long").alias("_id"), F.col(text).alias("_text"))
    return map_batches(chosen, run, "_id long, _class binary, _size long, _registers binary")


def _bands(heads: DataFrame, how: Similarity) -> DataFrame:
    """heads(_id, _registers) -> _id, _band, _key: a row for each band."""
    own = F.transform(F.sequence(F.lit(0), F.lit(how.bands - 1)), lambda i: F.xxhash64(F.substring("_registers", i * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    return heads.select("_id", F.posexplode(own).alias("_band", "_key"))


def _estimate(pairs: DataFrame, marks: DataFrame, how: Similarity) -> DataFrame:
    """pairs(a, b) whose corrected estimate is not far below the threshold."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            one, other = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(batch.num_rows, -1) for c in ("_one", "_other"))
            share = (one == other).mean(axis=1) if batch.num_rows else np.empty(0)
            near = (share - COLLISION) / (1 - COLLISION) >= how.percent / 100 - how.margin
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(near))

    one, other = marks.select(F.col("_id").alias("a"), F.col("_registers").alias("_one")), marks.select(F.col("_id").alias("b"), F.col("_registers").alias("_other"))
    return map_batches(pairs.join(one, "a").join(other, "b").select("a", "b", "_one", "_other"), run, "a long, b long")


def _confirm(pairs: DataFrame, sets: DataFrame, how: Similarity) -> DataFrame:
    """pairs(a, b) that are similar enough, on their full sets."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            one, other = batch.column("_one"), batch.column("_other")
            good = []
            for i in range(batch.num_rows):
                x, y = np.asarray(one[i].values), np.asarray(other[i].values)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= how.percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    one, other = sets.select(F.col("_id").alias("a"), F.col("_set").alias("_one"), F.col("_size").alias("_n")), sets.select(F.col("_id").alias("b"), F.col("_set").alias("_other"), F.col("_size").alias("_m"))
    within = 100 * F.least("_n", "_m") >= how.percent * F.greatest("_n", "_m")
    return map_batches(pairs.join(one, "a").join(other, "b").filter(within).select("a", "b", "_one", "_other"), run, "a long, b long")


def _sets(docs: DataFrame, wanted: DataFrame, how: Similarity, id_column: str, text: str) -> DataFrame:
    """Full sets of the wanted documents(_id): _id, _size, _set."""

    def run(batches):
        import pyarrow as pa

        known = _Words()
        for batch in batches:
            found = [shingle_hashes(x.as_py(), how.words, known) for x in batch.column("_text")]
            offsets = np.cumsum([0, *map(len, found)], dtype=np.int32)
            values = np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array([len(x) for x in found], pa.int64()), pa.ListArray.from_arrays(offsets, values)], ["_id", "_size", "_set"])

    chosen = docs.select(F.col(id_column).cast("long").alias("_id"), F.col(text).alias("_text"))
    return map_batches(chosen.join(broadcast_if_small(wanted, how.max_broadcast), "_id", "left_semi"), run, "_id long, _size long, _set array<long>")


def _pairs(one: str, other: str) -> list:
    return [F.least(one, other).alias("a"), F.greatest(one, other).alias("b")]


def _centres(members: DataFrame) -> DataFrame:
    """Pairs a < b of a group's heaviest member with its other members, each pair once."""
    top = members.groupBy("_band", "_key").agg(F.max(F.struct("_weight", "_id")).alias("_top"))
    return members.join(top, ["_band", "_key"]).filter("_id <> _top._id").select(*_pairs("_id", "_top._id")).distinct()


def _apart(members: DataFrame, key: list[str]) -> DataFrame:
    """Groups whose members are in several parts, with their number of members and heaviest one."""
    found = members.groupBy(*key).agg(F.min("_component").alias("_x"), F.max("_component").alias("_y"), F.count("*").alias("_m"), F.max(F.struct("_weight", "_id", "_component")).alias("_top"))
    return found.filter("_x < _y").drop("_x", "_y")


def _between(members: DataFrame, key: list[str], condition: str = "true") -> DataFrame:
    """Pairs a < b of a group's members of different parts, each pair once."""
    names = [c for c in members.columns if c not in key]
    one, other = (members.select(*key, *(F.col(c).alias(f"{side}{c}") for c in names)) for side in "lr")
    met = one.join(other, key).filter("l_id < r_id and l_component <> r_component").filter(condition)
    return met.select(F.col("l_id").alias("a"), F.col("r_id").alias("b")).distinct()


def _differences(members: DataFrame, sets: DataFrame, how: Similarity) -> DataFrame:
    """members(_centre, _id) -> _centre, _id, _mark (of the set, as an id in several rows has one for each text), _n (its
    size), _differs: what the set lacks of its group's body (the shingles that most members hold) or has beside it, and
    _excess: two sets of a group are similar if their excesses' sum is at most 2 * (100 + percent) times the differences
    that they share, and only then. A body has fewer than twice the mean set's shingles."""
    held = members.join(sets.select("_id", F.col("_size").alias("_n"), "_set", F.xxhash64("_set").alias("_mark")), "_id").dropDuplicates(["_centre", "_id", "_mark"])
    size = held.groupBy("_centre").agg(F.count("*").alias("_members"))
    holders = held.select("_centre", F.explode("_set").alias("_token")).groupBy("_centre", "_token").agg(F.count("*").alias("_holders"))
    body = holders.join(size, "_centre").filter("2 * _holders > _members").groupBy("_centre").agg(F.collect_list("_token").alias("_body"))
    differs = F.when(F.col("_body").isNull(), F.col("_set")).otherwise(F.concat(F.array_except("_set", "_body"), F.array_except("_body", "_set")))
    found = held.join(body, "_centre", "left").select("_centre", "_id", "_mark", "_n", differs.alias("_differs"))
    return found.withColumn("_excess", (100 + how.percent) * F.size("_differs").cast("long") - (100 - how.percent) * F.col("_n"))


def _prefixes(differences: DataFrame) -> DataFrame:
    """_centre, _id, _n, _excess, _token and _reach: each difference that another member has too, and how many of these
    stand from there on, in the order of how many members have them, the rarest first."""
    tokens = differences.select("_centre", "_id", "_mark", "_n", "_excess", F.explode("_differs").alias("_token"))
    holders = tokens.groupBy("_centre", "_token").agg(F.count("*").alias("_holders")).filter("_holders > 1")
    reach = F.row_number().over(Window.partitionBy("_centre", "_id", "_mark").orderBy(F.desc("_holders"), F.desc("_token")))
    return tokens.join(holders, ["_centre", "_token"]).select("_centre", "_id", "_n", "_excess", "_token", reach.cast("long").alias("_reach"))


def _within_reach(prefixes: DataFrame, how: Similarity) -> DataFrame:
    """Members of (_centre, _token) groups in several parts, without those that can reach no other member: what two sets
    share of differences from their first shared one on must make up for their excesses, and a partner's is no less than
    the group's least one, nor further below one's own than sizes and differences of similar sets can lie apart."""
    key, apart = ["_centre", "_token"], F.ceil(200 * (100 - how.percent) * F.col("_n") / how.percent)
    for _ in range(2):  # who is left may be in one part
        parts = prefixes.groupBy(*key).agg(F.min("_component").alias("_x"), F.max("_component").alias("_y"), F.min("_excess").alias("_least")).filter("_x < _y")
        least = F.greatest(F.col("_least"), F.col("_excess") - apart)
        prefixes = prefixes.join(parts, key).filter(2 * (100 + how.percent) * F.col("_reach") >= F.col("_excess") + least).drop("_x", "_y", "_least")
    return prefixes


class _Links:
    """Links that are confirmed so far, and the parts that they make. The full set of a document is made when an estimate
    or a prefix asks for it, so most documents never have one."""

    def __init__(self, marks: DataFrame, make_sets, how: Similarity, keep):
        self.marks, self.make_sets, self.how, self.keep = marks, make_sets, how, keep
        self.sets, self.tried, self.parts = None, None, None

    def need(self, ids: DataFrame) -> DataFrame:
        """Full sets that hold those of ids(_id)."""
        wanted = self.keep(ids.distinct() if self.sets is None else ids.distinct().join(self.sets.select("_id"), "_id", "left_anti"), "wanted")
        if self.sets is None or not wanted.isEmpty():
            new = self.keep(self.make_sets(wanted), "sets")
            self.sets = new if self.sets is None else self.sets.unionAll(new)
        return self.sets

    def add(self, pairs: DataFrame) -> None:
        """Confirms pairs(a, b) and joins the parts that they link. Without a pair or a link it ends there, as every
        further step is jobs of its own, whose plans the driver holds."""
        pairs = self.keep(pairs if self.tried is None else pairs.join(self.tried, ["a", "b"], "left_anti"), "pairs")
        self.tried = pairs if self.tried is None else self.tried.unionAll(pairs)
        new = pairs
        if not pairs.isEmpty():
            near = self.keep(_estimate(pairs, self.marks, self.how), "near")
            sets = self.need(near.select(F.col("a").alias("_id")).unionAll(near.select("b")))
            new = self.keep(_confirm(near, sets, self.how), "confirmed")
        if self.parts is None:
            self.parts = self.keep(connected_components(new, keep=self.keep), "components").withColumnRenamed("_node", "_id")
            return
        if new.isEmpty():
            return
        # a part is one node from now on, so later rounds are small
        ends = self.named(self.named(new.select(F.col("a").alias("_id"), "b")).select(F.col("_component").alias("a"), F.col("b").alias("_id"))).select("a", F.col("_component").alias("b"))
        merged = connected_components(ends, keep=self.keep).select(F.col("_node").alias("_component"), F.col("_component").alias("_to"))
        ids = self.parts.unionAll(merged.select(F.col("_component").alias("_id"), "_component"))
        ids = ids.groupBy("_id").agg(F.min("_component").alias("_component"))
        self.parts = self.keep(ids.join(merged, "_component", "left").select("_id", F.coalesce("_to", "_component").alias("_component")), "components")

    def named(self, rows: DataFrame) -> DataFrame:
        """rows with _id, with the part it is in."""
        return rows.join(self.parts, "_id", "left").withColumn("_component", F.coalesce("_component", "_id"))


def _add_large(found: _Links, few: DataFrame, many: DataFrame) -> None:
    """Links of the groups many(_centre, _id) by their members' differences from the body, and those of the pairs few(a, b)."""
    how, keep = found.how, found.keep
    differences = keep(_differences(many, found.need(many.select("_id")), how), "differences")
    # sets that no shared difference need make similar are all similar to the one of the least excess
    first = differences.groupBy("_centre").agg(F.min(F.struct("_excess", "_id")).alias("_first"))
    near_body = differences.join(first, "_centre").filter("_excess + _first._excess <= 0 and _id <> _first._id").select(*_pairs("_id", "_first._id"))
    prefixes = keep(_prefixes(differences), "prefixes")
    bound = f"{2 * (100 + how.percent)} * least(l_reach, r_reach) >= l_excess + r_excess"
    near = keep(_within_reach(found.named(prefixes), how), "reaching")
    top = near.groupBy("_centre", "_token").agg(F.max(F.struct((2 * (100 + how.percent) * F.col("_reach") - F.col("_excess")).alias("_room"), "_id", "_component", "_reach", "_excess")).alias("_top"))
    sides = {"l_reach": "_reach", "r_reach": "_top._reach", "l_excess": "_excess", "r_excess": "_top._excess"}
    met = near.join(top, ["_centre", "_token"]).filter("_component <> _top._component").withColumns({k: F.col(v) for k, v in sides.items()}).filter(bound).select(*_pairs("_id", "_top._id")).distinct()
    found.add(few.unionAll(near_body).unionAll(met).distinct())
    found.add(_between(keep(_within_reach(found.named(prefixes), how), "reaching"), ["_centre", "_token"], bound))


def similar_components(docs: DataFrame, how: Similarity, id_column: str, text: str, keep) -> DataFrame:
    """Per input row: _id, _size (of its set) and _component, the smallest id that it reaches. keep(df, name) writes a
    table on the way."""
    marks = keep(signatures(docs, how, id_column, text), "signatures")
    classes = marks.filter("_class is not null").groupBy("_class").agg(F.min("_id").alias("_least"))
    own = marks.select("_id", "_class", "_size")
    # the smallest id of a class carries its registers on; the others only its name
    heads = keep(marks.join(classes.select(F.col("_least").alias("_id")).distinct(), "_id", "left_semi").filter("_class is not null").select("_id", "_registers"), "heads")
    spread, key = _bands(heads, how), ["_band", "_key"]
    groups = spread.groupBy(*key).agg(F.count("*").alias("_n")).filter("_n > 1")
    members = keep(spread.join(groups, key), "members")
    weights = members.groupBy("_id").agg(F.sum("_n").alias("_weight"))
    members = keep(members.drop("_n").join(weights, "_id"), "members")

    found = _Links(heads, lambda wanted: _sets(docs, wanted, how, id_column, text), how, keep)
    found.add(_centres(members))
    named = found.named(members)
    left = keep(named.join(_apart(named, key), key), "apart")
    few = _between(left.filter(F.col("_m") <= how.few).select(*key, "_id", "_component"), key)
    # large groups whose centres are in one part go by one centre, the heaviest of that part
    heaviest = named.groupBy("_component").agg(F.max(F.struct("_weight", "_id")).alias("_h")).select(F.col("_component").alias("_part"), F.col("_h._id").alias("_centre"))
    large = left.filter(F.col("_m") > how.few).select("_id", F.col("_top._component").alias("_part")).distinct()
    many = keep(large.join(heaviest, "_part").select("_centre", "_id"), "many")
    if many.isEmpty():
        found.add(few)
    else:
        _add_large(found, few, many)
    reached = classes.join(found.parts.withColumnRenamed("_id", "_least"), "_least", "left").select("_class", F.coalesce("_component", "_least").alias("_component"))
    return own.join(reached, "_class", "left").select("_id", "_size", F.coalesce("_component", "_id").alias("_component"))


def near_duplicates(docs: DataFrame, how: Similarity = Similarity(), id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    component_id is the smallest id that a row reaches by links, its own included; kept says that it is its own. A null
    or empty text has no shingles and links with nothing. Rows that repeat an id are one document whose texts' links are
    pooled. Null ids link with nothing. An empty table gives no rows; other columns are not read. Ids are whole numbers, as
    the smallest names a component: others raise ValueError. A text of any length is read whole.
    """
    if docs.schema[id_column].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{id_column} holds no whole numbers")
    rows = docs.filter(F.col(id_column).isNotNull())
    none = signatures(docs.filter(F.col(id_column).isNull()), how, id_column, text)
    none = none.select(F.col("_id").alias(id_column), F.col("_size").alias("n_shingles"), F.col("_id").alias("component_id"), F.lit(True).alias("kept"))
    with Scratch(docs.sparkSession) as scratch:
        found = similar_components(rows, how, id_column, text, scratch.keep).select(F.col("_id").alias(id_column), F.col("_size").alias("n_shingles"), F.col("_component").alias("component_id"), (F.col("_id") == F.col("_component")).alias("kept"))
        return keep(found.unionAll(none), "near_duplicates")
