"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions alone.

An item is cut into windows of item words, and a window is the set of its one-word shingles at fixed places. For exact
containment one shingle of each window is a necessary prefix, and the rarest over all documents is the cheapest. The
join meets document words with those rarest words only. Bounds on place and length follow, and a candidate counts if
the document's own words at that place are the window's.

Documents are never shuffled: their words meet a broadcast table of windows. The windows come from the benchmark, whose
size doesn't follow the corpus; more than max_broadcast_windows are dealt into blocks of that many at most, each of
which meets all documents, so the bound drops nothing.
"""

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrecon.llm.storage import Scratch, keep
from docrecon.llm.text import plain_words, row_key, with_row


def item_windows(items: DataFrame, id_column: str = "item_id", text: str = "text", window: int = 10) -> DataFrame:
    """Per distinct window and item: _item, _size and _window (words joined by one space).

    An item with fewer words is one window, one without words has none. Repeated items count once.
    """
    cut = f"if(size(_w) <= {window}, array(array_join(_w, ' ')), transform(sequence(1, size(_w) - {window - 1}), i -> array_join(slice(_w, i, {window}), ' ')))"
    words = items.select(F.col(id_column).cast("string").alias("_item"), plain_words(F.col(text)).alias("_w")).filter(F.size("_w") > 0)
    return words.select("_item", F.least(F.size("_w"), F.lit(window)).alias("_size"), F.explode(F.expr(cut)).alias("_window")).distinct()


def window_hits(docs: DataFrame, windows: DataFrame, max_broadcast_windows: int = 1_000_000) -> DataFrame:
    """Places of windows(_window, _size) in docs(_id, _hash, _joined): _id, _hash, _start (from 0), _size, _window."""
    distinct = windows.select("_window", "_size").distinct()
    blocks = max(1, ceil(distinct.count() / max_broadcast_windows))
    shingles = distinct.select("_window", "_size", F.posexplode(F.split("_window", " ")).alias("_place", "_word"))
    spread = docs.select("*", F.split("_joined", " ").alias("_words"))
    found = None
    for block in range(blocks):
        own = shingles.filter(F.pmod(F.xxhash64("_window"), F.lit(blocks)) == block)
        # rarity of the items' words over all documents; the words of a block of windows are as bounded as the block
        counts = spread.select(F.explode("_words").alias("_word")).join(F.broadcast(own.select("_word").distinct()), "_word", "left_semi").groupBy("_word").agg(F.count("*").alias("_n"))
        ranked = own.join(F.broadcast(counts), "_word", "left").groupBy("_window", "_size").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_word", "_place")).alias("_rarest"))
        prefix = ranked.filter("_rarest.n > 0").select("_window", "_size", F.col("_rarest._word").alias("_word"), F.col("_rarest._place").alias("_place"))
        placed = spread.select("_id", "_hash", "_words", F.posexplode("_words").alias("_pos", "_word"))
        start = F.col("_pos") - F.col("_place")
        bounds = (start >= 0) & (start + F.col("_size") <= F.size("_words"))
        same = F.array_join(F.slice("_words", F.when(start >= 0, start + 1).otherwise(1), F.col("_size")), " ") == F.col("_window")
        part = placed.join(F.broadcast(prefix), "_word").filter(bounds & same).select("_id", "_hash", start.alias("_start"), "_size", "_window")
        found = part if found is None else found.unionAll(part)
    return found


def decontaminate(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, max_broadcast_windows: int = 1_000_000) -> DataFrame:
    """One row per input document: id, n_words, n_hit, n_items, items_sha256, contaminated.

    n_hit counts the document words inside any place of an item window, n_items the items with such a window, and
    items_sha256 is of their ids, sorted as strings and comma-joined (of the empty string without any). Null or empty
    texts have no words on either side; texts of any length are read whole. Repeated items and repeated documents change nothing but the number of rows.
    Other columns are not read; empty tables give no rows or no hits.
    """
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.keep(docs.select(*row_key(id_column, text), plain_words(F.col(text)).alias("_w")).select("_id", "_hash", F.size("_w").cast("long").alias("n_words"), F.array_join("_w", " ").alias("_joined")), "decontamination")
        windows = item_windows(items, item_id, item_text, window)
        hits = scratch.keep(window_hits(rows.select("_id", "_hash", "_joined").filter("_joined <> ''"), windows, max_broadcast_windows), "hits")
        covered = hits.groupBy("_id", "_hash").agg(F.collect_set(F.struct("_start", "_size")).alias("_spans")).select(
            "_id", "_hash", F.expr("cast(size(array_distinct(flatten(transform(_spans, s -> sequence(s._start, s._start + s._size - 1))))) as bigint)").alias("n_hit"))
        owners = hits.select("_id", "_hash", "_window").distinct().join(windows.select("_window", "_item"), "_window").groupBy("_id", "_hash").agg(F.array_sort(F.collect_set("_item")).alias("_items"))
        out = with_row(with_row(rows.select("_id", "_hash", "n_words"), covered), owners)
        out = out.select(
            F.col("_id").alias(id_column), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(F.size("_items"), F.lit(0)).cast("long").alias("n_items"),
            F.sha2(F.coalesce(F.array_join("_items", ","), F.lit("")), 256).alias("items_sha256"),
            F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
        )
        return keep(out, "decontaminated")
