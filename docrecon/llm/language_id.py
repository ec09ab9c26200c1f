"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point. The vectors of a three-letter run are turned by
their place and multiplied (bound) into one; those of a text are added up (bundled). A language's prototype is the
bundle of all its training texts, and a text takes the language whose prototype has the largest cosine with it.

Bundles are sums, so every task adds up its own texts and Spark adds up the tasks' sums: what moves is one vector per
task and language. The model is languages x dims numbers, whatever the corpus.
"""

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrecon.llm.storage import Scratch, keep, map_batches
from docrecon.shipping import ship

UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    """By code point: the code point of the letter in lower case, 0 for anything else."""
    return np.fromiter((ord(chr(c).lower()[0]) if chr(c).isalpha() else 0 for c in range(sys.maxunicode + 1)), np.int32, sys.maxunicode + 1)


def letter_runs(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of three letters (each 3 x 21 bits, 0 between words) and how often each stands in a text."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
    found = np.zeros(len(points) + 2, np.int64)
    found[1:-1] = _letters()[points]
    found = found[np.concatenate([[True], (found[1:] != 0) | (found[:-1] != 0)])]
    if len(found) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.unique(found[:-2] << 42 | found[1:-1] << 21 | found[2:], return_counts=True)


class Vectors:
    """Vectors of letter runs, a byte a number, made when first met; forgotten at max_runs, so that a worker's memory
    stays bounded: max_runs x dims bytes, and a block of BLOCK vectors as wider numbers."""

    BLOCK = 1024

    def __init__(self, dims: int, seed: int, max_runs: int = 16_384):
        self.dims, self.seed, self.max_runs = dims, seed, max_runs
        self.letters: dict[int, np.ndarray] = {}
        self.reset()

    def reset(self) -> None:
        self.known, self.order, self.rows, self.used = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((self.max_runs, self.dims), np.int8), 0

    def letter(self, point: int) -> np.ndarray:
        if point not in self.letters:
            self.letters[point] = np.random.default_rng([self.seed, point]).integers(0, 2, self.dims).astype(np.int8) * np.int8(2) - np.int8(1)
        return self.letters[point]

    def bound(self, run: int) -> np.ndarray:
        a, b, c = run >> 42, run >> 21 & 0x1FFFFF, run & 0x1FFFFF
        return np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)

    def bundle(self, runs: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of the vectors of sorted distinct runs, each as often as counted."""
        total = np.zeros(self.dims, np.float64)
        step = min(self.BLOCK, self.max_runs)
        for i in range(0, len(runs), step):
            total += counts[i : i + step].astype(np.float32) @ self.rows_of(runs[i : i + step]).astype(np.float32)
        return total

    def rows_of(self, runs: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, runs)
        here = np.zeros(len(runs), bool)
        if len(self.known):
            here = self.known[np.minimum(at, len(self.known) - 1)] == runs
        if not here.all():
            if self.used + len(runs) > self.max_runs:
                self.reset()
                here = np.zeros(len(runs), bool)
            new = runs[~here]
            for k, run in enumerate(new.tolist()):
                self.rows[self.used + k] = self.bound(run)
            known, order = np.concatenate([self.known, new]), np.concatenate([self.order, np.arange(self.used, self.used + len(new))])
            self.used += len(new)
            by = np.argsort(known, kind="stable")
            self.known, self.order = known[by], order[by]
            at = np.searchsorted(self.known, runs)
        return self.rows[self.order[at]]


def language_prototypes(df: DataFrame, text: str = "text", lang: str = "lang", dims: int = 1024, seed: int = 7, max_languages: int = 2000, max_held: int = 500_000) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes, from all rows with a text and a language. A task adds up the letter runs
    of its texts when it holds max_held of them.

    Raises ValueError beyond max_languages distinct values, as such a column names no languages.
    """

    def run(batches):
        from collections import defaultdict

        waiting: dict[str, list] = defaultdict(list)
        vectors, sums, held = Vectors(dims, seed), defaultdict(lambda: np.zeros(dims)), 0

        def fold():
            for name, parts in waiting.items():
                runs, at = np.unique(np.concatenate([r for r, _ in parts]), return_inverse=True)
                sums[name] += vectors.bundle(runs, np.bincount(at, np.concatenate([n for _, n in parts])))
            waiting.clear()

        for batch in batches:
            for name, content in zip(batch.column("_lang"), batch.column("_text"), strict=True):
                found = letter_runs(content.as_py())
                waiting[name.as_py()].append(found)
                held += len(found[0])
                if held > max_held:
                    fold()
                    held = 0
        fold()
        yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["_lang", "_sum"])

    known = df.select(F.col(lang).alias("_lang"), F.col(text).alias("_text")).filter("_lang is not null and _text is not null")
    sums = map_batches(known, run, "_lang string, _sum array<double>").select("_lang", F.posexplode("_sum").alias("_dim", "_value")).groupBy("_lang", "_dim").agg(F.sum("_value").alias("_value"))
    rows = sums.groupBy("_lang").agg(F.array_sort(F.collect_list(F.struct("_dim", "_value"))).alias("_sum")).orderBy("_lang").limit(max_languages + 1).collect()
    if len(rows) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    rows = [r for r in rows if any(x["_value"] for x in r["_sum"])]
    return [r["_lang"] for r in rows], np.array([[x["_value"] for x in r["_sum"]] for r in rows]).reshape(len(rows), dims)


def language_of(text: Column, languages: list[str], prototypes: np.ndarray, seed: int = 7) -> Column:
    """A struct of lang_pred, score (cosine with its prototype, at least 0) and runs (distinct letter runs of the text).

    A text that is null or has no letter is `und` with score 0, and so is every text if there are no languages. Equal
    cosines go to the language that comes first. Only the text goes to the Python workers, in batches.
    """
    dims = prototypes.shape[1] if len(languages) else 1024

    @F.arrow_udf("lang_pred string, score double, runs int")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vectors = Vectors(dims, seed)
        units = prototypes / np.linalg.norm(prototypes, axis=1, keepdims=True) if languages else None
        for texts in batches:
            names, scores, sizes = [], [], []
            for content in texts:
                runs, counts = letter_runs(content.as_py())
                sizes.append(len(runs))
                if not len(runs) or not languages:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                own = vectors.bundle(runs, counts)
                cosines = np.round(units @ own / max(np.linalg.norm(own), 1e-9), 9)
                best = int(cosines.argmax())
                names.append(languages[best])
                scores.append(min(1.0, max(0.0, float(cosines[best]))))
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sizes, pa.int32())], ["lang_pred", "score", "runs"])

    return run(text)


def predict_language(df: DataFrame, languages: list[str], prototypes: np.ndarray, text: str = "text", seed: int = 7) -> DataFrame:
    """df with lang_pred and score as language_of gives them. Columns of df of these names are replaced; repeated rows
    and an empty table need no care."""
    ship(df.sparkSession)
    found = df.withColumn("_found", language_of(F.col(text), languages, prototypes, seed))
    return found.withColumns({"lang_pred": F.col("_found.lang_pred"), "score": F.col("_found.score")}).drop("_found")


def language_bounds(found: DataFrame, lang: str = "lang", low: float = 0.05, part: float = 0.5, least_texts: int = 50, classes: int = 32) -> DataFrame:
    """Of found, which has lang_pred, score, runs (distinct letter runs) and the labelled language: per lang_pred and
    _size (the power of two of the runs) the bound under which a score says that a text is not in lang_pred.

    The bound is a part of the low quantile of the scores of all texts that are labelled and predicted as the language,
    by size, as texts with few different runs have lower cosines. So it stays below a language's own texts, and
    mislabelled ones that are fewer than `low` of a size do not move it. With fewer than least_texts of a language and
    size, those of all languages count; with fewer of these, a size takes the bound of the next smaller one, or 0
    without one. As many rows as languages x classes.
    """
    own = found.withColumn("_size", size_class("runs")).filter(F.col(lang) == F.col("lang_pred")).select(F.explode(F.array("lang_pred", F.lit(None))).alias("name"), "_size", "score")
    lows = own.groupBy("name", "_size").agg(F.percentile_approx("score", low).alias("low"), F.count("*").alias("n")).collect()
    known, rows = {(r["name"], r["_size"]): part * r["low"] for r in lows if r["n"] >= least_texts}, []
    for name in {r["name"] for r in lows} - {None}:
        bound = 0.0
        for size in range(classes):
            bound = known.get((name, size), known.get((None, size), bound))
            rows.append((name, size, bound))
    return found.sparkSession.createDataFrame(rows, "lang_pred string, _size int, bound double")


def size_class(runs: str) -> Column:
    return F.floor(F.log2(F.greatest(F.col(runs), F.lit(1)))).cast("int")


def in_known_language(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of docs in one of the languages that docs name, with the columns of docs, whatever their names.

    Texts without a letter, null or empty go, and those further from their nearest language than its own texts of as
    many letter runs go (language_bounds). Repeated rows stay or go alike. Without a named language nothing stays. Texts
    reach the workers in small batches and once, beside their rows; what they give is written here with the rows.
    """
    ship(docs.sparkSession)
    with Scratch(docs.sparkSession):
        languages, prototypes = language_prototypes(docs, text, lang)
        guess = language_of(F.col(text), languages, prototypes)
        packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(lang).alias("_lang"), guess.alias("_found"))
        scored = keep(packed.select("row", "_lang", "_found.*"), "language")
    bounds = F.broadcast(language_bounds(scored, "_lang"))
    bounded = scored.withColumn("_size", size_class("runs")).join(bounds, ["lang_pred", "_size"], "left")
    return bounded.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= F.coalesce("bound", F.lit(0.0)))).select("row.*")


def fold_of(id_column: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; 0 for a null id, as of the empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % folds


def identify_languages(docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang", dims: int = 1024, seed: int = 7) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score. Learns from the documents of which held_out is false.

    Null and empty texts and those without a letter are `und` with score 0. A text of any length is read whole. Repeated
    rows give repeated results, an empty table none; other columns are not read, whatever their names.
    """
    held = fold_of(F.col(id_column), 4) == 2
    languages, prototypes = language_prototypes(docs.filter(~held), text, lang, dims, seed)
    chosen = docs.select(F.col(id_column).alias("_id"), held.alias("held_out"), F.col(text).alias("_content"))
    return predict_language(chosen, languages, prototypes, "_content", seed).select(F.col("_id").alias(id_column), "held_out", "lang_pred", "score")
