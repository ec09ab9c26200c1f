"""Quality classifier with hierarchical empirical Bayes.

A logistic regression on text measures and hashed words gives each document's own evidence. Documents of a site share more than their
texts show, so the evidence is summed by host and by path under it, and each site gets a posterior mean: a host's is
drawn towards the mean of all documents, a path's towards its host's. How strongly depends on how much sites of that
level differ, as estimated from all of them (method of moments), so a site of few documents stays near its parent. A
document's log odds are its own plus what its path's posterior adds to the common mean's.

All documents enter the site sums, which are grouped with map-side sums, so a host with a third of all rows is one row
per task. Measures and scores are column expressions.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrecon.llm.storage import keep
from docrecon.llm.text import blank_words

#: Measures weigh more than single words in the penalty of the regression, which takes both as they are.
SCALE = 10
MEASURES = ("marks", "capitals", "digits", "stops", "distinct", "word_length", "words")


def measures(df: DataFrame, text: str, words: str) -> DataFrame:
    """Adds the columns MEASURES (prefixed with _m_, times SCALE) of a text and its array of words; a null text is as an
    empty one."""
    content = F.coalesce(F.col(text), F.lit(""))

    def share(kept: str) -> Column:
        return F.char_length(F.regexp_replace(content, kept, "")) / F.greatest(F.char_length(content), F.lit(1))

    n = F.greatest(F.size(words), F.lit(1))
    found = {
        "_m_marks": share(r"[^#*$%&|<>!?{}=_~^+@\\]+"),
        "_m_capitals": share(r"[^\p{Lu}]+"),
        "_m_digits": share(r"[^0-9]+"),
        "_m_stops": share(r"[^.,;:]+"),
        "_m_distinct": F.size(F.array_distinct(words)) / n,
        "_m_word_length": F.char_length(content) / n / 10,
        "_m_words": F.log1p(F.size(words)) / 10,
    }
    return df.withColumns({k: SCALE * v for k, v in found.items()})


def evidence_vectors(df: DataFrame, text: str, tokens: int) -> DataFrame:
    """Adds _x: the measures, and the text's lower-case words hashed into `tokens` places, as a vector of length one."""
    from pyspark.ml.feature import HashingTF, Normalizer, VectorAssembler

    named = [f"_m_{m}" for m in MEASURES]
    out = measures(df.withColumn("_tokens", blank_words(F.lower(F.col(text)))), text, "_tokens")
    out = HashingTF(inputCol="_tokens", outputCol="_counts", numFeatures=tokens).transform(out)
    out = Normalizer(inputCol="_counts", outputCol="_unit").transform(out)
    return VectorAssembler(inputCols=[*named, "_unit"], outputCol="_x").transform(out).drop(*named, "_tokens", "_counts", "_unit")


@dataclass(frozen=True)
class QualityModel:
    """fitted: the logistic regression over evidence_vectors, or None where nothing is known. tokens: places of words."""

    fitted: object
    tokens: int


def fit_quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality", max_fit_rows: int = 20_000, tokens: int = 4096) -> QualityModel:
    """Fits the evidence on labelled documents, at most about max_fit_rows of them, drawn by a hash of the id.

    Rows weigh such that both labels count the same. Without rows of both labels the model knows nothing.
    """
    from pyspark.ml.classification import LogisticRegression

    known = labels.filter(F.col(label).isin(0, 1)).select(F.col(id_column).alias("_id"), F.col(label).cast("double").alias("_label"))
    share = min(1.0, max_fit_rows / max(1, known.count()))
    drawn = known.filter(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(share * 1_000_000)).groupBy("_id").agg(F.max("_label").alias("_label"))
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(drawn), "_id")
    rows = evidence_vectors(rows, "_text", tokens).select("_x", "_label").cache()
    counts = {r["_label"]: r["n"] for r in rows.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    try:
        if len(counts) < 2:
            return QualityModel(None, tokens)
        total = sum(counts.values())
        weight = F.when(F.col("_label") == 1, total / 2 / counts[1.0]).otherwise(total / 2 / counts[0.0])
        fitted = LogisticRegression(featuresCol="_x", labelCol="_label", weightCol="_w", predictionCol="_p", probabilityCol="_q", rawPredictionCol="_raw", maxIter=50, regParam=0.001, standardization=False).fit(rows.withColumn("_w", weight))
        return QualityModel(fitted, tokens)
    finally:
        rows.unpersist()


def with_evidence(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """docs with _evidence, the log odds of their own text (-20 to 20), 0 where the model knows nothing."""
    from pyspark.ml.functions import vector_to_array

    if model.fitted is None:
        return docs.withColumn("_evidence", F.lit(0.0))
    scored = model.fitted.transform(evidence_vectors(docs, text, model.tokens))
    odds = vector_to_array("_raw")[1]
    return scored.withColumn("_evidence", F.greatest(F.lit(-20.0), F.least(F.lit(20.0), odds))).drop("_x", "_raw", "_p", "_q")


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _spread(sites: DataFrame, n: str, total: str, parent: Column) -> float:
    """How many documents the parent's mean counts as, from how much more sites differ than documents of a site do."""
    mean = F.col(total) / F.col(n)
    row = sites.agg(F.count("*").alias("k"), F.sum(n).alias("n"), F.sum(F.col(n) * (mean - parent) ** 2).alias("between"), F.sum(F.col(n) * parent * (1 - parent)).alias("var")).head()
    if not row["n"] or row["k"] < 2:
        return 10.0
    variance = row["var"] / row["n"]
    excess = (row["between"] - row["k"] * variance) / row["n"]
    return min(1e4, max(1.0, variance / excess - 1)) if excess > 1e-9 else 1e4


def site_posteriors(evidence: DataFrame, host: Column, path: Column) -> tuple[DataFrame, float]:
    """Per host and path: _host, _path, host_posterior, path_posterior; and the mean of all documents. Null names are a
    site of their own."""
    p = 1 / (1 + F.exp(-F.col("_evidence")))
    paths = keep(evidence.select(host.alias("_host"), path.alias("_path"), p.alias("_p")).groupBy("_host", "_path").agg(F.count("*").alias("_n"), F.sum("_p").alias("_total")), "paths")
    hosts = paths.groupBy("_host").agg(F.sum("_n").alias("_hn"), F.sum("_total").alias("_htotal"))
    row = hosts.agg(F.sum("_htotal").alias("p"), F.sum("_hn").alias("n")).head()
    mean = min(0.999, max(0.001, row["p"] / row["n"])) if row["n"] else 0.5
    weight = _spread(hosts, "_hn", "_htotal", F.lit(mean))
    hosts = hosts.withColumn("host_posterior", (F.col("_htotal") + weight * mean) / (F.col("_hn") + weight)).withColumnRenamed("_host", "_of")
    joined = paths.join(hosts, F.expr("_host <=> _of")).drop("_of")
    weight = _spread(joined, "_n", "_total", F.col("host_posterior"))
    posterior = (F.col("_total") + weight * F.col("host_posterior")) / (F.col("_n") + weight)
    return joined.select("_host", "_path", "host_posterior", posterior.alias("path_posterior")), mean


def combine_evidence(evidence: DataFrame, sites: DataFrame, mean: float, host: Column, path: Column, threshold: float = 0.5, max_broadcast_sites: int = 500_000) -> DataFrame:
    """evidence with host_posterior, path_posterior, score (0 to 1) and kept (score >= threshold).

    Sites are broadcast if they are no more than max_broadcast_sites; else the join is an ordinary one, whose hot sites
    Spark splits.
    """
    few = sites.limit(max_broadcast_sites + 1).count() <= max_broadcast_sites
    named = evidence.withColumns({"_h": host, "_p": path})
    joined = named.join(F.broadcast(sites) if few else sites, F.expr("_h <=> _host and _p <=> _path")).drop("_h", "_p", "_host", "_path")
    edge = lambda c: F.greatest(F.lit(0.001), F.least(F.lit(0.999), F.col(c)))
    odds = F.col("_evidence") + _logit(edge("path_posterior")) - _logit(F.lit(mean))
    return joined.withColumn("score", 1 / (1 + F.exp(-odds))).withColumn("kept", F.col("score") >= threshold)


def classify_quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", max_fit_rows: int = 20_000) -> DataFrame:
    """One row per input row: id, evidence (0 to 1), host_posterior, path_posterior, score, kept.

    A path is named by the host and the column `path`. Null texts are as empty ones, null hosts and paths are sites of
    their own. Repeated rows count in their sites as often as they come; an empty table gives no rows. Other columns are
    not read.
    """
    model = fit_quality(docs, labels, id_column, text, max_fit_rows=max_fit_rows)
    chosen = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("_text"), F.col(host).alias("_hostname"), F.col(path).alias("_pathname"))
    found = keep(with_evidence(chosen, model, "_text").drop("_text"), "evidence")
    names = F.col("_hostname"), F.col("_pathname")
    sites, mean = site_posteriors(found, *names)
    return combine_evidence(found, sites, mean, *names).select(F.col("_id").alias(id_column), (1 / (1 + F.exp(-F.col("_evidence")))).alias("evidence"), "host_posterior", "path_posterior", "score", "kept")


def good_documents(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", max_fit_rows: int = 20_000) -> DataFrame:
    """The rows of docs that the classifier keeps, with the columns of docs, whatever their names.

    Cases as for classify_quality; repeated rows stay or go alike.
    """
    model = fit_quality(docs, labels, id_column, text, max_fit_rows=max_fit_rows)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("_text"), F.col(host).alias("_hostname"), F.col(path).alias("_pathname"))
    names = F.col("_hostname"), F.col("_pathname")
    sites, mean = site_posteriors(with_evidence(packed.drop("row"), model, "_text").drop("_text"), *names)
    # the evidence is made once more beside the whole rows, as the texts are not written a second time
    found = with_evidence(packed, model, "_text").drop("_text")
    return combine_evidence(found, sites, mean, *names).filter("kept").select("row.*")
