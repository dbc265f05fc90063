"""Quality of documents: a classifier's evidence combined with site posteriors, shrunk by hierarchical empirical Bayes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantlytics.llm.common import fold, pick, read, stored
from plantlytics.llm.kernels import NOT_BLANK, blocks, row_of, words
from plantlytics.llm.linear import sample_labels
from plantlytics.llm.textmap import map_text

#: Most that a site may add to or take from a document's log odds, bounds of a posterior, and the score that keeps.
SITE_LIMIT, EDGE, KEEP = 1.0, 1e-4, 0.5
MEASURES = 8

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in "#*$%&<>"]] = True


def measures(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Form of each text: words, word length, shares of signs, capitals, ! and |, of distinct words and of immediate repeats."""
    h, begin, end, ptr = words(raw, off, NOT_BLANK)
    row, n = row_of(ptr), np.diff(ptr)
    some = np.maximum(n, 1)
    texts = len(n)
    letters = np.bincount(row, (end - begin).astype(float), texts)
    def share(of: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(of)))
        return total[off[1:]] - total[off[:-1]]

    pairs = np.unique(np.stack((row.astype(np.uint64), h), 1), axis=0)[:, 0].astype(np.int64) if len(h) else row
    again = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    return np.stack((
        np.log1p(n), np.log1p(letters / some), np.log1p(share(_SIGN[raw]) / some), share(_UPPER[raw]) / np.maximum(letters, 1),
        np.log1p(share(raw == 33) / some), np.log1p(share(raw == 124) / some),
        np.bincount(pairs, minlength=texts) / some, np.bincount(row[1:][again], minlength=texts) / some), 1)


def with_measures(docs: DataFrame, keep: list[str]) -> DataFrame:
    def make():
        def work(text: pa.Array) -> list[pa.Array]:
            rows = [x for _, _, raw, off in blocks(text) for x in measures(raw, off)]
            return [pa.array(rows, pa.list_(pa.float64()))]

        return work

    return map_text(docs, make, keep=keep, x="array<double>")


def fit_classifier(rows: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Logistic weights from at most ``max_rows`` labelled rows outside fold 0 of 5: means, scales, weights, bias.

    Without labels, or with one class alone, the weights are 0 and the bias is that class's.
    """
    sample = sample_labels(pick(labels, doc_id="bigint", quality="int"), "quality", max_rows)
    table = rows.join(F.broadcast(sample), rows["doc_id"] == F.col("id")).select("x", "y").collect()
    x, y = np.array([r.x for r in table], float).reshape(-1, MEASURES), np.array([r.y for r in table], float)
    if not len(y) or y.min() == y.max():
        return np.zeros(MEASURES), np.ones(MEASURES), np.zeros(MEASURES), 0.0 if not len(y) else 8.0 * (2 * y[0] - 1)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.concatenate(((x - mean) / scale, np.ones((len(x), 1))), 1)
    w, ridge = np.zeros(MEASURES + 1), np.eye(MEASURES + 1)
    ridge[-1, -1] = 1e-6
    for _ in range(25):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return mean, scale, w[:-1], float(w[-1])


def _bounded(p: Column) -> Column:
    return F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), p))


def _log_odds(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(sites: DataFrame, prior: Column) -> Column:
    """Pseudo-count of a beta prior by moments: how much less sites differ from ``prior`` than single documents would."""
    n, gap = F.col("n"), F.col("s") / F.col("n") - prior
    noise = prior * (1 - prior)
    between = F.sum(n * gap * gap) - F.sum(noise)
    return F.when(between <= 0, F.lit(1e6)).otherwise(F.greatest(F.lit(1.0), F.sum(n * noise) / between - 1))


def combine(rows: DataFrame) -> DataFrame:
    """``rows`` (``p, host, path`` and others) with ``site`` and ``score``.

    A host's posterior is (s + k m) / (n + k) with the global mean m; a path's is (s + k' h) / (n + k') with its host's
    posterior h; s and n leave the document itself out, so that no document speaks for itself through its site. k and k'
    come from moments over all hosts and paths: where sites hardly differ they are large, and sparse sites stay near the
    level above. The score's log odds are the classifier's plus those of the site beyond the global mean, at most
    SITE_LIMIT. Sums are grouped by site with partial sums, so a site may hold any share of the rows.
    """
    sites = stored(rows.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum("p").alias("s")), "sites")
    hosts = sites.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = min(1 - EDGE, max(EDGE, (total.s or 0.0) / total.n)) if total.n else 0.5
    m = F.lit(mean)
    k = float(hosts.agg(_strength(hosts, m).alias("k")).first().k or 1.0)
    hosts = hosts.select("host", F.col("n").alias("hn"), F.col("s").alias("hs"))
    paths = sites.join(hosts, "host")
    inner = _bounded((F.col("hs") + k * mean) / (F.col("hn") + k))
    k2 = float(paths.agg(_strength(paths, inner).alias("k")).first().k or 1.0)
    out = rows.join(paths, ["host", "path"])
    host = (F.col("hs") - F.col("p") + F.lit(k * mean)) / (F.col("hn") - 1 + F.lit(k))
    out = out.withColumn("site", _bounded((F.col("s") - F.col("p") + F.lit(k2) * host) / (F.col("n") - 1 + F.lit(k2))))
    extra = F.greatest(F.lit(-SITE_LIMIT), F.least(F.lit(SITE_LIMIT), _log_odds(F.col("site")) - _log_odds(m)))
    return out.withColumn("score", 1 / (1 + F.exp(-(_log_odds(_bounded(F.col("p"))) + extra)))).drop("n", "s", "hn", "hs")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, host, path, classifier, site, score, kept`` for each row of ``docs`` (``doc_id, text, source, lang``).

    A document's host is its source and its path the language section within it. NULL source or language
    is the value ''. NULL and empty texts are measured as having no words. Repeated rows count each. An empty table gives an
    empty result.
    """
    base = pick(docs, doc_id="bigint", text="string", source="string", lang="string")
    rows = stored(with_measures(base, ["doc_id", "source", "lang"]), "measures")
    mean, scale, w, bias = fit_classifier(rows.select("doc_id", "x"), labels)
    z = F.lit(bias)
    for j in range(MEASURES):
        z = z + (F.element_at("x", j + 1) - float(mean[j])) / float(scale[j]) * float(w[j])
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    host = F.coalesce("source", F.lit(""))
    told = rows.select("doc_id", host.alias("host"), F.concat(host, F.lit("/"), F.coalesce("lang", F.lit(""))).alias("path"), p.alias("p"))
    found = combine(told)
    return found.select("doc_id", "host", "path", F.col("p").alias("classifier"), "site", "score", (F.col("score") >= KEEP).alias("kept"))


def op9_bayes_quality_classifier(spark, sf_dir: str) -> DataFrame:
    found = quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.withColumn("held_out", fold(F.col("doc_id"), 5) == 0)
