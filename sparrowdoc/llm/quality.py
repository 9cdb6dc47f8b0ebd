"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A document's evidence is a logistic model over text statistics and a lexicon of words and word beginnings that mark
toxic texts, both learned from at most ``MAX_LABELLED`` labelled rows (taken by a hash of the id). Grouped sums give each
host's and path's share of bad documents; a host's posterior shrinks to the global share, a path's to its host's, by
pseudo-counts. A document's posterior is its evidence, moved by the log-odds that its path has without it against the
global ones. Tables with a URL give both by ``sites``; the documents table has none, so its source and language stand in.

Defined cases: null and empty texts are documents without words and get the evidence of such; null hosts and paths are
a site of their own; without labels of both kinds every document stays; labels that repeat count by their worst.
"""

from __future__ import annotations

import re
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, materialize

#: Bound on the labelled rows that the classifier is fitted on.
MAX_LABELLED = 8000
#: Pseudo-counts that tie a host to the global share and a path to its host.
HOST_STRENGTH, PATH_STRENGTH = 200.0, 100.0
REJECT = 0.5
#: A lexicon entry stands in so many toxic texts at least, and is so many times as common there.
LEAST_TEXTS, LEAST_LIFT = 4, 20.0
_STRIP = ".,!?;:|%#*$&\"'()[]{}<>-"
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "|%#*$&!@^~=+<>{}[]\\_"]] = True


def marks(text: str | None) -> set[str]:
    """The text's words and their beginnings of 4 to 6 letters (with a star)."""
    out: set[str] = set()
    for w in set(text.split()) if text else ():
        w = w.strip(_STRIP).lower()
        out.add(w)
        out.update(w[:k] + "*" for k in (4, 5, 6) if len(w) >= k)
    out.discard("")
    return out


def features(text: str | None, lexicon: dict[str, float]) -> list[float]:
    words = text.split() if text else []
    n = max(len(words), 1)
    counts = Counter(words)
    most = max(counts.values(), default=0)
    repeats = sum(map(eq, words, words[1:]))
    data = np.frombuffer((text or "").encode(), np.uint8)
    histogram = np.bincount(data, minlength=256)
    size = max(len(data), 1)
    upper, lower = histogram[65:91].sum(), histogram[97:123].sum()
    found: dict[str, float] = {}
    if lexicon:
        for w in counts:
            w = w.strip(_STRIP).lower()
            best = max((lexicon.get(k, 0.0) for k in (w, w[:4] + "*", w[:5] + "*", w[:6] + "*")), default=0.0)
            if best:
                found[w] = best
    weights = sorted(found.values(), reverse=True)
    return [
        np.log1p(len(words)), len(counts) / n, most / n, repeats / n, upper / max(upper + lower, 1), histogram[_SYMBOLS].sum() / size,
        histogram[48:58].sum() / size, sum(map(len, counts)) / max(len(counts), 1) / 10, min(len(weights), 8), sum(weights[:4]), sum(found[w.strip(_STRIP).lower()] > 0 for w in words if w.strip(_STRIP).lower() in found) / n if found else 0.0,
    ]


def lexicon(sample: DataFrame, text_col: str, label: str) -> dict[str, float]:
    """Marks of the texts with ``label`` 1, with the logarithm of their lift."""
    def run(batches):
        every: Counter = Counter()
        bad: Counter = Counter()
        for b in batches:
            for text, y in zip(b.column(text_col).to_pylist(), b.column(label).to_pylist(), strict=True):
                own = marks(text)
                every.update(own)
                if y:
                    bad.update(own)
        keys = list(every)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([every[k] for k in keys], pa.int64()), pa.array([bad[k] for k in keys], pa.int64())], names=["mark", "every", "bad"])

    total = sample.agg(F.count("*").alias("n"), F.sum(label).alias("bad")).first()
    n, bad = total["n"], total["bad"] or 0
    if not bad or bad == n:
        return {}
    counts = sample.select(text_col, label).mapInArrow(run, "mark string, every long, bad long").groupBy("mark").agg(F.sum("every").alias("every"), F.sum("bad").alias("bad"))
    lift = ((F.col("bad") + 0.5) / (bad + 1)) / ((F.col("every") - F.col("bad") + 0.5) / (n - bad + 1))
    rows = counts.where(F.col("bad") >= max(LEAST_TEXTS, 0.02 * bad)).select("mark", lift.alias("lift")).where(F.col("lift") >= LEAST_LIFT).collect()
    return {r["mark"]: float(np.log(r["lift"])) for r in rows}


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights with the intercept last) of a logistic regression by Newton's method."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> dict | None:
    """The classifier, or None where the labels hold one kind only."""
    marked = labels.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max((F.coalesce(F.col("quality"), F.lit(1)) == 0).cast("int")).alias("_low"), F.max(F.coalesce("toxic", F.lit(0))).cast("int").alias("_toxic"))
    chosen = marked.orderBy(F.xxhash64(id_col), id_col).limit(max_labelled)
    # at most max_labelled rows: the bound that lets it be broadcast
    sample = materialize(docs.select(id_col, text_col).join(F.broadcast(chosen), id_col), "labelled")
    words = lexicon(sample.where("_low = 0"), text_col, "_toxic")
    scored = annotate(sample.drop(id_col), text_col, lambda: lambda texts: [pa.array([features(t, words) for t in texts], pa.list_(pa.float64()))], [T.StructField("x", T.ArrayType(T.DoubleType()))])
    rows = scored.select("x", F.greatest("_low", "_toxic").alias("y")).collect()
    y = np.array([r["y"] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return None
    order = np.lexsort(np.array([r["x"] for r in rows]).T)
    mean, scale, w = fit(np.array([r["x"] for r in rows])[order], y[order])
    return {"lexicon": words, "mean": mean, "scale": scale, "weights": w}


def evidence(docs: DataFrame, model: dict | None, *, text_col: str = "text", out: str = "p_doc") -> DataFrame:
    def factory():
        def kernel(texts):
            if model is None:
                return [pa.array([0.0] * len(texts), pa.float64())]
            x = np.array([features(t, model["lexicon"]) for t in texts])
            z = np.hstack([(x - model["mean"]) / model["scale"], np.ones((len(x), 1))])
            return [pa.array(1 / (1 + np.exp(-np.clip(z @ model["weights"], -30, 30))))]

        return kernel

    return annotate(docs, text_col, factory, [T.StructField(out, T.DoubleType())])


def posterior(scored: DataFrame, *, host: str, path: str, p: str = "p_doc") -> DataFrame:
    """``scored`` with host_rate, path_rate and p_bad; its rows are joined with one row for each path.

    A document's own evidence counts in neither rate, so that it moves its posterior once.
    """
    paths = materialize(scored.groupBy(F.col(host).alias("_host"), F.col(path).alias("_path")).agg(F.sum(p).alias("_s"), F.count("*").alias("_n")), "paths")
    total = paths.agg(F.sum("_s").alias("s"), F.sum("_n").alias("n")).first()
    g = min(max((total["s"] or 0.0) / total["n"], 1e-6), 1 - 1e-6) if total["n"] else 0.5
    hosts = paths.groupBy(F.col("_host").alias("_h")).agg(F.sum("_s").alias("_hs"), F.sum("_n").alias("_hn"))
    sites = paths.join(hosts, F.col("_host").eqNullSafe(F.col("_h"))).drop("_h")
    joined = scored.join(sites, F.col(host).eqNullSafe(F.col("_host")) & F.col(path).eqNullSafe(F.col("_path")))
    rate = lambda s, n, prior, strength: (F.greatest(F.col(s) - F.col(p), F.lit(0.0)) + prior * strength) / (F.col(n) - 1 + strength)
    joined = joined.withColumn("host_rate", rate("_hs", "_hn", F.lit(g), HOST_STRENGTH))
    joined = joined.withColumn("path_rate", rate("_s", "_n", F.col("host_rate"), PATH_STRENGTH)).drop("_host", "_path", "_s", "_n", "_hs", "_hn")
    odds = lambda c: F.log(c / (1 - c))
    inside = lambda c, e: F.greatest(F.lit(e), F.least(F.lit(1 - e), c))
    moved = odds(inside(F.col(p), 1e-9)) + odds(inside(F.col("path_rate"), 1e-6)) - float(np.log(g / (1 - g)))
    return joined.withColumn("p_bad", 1 / (1 + F.exp(-moved)))


def sites(url: Column) -> tuple[Column, Column]:
    """Host and path (its first part) of a URL, for tables that have one; null where it has none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]+)", 1))
    path = F.regexp_extract(url, r"^[^:]+://[^/?#]+(/[^/?#]*)", 1)
    return F.nullif(host, F.lit("")), F.nullif(path, F.lit(""))


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host: str = "source", path: str = "lang") -> DataFrame:
    """id, p_doc, host_rate, path_rate, p_bad and kept, for every document."""
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    scored = evidence(docs.select(id_col, text_col, F.col(host).alias("_site"), F.col(path).alias("_part")), model, text_col=text_col).drop(text_col)
    out = posterior(materialize(scored, "scored"), host="_site", path="_part")
    return out.select(id_col, "p_doc", "host_rate", "path_rate", "p_bad", (F.col("p_bad") < REJECT).alias("kept"))


def keep(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host: str = "source", path: str = "lang") -> DataFrame:
    """``docs`` (same columns, whatever their names) without the documents that are rejected."""
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    rest = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("_rest")
    packed = docs.select(rest, F.col(text_col).alias("_text"), F.col(host).alias("_site"), F.col(path).alias("_part"))
    scored = materialize(evidence(packed, model, text_col="_text", out="_p"), "scored")
    kept = posterior(scored, host="_site", path="_part", p="_p").where(F.col("p_bad") < REJECT)
    return kept.select(*[F.col("_text").alias(c) if c == text_col else F.col(f"_rest.`{c}`") for c in docs.columns])
