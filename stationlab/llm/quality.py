"""Quality by hierarchical empirical Bayes: document evidence, and posteriors of host and path."""

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationlab.llm.common import SPACE, broadcast_if_small, cut

MAX_TRAINING_ROWS = 20_000
"""The bound of the labelled sample: the rows of the smallest id hashes."""
KEEP = 0.5
FEATURES = ("size", "word", "letters", "capitals", "digits", "lines", "repeated_lines", "repeated_words", "long_runs")


def features(text: Column) -> dict[str, Column]:
    """What a text looks like, from whole texts and built-in functions only."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    words, lines = F.split(F.trim(text), SPACE), F.split(text, "\n")
    many = F.size(words).cast("double")
    only = lambda kinds: F.length(F.regexp_replace(text, f"[^{kinds}]+", "")) / n
    return {
        "size": F.log(n),
        "word": n / many,
        "letters": only(r"\p{L}"),
        "capitals": only(r"\p{Lu}"),
        "digits": only(r"\p{N}"),
        "lines": F.size(lines) / many,
        "repeated_lines": 1 - F.size(F.array_distinct(lines)) / F.size(lines),
        "repeated_words": 1 - F.size(F.array_distinct(words)) / many,
        "long_runs": F.length(F.regexp_replace(text, r"(?:[^\p{L}\p{N}\s][^\p{L}\p{N}\s]+)", "")) / n,
    }


def fit(rows: np.ndarray, labels: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, scale and weights (last: the bias) of a ridge logistic regression over features and their squares.

    Without rows the weights are zero; with one label only, the smoothed share's.
    """
    width = rows.shape[1]
    share = (labels.sum() + 0.5) / (len(labels) + 1.0)
    flat = np.r_[np.zeros(2 * width), np.log(share / (1 - share))]
    if not len(labels) or labels.min() == labels.max():
        return np.zeros(width), np.ones(width), flat
    centre, scale = rows.mean(axis=0), rows.std(axis=0) + 1e-9
    z = np.clip((rows - centre) / scale, -8, 8)
    x = np.c_[z, z * z, np.ones(len(z))]
    w = flat
    penalty = np.r_[np.full(2 * width, ridge), 1e-6]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - labels) + penalty * w
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return centre, scale, w


def _logit(p: Column) -> Column:
    inside = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(inside / (1 - inside))


def _strength(groups: DataFrame, mean: float) -> float:
    """How many documents the prior of a level is worth, from the spread of its groups' means around their parents'.

    ``groups`` has n, k (sum of evidence), s (sum of squared evidence) and the same of the parent as _n and _k.  By
    moments: what the means vary beyond chance is the level's own variance.
    """
    here, above = F.col("k") / F.col("n"), F.col("_k") / F.col("_n")
    got = groups.agg(
        F.sum("n"), F.count("*"), F.sum(F.col("n") / F.col("_n")), F.sum(F.col("n") * F.col("n") / F.col("_n")),
        F.sum(F.col("n") * (here - above) ** 2),
        F.sum(F.col("s") - F.col("k") * F.col("k") / F.col("n")),
    ).first()
    n, m, parents, squares, between, within = (float(x or 0) for x in got)
    parents = round(parents)  # the shares of each parent's groups add up to one
    if n <= m or m <= parents or n <= squares:
        return 1e6  # groups alone under their parents, or one document each: no sign of a spread
    chance = within / (n - m)
    own = (between - (m - parents) * chance) / (n - squares)
    return float(np.clip(mean * (1 - mean) / own - 1, 1.0, 1e6)) if own > 0 else 1e6


def score(docs: DataFrame, labels: DataFrame, host: Column, path: Column, keep: float = KEEP, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """Per row of ``docs``: doc_id, host, path, evidence, host_posterior, path_posterior, posterior, keep.

    ``evidence`` is a classifier's probability of quality 1, fitted to a bounded sample of
    labelled rows.  A host's share of good documents is shrunk to the global share, a path's
    to its host's, each by a strength estimated from the data; sparse sites stay near their
    parent.  A document's posterior odds are its evidence's, moved from the global prior to
    its path's, the document itself left out of both levels.  Null texts count as empty; a
    null host or path is a site of its own; labels without id or value teach nothing, of an id
    labelled twice the larger counts; repeated rows stay; no rows give no rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", host.cast("string").alias("host"), path.cast("string").alias("path"), *[c.cast("double").alias(f"_{n}") for n, c in features(text).items()])
    rows = cut(rows)
    names = [f"_{n}" for n in FEATURES]
    wanted = (
        labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("_quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    sample = rows.join(F.broadcast(wanted), "doc_id").select(*names, "_quality").orderBy(F.xxhash64(*names), *names).limit(max_rows).collect()
    table = np.array([r[:-1] for r in sample], np.float64).reshape(-1, len(names))
    centre, scale, w = fit(table, np.array([r[-1] for r in sample], np.float64))
    logit = F.lit(float(w[-1]))
    for i, n in enumerate(names):
        z = F.least(F.greatest((F.col(n) - float(centre[i])) / float(scale[i]), F.lit(-8.0)), F.lit(8.0))
        logit = logit + z * float(w[i]) + z * z * float(w[len(names) + i])
    given = rows.select("doc_id", "host", "path", (1 / (1 + F.exp(-logit))).alias("evidence"))
    p = F.col("evidence")
    sums = [F.count("*").alias("n"), F.sum(p).alias("k"), F.sum(p * p).alias("s")]
    paths = cut(given.groupBy("host", "path").agg(*sums))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum("s").alias("s"))
    total = hosts.agg(F.sum("n"), F.sum("k")).first()
    mean = float(np.clip((total[1] or 0.0) / total[0], 1e-6, 1 - 1e-6)) if total[0] else 0.5
    of_hosts = _strength(hosts.withColumns({"_n": F.lit(float(total[0] or 1)), "_k": F.lit(float(total[1] or 0))}), mean)
    sites = paths.alias("p").join(hosts.alias("h"), F.col("p.host").eqNullSafe(F.col("h.host"))).select(
        F.col("p.host").alias("_host"), F.col("p.path").alias("_path"), "p.s",
        F.col("p.n").alias("_pn"), F.col("p.k").alias("_pk"), F.col("h.n").alias("_hn"), F.col("h.k").alias("_hk"),
    )
    sites = cut(sites)
    of_paths = _strength(sites.select("s", *[F.col(a).alias(b) for a, b in (("_pn", "n"), ("_pk", "k"), ("_hn", "_n"), ("_hk", "_k"))]), mean)
    sites = broadcast_if_small(sites.drop("s"), 256)
    same = F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path"))
    host_share = (F.col("_hk") - p + of_hosts * mean) / (F.col("_hn") - 1 + of_hosts)
    path_share = (F.col("_pk") - p + of_paths * F.col("host_posterior")) / (F.col("_pn") - 1 + of_paths)
    moved = _logit(p) + _logit(F.col("path_posterior")) - _logit(F.lit(mean))
    return (
        given.join(sites, same)
        .withColumn("host_posterior", host_share)
        .withColumn("path_posterior", path_share)
        .withColumn("posterior", 1 / (1 + F.exp(-moved)))
        .select("doc_id", "host", "path", "evidence", "host_posterior", "path_posterior", "posterior", (F.col("posterior") >= keep).alias("keep"))
    )
