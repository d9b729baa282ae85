"""Soft-membership mixing of documents to target weights of domains, in DataFrame operations only.

A naive Bayes classifier, learned from a labelled table, gives every document a posterior for each domain. Rates, one a
document and never negative, are then fitted so that the expected tokens of each domain, the sum over the documents of
rate x tokens x posterior, match their targets in least squares. The fit is a projected gradient descent: each step
needs the domain totals alone, one number a domain from one aggregation, and a document's rate follows from its own
posterior and the steps so far, so that nothing of the size of the corpus leaves the executors.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow.session import settle

MAX_TRAIN_ROWS = 20_000
LEXICON = 64
MAX_DOMAINS = 64
STEM = 5
# upper edges of the bins of the style features
EDGES = {
    "chars": (20, 100, 300, 1000, 3000, 10_000, 30_000),
    "word_chars": (4.0, 5.0, 5.5, 6.0, 6.5, 7.0, 8.0),
    "marks": (0.005, 0.01, 0.02, 0.03, 0.05, 0.1, 0.2, 0.3),
    "capitals": (0.002, 0.005, 0.01, 0.02, 0.04, 0.1, 0.3),
    "digits": (0.0005, 0.005, 0.02, 0.1),
    "distinct": (0.05, 0.2, 0.4, 0.6, 0.7, 0.8, 0.9),
}


def _binned(value: Column, edges: tuple) -> Column:
    return reduce(lambda total, edge: total + (value > F.lit(float(edge))).cast("int"), edges, F.lit(0))


def with_features(rows: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns of `keep`, then __tokens, __stems (distinct, of the words) and __style, the bins of EDGES."""
    whole = F.coalesce(F.col(text), F.lit(""))
    # a word is a run of lower-cased ASCII letters and digits and of characters outside ASCII
    words = F.array_remove(F.split(F.lower(whole), r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"), "")
    base = rows.select(*keep, whole.alias("__text"), words.alias("__words"))
    chars = F.greatest(F.length("__text"), F.lit(1))
    count = F.size("__words")
    base = base.select(*keep, "__text", count.cast("bigint").alias("__tokens"), F.array_distinct(F.transform("__words", lambda w: F.substring(w, 1, STEM))).alias("__stems"))
    count = F.greatest(F.col("__tokens"), F.lit(1))
    values = {
        "chars": F.length("__text"), "word_chars": chars / count, "distinct": F.size("__stems") / count,
        "marks": F.regexp_count("__text", F.lit(r"[!-/:-@\[-`{-~]")) / chars,
        "capitals": F.regexp_count("__text", F.lit("[A-Z]")) / chars, "digits": F.regexp_count("__text", F.lit("[0-9]")) / chars,
    }
    return base.select(*keep, "__tokens", "__stems", F.array(*[_binned(values[name], edges) for name, edges in EDGES.items()]).alias("__style"))


@dataclass(frozen=True)
class DomainModel:
    """Domains in name order, stems that speak for each, and log-probabilities by domain, feature and bin."""

    domains: tuple[str, ...]
    lexicons: tuple[tuple[str, ...], ...]
    priors: tuple[float, ...]
    tables: tuple[tuple[tuple[float, ...], ...], ...]

    def bins(self) -> Column:
        hits = [F.least(F.size(F.array_intersect("__stems", F.array(*map(F.lit, words)))), F.lit(3)) if words else F.lit(0) for words in self.lexicons]
        return F.concat(F.col("__style"), F.array(*hits))

    def posteriors(self, bins: Column) -> Column:
        """Probability of each domain, in their order."""
        scores = []
        for prior, table in zip(self.priors, self.tables, strict=True):
            parts = [F.get(F.array(*map(F.lit, own)), bins[k]) for k, own in enumerate(table)]
            scores.append(reduce(lambda a, b: a + b, parts, F.lit(prior)))
        top = F.greatest(*scores) if len(scores) > 1 else scores[0]
        # exp of differences cannot overflow, and the largest is 1
        raised = F.transform(F.array(*scores), lambda s: F.exp(s - top))
        return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def fit_domains(rows: DataFrame, labelled: DataFrame, key: str = "doc_id", text: str = "text", domain: str = "domain", max_train_rows: int = MAX_TRAIN_ROWS) -> DomainModel:
    """Learns from the rows whose key `labelled` gives a domain; of several domains of a key the first in name order.

    About max_train_rows labelled keys are used, those of the smallest hashes. They are broadcast, at most about that
    many keys with a name. The model holds LEXICON stems and a table of 60 numbers for each domain. Without a labelled
    row there are no domains.
    """
    known = (labelled.where(F.col(key).isNotNull() & F.col(domain).isNotNull())
             .groupBy(F.col(key).cast("bigint").alias("__key")).agg(F.min(domain).alias("__domain")))
    known = settle(known)
    share = min(1.0, max_train_rows / max(known.count(), 1))
    known = known.where(F.pmod(F.xxhash64("__key"), F.lit(1 << 30)) < int(share * (1 << 30)))
    chosen = rows.withColumn("__key", F.col(key).cast("bigint")).join(F.broadcast(known), "__key").select("__domain", F.col(text).alias("__source"))
    train = settle(with_features(chosen, "__source", ["__domain"]))
    sizes = {r["__domain"]: r["n"] for r in train.groupBy("__domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) > MAX_DOMAINS:
        raise ValueError(f"{len(sizes)} domains; a model has at most {MAX_DOMAINS}")
    domains, total = tuple(sorted(sizes)), sum(sizes.values())
    seen = settle(train.select("__domain", F.explode("__stems").alias("stem")).groupBy("stem").pivot("__domain", list(domains)).count().na.fill(0)) if domains else None
    lexicons = []
    for name in domains:
        rest = reduce(lambda a, b: a + b, [F.col(f"`{d}`") for d in domains if d != name], F.lit(0))
        odds = F.log((F.col(f"`{name}`") + 0.5) / (sizes[name] + 1)) - F.log((rest + 0.5) / (total - sizes[name] + 1))
        telling = seen.where((F.col(f"`{name}`") >= 5) & (odds > 1.5)).orderBy(F.desc(odds * F.col(f"`{name}`")), "stem").limit(LEXICON)
        lexicons.append(tuple(r["stem"] for r in telling.select("stem").collect()))
    widths = [len(edges) + 1 for edges in EDGES.values()] + [4] * len(domains)
    blank = DomainModel(domains, tuple(lexicons), (), ())
    counts = np.zeros((len(domains), len(widths), max(widths, default=1)))
    if domains:
        cells = train.select("__domain", F.posexplode(blank.bins()).alias("feature", "bin")).groupBy("__domain", "feature", "bin").count()
        for r in cells.collect():
            counts[domains.index(r["__domain"]), r["feature"], r["bin"]] = r["count"]
    tables = tuple(tuple(tuple(np.log((own[k, :w] + 0.5) / (own[k, :w].sum() + 0.5 * w)).tolist()) for k, w in enumerate(widths)) for own in counts)
    return DomainModel(domains, tuple(lexicons), tuple(float(np.log(sizes[d] / total)) for d in domains), tables)


def _path(posteriors: Column, steps: list[tuple[float, ...]]) -> Column:
    """A document's rate and the point the next gradient is taken at, after the given steps: (step by domain..., momentum)."""
    start = F.struct(F.lit(1.0).alias("rate"), F.lit(1.0).alias("point"))
    if not steps:
        return start
    last = len(steps[0]) - 1

    def go(state: Column, step: Column) -> Column:
        new = F.greatest(F.lit(0.0), state["point"] - reduce(lambda a, b: a + b, [posteriors[k] * step[k] for k in range(last)]))
        return F.struct(new.alias("rate"), (new + step[last] * (new - state["rate"])).alias("point"))

    return F.aggregate(F.array(*[F.array(*map(F.lit, step)) for step in steps]), start, go)


def rate(posteriors: Column, steps: list[tuple[float, ...]]) -> Column:
    """A document's rate after the given steps, each projected to what is not negative; 1 before the first."""
    return _path(posteriors, steps)["rate"]


def fit_rates(weighted: DataFrame, targets: list[float], tokens: str = "__tokens", posteriors: str = "__posteriors", rounds: int = 60, close: float = 1e-4) -> list[tuple[float, ...]]:
    """Steps of the projected gradient descent that bring the expected tokens of the domains to their targets.

    The residuals are weighted by the inverse of the sum of tokens x posterior x posterior', and a document's gradient
    by one over its tokens, in which measure the gradient's Lipschitz constant is 1. Momentum speeds it up and starts
    anew when the residual grows. It ends when no total is off by more than `close` of all tokens, or after `rounds`,
    which leaves nearly the least squares of targets that cannot be met.
    """
    k = len(targets)
    t, p = F.col(tokens).cast("double"), F.col(posteriors)
    pairs = [(a, b) for a in range(k) for b in range(a, k)]
    sums = weighted.agg(*[F.coalesce(F.sum(t * p[a] * p[b]), F.lit(0.0)).alias(f"m{a}_{b}") for a, b in pairs], F.coalesce(F.sum(t), F.lit(0.0)).alias("all")).first()
    if not sums["all"]:
        return []
    gram = np.zeros((k, k))
    for a, b in pairs:
        gram[a, b] = gram[b, a] = sums[f"m{a}_{b}"]
    weights = np.linalg.inv(gram + np.eye(k) * 1e-9 * sums["all"])
    steps: list[tuple[float, ...]] = []
    speed, cost = 1.0, float("inf")
    for _ in range(rounds):
        at = weighted.select(tokens, posteriors, _path(p, steps).alias("__at"))
        got = at.agg(*[F.sum(F.col(f"__at.{what}") * t * p[a]).alias(f"{what}{a}") for a in range(k) for what in ("rate", "point")]).first()
        off, ahead = (np.array([got[f"{what}{a}"] for a in range(k)]) - np.array(targets) for what in ("rate", "point"))
        if np.abs(off).max() <= close * sums["all"]:
            break
        if off @ weights @ off > cost:
            speed = 1.0
        cost = off @ weights @ off
        faster = (1 + (1 + 4 * speed * speed) ** 0.5) / 2
        steps.append((*(weights @ ahead).tolist(), (speed - 1) / faster))
        speed = faster
    return steps


@dataclass(frozen=True)
class Mixture:
    """A fitted mixture: what a row needs to get its posterior and its rate."""

    model: DomainModel
    steps: list[tuple[float, ...]]


def fit_mixture(rows: DataFrame, labelled: DataFrame, weights: dict[str, float], key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> tuple[Mixture, DataFrame]:
    """A mixture, and the written rows it was fitted on: the columns of `keep`, __tokens and __posteriors.

    The target of a domain is its share of the weights times all tokens of the rows; domains without a weight have the
    target 0, and weights of domains that no label names are left out. Without domains every rate is 1.
    """
    model = fit_domains(rows, labelled, key, text)
    marked = with_features(rows.select(*[F.col(c) for c in keep or [key]], F.col(text).alias("__source")), "__source", keep or [key])
    if model.domains:
        binned = marked.select(*(keep or [key]), "__tokens", model.bins().alias("__bins"))
        marked = binned.select(*(keep or [key]), "__tokens", model.posteriors(F.col("__bins")).alias("__posteriors"))
    else:
        marked = marked.select(*(keep or [key]), "__tokens", F.array().cast("array<double>").alias("__posteriors"))
    marked = settle(marked)
    share = [max(0.0, weights.get(d, 0.0)) for d in model.domains]
    if not sum(share):
        return Mixture(model, []), marked
    tokens = marked.agg(F.sum("__tokens")).first()[0] or 0
    return Mixture(model, fit_rates(marked, [tokens * s / sum(share) for s in share])), marked


def mix(rows: DataFrame, labelled: DataFrame, weights: dict[str, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, tokens, posteriors (map by domain), rate: one row for each row given.

    A null or empty text has no tokens and the posterior of an empty text. Rows repeated, or without a key, are weighed
    like any other. No row in, no row out. Columns other than those named are ignored.
    """
    mixture, marked = fit_mixture(rows.select(F.col(key).alias("__id"), F.col(text).alias("__own")), labelled.withColumnRenamed(key, "__id"), weights, "__id", "__own")
    names = F.array(*map(F.lit, mixture.model.domains)).cast("array<string>")
    return marked.select(F.col("__id").alias(key), F.col("__tokens").alias("tokens"), F.map_from_arrays(names, F.col("__posteriors")).alias("posteriors"),
                         rate(F.col("__posteriors"), mixture.steps).alias("rate"))


def resample(rows: DataFrame, labelled: DataFrame, weights: dict[str, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows, each as often as its rate says: the whole part for sure, once more with the fraction as probability.

    The draw is a hash of key and text, so the same rows always give the same result. All columns stay as they are.
    """
    mixture, marked = fit_mixture(rows, labelled, weights, key, text, rows.columns)
    drawn = F.pmod(F.xxhash64(F.lit("mix"), F.col(key), F.col(text)), F.lit(1 << 30)) / float(1 << 30)
    times = F.floor(rate(F.col("__posteriors"), mixture.steps) + drawn).cast("int")
    return marked.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), times))).select(*rows.columns)
