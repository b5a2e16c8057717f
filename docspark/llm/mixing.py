"""Mixing documents to target domain weights by soft membership, in DataFrame operations only.

A naive Bayes classifier over hashed words, fitted on a bounded sample of a labelled table,
gives every document a posterior over domains. Nonnegative document rates are then fitted by
accelerated projected-gradient least squares, so that the expected tokens of each domain,
sum of rate x tokens x posterior, meet their targets. An iteration is one aggregation of a
few sums over all documents; the step itself is a column expression.
"""
from __future__ import annotations

import math
import warnings
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.session import materialize

SLOTS = 4096          # hashed words
SAMPLE = 16_384       # labelled documents used for fitting, at most
EVIDENCE = 64.0       # a longer text counts as so many words, so that membership stays soft
DOMAINS = 32          # more different domains than this are refused
STEPS, TOLERANCE, RIDGE = 60, 1e-3, 1e-3
KEEP_EVERY = 8        # steps after which the state is written


def _slots(text: Column) -> Column:
    """Hashed words of a text; words are runs of characters other than ASCII white space."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t\\n\\u000b\\f\\r]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(SLOTS)).cast("int"))


def classifier(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[str], list[float], list[list[float]]]:
    """Domains, log priors, and per domain the log-likelihood of each slot, from docs (doc_id, text) and labels (doc_id, domain).

    A document labelled twice counts for its greatest domain.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("domain").isNotNull()).groupBy("doc_id").agg(F.max("domain").alias("domain"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # the documented bound
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    counts = rows.select("domain", F.explode(_slots(F.col("text"))).alias("slot")).groupBy("domain", "slot").count().collect()
    sizes = {r["domain"]: r["count"] for r in rows.groupBy("domain").count().collect()}
    domains = sorted(sizes)
    if len(domains) > DOMAINS:
        raise ValueError(f"more than {DOMAINS} domains")
    table = {d: [1.0] * SLOTS for d in domains}
    for r in counts:
        table[r["domain"]][r["slot"]] += r["count"]
    total = sum(sizes.values())
    return domains, [math.log(sizes[d] / total) for d in domains], [[math.log(x / sum(table[d])) for x in table[d]] for d in domains]


def _sum_of(odds: list[float]) -> Column:
    """The sum of `odds` over the slots of a text."""
    values = F.split(F.lit(",".join(f"{x:.6g}" for x in odds)), ",").cast("array<double>")  # a constant, once planned
    return F.aggregate("_slots", F.lit(0.0), lambda a, s: a + F.get(values, s))


def posteriors(docs: DataFrame, model, columns: list[str]) -> DataFrame:
    """`columns` of docs with n_tokens and the posterior of each domain, p0, p1, ...; a text without words has the prior."""
    domains, prior, like = model
    if not domains:
        return docs.select(*columns, F.size(_slots(F.col("text"))).cast("long").alias("n_tokens"))
    base = docs.select(*columns, _slots(F.col("text")).alias("_slots")).withColumn("n_tokens", F.size("_slots").cast("long"))
    soft = F.lit(EVIDENCE) / F.greatest(F.col("n_tokens"), F.lit(EVIDENCE))
    scores = [F.lit(0.0)]
    for k in range(1, len(domains)):  # log-odds against the first domain
        scores.append(F.lit(prior[k] - prior[0]) + soft * _sum_of([a - b for a, b in zip(like[k], like[0])]))
    scored = base.select(*columns, "n_tokens", *[s.alias(f"s{k}") for k, s in enumerate(scores)])
    top = F.greatest(*[F.col(f"s{k}") for k in range(len(domains))]) if len(domains) > 1 else F.col("s0")
    scored = scored.select(*columns, "n_tokens", *[F.exp(F.col(f"s{k}") - top).alias(f"s{k}") for k in range(len(domains))])
    norm = reduce(lambda a, b: a + b, [F.col(f"s{k}") for k in range(len(domains))])
    return scored.select(*columns, "n_tokens", *[(F.col(f"s{k}") / norm).alias(f"p{k}") for k in range(len(domains))])


class Fit(NamedTuple):
    """Rows with their rate, the expected tokens a domain, the steps taken, and whether the loss had settled by then."""

    rows: DataFrame
    expected: list[float]
    steps: int
    converged: bool


class Mix(NamedTuple):
    """Rates a document, the domains, the tokens aimed at and expected in each, the steps taken, and whether they settled."""

    rates: DataFrame
    domains: list[str]
    targets: list[float]
    expected: list[float]
    steps: int
    converged: bool


def fit_rates(state: DataFrame, targets: list[float], least: float = 0.0, steps: int = STEPS, tolerance: float = TOLERANCE,
              ridge: float = RIDGE) -> Fit:
    """Adds `rate` >= least to rows with n_tokens and p0, p1, ..., in at most `steps` steps.

    Minimises sum of ((expected - target) / scale)^2 / 2 + ridge / 2 * token-weighted mean of
    (rate - 1)^2, the scale being the target, or a hundredth of an even share if that is more.
    """
    k = len(targets)
    scale = [max(t, sum(targets) / (100 * k), 1.0) for t in targets]
    p = [F.col(f"p{d}") for d in range(k)]
    gram = state.agg(F.sum("n_tokens").alias("n"), *[F.sum(F.col("n_tokens") * p[a] * p[b]).alias(f"g{a}_{b}") for a in range(k) for b in range(a, k)]).first()
    n = gram["n"] or 0
    state = state.withColumn("rate", F.lit(max(1.0, least))).withColumn("_v", F.col("rate"))
    if not n:
        return Fit(state.drop("_v"), [0.0] * k, 0, True)
    g = [[gram[f"g{min(a, b)}_{max(a, b)}"] * n / (scale[a] * scale[b]) for b in range(k)] for a in range(k)]
    bound = max(sum(abs(x) for x in row) for row in g) + ridge  # no eigenvalue is greater
    momentum, last, done, t = 1.0, None, 0, 0
    while True:
        sums = state.agg(*[F.sum(F.col("n_tokens") * F.col("_v") * x).alias(f"v{d}") for d, x in enumerate(p)],
                         *[F.sum(F.col("n_tokens") * F.col("rate") * x).alias(f"r{d}") for d, x in enumerate(p)],
                         F.sum(F.col("n_tokens") * (F.col("rate") - 1) * (F.col("rate") - 1)).alias("far")).first()
        done = [sums[f"r{d}"] for d in range(k)]
        loss = sum(((done[d] - targets[d]) / scale[d]) ** 2 for d in range(k)) + ridge * sums["far"] / n
        settled = last is not None and abs(last - loss) <= tolerance * max(loss, tolerance)
        if t == steps or settled and t % 4 == 0:
            break
        if last is not None and loss > last:
            momentum = 1.0  # restart
        last = loss
        pull = reduce(lambda a, b: a + b, [F.lit((sums[f"v{d}"] - targets[d]) / scale[d] * n / scale[d]) * p[d] for d in range(k)])
        new = F.greatest(F.lit(least), F.col("_v") - (pull + F.lit(ridge) * (F.col("_v") - 1)) / bound)
        ahead = (1 + math.sqrt(1 + 4 * momentum * momentum)) / 2
        carry, momentum = (momentum - 1) / ahead, ahead
        state = state.withColumn("_new", new).withColumn("_v", F.col("_new") + F.lit(carry) * (F.col("_new") - F.col("rate")))
        state = state.withColumn("rate", F.col("_new")).drop("_new")
        t += 1
        if t % KEEP_EVERY == 0:
            state = materialize(state)
    return Fit(state.drop("_v"), done, t, settled)


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float], budget: float | None = None, least: float = 0.0,
        sample: int = SAMPLE, steps: int = STEPS) -> Mix:
    """A sampling rate for every row of docs (doc_id, text, any others), so that expected domain tokens have the given weights.

    labels: (doc_id, domain). `weights` are shares of `budget` tokens (default: the tokens
    there are; with `least` > 0 no less than leaves room for it). Domains without a weight aim
    at 0, weights of domains without labelled texts are left out. The rates have doc_id, n_tokens,
    rate, and p0, p1, ..., the posterior of each of the domains returned beside them. Null,
    empty and blank texts have no tokens, the prior as posterior and a rate like any other.
    Without any labels every rate is max(1, least). Repeated ids are rows of their own, columns
    of docs other than doc_id and text are not read. A fit that has not settled within `steps`
    steps warns and says so; targets that no rates can meet (by `least`) settle at the nearest.
    """
    model = classifier(docs, labels, sample)
    rows = materialize(posteriors(docs.select("doc_id", "text"), model, ["doc_id"]))
    domains = model[0]
    if not domains:
        return Mix(rows.withColumn("rate", F.lit(max(1.0, least))), [], [], [], 0, True)
    share = [max(0.0, weights.get(d, 0.0)) for d in domains]
    if not sum(share):
        raise ValueError("no domain has a weight")
    share = [x / sum(share) for x in share]
    have = rows.agg(F.sum("n_tokens").alias("n"), *[F.sum(F.col("n_tokens") * F.col(f"p{d}")).alias(f"d{d}") for d in range(len(domains))]).first()
    total = float(budget if budget is not None else have["n"] or 0)
    if least > 0:
        total = max([total, *(least * (have[f"d{d}"] or 0) / s for d, s in enumerate(share) if s > 0)])
    targets = [total * s for s in share]
    fit = fit_rates(rows, targets, least, steps)
    if not fit.converged:
        warnings.warn(f"rates have not settled after {fit.steps} steps: tokens expected {fit.expected}, aimed at {targets}")
    rates = fit.rows.select("doc_id", "n_tokens", "rate", *[f"p{d}" for d in range(len(domains))])
    return Mix(rates, domains, targets, fit.expected, fit.steps, fit.converged)


def mixing_rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float], budget: float | None = None, least: float = 0.0,
                 sample: int = SAMPLE) -> tuple[DataFrame, list[str]]:
    """The rates and domains of `mix`."""
    return mix(docs, labels, weights, budget, least, sample)[:2]


def copies(rate: Column, *key: Column, seed: int = 1) -> Column:
    """How often a row comes in a draw at `rate`: its whole part, and one more by a fixed random number of `key`."""
    u = (F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 40)) / float(1 << 40))
    return (F.floor(rate) + F.when(u < rate - F.floor(rate), 1).otherwise(0)).cast("int")
