"""Mixing sources to target weights with soft membership, in DataFrame functions alone.

A classifier learned from a labelled table gives each document a posterior over domains. Document rates, none negative,
are then fitted so that the expected tokens of each domain (rate times tokens times posterior, summed) match targets:
least squares by projected gradients, where each step is one aggregation over all documents. Residuals are measured
in the metric of the domains' Gram matrix, in which an unbounded step is exact, so few steps are needed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemart.llm.shared import settled, written

BUCKETS = 1 << 14
#: Tokens are words and the signs that follow them.
TOKENS = r"\s+|(?<=[\p{L}\p{N}])(?=[^\p{L}\p{N}\s])"
UNIT = 1 << 30


def tokens(text: Column) -> Column:
    """A null text has none."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), TOKENS), lambda t: t != "")


def buckets(words: Column) -> Column:
    """The distinct hash buckets of an array of tokens, from 1."""
    return F.array_distinct(F.transform(words, lambda t: (F.pmod(F.xxhash64(t), F.lit(BUCKETS)) + 1).cast("int")))


@dataclass
class Classifier:
    """Per domain: the weight of each bucket, and prior, means and deviations of all domains' scores."""

    domains: list[str]
    weights: list[list[float]]
    prior: list[float]
    mean: list[list[float]]
    spread: list[list[float]]

    def scores(self, found: Column) -> list[Column]:
        """Sum of the buckets' weights for each domain."""

        def summed(weights: list[float]) -> Column:
            table = F.split(F.lit(",".join(f"{x:.4g}" for x in weights)), ",").cast("array<double>")
            return F.aggregate(found, F.lit(0.0), lambda s, b: s + F.element_at(table, b))

        return [summed(w) for w in self.weights]

    def posterior(self, text: Column) -> Column:
        """struct(n_tokens, p): p is an array of one probability per domain."""
        if not self.weights:
            return F.struct(F.size(tokens(text)).cast("long").alias("n_tokens"), F.array(*[F.lit(float(x)) for x in self.prior]).alias("p"))

        def of(words: Column) -> Column:
            score = F.transform(F.array(buckets(words)), lambda b: F.array(*self.scores(b)))[0]
            return F.struct(F.size(words).cast("long").alias("n_tokens"), F.transform(F.array(score), self._softmax)[0].alias("p"))

        return F.transform(F.array(tokens(text)), of)[0]

    def _softmax(self, s: Column) -> Column:
        logs = []
        for d, prior in enumerate(self.prior):
            terms = [F.lit(math.log(max(prior, 1e-9)))]
            for j in range(len(self.domains)):
                z = (s[j] - F.lit(self.mean[d][j])) / F.lit(self.spread[d][j])
                terms.append(-z * z / 2 - F.lit(math.log(self.spread[d][j])))
            logs.append(sum(terms[1:], terms[0]))
        top = F.array_max(F.array(*logs))
        grown = F.transform(F.array(*logs), lambda x: F.exp(x - top))
        return F.transform(F.array(grown), lambda g: F.transform(g, lambda x: x / F.aggregate(g, F.lit(0.0), lambda a, v: a + v)))[0]


def learn(docs: DataFrame, labelled: DataFrame, domains: list[str], sample: int = 20_000) -> Classifier:
    """Learn from about `sample` labelled documents at most, chosen by a hash of doc_id: half give the buckets' weights, half the scores' spread.

    labelled has doc_id and domain; of several domains of one document the first by name counts, and domains that are not
    asked for, null ids and null texts teach nothing. Where a half has under two domains, posteriors are equal for all.
    """
    known = labelled.where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    share = min(1.0, sample / max(1, known.count()))
    draw = F.pmod(F.xxhash64(F.lit("mix"), "doc_id"), F.lit(UNIT))
    chosen = known.where(draw < int(share * UNIT)).withColumn("half", F.pmod(draw, F.lit(2)))
    taught = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")  # about `sample` rows
    found = written(taught.select("domain", "half", buckets(tokens(F.col("text"))).alias("found")), "taught")
    size = {d: 0 for d in domains} | {r.domain: r.n for r in found.where("half = 0").groupBy("domain").agg(F.count("*").alias("n")).collect()}
    whole = sum(size.values())
    equal = Classifier(domains, [], [1 / len(domains)] * len(domains), [], [])
    if sum(n > 0 for n in size.values()) < 2:
        return equal
    counts: dict[int, dict[str, int]] = {}
    rows = found.where("half = 0").select("domain", F.explode("found").alias("bucket")).groupBy("bucket", "domain").agg(F.count("*").alias("n"))
    for r in rows.collect():  # a row per bucket and domain at most
        counts.setdefault(r.bucket, {})[r.domain] = r.n
    weights = []
    for d in domains:
        w = [0.0] * BUCKETS
        for b, n in counts.items():
            own, rest = n.get(d, 0), sum(n.values()) - n.get(d, 0)
            x = math.log((own + 0.5) / (size[d] + 1)) - math.log((rest + 0.5) / (whole - size[d] + 1))
            if abs(x) >= 4 * math.sqrt(1 / (own + 0.5) + 1 / (rest + 0.5)):  # four standard errors
                w[b - 1] = x
        weights.append(w)
    made = Classifier(domains, weights, [], [], [])
    scored = found.where("half = 1").select("domain", *[s.alias(f"s{j}") for j, s in enumerate(made.scores(F.col("found")))])
    stats = {r.domain: r for r in scored.groupBy("domain").agg(F.count("*").alias("n"), *[f(f"s{j}").alias(f"{n}{j}") for j in range(len(domains)) for n, f in (("m", F.avg), ("v", F.var_pop))]).collect()}
    if len(stats) < 2:
        return equal
    some = next(iter(stats.values()))
    for d in domains:
        r = stats.get(d, some)
        made.prior.append(r.n / sum(x.n for x in stats.values()) if d in stats else 0.0)
        made.mean.append([r[f"m{j}"] for j in range(len(domains))])
        made.spread.append([math.sqrt(r[f"v{j}"] + 1e-2) for j in range(len(domains))])
    return made


def solved(m: list[list[float]], y: list[float]) -> list[float]:
    """x of m x = y, m square, symmetric and not negative, with a small ridge; by elimination."""
    n = len(y)
    ridge = 1e-9 * (sum(m[i][i] for i in range(n)) or 1.0)
    a = [[*(m[i][j] + ridge * (i == j) for j in range(n)), y[i]] for i in range(n)]
    for k in range(n):
        p = max(range(k, n), key=lambda i: abs(a[i][k]))
        a[k], a[p] = a[p], a[k]
        for i in range(n):
            if i != k:
                f = a[i][k] / a[k][k]
                a[i] = [u - f * v for u, v in zip(a[i], a[k], strict=True)]
    return [a[i][n] / a[i][i] for i in range(n)]


def _rate(start: Column, p: Column, steps: list[list[float]], most: float) -> Column:
    """The rate after some projected steps."""
    rate = start
    for g in steps:
        rate = F.least(F.greatest(rate - sum((p[j] * F.lit(x) for j, x in enumerate(g[1:], 1)), p[0] * F.lit(g[0])), F.lit(0.0)), F.lit(most))
    return rate


def fit_rates(members: DataFrame, targets: list[float], total: float | None = None, most: float = 1e9, steps: int = 24, tolerance: float = 1e-4, kept: int = 6) -> list[list[float]]:
    """The gradients whose projected steps give the rates: those of members (n_tokens, p), from 1, or `most` if that is less, for every document.

    targets are shares of `total` tokens; without it, of the most tokens of which no domain needs more than it has.
    """
    domains, table = range(len(targets)), members.select("n_tokens", "p").withColumn("rate", F.lit(min(1.0, most)))

    def measured(rates: DataFrame) -> tuple[list[list[float]], list[float]]:
        """The Gram matrix of the documents whose rate no bound holds, and the domains' tokens."""
        part, free = (lambda i: F.col("n_tokens") * F.col("p")[i]), (F.col("rate") > 0) & (F.col("rate") < most)
        sums = rates.agg(*[F.sum(F.when(free, part(i) * F.col("p")[j])).alias(f"g{i}_{j}") for i in domains for j in domains], *[F.sum(part(i) * F.col("rate")).alias(f"t{i}") for i in domains]).first()
        return [[sums[f"g{i}_{j}"] or 0.0 for j in domains] for i in domains], [sums[f"t{i}"] or 0.0 for i in domains]

    _, have = measured(table)
    metric, _ = measured(table.withColumn("rate", F.lit(min(0.5, most / 2))))
    if not sum(have):
        return []
    if total is None:
        total = min(h / t for h, t in zip(have, targets, strict=True) if t > 0)
    whole, at = metric, have
    taken: list[list[float]] = []
    fresh: list[list[float]] = []

    def missed(sums: list[float]) -> tuple[list[float], float]:
        """The residual, and its square in the metric of all documents, in which a unit step never makes it larger."""
        left = [a - total * t for a, t in zip(sums, targets, strict=True)]
        return left, sum(x * y for x, y in zip(left, solved(whole, left), strict=True))

    residual, square = missed(at)
    for _ in range(steps):
        if max(map(abs, residual)) <= tolerance * total:
            break
        for form, enough in ((metric, 0.9), (whole, 0.99)):
            step = solved(form, residual)
            now_metric, now = measured(table.select("n_tokens", "p", _rate(F.col("rate"), F.col("p"), [*fresh, step], most).alias("rate")))
            now_residual, now_square = missed(now)
            if now_square < enough * square:
                break
        else:
            break  # the bounds allow no better fit
        metric, residual, square = now_metric, now_residual, now_square
        fresh.append(step)
        if len(fresh) >= kept:  # the rates so far become a column, so that no step's expression grows without end
            table = written(table.withColumn("rate", _rate(F.col("rate"), F.col("p"), fresh, most)), "rates")
            taken, fresh = taken + fresh, []
    return taken + fresh


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], total: float | None = None, most: float = 1e9, **options: int) -> DataFrame:
    """(doc_id, n_tokens, p_<domain>..., rate) per row of docs (doc_id, text): in expectation, rate copies give the targets.

    Target weights are shares of all tokens of docs, or of `total`. A document without tokens has the rate of its
    posterior and adds nothing. Repeated rows and null ids each count. Other columns are ignored; an empty table gives an empty result.
    """
    return settled(docs.sparkSession, "rates", lambda: _mix(docs, labelled, targets, total, most, **options))


def _mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], total: float | None, most: float, **options: int) -> DataFrame:
    domains = sorted(targets)
    shares = [targets[d] / sum(targets.values()) for d in domains]
    model = learn(docs, labelled, domains, **options)
    members = written(docs.select("doc_id", model.posterior(F.col("text")).alias("m")).select("doc_id", "m.n_tokens", "m.p"), "posteriors")
    total = total or float(members.agg(F.sum("n_tokens")).first()[0] or 0)
    gradients = fit_rates(members, shares, total, most)
    return members.select("doc_id", "n_tokens", *[F.col("p")[j].alias(f"p_{d}") for j, d in enumerate(domains)], _rate(F.lit(min(1.0, most)), F.col("p"), gradients, most).alias("rate"))


def ceilings(have: list[float], shares: list[float], whole: list[int]) -> list[float]:
    """The domains' tokens if those of `whole` stay whole and each other has at most its share of all that is kept."""
    thin: set[int] = set()
    while True:
        total = sum(h for d, h in enumerate(have) if d not in thin) / (1 - sum(shares[d] for d in thin))
        more = {d for d, h in enumerate(have) if d not in whole and d not in thin and h > shares[d] * total}
        if not more:
            return [shares[d] * total if d in thin else h for d, h in enumerate(have)]
        thin |= more


def subsample(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], seed: int = 11, whole: tuple[str, ...] = (), **options: int) -> DataFrame:
    """docs, all columns, less the rows that a mix of rates up to 1 leaves out: each row stays if its seeded draw is under its rate.

    The total is the most that no domain's tokens fall short of. With `whole`, which needs a share, the domains named there
    stay whole instead, and the other targets are ceilings: a domain that has less than its share takes nothing from others.
    Where the labels can't tell domains apart, all rows stay then. Rows of one doc_id and text share a draw; null ids and
    texts are drawn like others. An empty table gives an empty result.
    """
    domains = sorted(targets)
    shares = [targets[d] / sum(targets.values()) for d in domains]
    model = learn(docs, labelled, domains, **options)
    if whole and not model.weights:
        return docs
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    kept = written(docs.select(row.alias("row"), model.posterior(F.col("text")).alias("m")), "posteriors", compression="zstd")  # found once, and read beside the row
    members = kept.select("m.n_tokens", "m.p")
    total = None
    if whole:
        have = [x or 0.0 for x in members.agg(*[F.sum(F.col("n_tokens") * F.col("p")[j]) for j in range(len(domains))]).first()]
        goal = ceilings(have, shares, [domains.index(d) for d in whole])
        total = sum(goal)
        shares = [g / (total or 1.0) for g in goal]
    gradients = fit_rates(members, shares, total, 1.0)
    rate = _rate(F.lit(1.0), F.col("m.p"), gradients, 1.0)
    draw = F.pmod(F.xxhash64(F.lit(seed), "row.doc_id", F.col("row.text").cast("string")), F.lit(UNIT)) / F.lit(float(UNIT))
    return kept.where(draw < rate).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def quality_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of labels (doc_id, quality, toxic): toxic, else good or plain; unknown labels are left out."""
    domain = F.when(F.col("toxic") == 1, "toxic").when((F.col("toxic") == 0) & (F.col("quality") == 1), "good").when((F.col("toxic") == 0) & (F.col("quality") == 0), "plain")
    return labels.select("doc_id", domain.alias("domain")).where("domain is not null")
