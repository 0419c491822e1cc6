"""Mixing to target weights: soft domain posteriors and projected-gradient document rates. SQL functions only."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import drop_staged, staged

BUCKETS = 4096  # hashed word features
SAMPLE = 6000  # labelled documents that the classifier is fitted on at most, a fifth of them for its calibration
SCALES = [2.0 ** -(k / 2) for k in range(27)]  # of the evidence, from which calibration chooses
STEPS, LESS, GAP = 16, 0.005, 1e-4  # gradient steps at most; what each must lower the objective by; the part of all tokens that may be missed without a warning
# Domains and the shares of tokens wanted of each, as (quality, toxic): share.
TARGETS = {(1, 0): 0.80, (1, 1): 0.08, (0, 0): 0.10, (0, 1): 0.02}
# In the pipeline, where toxic documents are gone: by quality alone.
PIPELINE_TARGETS = {(1,): 0.90, (0,): 0.10}
# Words stand between runs of the six ASCII white-space marks: the other five become spaces, empty words go.
WORDS = r"filter(split(translate(coalesce(cast(text as string), ''), '\t\n\u000b\u000c\r', '     '), ' '), w -> w <> '')"


def feature(word: Column | str) -> Column:
    """Bucket of a word's first three and last two characters and its size class: words repeat little, their edges do."""
    return F.pmod(F.xxhash64(F.substring(word, 1, 3), F.substring(word, -2, 2), F.least(F.length(word), F.lit(12))), F.lit(BUCKETS))


@dataclass
class Domains:
    """A fitted classifier: log probability of each bucket by domain, log shares of the domains, scale of the evidence."""

    logs: list[list[float]]
    prior: list[float]
    scale: float = 1.0


def fit(docs: DataFrame, labels: DataFrame, domains: list[tuple], sample: int = SAMPLE) -> Domains:
    """Naive Bayes over hashed words, calibrated.

    At most ``sample`` labelled documents, in the order of a hash of their ids; counts reach the driver as one row
    per domain and bucket. A domain is the tuple of the label columns (quality, toxic) cut to the tuple's length.
    Words aren't independent, so the evidence of a text's words is scaled by the factor that makes a fifth of the
    sample, which the counts leave out, most likely."""
    cols = ["quality", "toxic"][: len(domains[0])]
    which = None
    for k, d in enumerate(domains):
        is_d = F.lit(True)
        for c, v in zip(cols, d):
            is_d = is_d & (F.col(c) == v)
        which = F.when(is_d, k) if which is None else which.when(is_d, k)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), which.alias("domain")).filter("domain IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    texts = staged(texts.withColumn("kept", F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(5)) == 0), "labelled")
    words = texts.filter("NOT kept").select("domain", F.explode(F.expr(WORDS)).alias("w"))
    rows = words.groupBy("domain", feature(F.col("w")).cast("int").alias("b")).agg(F.count("*").alias("n")).collect()
    sizes = {r.domain: r.n for r in texts.dropDuplicates(["doc_id"]).groupBy("domain").agg(F.count("*").alias("n")).collect()}
    count = [[0.5] * BUCKETS for _ in domains]
    for r in rows:
        count[r.domain][r.b] += r.n
    logs = []
    for c in count:
        total = math.log(sum(c))
        logs.append([math.log(x) - total for x in c])
    prior = [math.log((sizes.get(k, 0) + 0.5) / (sum(sizes.values()) + 0.5 * len(domains))) for k in range(len(domains))]
    found = Domains(logs, prior)
    out = staged(evidence(texts.filter("kept"), found, ["domain"]), "calibration")
    likely = []
    for s in SCALES:
        z = f"zip_with(s.e, {literal(prior)}, (a, q) -> q + a * {s!r}D)"
        sure = let(z, "z", let("element_at(z, domain + 1)", "own", "aggregate(z, 0D, (a, v) -> a + exp(v - own), a -> -ln(a))"))
        likely.append(F.sum(F.expr(sure)).alias(f"s{len(likely)}"))
    best = out.agg(*likely).first()
    found.scale = max(((v if v is not None and v == v else -math.inf, s) for v, s in zip(best, SCALES)), key=lambda t: (t[0], -t[1]))[1]
    drop_staged(texts, out)
    return found


def literal(xs: list[float]) -> str:
    return f"cast(split('{','.join(f'{x:.9g}' for x in xs)}', ',') as array<double>)"


def let(value: str, name: str, body: str) -> str:
    """SQL of ``body`` with ``name`` standing for ``value``, which is computed once however the optimizer moves it."""
    return f"transform(array({value}), {name} -> {body})[0]"


def evidence(docs: DataFrame, found: Domains, keep: list[str]) -> DataFrame:
    """``keep`` columns and s: n_tokens (words), e, the log likelihood of the text's words by domain, less the greatest."""
    sums = ", ".join(f"element_at({literal(x)}, b)" for x in found.logs)
    bucket = f"cast(pmod(xxhash64(substring(w, 1, 3), substring(w, -2, 2), least(length(w), 12)), {BUCKETS}) as int) + 1"
    zero = "array(" + ", ".join(["0D"] * len(found.prior)) + ")"
    add = f"zip_with(s, {let(bucket, 'b', f'array({sums})')}, (a, v) -> a + v)"
    e = let(f"aggregate(ws, {zero}, (s, w) -> {add})", "z", let("array_max(z)", "top", "transform(z, x -> x - top)"))
    s = let(WORDS, "ws", f"named_struct('n_tokens', cast(size(ws) as long), 'e', {e})")
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.expr(s).alias("s"))


def posteriors(docs: DataFrame, found: Domains, keep: list[str]) -> DataFrame:
    """``keep`` columns, n_tokens (words) and p, the array of domain posteriors of each document."""
    z = f"zip_with(s.e, {literal(found.prior)}, (a, q) -> q + a * {found.scale!r}D)"
    share = let("aggregate(y, 0D, (a, v) -> a + v)", "total", "transform(y, x -> x / total)")
    p = let(z, "z", let(let("array_max(z)", "top", "transform(z, x -> exp(x - top))"), "y", share))
    return evidence(docs, found, keep).select(*[F.col(f"`{c}`") for c in keep], F.col("s.n_tokens").alias("n_tokens"), F.expr(p).alias("p"))


def solve(m: list[list[float]], v: list[float]) -> list[float]:
    """m x = v for a small symmetric positive matrix, by elimination."""
    n = len(v)
    a = [row[:] + [b] for row, b in zip(m, v)]
    for i in range(n):
        j = max(range(i, n), key=lambda k: abs(a[k][i]))
        a[i], a[j] = a[j], a[i]
        for k in range(i + 1, n):
            f = a[k][i] / a[i][i]
            for c in range(i, n + 1):
                a[k][c] -= f * a[i][c]
    x = [0.0] * n
    for i in reversed(range(n)):
        x[i] = (a[i][n] - sum(a[i][k] * x[k] for k in range(i + 1, n))) / a[i][i]
    return x


def rate_sql(steps: list[list[float]], floor: float, p: str = "p") -> str:
    """SQL of a document's rate after the gradient steps so far, each projected to ``floor`` or more."""
    rate = repr(max(1.0, floor)) + "D"
    for g in steps:
        rate = f"greatest({floor!r}D, {rate} - ({' + '.join(f'{p}[{k}] * {x!r}D' for k, x in enumerate(g))}))"
    return rate


def fit_rates(post: DataFrame, shares: list[float], floor: float = 0.0, steps: int = STEPS) -> tuple[list[list[float]], float]:
    """(gradient steps that take rates from 1 to nonnegative ones whose expected domain totals match the targets, gap).

    Minimises sum_k (sum_i r_i t_i p_ik - T_k)^2 over r_i >= floor, t tokens, p posteriors, T_k = B * shares_k
    with the least budget B at which no domain shrinks. Each step moves r_i by -p_i . g, g the residual times the
    inverse second moments sum_i t_i p_i p_i' of the rates that may move. Shorter ones of these and plain gradient
    steps (g the residual over all tokens, which always lower the objective) are tried with it in one distributed pass,
    and the best is taken; another pass sums the moments. K and K^2 sums reach the driver. The gap is the greatest |total - T_k| / B
    of the rates returned; a warning says so where it exceeds GAP (a domain without tokens can't get its share).
    """
    n = len(shares)
    totals = post.agg(*[F.sum(F.col("n_tokens") * F.col("p")[k]).alias(f"t{k}") for k in range(n)]).first()
    have = [float(x or 0.0) for x in totals]
    budget = max([h / s for h, s in zip(have, shares) if s > 0 and h > 0], default=0.0)
    want, scale = [budget * s for s in shares], max(budget, 1.0)

    def gaps(tries: list[list[list[float]]]) -> list[tuple[float, list[float], list[list[float]]]]:
        """(loss, gap, steps) of each sequence of steps, in one pass."""
        sums = [F.sum(F.expr(f"{rate_sql(done, floor)} * n_tokens * p[{k}]")).alias(f"s{a}_{k}") for a, done in enumerate(tries) for k in range(n)]
        row, out = post.agg(*sums).first().asDict(), []
        for a, done in enumerate(tries):
            gap = [float(row[f"s{a}_{k}"] or 0) - want[k] for k in range(n)]
            out.append((sum((g / scale) ** 2 for g in gap), gap, done))
        return out

    def moments(done: list[list[float]], gap: list[float]) -> list[list[float]]:
        """Second moments of the rates that may move: those off the floor, and those at it that the gap would raise."""
        raised = sum((F.col("p")[k] * F.lit(gap[k]) for k in range(n)), F.lit(0.0)) < 0
        free = F.when((F.expr(rate_sql(done, floor)) > floor) | raised, F.col("n_tokens").cast("double")).otherwise(0.0)
        row = post.agg(*[F.sum(free * F.col("p")[i] * F.col("p")[j]).alias(f"m{i}_{j}") for i in range(n) for j in range(i, n)]).first().asDict()
        return [[float(row[f"m{min(i, j)}_{max(i, j)}"] or 0) + (1e-6 * scale if i == j else 0) for j in range(n)] for i in range(n)]

    loss, gap, done = gaps([[]])[0]
    plain = 1 / max(sum(have), 1e-300)  # the moments' trace is less than all tokens
    for _ in range(steps):
        if loss < 1e-10:
            break
        newton = solve(moments(done, gap), gap)
        tries = [[k * x for x in newton] for k in (1.0, 0.5, 0.125)] + [[k * plain * x for x in gap] for k in (1.0, 4.0)]
        best = min(gaps([[*done, g] for g in tries]), key=lambda t: t[0])
        if best[0] > loss * (1 - LESS):
            break
        loss, gap, done = best
    missed = max((abs(g) / scale for g in gap), default=0.0)
    if missed > GAP:
        warnings.warn(f"mixing misses its targets by up to {missed:.2g} of all tokens", stacklevel=2)
    return done, missed


def mix(docs: DataFrame, labels: DataFrame, targets: dict[tuple, float] = TARGETS, floor: float = 0.0) -> DataFrame:
    """doc_id, n_tokens, posteriors (by the order of ``targets``), rate, copies of each document, and gap: the greatest
    part of all tokens by which a domain's expected total misses its target (the same in all rows).

    copies is the rate rounded up or down by a hash of doc_id and text, so that its expectation is the rate. Tokens
    are words between runs of white space, of whole texts however long. Null, empty and blank texts have no tokens, the
    prior's posteriors and the rate these give. Repeated rows get equal rates. No rows: no rows. Labels with nulls or
    outside the targets aren't learned. Other columns of ``docs`` aren't read.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("doc_id", "text"))
    post = staged(posteriors(keyed, fit(keyed, labels, list(targets)), ["doc_id", "h"]), "posteriors")
    steps, gap = fit_rates(post, [s / sum(targets.values()) for s in targets.values()], floor)
    rated = post.withColumn("rate", F.expr(rate_sql(steps, floor)))
    return rated.select("doc_id", "n_tokens", F.col("p").alias("posteriors"), "rate", copies(F.col("rate"), F.col("h")).alias("copies"), F.lit(gap).alias("gap"))


def copies(rate: Column, h: Column) -> Column:
    """The rate rounded up or down by a hash, so that its expectation is the rate."""
    share = F.shiftrightunsigned(F.xxhash64(h, F.lit("copies")), 11).cast("double") / F.lit(float(1 << 53))
    return F.transform(F.array(rate), lambda r: (F.floor(r) + (share < r - F.floor(r)).cast("long")).cast("int"))[0]


def resample(docs: DataFrame, labels: DataFrame, targets: dict[tuple, float] = PIPELINE_TARGETS, floor: float = 1.0) -> DataFrame:
    """``docs`` with each row repeated by its copies. At a floor of 1 no document goes; under-represented domains repeat.

    A row's rate is a function of its text, so it is computed again where the row is read: nothing is joined or
    shuffled. Rows with null, empty or repeated texts or null ids are kept and repeated like any other."""
    names, found = docs.columns, fit(docs, labels, list(targets))
    plain = docs.select(F.col("text").cast("string").alias("text"))
    post = staged(posteriors(plain, found, []), "posteriors")
    steps, _ = fit_rates(post, [s / sum(targets.values()) for s in targets.values()], floor)
    drop_staged(post)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("h"))
    rated = posteriors(whole, found, ["row", "h"]).withColumn("n", copies(F.expr(let("p", "q", rate_sql(steps, floor, "q"))), F.col("h")))
    # an outer explode, so that no filter on n is made below it, which would compute n twice
    many = F.explode_outer(F.expr("IF(n > 0, sequence(1, n), cast(array() as array<int>))"))
    return rated.select("row", many.alias("k")).filter("k IS NOT NULL").select(*[F.col("row").getField(c).alias(c) for c in names])
