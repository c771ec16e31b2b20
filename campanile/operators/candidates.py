"""Candidate features, scores, batches and trust regions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import fold_tokens, uniform
from ..functions.numeric import cosine, normal_cdf, normal_pdf, tanimoto
from ..functions.scan import as_column, number_rows, running
from ..session import cut
from .features import Ranges, interactions

# fixed values: batch strategies each score may use, the first being its default
BATCH_STRATEGIES = {
    "ei": ("kriging_believer", "constant_liar"),
    "lfbo": ("diverse_greedy",),
    "lfbo_ssl": ("diverse_greedy",),
    "consensus": ("diverse_greedy",),
    "thompson": ("diverse_greedy",),
    "random": ("diverse_greedy",),
}


def batch_strategy(score: str, requested: str | None = None) -> str:
    """The requested strategy when the score allows it, else the default of the score."""
    allowed = BATCH_STRATEGIES.get(score)
    if allowed is None:
        return requested or "diverse_greedy"
    return requested if requested in allowed else allowed[0]


def batch_strategies(score, requested) -> Column:
    """C5 by row: the same rule over columns of score names and requested strategies."""
    s, r = as_column(score), as_column(requested)
    known = F.create_map(*[x for name, allowed in BATCH_STRATEGIES.items() for x in (F.lit(name), F.array(*map(F.lit, allowed)))])
    bound = F.array(F.struct(F.element_at(known, s).alias("allowed"), r.alias("asked")))
    rule = lambda b: F.when(b["allowed"].isNull(), F.coalesce(b["asked"], F.lit("diverse_greedy"))).when(F.array_contains(b["allowed"], b["asked"]), b["asked"]).otherwise(b["allowed"][0])
    return F.transform(bound, rule)[0]


def candidate_features(candidates: DataFrame, template: Mapping[str, float], ranges: Ranges, temperature: str, ratio: str, hours: str) -> DataFrame:
    """Template values for absent columns, candidate values scaled and clipped by the trained ranges, interactions."""
    rows = candidates.withColumns({c: F.lit(v) for c, v in template.items() if c not in candidates.columns})
    scaled = {f"{c}_norm": ranges.scaled(c, clip=True) for c in ranges.low}
    out = rows.withColumns(scaled)
    return out.withColumns(interactions(F.col(f"{temperature}_norm"), F.col(f"{ratio}_norm"), F.col(f"{hours}_norm")))


def diversity_penalty(score, group_count, expected, strength: float = 0.5) -> Column:
    """C2."""
    s, n, e = as_column(score), as_column(group_count), as_column(expected)
    return s / (1 + F.lit(strength) * F.greatest(F.lit(0.0), n - e) / (e + 1e-9))


def diverse_batch(candidates: DataFrame, key: str, score: str, params: Sequence[str], label: str, size: int, weight: float = 0.3) -> DataFrame:
    """The batch as (batch_rank, key, combined).

    One aggregation per pick: the pick is a few numbers, and its distance joins a
    running minimum column on every candidate. Pairs are never formed. Lineage
    is cut every eight picks.
    """
    ranges = Ranges.fit(candidates, [score, *params])
    span = ranges.high[score] - ranges.low[score] + 1e-9

    def scaled(p: str) -> Column:
        width = ranges.high[p] - ranges.low[p]
        return (F.col(p).cast("double") - ranges.low[p]) / F.lit(width if width >= 1e-9 else 1.0)

    pool = candidates.select(
        key, F.col(label).alias("__label"), ((F.col(score) - ranges.low[score]) / F.lit(span)).alias("__q"),
        *[scaled(p).alias(f"__x{i}") for i, p in enumerate(params)], F.lit(None).cast("double").alias("__near"),
    )
    picks: list = []
    while len(picks) < size:
        worth = F.col("__q") if not picks else (1 - weight) * F.col("__q") + weight * F.col("__near")
        free = pool.filter(~F.col(key).isin([p[key] for p in picks])) if picks else pool
        best = free.withColumn("combined", worth).orderBy(F.desc("combined"), key).limit(1).collect()
        if not best:
            break
        pick = best[0]
        picks.append(pick)
        gap = sum(((F.col(f"__x{i}") - pick[f"__x{i}"]) * (F.col(f"__x{i}") - pick[f"__x{i}"]) for i in range(len(params))), F.lit(0.0))
        far = 0.5 * F.sqrt(gap) / F.lit(max(1, len(params)) ** 0.5) + 0.5 * F.when(F.col("__label") == pick["__label"], F.lit(0.0)).otherwise(F.lit(1.0))
        pool = pool.withColumn("__near", F.least(F.col("__near"), far))
        if len(picks) % 8 == 0:
            pool = cut(pool)
    rows = [(i, p[key], float(p["combined"])) for i, p in enumerate(picks, 1)]
    kind = dict(candidates.dtypes)[key]
    return candidates.sparkSession.createDataFrame(rows, f"batch_rank int, `{key}` {kind}, combined double")


def expected_improvement(mu, sigma, best: float, xi: float = 0.01) -> Column:
    """M11."""
    m, s = as_column(mu), as_column(sigma)
    gain = m - F.lit(float(best)) - F.lit(float(xi))
    z = gain / s
    return F.when(s > 1e-10, gain * normal_cdf(z) + s * normal_pdf(z)).otherwise(F.greatest(gain, F.lit(0.0)))


def fallback_chain(scores: DataFrame, chain: Sequence[str], threshold: float = 1e-4) -> DataFrame:
    """One row per score column of the chain up to the first usable one: maximum, range, degenerate, chosen."""
    row = scores.agg(*[f(c).alias(f"{c}__{n}") for c in chain for f, n in ((F.max, "max"), (F.min, "min"))])
    steps = F.array(*[
        F.struct(F.lit(i).alias("rung"), F.lit(c).alias("name"), F.col(f"{c}__max").alias("maximum"), (F.col(f"{c}__max") - F.col(f"{c}__min")).alias("spread"))
        for i, c in enumerate(chain)
    ])
    bad = lambda s: s["maximum"].isNull() | (s["maximum"] < threshold) | (s["spread"] < threshold)
    good = F.transform(F.filter(F.col("steps"), lambda s: ~bad(s)), lambda s: s["rung"])
    stop = F.coalesce(F.array_min(good), F.lit(len(chain) - 1))
    tried = row.select(steps.alias("steps")).withColumn("stop", stop).select("stop", F.explode("steps").alias("s"))
    return tried.filter(F.col("s.rung") <= F.col("stop")).select("s.*", (F.col("s.rung") == F.col("stop")).alias("chosen"))


def epsilon_greedy(scored: DataFrame, by: Sequence[str], score: str, key: str, epsilon: float = 0.1, seed: int = 0) -> DataFrame:
    """Per group a random row with probability epsilon, else the best one. Both are map-side maxima."""
    best = F.min_by(key, F.struct((-F.col(score)).alias("s"), F.col(key).alias("k")))
    lucky = F.min_by(key, F.struct(uniform(key, F.lit(seed)).alias("u"), F.col(key).alias("k")))
    both = scored.groupBy(*by).agg(best.alias("best"), lucky.alias("lucky"))
    explore = uniform(*[F.col(c) for c in by], F.lit(seed), F.lit("explore")) < epsilon
    return both.select(*by, F.when(explore, F.col("lucky")).otherwise(F.col("best")).alias(key), explore.alias("explored"))


# ---- trust region -----------------------------------------------------------------------


def _machine(start: float, low: float, high: float, success_tol: int, failure_tol: int, reset: float):
    """The reachable (length, successes, failures) states and the two transition tables between them."""

    def step(state, improved):
        length, s, f = state
        s, f = (s + 1, 0) if improved else (0, f + 1)
        if s >= success_tol:
            length, s = min(length * 2.0, high), 0
        if f >= failure_tol:
            length, f = length / 2.0, 0
            if length < low:
                length = reset
        return (length, s, f)

    states, todo = [(start, 0, 0)], [(start, 0, 0)]
    while todo:
        state = todo.pop()
        for improved in (False, True):
            nxt = step(state, improved)
            if nxt not in states:
                states.append(nxt)
                todo.append(nxt)
    return states, [[states.index(step(s, flag)) for s in states] for flag in (False, True)]


def _small_rises(flagged: DataFrame, campaign: str, score: str, least: float = 1e-6) -> DataFrame:
    """Set `__up` right where the highest score rose by `least` or less, so that the best lags behind it.

    Only rows above all before them can improve. A row that rises by more than `least` above all before it does, whatever the best; the rows of small rises that follow it are
    gone through in order, up to the next such row. Tables without small rises are left as they are.
    """
    rise = F.col(score) > F.col("__before")
    if flagged.filter(rise & (F.col("__up") == 0)).isEmpty():
        return flagged
    high = flagged.filter(rise | F.col("__before").isNull()).select(campaign, "rn", F.col(score).alias("__s"), "__up")
    chains = running(high, [campaign], "rn", "rn", {"__chain": ("sum", "__up")}).groupBy(campaign, "__chain").agg(F.array_sort(F.collect_list(F.struct("rn", "__s"))).alias("rows"))
    start = F.struct(F.lit(float("-inf")).alias("best"), F.array().cast("array<bigint>").alias("taken"))

    def take(acc, r):
        better = r["__s"] > acc["best"] + least
        return F.struct(F.when(better, r["__s"]).otherwise(acc["best"]).alias("best"), F.when(better, F.array_append(acc["taken"], r["rn"])).otherwise(acc["taken"]).alias("taken"))

    taken = chains.select(campaign, F.explode(F.aggregate("rows", start, take)["taken"]).alias("rn")).withColumn("__took", F.lit(1))
    return flagged.drop("__up").join(taken, [campaign, "rn"], "left").withColumn("__up", F.coalesce("__took", F.lit(0))).drop("__took")


def trust_region(history: DataFrame, campaign: str, step: str, score: str, start: float = 0.8, low: float = 0.1, high: float = 1.6,
                 success_tol: int = 3, failure_tol: int = 3, reset: float = 0.8, chunk: int = 10_000) -> DataFrame:
    """Length, counters and best score of each campaign after its last update.

    The rule has few reachable states, so a stretch of updates is a map from
    state to state. Maps of stretches of `chunk` updates are made in parallel and
    composed in rounds until one per campaign is left: no task sees more than
    `chunk` rows of a campaign. An update improves when it beats the best by more
    than 1e-6, and is then the best; a smaller rise leaves the best as it was.
    """
    states, tables = _machine(start, low, high, success_tol, failure_tol, reset)
    # the place of a row in the order is its number, so ordering needs one more scan only for `improved`
    seen = running(history, [campaign], step, step, {"__best": ("max", score), "rn": ("count", F.lit(1))})
    from ..functions.scan import lagged

    flagged = lagged(seen, [campaign], "__best", "rn", "__before").withColumn(
        "__up", F.when(F.col("__before").isNull() | (F.col(score) > F.col("__before") + 1e-6), F.lit(1)).otherwise(F.lit(0))
    )
    flagged = _small_rises(cut(flagged), campaign, score)
    identity = F.array(*[F.lit(i) for i in range(len(states))])
    moves = F.array(*[F.array(*[F.lit(x) for x in t]) for t in tables])
    runs = flagged.groupBy(campaign, F.floor((F.col("rn") - 1) / chunk).alias("part")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rn", "__up"))), lambda r: r["__up"]).alias("ups"),
        F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("__up") == 1, F.col(score))).alias("best"),
    )
    maps = runs.select(
        campaign, "part", "n", "best",
        F.aggregate("ups", identity, lambda acc, up: F.transform(acc, lambda s: F.get(F.get(moves, up), s))).alias("m"),
    )
    rounds, size = 0, 1
    longest = runs.agg(F.max("part")).first()[0] or 0
    while size <= longest:
        size *= chunk
        rounds += 1
    for _ in range(max(1, rounds)):
        grouped = maps.groupBy(campaign, F.floor(F.col("part") / chunk).alias("part")).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("part", "m"))), lambda r: r["m"]).alias("ms"), F.sum("n").alias("n"), F.max("best").alias("best")
        )
        maps = grouped.select(campaign, "part", "n", "best", F.aggregate("ms", identity, lambda acc, m: F.transform(acc, lambda s: F.get(m, s))).alias("m"))
    ends = F.array(*[F.struct(F.lit(a).alias("length"), F.lit(b).alias("successes"), F.lit(c).alias("failures")) for a, b, c in states])
    return maps.withColumn("end", F.get(ends, F.get("m", F.lit(0)))).select(campaign, "end.length", "end.successes", "end.failures", "best", F.col("n").alias("n_updates"))


def region_bounds(params: DataFrame, length, center="center", low="low", high="high", scale="scale") -> DataFrame:
    """Centre +/- length * scale * range / 2, clipped; the full range when that is empty."""
    lo, hi = as_column(low), as_column(high)
    half = as_column(length) * F.coalesce(as_column(scale), F.lit(1.0)) * (hi - lo) / 2
    c = F.coalesce(as_column(center), (lo + hi) / 2)
    a, b = F.greatest(lo, F.least(hi, c - half)), F.greatest(lo, F.least(hi, c + half))
    ok = a < b
    return params.withColumns({"region_low": F.when(ok, a).otherwise(lo), "region_high": F.when(ok, b).otherwise(hi)})


def region_start(params: DataFrame, by: Sequence[str], spread="spread", low="low", high="high") -> DataFrame:
    """Initial length per campaign: mean of min(1, 2 * spread / range), within [0.3, 0.8]."""
    width = as_column(high) - as_column(low)
    part = F.when(width > 0, F.least(F.lit(1.0), 2 * F.coalesce(as_column(spread), width / 4) / width))
    return params.groupBy(*by).agg(F.greatest(F.lit(0.3), F.least(F.lit(0.8), F.coalesce(F.avg(part), F.lit(0.8)))).alias("length"))


def param_scale(spread="spread", low="low", high="high") -> Column:
    """Spread against a quarter of the range, within [0.5, 2]."""
    width = as_column(high) - as_column(low)
    ratio = as_column(spread) / F.greatest(width / 4, F.lit(1e-9))
    return F.when((width > 0) & as_column(spread).isNotNull(), F.greatest(F.lit(0.5), F.least(F.lit(2.0), ratio))).otherwise(F.lit(1.0))


def recentre(rows: DataFrame, exact: Column, neighbour: Column, score: str, key: str, floor: float = 5.0) -> DataFrame:
    """Best exact match when its score reaches the floor, else best neighbour, else best of all (first on ties)."""
    level = F.when(exact & neighbour & (F.col(score) >= floor), F.lit(0)).when(neighbour, F.lit(1)).otherwise(F.lit(2))
    order = F.struct(level.alias("level"), (-F.col(score)).alias("s"), F.col(key).alias("k"))
    return rows.agg(F.min(order).alias("o")).select(F.col("o.k").alias(key), F.element_at(F.array(F.lit("exact"), F.lit("neighbour"), F.lit("global")), F.col("o.level") + 1).alias("source"), (-F.col("o.s")).alias("best"))


def score_scope(neighbours: DataFrame, score: str, least: int = 8) -> DataFrame:
    """Whether the neighbourhood is large and varied enough to train the score on."""
    row = neighbours.agg(F.count(F.lit(1)).alias("n"), F.max(score).alias("best"), (F.max(score) - F.min(score)).alias("spread"))
    return row.select("n", "best", F.when((F.col("n") >= least) & (F.col("spread") > 0), "neighborhood").otherwise("global").alias("scope"))


def similarity_level(value) -> Column:
    """C11."""
    v = as_column(value)
    return F.when(v < 0.30, "low").when(v < 0.60, "medium").otherwise("high")


def pair_label(first, second, phi=None) -> Column:
    """C17: first, or first+second unless pure."""
    a = F.coalesce(F.upper(F.trim(as_column(first))), F.lit("UNKNOWN"))
    b = F.coalesce(F.upper(F.trim(as_column(second))), F.lit(""))
    pure = b.isin("", "NA", "NONE") if phi is None else F.coalesce(as_column(phi), F.lit(1.0)) >= 1
    return F.when(pure, a).otherwise(F.concat(a, F.lit("+"), b))


def shingle_fingerprint(text, bits: int = 2048, width: int = 3, pattern: str = "[^a-z]+") -> Column:
    """Sorted bits set by the word shingles of a whole text.

    The words are bound to a lambda variable, so a text is split once however
    many shingles it has and wherever the optimizer moves the expression.
    """
    words = F.filter(F.split(F.lower(as_column(text)), pattern), lambda w: F.length(w) > 0)

    def fold(w: Column) -> Column:
        heads = F.slice(w, F.lit(1), F.greatest(F.size(w) - (width - 1), F.lit(0)))
        return fold_tokens(F.transform(heads, lambda x, i: F.concat_ws(" ", x, *[F.get(w, i + j) for j in range(1, width)])), bits)

    return F.get(F.transform(F.array(words), fold), F.lit(0))


# ---- neighbourhood template ---------------------------------------------------------------


def set_similarity(roles: Mapping[str, tuple[Column, float]], columns: Mapping[str, str]) -> Column:
    """Weighted Tanimoto over roles; the weights of absent roles are spread over the others.

    `roles` gives per role the target's token array (or None) and its weight;
    `columns` the token array column of each role.
    """
    present = {r: (t, w) for r, (t, w) in roles.items() if t is not None}
    total = sum(w for _, w in present.values())
    return sum((tanimoto(columns[r], t) * (w / total) for r, (t, w) in present.items()), F.lit(0.0))


def blended_similarity(rows: DataFrame, key: str, fp: Column, vector: str, blend: float = 0.3) -> DataFrame:
    """C6 stages 1 and 2: token similarity, cosine to the vector of its best row that has one, and their blend; a row without a vector has cosine 0."""
    first = rows.withColumn("fp_sim", fp)
    best = first.where(F.col(vector).isNotNull()).agg(F.min_by(vector, F.struct((-F.col("fp_sim")).alias("s"), F.col(key).alias("k")))).scalar()
    out = first.withColumn("__ref", best).withColumn("feat_sim", F.coalesce(cosine(vector, "__ref"), F.lit(0.0))).drop("__ref")
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("feat_sim")))
    return out.withColumn("combined_sim", blend * F.col("fp_sim") + (1 - blend) * clipped)


def nearest_rows(similar: DataFrame, key: str, top: int = 15, least: float = 0.05) -> DataFrame:
    """The `top` rows above a minimum similarity."""
    return similar.filter(F.col("combined_sim") >= least).orderBy(F.desc("combined_sim"), key).limit(top)


def neighbourhood_template(neighbours: DataFrame, key: str, tokens: str, hub: str, target_hub: str, score: str,
                           bounds: Mapping[str, tuple[float, float]], strat: float = 0.85, success: float = 5.0) -> DataFrame:
    """(param, center, spread) from the nearest rows (a handful).

    When the rows look alike by tokens (mean pairwise similarity at least
    `strat`), only those of the target's hub class count, if there are two. The
    centre is the weighted mean over successes (if there are two), the spread
    the population deviation over the whole pool.
    """
    # each row carries the token sets of the others as one array: a handful of rows, no join
    sets = neighbours.agg(F.collect_list(F.struct(F.col(key).alias("k"), F.col(tokens).alias("t")))).scalar()
    later = neighbours.withColumn("__sets", sets).select(F.col(key), F.col(tokens), F.explode("__sets").alias("o")).filter(F.col("o.k") > F.col(key))
    alike = later.agg(F.coalesce(F.avg(tanimoto(tokens, "o.t")), F.lit(0.0))).scalar()
    of_hub = neighbours.agg(F.count_if(F.col(hub) == target_hub)).scalar()
    tagged = neighbours.withColumns({"__alike": alike, "__of_hub": of_hub})
    pool = tagged.filter(~((F.col("__alike") >= strat) & (F.col("__of_hub") >= 2)) | (F.col(hub) == target_hub))
    params = F.array(*[
        F.struct(F.lit(p).alias("param"), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), F.coalesce(F.col(p).cast("double"), F.lit((lo + hi) / 2)))).alias("v"))
        for p, (lo, hi) in bounds.items()
    ])
    good = F.coalesce(F.col(score), F.lit(0.0)) >= success
    long = pool.select("combined_sim", F.coalesce(F.col(score), F.lit(0.0)).alias("__s"), good.alias("__good"), F.explode(params).alias("p")).select("*", "p.*")
    w = F.col("combined_sim") * (F.col("__s") + 1)
    mean = lambda c: F.try_divide(F.sum(F.when(c, F.col("v") * w)), F.sum(F.when(c, w)))
    every = F.lit(True)
    out = long.groupBy("param").agg(
        F.when(F.count_if("__good") >= 2, mean(F.col("__good"))).otherwise(mean(every)).alias("center"), F.avg("v").alias("__plain"), F.stddev_pop("v").alias("spread")
    )
    return out.select("param", F.coalesce("center", "__plain").alias("center"), "spread")


def max_similarity(rows: DataFrame, vector: str, target: Column) -> DataFrame:
    """The largest cosine of one target to all rows."""
    return rows.withColumn("__t", target).agg(F.max(cosine(vector, "__t")).alias("max_similarity"))
