"""Regression trees of every entity at once, grown level by level.

All trees of all entities share each step; nothing is fitted inside a single task.
Rows know the node they are in as a column. A level is one aggregate over (entity,
tree, node, feature, bin): weight, sum and extent of each bin. Running sums along the bins
give the gain of every cut, the best cut of a node is a grouped maximum, and the rows move on
by a join with the cuts. A node stays a leaf when its targets are all equal or no
feature tells its rows apart, so depth is bounded only by the data (or by ``max_depth``).

Bins are the distinct values of a feature in its entity, in order; with more than ``MAX_BINS`` of
them, runs of neighbouring ranks share a bin. A threshold is midway between the
neighbouring values of the node. Targets enter as integers (``DECIMALS`` decimals), so sums are
exact and equal gains stay equal however the rows are dealt out: ties go to the first
feature, then to the lowest cut. Infinite features are ordinary ends of the order, NaN is above
them. Bootstrap weights are Poisson(1), drawn by an integer recurrence over
(row position, tree, seed): any engine can repeat them.

Rows: ``entity_id``, ``date``, ``y`` DOUBLE, ``x`` ARRAY<DOUBLE>. Nodes: entity_id, tree,
level, node, n, value, feature (position in ``x``), threshold, gain, left (right is
left + 1; NULL in a leaf).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.session import Spool

MAX_BINS = 256
DECIMALS = 6
# Forest settings of the reference (100 trees, seed 42, at least 30 rows).
N_TREES = 100
SEED = 42
MIN_ROWS = 30
#: The distribution function of Poisson(1) at 0, 1, 2, ...
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676)
PRIME = 2147483647
NODE = ["entity_id", "tree", "node"]
LIMIT = 1e11                  # largest |y|; beyond it exact sums could overflow


def poisson_weight(row: Column, tree: Column, seed: int = SEED) -> Column:
    """Bootstrap weight of a training row (its position by date) in a tree."""
    a = (row * 7919 + tree * 104729 + F.lit(seed * 1299709 + 12345).cast("long")) % PRIME
    for c in (1013904223, 362437):
        a = (a * a + F.lit(c)) % PRIME
    u = a / F.lit(float(PRIME))
    out = F.lit(len(POISSON))
    for k, p in reversed(list(enumerate(POISSON))):
        out = F.when(u < p, F.lit(k)).otherwise(out)
    return out.cast("long")


def positions(train: DataFrame) -> DataFrame:
    """``row``: the position of a training row by date within its entity."""
    w = Window.partitionBy("entity_id").orderBy("date")
    return train.select("entity_id", "y", "x", (F.row_number().over(w) - 1).cast("long").alias("row"))


def binned(rows: DataFrame, max_bins: int = MAX_BINS) -> DataFrame:
    """(entity_id, row, cells ARRAY<STRUCT<f, bin, x>>)."""
    long = rows.select("entity_id", "row", F.posexplode("x").alias("f", "x"))
    rank = F.dense_rank().over(Window.partitionBy("entity_id", "f").orderBy("x"))
    r = long.withColumn("_r", rank).withColumn("_k", F.max("_r").over(Window.partitionBy("entity_id", "f")))
    bin_ = F.when(F.col("_k") <= max_bins, F.col("_r")).otherwise(F.expr(f"CAST((_r - 1) * {max_bins}L DIV _k AS INT) + 1"))
    return r.groupBy("entity_id", "row").agg(F.array_sort(F.collect_list(F.struct("f", bin_.alias("bin"), "x"))).alias("cells"))


def _nodes(at: DataFrame, cells: DataFrame, level: int, max_depth: int | None) -> DataFrame:
    """The nodes of a level with their best cuts."""
    s = F.col("w") * F.col("target")
    stats = at.groupBy(*NODE).agg(F.sum("w").alias("n"), F.sum(s).alias("_s"), F.min("target").alias("_min"),
                                  F.max("target").alias("_max"))
    value = F.col("_s").cast("double") / F.col("n") / F.lit(10.0 ** DECIMALS)
    leaf = stats.select(*NODE, F.lit(level).alias("level"), "n", value.alias("value"), "_s", "_min", "_max")
    if max_depth is not None and level >= max_depth:
        return leaf.select(*NODE, "level", "n", "value", *[F.lit(None).cast(t).alias(c) for c, t in (
            ("feature", "int"), ("threshold", "double"), ("gain", "double"), ("left", "long"))])
    open_ = stats.filter(F.col("_min") < F.col("_max")).select(*NODE)
    hist = (at.join(open_, NODE).join(cells, ["entity_id", "row"]).select(*NODE, "w", s.alias("s"), F.inline("cells"))
            .groupBy(*NODE, "f", "bin").agg(F.sum("w").alias("w"), F.sum("s").alias("s"), F.min("x").alias("lo"), F.max("x").alias("hi")))
    whole = Window.partitionBy(*NODE, "f")
    along = whole.orderBy("bin")
    cum = hist.select(*NODE, "f", "bin", "hi", F.sum("w").over(along).cast("double").alias("wl"),
                      F.sum("s").over(along).cast("double").alias("sl"), F.sum("w").over(whole).cast("double").alias("wa"),
                      F.sum("s").over(whole).cast("double").alias("sa"), F.lead("lo").over(along).alias("next"))
    wl, sl, wr, sr = F.col("wl"), F.col("sl"), F.col("wa") - F.col("wl"), F.col("sa") - F.col("sl")
    gain = sl * sl / wl + sr * sr / wr
    mid = (F.col("hi") + F.col("next")) / 2
    cuts = cum.filter(F.col("wl") < F.col("wa")).select(
        *NODE, "f", "bin", F.when(mid < F.col("next"), mid).otherwise(F.col("hi")).alias("thr"), gain.alias("g"))
    best = cuts.groupBy(*NODE).agg(F.max(F.struct("g", (-F.col("f")).alias("nf"), (-F.col("bin")).alias("nb"), "thr")).alias("b"))
    k = F.row_number().over(Window.partitionBy("entity_id", "tree").orderBy("node"))
    best = best.select(*NODE, F.col("b"), (2 * (k - 1)).cast("long").alias("left"))
    base = F.col("_s").cast("double") * F.col("_s").cast("double") / F.col("n")
    return leaf.join(best, NODE, "left").select(
        *NODE, "level", "n", "value", (-F.col("b.nf")).cast("int").alias("feature"), F.col("b.thr").alias("threshold"),
        ((F.col("b.g") - base) / F.lit(10.0 ** (2 * DECIMALS))).alias("gain"), "left")


def grow(rows: DataFrame, n_trees: int = 1, max_depth: int | None = None, seed: int | None = SEED, max_bins: int = MAX_BINS,
         sp: Spool | None = None, cells: DataFrame | None = None) -> DataFrame:
    """Fits ``n_trees`` trees for each entity of ``rows`` (entity_id, row, y, x; y finite and at most
    ``LIMIT`` in size) and returns their nodes, written. ``seed=None``: one weight for all, no bootstrap. ``cells``: the
    rows' :func:`binned` features, where they are at hand."""
    sp = sp or Spool(rows.sparkSession)
    scratch = Spool(rows.sparkSession)
    if cells is None:
        cells = sp.put(binned(rows, max_bins))
    target = F.round(F.col("y") * F.lit(10.0 ** DECIMALS)).cast("long")
    tree = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_trees - 1).cast("long"))).alias("tree")
    w = F.lit(1).cast("long") if seed is None else poisson_weight(F.col("row"), F.col("tree"), seed)
    at = scratch.put(rows.select("entity_id", "row", target.alias("target"), tree)
                     .withColumn("w", w).filter("w > 0").withColumn("node", F.lit(0).cast("long")))
    levels, level = [], 0
    while True:
        nodes = sp.put(_nodes(at, cells, level, max_depth))
        levels.append(nodes)
        cuts = nodes.filter("feature IS NOT NULL").select(*NODE, "feature", "threshold", "left")
        if cuts.isEmpty():
            break
        right = F.expr("cells[feature].x > threshold").cast("long")
        at = scratch.put(at.join(cuts, NODE).join(cells, ["entity_id", "row"]).select(
            "entity_id", "row", "target", "tree", "w", (F.col("left") + right).alias("node")))
        scratch.drop(keep_last=1)
        level += 1
    out = levels[0]
    for n in levels[1:]:
        out = out.unionByName(n)
    scratch.drop()
    return sp.put(out.select("entity_id", "tree", "level", "node", "n", "value", "feature", "threshold", "gain", "left"))


def predict(nodes: DataFrame, rows: DataFrame, keys: list[str], sp: Spool | None = None) -> DataFrame:
    """(``keys``, prediction): the mean over the trees of the row's entity, one join for each level.
    ``keys`` identify a row and include entity_id; rows of entities without trees have no prediction."""
    sp = sp or Spool(rows.sparkSession)
    scratch = Spool(rows.sparkSession)
    depth = nodes.agg(F.max("level")).first()[0]
    roots = nodes.filter("level = 0").select("entity_id", "tree")
    at = rows.select(*keys, "x").join(roots, "entity_id").withColumn("node", F.lit(0).cast("long"))
    done = []
    for level in range((-1 if depth is None else depth) + 1):
        here = nodes.filter(F.col("level") == level).select(*NODE, "value", "feature", "threshold", "left")
        met = sp.put(at.join(here, NODE))
        done.append(met.filter("feature IS NULL").select(*keys, "tree", "value"))
        at = met.filter("feature IS NOT NULL").select(
            *keys, "x", "tree", (F.col("left") + F.expr("x[feature] > threshold").cast("long")).alias("node"))
    if not done:
        return rows.limit(0).select(*keys, F.lit(0.0).alias("prediction"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.groupBy(*keys).agg((F.sum(F.col("value").cast("decimal(38,12)")).cast("double") / F.count("value")).alias("prediction"))


def usable(train: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """(entity_id, n_train, n_features, status) of each entity's training rows."""
    from panelcast.operators.linear import INSUFFICIENT, MIXED, NOT_FINITE, OK
    good = F.col("y").isNotNull() & ~F.isnan("y") & (F.abs("y") <= LIMIT)
    s = train.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_train"), F.min(F.size("x")).alias("_p"), F.max(F.size("x")).alias("_q"),
                                       F.min(good).alias("_good"))
    status = (F.when(F.col("_p") != F.col("_q"), F.lit(MIXED)).when(F.col("n_train") < min_rows, F.lit(INSUFFICIENT))
              .when(~F.col("_good"), F.lit(NOT_FINITE)).otherwise(F.lit(OK)))
    return s.select("entity_id", "n_train", F.col("_q").cast("bigint").alias("n_features"), status.alias("status"))


def fit_forest(train: DataFrame, n_trees: int = N_TREES, max_depth: int | None = None, seed: int = SEED, min_rows: int = MIN_ROWS,
               sp: Spool | None = None) -> tuple[DataFrame, DataFrame]:
    """M4: (nodes, fits) of one forest for each entity; ``fits`` has a status for each entity."""
    sp = sp or Spool(train.sparkSession)
    fits = sp.put(usable(train, min_rows))
    rows = sp.put(positions(train.join(fits.filter("status = 'ok'").select("entity_id"), "entity_id")))
    return grow(rows, n_trees, max_depth, seed, sp=sp), fits


def importances(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """M5: (entity_id, feature, importance, rank) of every feature: its share of a tree's gains, averaged over
    the trees that have a cut; ranked by 9 decimals, ties by name. ``names``: (entity_id, features ARRAY<STRING>), one row for each entity."""
    gains = nodes.filter("feature IS NOT NULL").groupBy("entity_id", "tree", "feature").agg(F.sum("gain").alias("g"))
    share = gains.withColumn("_t", F.sum("g").over(Window.partitionBy("entity_id", "tree"))).withColumn(
        "s", F.when(F.col("_t") > 0, F.col("g") / F.col("_t")).otherwise(F.lit(0.0)))
    trees = gains.groupBy("entity_id").agg(F.countDistinct("tree").alias("_n"))
    mean = share.groupBy("entity_id", "feature").agg(F.sum("s").alias("s")).join(trees, "entity_id").select(
        "entity_id", "feature", (F.col("s") / F.col("_n")).alias("importance"))
    all_ = names.join(trees.select("entity_id"), "entity_id").select("entity_id", F.posexplode("features").alias("_f", "name"))
    out = all_.join(mean, (all_.entity_id == mean.entity_id) & (F.col("_f") == mean.feature), "left").select(
        all_.entity_id, F.col("name").alias("feature"), F.coalesce("importance", F.lit(0.0)).alias("importance"))
    rank = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.round("importance", 9).desc(), "feature"))
    return out.withColumn("rank", rank.cast("bigint"))


def boost(train: DataFrame, rounds: int = 30, max_depth: int = 3, rate: float = 0.1, min_rows: int = MIN_ROWS,
          sp: Spool | None = None) -> tuple[DataFrame, DataFrame]:
    """Additive rounds for every entity: the residual is a column, each round grows one tree of all entities on it
    (squared loss, so the gradient is the residual and every hessian 1) and adds ``rate`` times its values. The first value is the
    mean, as tree -1. Returns (nodes, fits); nodes hold values already multiplied by ``rate``."""
    sp = sp or Spool(train.sparkSession)
    fits = sp.put(usable(train, min_rows))
    rows = sp.put(positions(train.join(fits.filter("status = 'ok'").select("entity_id"), "entity_id")))
    cells = sp.put(binned(rows))
    first = grow(rows, max_depth=0, seed=None, sp=sp, cells=cells).withColumn("tree", F.lit(-1).cast("long"))
    means = first.select("entity_id", F.col("value").alias("_m"))
    left = sp.put(rows.join(means, "entity_id").withColumn("y", F.col("y") - F.col("_m")).drop("_m"))
    out = first
    for r in range(rounds):
        nodes = sp.put(grow(left, max_depth=max_depth, seed=None, sp=sp, cells=cells).withColumn("tree", F.lit(r).cast("long"))
                       .withColumn("value", F.col("value") * F.lit(rate)))
        step = predict(nodes, left, ["entity_id", "row"], sp)
        left = sp.put(left.join(step, ["entity_id", "row"]).withColumn("y", F.col("y") - F.col("prediction")).drop("prediction"))
        out = out.unionByName(nodes)
    return sp.put(out), fits


def predict_boosted(nodes: DataFrame, rows: DataFrame, keys: list[str], sp: Spool | None = None) -> DataFrame:
    """The sum, not the mean, over the trees."""
    n = nodes.filter("level = 0").groupBy("entity_id").agg(F.count(F.lit(1)).alias("_n"))
    return (predict(nodes, rows, keys, sp).join(n, "entity_id")
            .select(*keys, (F.col("prediction") * F.col("_n")).alias("prediction")))
