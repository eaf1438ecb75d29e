"""Regression trees per key on histograms: forests, boosting, importances.

All trees of all keys grow together, level by level. Features are cut once per
key into at most ``n_bins`` bins at quantiles of its train rows. For a level,
every row is led to its node of every tree, and (key, tree, node, feature, bin)
sums are added up by partial aggregation, so a key's rows may lie anywhere and a
hot key is combined before the shuffle. The best cut of every node is chosen
from these sums alone. The driver loops over levels (and boosting rounds), never
over keys, trees or rows, and collects nothing.

Targets are held as whole numbers of 1/SCALE, so all sums are exact and the
trees are the same on any partitioning. Ties go to the first feature, then the
lowest cut. A node is a row (keys, tree, level, node, n, feature, bin, gain,
value, left_value, right_value); a leaf has a null feature. Node k has the
children 2k + 1 (feature <= edge) and 2k + 2.

Rows that miss a feature or the target are left out. A key without train rows
has no trees and no predictions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators.clean import drop_missing
from panelcast.operators.split import target_scaling
from panelcast.session import cut_lineage

SCALE = 10_000       # of a target in its own unit
N_BINS = 16
UNIT_SCALE = 1 << 24  # of a standardised target
_STEP = "struct<node:int,value:double>"


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def bin_edges(df: DataFrame, features: Sequence[str], key: str | Sequence[str], train: Column, n_bins: int = N_BINS) -> DataFrame:
    """One row per key: ``edges``, for each feature the n_bins - 1 quantiles of its train rows."""
    cuts = F.array(*[F.lit(k / n_bins) for k in range(1, n_bins)])
    found = [F.percentile_approx(F.when(train, F.col(f"`{f}`").cast("double")), cuts, 10_000) for f in features]
    return df.groupBy(*_keys(key)).agg(F.array(*found).alias("edges"))


def binned(df: DataFrame, features: Sequence[str], key: str | Sequence[str] = "ticker",
           train_flag: str = "is_test", n_bins: int = N_BINS) -> DataFrame:
    """``df`` with ``bins``: for each feature, how many edges lie below the value."""
    rows = drop_missing(df, list(features))
    train = F.col(train_flag) == F.lit(False)
    joined = rows.join(bin_edges(rows, features, key, train, n_bins), _keys(key))
    values = F.array(*[F.col(f"`{f}`").cast("double") for f in features])
    below = F.zip_with("edges", values, lambda e, x: F.size(F.filter(e, lambda v: v < x)))
    return joined.withColumn("bins", below).drop("edges")


def _dealt(rows: DataFrame, keys: Sequence[str], row: Sequence[str]) -> DataFrame:
    """Rows dealt out evenly: every row is looked at once for each tree and
    feature, far more work than its size tells."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(rows.repartition(parts, *keys, *row))


def _bootstrap(row: Sequence[str], num_trees: int, seed: int) -> Column:
    """How often each tree draws a row: Poisson(1) by a hash of the row, as an array."""
    law, total, p = [], 0.0, 0.36787944117144233
    for k in range(8):
        total += p
        law.append((k, total))
        p /= k + 1

    def drawn(t):
        u = F.pmod(F.xxhash64(F.lit(seed), t, *[F.col(c) for c in row]), F.lit(1 << 30)) / float(1 << 30)
        out = F.lit(8)
        for k, upto in reversed(law):
            out = F.when(u < upto, k).otherwise(out)
        return out
    return F.transform(F.sequence(F.lit(0), F.lit(num_trees - 1)), drawn)


_ENTRY = "struct<feature:int,bin:int,value:double,left_value:double,right_value:double>"


def _model(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key: ``model``, the cuts and values of its nodes by tree, then by node."""
    entry = F.struct("feature", "bin", "value", "left_value", "right_value")
    trees = nodes.groupBy(*keys, "tree").agg(F.map_from_entries(F.collect_list(F.struct("node", entry))).alias("own"))
    return trees.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("tree", "own"))).alias("model"))


def _walk(tree: Column, levels: int) -> Column:
    """(node, value) of a row in a tree after ``levels`` cuts."""
    def step(at, own):
        found = F.try_element_at(own, at["node"])
        right = F.element_at("bins", found["feature"] + 1) > found["bin"]
        return (F.when(found.isNull(), at)
                .when(found["feature"].isNull(), F.struct(at["node"].alias("node"), found["value"].alias("value")))
                .otherwise(F.struct((at["node"] * 2 + F.when(right, 2).otherwise(1)).cast("int").alias("node"),
                                    F.when(right, found["right_value"]).otherwise(found["left_value"]).alias("value"))))
    start = F.struct(F.lit(0).alias("node"), F.lit(None).cast("double").alias("value")).cast(_STEP)
    if levels == 0:
        return start
    own = F.try_element_at("model", tree)
    return F.aggregate(F.array_repeat(own, levels), start, lambda at, tree_map: step(at, tree_map).cast(_STEP))


def _led(rows: DataFrame, nodes: DataFrame | None, keys: Sequence[str], num_trees: int, levels: int) -> DataFrame:
    """``rows`` with ``places``: (node, value) in every tree."""
    if nodes is None:
        rows = rows.withColumn("model", F.expr(f"cast(null as map<int, map<int, {_ENTRY}>>)"))
    else:
        rows = rows.join(_model(nodes, keys), list(keys), "left")
    trees = F.sequence(F.lit(0), F.lit(num_trees - 1))
    return rows.withColumn("places", F.transform(trees, lambda t: _walk(t, levels))).drop("model")


def _open(level: int) -> Column:
    """Whether a node lies on ``level`` (and so isn't settled above it)."""
    return (F.col("node") >= (1 << level) - 1) & (F.col("node") < (1 << (level + 1)) - 1)


def best_cuts(rows: DataFrame, keys: Sequence[str], level: int, max_depth: int, min_leaf: int = 1,
              l2: float = 0.0, scale: float = SCALE) -> DataFrame:
    """Nodes of one level from the train rows (keys, target, weights, places, bins)."""
    trees = rows.select(*keys, "target", "bins", F.posexplode(F.arrays_zip("weights", "places")).alias("tree", "t"))
    live = (trees.select(*keys, "tree", F.col("t.weights").cast("long").alias("w"), F.col("t.places.node").alias("node"), "target", "bins")
            .where((F.col("w") > 0) & _open(level)))
    cells = (live.select(*keys, "tree", "node", "w", (F.col("w") * F.col("target")).alias("s"), F.posexplode("bins").alias("feature", "bin"))
             .groupBy(*keys, "tree", "node", "feature", "bin").agg(F.sum("w").alias("n"), F.sum("s").alias("s")))
    of_feature = Window.partitionBy(*keys, "tree", "node", "feature")
    upto = of_feature.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = cells.select(*keys, "tree", "node", "feature", "bin", F.sum("n").over(upto).alias("n_left"), F.sum("s").over(upto).alias("s_left"),
                        F.sum("n").over(of_feature).alias("n"), F.sum("s").over(of_feature).alias("s"))
    n_right, s_right = F.col("n") - F.col("n_left"), F.col("s") - F.col("s_left")

    def part(s, n):
        s = s.cast("double") / float(scale)
        return s * s / (n.cast("double") + float(l2))

    gain = part(F.col("s_left"), F.col("n_left")) + part(s_right, n_right) - part(F.col("s"), F.col("n"))
    may = (F.col("n_left") >= min_leaf) & (n_right >= min_leaf) & F.lit(level < max_depth)
    # sums are exact, so cuts that part the rows alike have equal gains
    cut = F.when(may, F.struct(gain.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "n_left", "s_left"))
    best = sums.groupBy(*keys, "tree", "node").agg(F.max(cut).alias("c"), F.max("n").alias("n"), F.max("s").alias("s"))
    split = F.col("c.gain") > 0
    value = lambda s, n: s.cast("double") / float(scale) / (n.cast("double") + float(l2))
    return best.select(
        *keys, "tree", F.lit(level).alias("level"), "node", "n",
        F.when(split, -F.col("c.f")).cast("int").alias("feature"), F.when(split, -F.col("c.b")).cast("int").alias("bin"),
        F.when(split, F.col("c.gain")).otherwise(F.lit(0.0)).alias("gain"), value(F.col("s"), F.col("n")).alias("value"),
        F.when(split, value(F.col("c.s_left"), F.col("c.n_left"))).alias("left_value"),
        F.when(split, value(F.col("s") - F.col("c.s_left"), F.col("n") - F.col("c.n_left"))).alias("right_value"))


def _grow(rows: DataFrame, keys: Sequence[str], train: Column, num_trees: int, max_depth: int, min_leaf: int,
          l2: float, scale: float) -> DataFrame:
    """All nodes of all trees of all keys. ``rows`` has bins, target and weights."""
    nodes = None
    rows = rows.where(train).select(*keys, "bins", "target", "weights")
    for level in range(max_depth):
        placed = _led(rows, nodes, keys, num_trees, level)
        own = cut_lineage(best_cuts(placed, keys, level, max_depth, min_leaf, l2, scale))
        nodes = own if nodes is None else nodes.unionByName(own)
    return nodes


def fit_forest(df: DataFrame, features: Sequence[str], y: str = "y", key: str | Sequence[str] = "ticker",
               row: Sequence[str] = ("month",), train_flag: str = "is_test", num_trees: int = 50, max_depth: int = 5,
               n_bins: int = N_BINS, min_leaf: int = 1, bootstrap: bool = True, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(nodes, rows): a forest for every key, and the binned rows it can score.

    ``row`` names the columns that tell a key's rows apart; with them a row's
    draws are the same in every run.
    """
    keys = _keys(key)
    rows = binned(df.where(F.col(y).isNotNull()), features, keys, train_flag, n_bins)
    weights = _bootstrap([*keys, *row], num_trees, seed) if bootstrap else F.array_repeat(F.lit(1), num_trees)
    rows = _dealt(rows.withColumns({"target": F.round(F.col(y) * SCALE).cast("long"), "weights": weights}), keys, row)
    train = F.col(train_flag) == F.lit(False)
    return _grow(rows, keys, train, num_trees, max_depth, min_leaf, 0.0, SCALE), rows


def predict_forest(rows: DataFrame, nodes: DataFrame, num_trees: int, max_depth: int, key: str | Sequence[str] = "ticker",
                   out: str = "predicted") -> DataFrame:
    """Mean of the trees' values for binned rows; a tree that drew none of a
    key's rows has no say."""
    placed = _led(rows, nodes, _keys(key), num_trees, max_depth)
    said = F.filter(F.transform("places", lambda p: p["value"]), lambda v: v.isNotNull())
    mean = F.try_divide(F.aggregate(said, F.lit(0.0), lambda a, v: a + v), F.size(said))
    return placed.withColumn(out, mean).drop("places", "bins", "weights", "target")


def importances(nodes: DataFrame, features: Sequence[str], key: str | Sequence[str] = "ticker") -> DataFrame:
    """(key, feature, importance), all features; importances of a key sum to 1.

    Gains are normalised in each tree, then averaged over the trees with a cut;
    a key without any cut has zeros.
    """
    keys = _keys(key)
    cuts = nodes.where("feature is not null")
    of_tree = cuts.groupBy(*keys, "tree", "feature").agg(F.sum("gain").alias("g"))
    share = of_tree.select(*keys, "feature", (F.col("g") / F.sum("g").over(Window.partitionBy(*keys, "tree"))).alias("g"))
    total = share.groupBy(*keys, "feature").agg(F.sum("g").alias("g"))
    total = total.select(*keys, "feature", (F.col("g") / F.sum("g").over(Window.partitionBy(*keys))).alias("g"))
    names = F.array(*[F.lit(f) for f in features])
    every = nodes.select(*keys).distinct().select(*keys, F.posexplode(names).alias("feature", "name"))
    return every.join(total, [*keys, "feature"], "left").select(
        *keys, F.col("name").alias("feature"), F.coalesce("g", F.lit(0.0)).alias("importance"))


def fit_boosted(df: DataFrame, features: Sequence[str], y: str = "y", key: str | Sequence[str] = "ticker",
                train_flag: str = "is_test", rounds: int = 100, max_depth: int = 6, rate: float = 0.1, n_bins: int = N_BINS,
                min_leaf: int = 1, l2: float = 1.0, exact_scale: int = 4, out: str = "predicted") -> tuple[DataFrame, DataFrame]:
    """(scored rows, nodes): boosted trees for every key, squared error.

    The target is standardised by its key's train rows (G4); each round fits one
    tree a key to what is left of it (a leaf's value is the shrunk sum
    s / (n + l2)), and moves the prediction by ``rate`` of the leaf. Rounds are
    the trees' numbers. All rows are scored, test rows too. Each round is cut
    from its lineage in the shared checkpoint folder.
    """
    keys = _keys(key)
    rows = binned(df.where(F.col(y).isNotNull()), features, keys, train_flag, n_bins)
    rows = target_scaling(rows, y, keys, train_flag, exact_scale).drop("y_back")
    # what a round doesn't need stays packed until the end
    rows = cut_lineage(rows.select(*keys, "bins", "y_scaled", F.array(F.lit(1)).alias("weights"), F.lit(0.0).alias("_at"),
                                   (F.col(train_flag) == F.lit(False)).alias("_train"), F.struct(*rows.columns).alias("_row")))
    train = F.col("_train")
    nodes = None
    for k in range(rounds):
        left = rows.withColumn("target", F.round((F.col("y_scaled") - F.col("_at")) * UNIT_SCALE).cast("long"))
        grown = _grow(left, keys, train, 1, max_depth, min_leaf, l2, UNIT_SCALE)
        placed = _led(rows, grown, keys, 1, max_depth)
        moved = F.col("_at") + rate * F.coalesce(F.element_at("places", 1)["value"], F.lit(0.0))
        rows = placed.withColumn("_at", moved).drop("places")
        rows = cut_lineage(rows) if k + 1 < rounds else rows
        grown = grown.withColumn("tree", F.lit(k))
        nodes = grown if nodes is None else nodes.unionByName(grown)
    scored = rows.select("_row.*", (F.col("_at") * F.col("_row.y_std") + F.col("_row.y_mean")).alias(out))
    return scored.drop("bins", "y_scaled", "y_mean", "y_std"), nodes


def cross_validate(df: DataFrame, features: Sequence[str], y: str = "y", key: str = "ticker", order: str = "month",
                   n_folds: int = 5, num_trees: int = 50, max_depth: int = 5, n_bins: int = N_BINS, seed: int = 42) -> DataFrame:
    """G8 + A11 per key: k-fold (contiguous, unshuffled) R2 of a forest.

    The fold left out is a key beside ``key``: the forests of all keys and folds
    grow at once. Returns (key, cv_r2_mean, cv_r2_std (population), n_folds).
    """
    from panelcast.operators.forecast import fold_ids, r2_expr

    folds = fold_ids(df.where(F.col(y).isNotNull()), n_folds, key, order, "_own")
    left_out = F.array(*[F.lit(k) for k in range(n_folds)])
    many = folds.withColumn("fold", F.explode(left_out)).withColumn("_held", F.col("_own") == F.col("fold"))
    keys = [key, "fold"]
    nodes, rows = fit_forest(many, features, y, keys, (order,), "_held", num_trees, max_depth, n_bins, seed=seed)
    scored = predict_forest(rows.where("_held"), nodes, num_trees, max_depth, keys)
    r2 = scored.where("predicted is not null").groupBy(*keys).agg(r2_expr(y, "predicted").alias("r2"))
    return r2.groupBy(key).agg(F.avg("r2").alias("cv_r2_mean"), F.stddev_pop("r2").alias("cv_r2_std"),
                               F.count(F.lit(1)).cast("int").alias("n_folds"))
