"""Registered queries of the trees themselves: the exact tree with its SQL, and importances of all ensembles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.operators.tree_arrays import Trees, with_predictions
from tidecast.operators.tree_growth import exact_tree
from tidecast.plans import model_jobs as MJ
from tidecast.plans.registry import register
from tidecast.session import written_table

DEPTH, LEAF = 3, 5  # the first setting of the decision-tree grid


def _tree_ctes() -> list[tuple[str, str]]:
    """SQL that grows the tree one level after the other: ``tree`` has its nodes (a node's children are 2n and 2n + 1), ``down`` the node of every row."""
    feats = MJ.FEATURES
    row = "id, split, total_rentals, " + ", ".join(feats)
    ctes = [("r0", f"SELECT {row}, CAST(1 AS BIGINT) AS node FROM split_table")]
    for level in range(DEPTH):
        train = f"(SELECT * FROM r{level} WHERE split = 'train')"
        stacked = " UNION ALL ".join(f"SELECT node, {i} AS f, CAST({c} AS DOUBLE) AS v, total_rentals AS y FROM {train}" for i, c in enumerate(feats))
        ctes += [
            (f"g{level}", f"SELECT node, f, v, count(*) AS n, sum(y) AS s FROM ({stacked}) GROUP BY node, f, v"),
            (f"p{level}", f"SELECT node FROM {train} GROUP BY node HAVING min(total_rentals) < max(total_rentals)"),
            (f"w{level}", f"""SELECT node, f, v, lead(v) OVER (PARTITION BY node, f ORDER BY v) AS above,
                sum(n) OVER (PARTITION BY node, f ORDER BY v) AS ln, sum(s) OVER (PARTITION BY node, f ORDER BY v) AS ls,
                sum(n) OVER (PARTITION BY node, f) AS n, sum(s) OVER (PARTITION BY node, f) AS s FROM g{level} WHERE node IN (SELECT node FROM p{level})"""),
            (f"c{level}", f"SELECT *, ls * ls / ln + (s - ls) * (s - ls) / (n - ln) AS score FROM w{level} WHERE ln >= {LEAF} AND n - ln >= {LEAF} AND above IS NOT NULL"),
            (f"b{level}", f"""SELECT node, f, CASE WHEN v / 2 + above / 2 >= above THEN v ELSE v / 2 + above / 2 END AS cut
                FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY score DESC, f, v) AS k FROM c{level}) WHERE k = 1"""),
            (f"r{level + 1}", f"""SELECT {row}, CASE WHEN b.node IS NULL THEN r.node ELSE 2 * r.node + CASE WHEN
                CASE b.f {' '.join(f'WHEN {i} THEN {c}' for i, c in enumerate(feats))} END > b.cut THEN 1 ELSE 0 END END AS node
                FROM r{level} r LEFT JOIN b{level} b ON r.node = b.node"""),
        ]
    means = " UNION ALL ".join(f"SELECT node, avg(total_rentals) AS value, count(*) AS n FROM r{k} WHERE split = 'train' GROUP BY node" for k in range(DEPTH + 1))
    cuts = " UNION ALL ".join(f"SELECT node, f, cut FROM b{k}" for k in range(DEPTH))
    names = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(feats))
    ctes.append(("tree", f"SELECT m.node, CASE c.f {names} END AS feature, c.cut, m.value, m.n FROM (SELECT DISTINCT * FROM ({means})) m LEFT JOIN ({cuts}) c ON m.node = c.node"))
    return ctes


def small_tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Trees]:
    """The table with its splits, and the exact tree, every level of it grown by grouped aggregates."""
    t = written_table(MJ.split_table(spark, sf_dir), "exact-tree")[0]
    return t, exact_tree(t.where("split = 'train'"), MJ.FEATURES, MJ.LABEL, LEAF, DEPTH, local_rows=0)


def node_rows(trees: Trees) -> list[tuple]:
    """(node, feature, threshold, value, rows) of the first tree; a node's children are numbered 2n and 2n + 1."""
    out, open_nodes = [], [(int(trees.start[0]), 1)]
    while open_nodes:
        at, number = open_nodes.pop()
        f = int(trees.feature[at])
        out.append((number, trees.features[f] if f >= 0 else None, float(trees.threshold[at]) if f >= 0 else None, float(trees.value[at]), int(trees.rows[at])))
        if f >= 0:
            open_nodes += [(int(trees.left[at]), 2 * number), (int(trees.left[at]) + 1, 2 * number + 1)]
    return out


@register("exact_tree", MJ._mv(f"SELECT node, feature, round(cut, {MJ.R}) AS threshold, round(value, {MJ.R}) AS value, CAST(n AS BIGINT) AS n_rows FROM tree", _tree_ctes()))
def q_exact_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the exact tree of depth 3 with at least 5 rows a leaf."""
    made = spark.createDataFrame(node_rows(small_tree(spark, sf_dir)[1]), "node long, feature string, threshold double, value double, n_rows long")
    return MJ._round_cols(made, ["threshold", "value"])


@register("tree_predictions", MJ._mv(f"SELECT id, split, round(value, {MJ.R}) AS prediction, round(total_rentals - value, {MJ.R}) AS residual FROM r{DEPTH} JOIN tree USING (node)", _tree_ctes()))
def q_tree_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of the exact tree for all three splits, by the scorer of all ensembles."""
    t, trees = small_tree(spark, sf_dir)
    scored = with_predictions(t, trees, MJ.FEATURES).withColumn("prediction", F.get("predictions", 0))
    return MJ._round_cols(scored.select("id", "split", "prediction", (F.col(MJ.LABEL) - F.col("prediction")).alias("residual")), ["prediction", "residual"])


@register("ensemble_importances")
def q_ensemble_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature importances (sum 1) of the best decision tree, forest and boosting of their grids."""
    rows = []
    for kind in MJ.TREE_GRIDS:
        table, fits = MJ.tree_search(spark, sf_dir, kind)
        rows += [(kind, f, v) for f, v in fits[table.first()["setting"]].importances()]
    return spark.createDataFrame(rows, "model string, feature string, importance double").orderBy("model", F.desc("importance"))
