"""Trees on quantile-binned features, grown level by level from histograms.

Two learners share one grower:

* ``boost`` - second-order gradient boosting of the logistic loss: row and column
  sampling for each tree, gain and leaf values from gradient and hessian sums with an
  L2 penalty;
* ``forest`` - a random forest of probability trees: Poisson bootstrap, a random subset of
  the features at each node, and the stop rule Spark ML lacks, a least number of rows
  for a node to be split. With gradient ``-w y`` and hessian ``w`` the same gain is the
  decrease of the Gini impurity and the leaf value the share of positives.

The rows are binned once and stored as blocks in the shared checkpoint folder. For each
level a task adds its rows' gradients and hessians into cells (node, feature, bin), one
grouped sum merges the cells of all tasks, and the driver, which sees histograms only, picks
the splits; of two siblings only the smaller is summed, the other is its parent less
that. Gradients are summed as whole numbers, so a tree doesn't depend on how the rows are
partitioned. Boosting keeps the margin of the trees up to the last refresh with the blocks and
adds that of the few trees since then on the fly: a lost task needs nothing but its blocks and
those trees.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import metrics as M

#: Gradients and hessians are summed as multiples of this.
UNIT = 2.0 ** -24
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


@dataclass
class Tree:
    """Nodes by number, 0 the root. A row goes left where its value is at most the
    feature's edge ``cut``; leaves have feature -1."""
    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    rows: list[int] = field(default_factory=list)

    def add(self, value: float, rows: int) -> int:
        for column, x in ((self.feature, -1), (self.cut, 0), (self.left, -1), (self.right, -1),
                          (self.value, value), (self.rows, rows)):
            column.append(x)
        return len(self.feature) - 1

    def arrays(self):
        return (np.array(self.feature), np.array(self.cut), np.array(self.left), np.array(self.right),
                np.array(self.value, float))


def walk(tree, bins: np.ndarray) -> np.ndarray:
    """The node that each row ends in. ``tree``: ``Tree.arrays``."""
    feature, cut, left, right, _ = tree
    node = np.zeros(len(bins), np.int64)
    at = np.flatnonzero(feature[node] >= 0)
    while len(at):
        here = node[at]
        goes = bins[at, feature[here]] > cut[here]
        node[at] = np.where(goes, right[here], left[here])
        at = at[feature[node[at]] >= 0]
    return node


def uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in [0, 1) from row keys, the same wherever a row is."""
    with np.errstate(over="ignore"):
        z = keys.view(np.uint64) + np.uint64((salt + 1) * _MIX[0] % (1 << 64))
        for shift, by in ((30, _MIX[1]), (27, _MIX[2])):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(by)
        return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def poisson_one(keys: np.ndarray, salt: int) -> np.ndarray:
    """How often each row stands in a bootstrap sample."""
    steps, p, total = [], np.exp(-1.0), 0.0
    for k in range(1, 13):
        total += p
        steps.append(total)
        p /= k
    return np.searchsorted(steps, uniform(keys, salt), side="right")


# -- binned rows ------------------------------------------------------------------
def bin_edges(vectors: DataFrame, max_bins: int = 64, accuracy: int = 10_000) -> list[np.ndarray]:
    """Upper edges of each feature's bins: its quantiles below its largest value. The
    last bin has what is above (and what isn't a number). ``vectors``: array column ``x``."""
    cells = vectors.select(F.posexplode("x").alias("f", "v")).where("v is not null and not isnan(v)")
    points = [i / max_bins for i in range(1, max_bins)]
    told = {r.f: sorted({v for v in r.q if v < r.most}) for r in cells.groupBy("f").agg(
        F.percentile_approx("v", [float(p) for p in points], accuracy).alias("q"), F.max("v").alias("most")).collect()}
    width = vectors.select(F.max(F.size("x"))).first()[0] or 0
    return [np.array(told.get(f, []), float) for f in range(width)]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)]).astype(np.uint8)


_BLOCK = "n int, bins binary, y binary, w binary, k binary, margin binary"


def _blocks(rows: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["x"].to_numpy())
            yield pd.DataFrame({
                "n": [len(pdf)], "bins": [binned(x, edges).tobytes()], "y": [pdf["y"].to_numpy(float).tobytes()],
                "w": [pdf["w"].to_numpy(float).tobytes()], "k": [pdf["k"].to_numpy(np.int64).tobytes()],
                "margin": [np.zeros(len(pdf)).tobytes()]})
    return _kept(rows.mapInPandas(pack, _BLOCK))


def _kept(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _read(row, width: int):
    bins = np.frombuffer(row.bins, np.uint8).reshape(row.n, width)
    return bins, *(np.frombuffer(b, float) for b in (row.y, row.w, row.margin)), np.frombuffer(row.k, np.int64)


def training_rows(df: DataFrame, features: str = "features", label: str = "label", weight: str | None = None,
                  key: Column | None = None) -> DataFrame:
    """x (array), y, w, k (the key that sampling goes by: by default a hash of the row)."""
    is_vector = df.schema[features].dataType.typeName() != "array"
    x = vector_to_array(features) if is_vector else F.col(features).cast("array<double>")
    rows = df.select(x.alias("x"), F.col(label).cast("double").alias("y"),
                     (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
                     *([key.alias("k")] if key is not None else []))
    return rows if key is not None else rows.withColumn("k", F.xxhash64("x", "y", "w"))


# -- growing ------------------------------------------------------------------------
@dataclass
class Rules:
    """When and how nodes are split."""
    depth: int
    min_split: int = 2
    min_leaf: int = 1
    min_hessian: float = 0.0
    l2: float = 0.0
    node_features: int | None = None


class Cells:
    """Numbering of (feature, bin) over all features."""

    def __init__(self, edges: list[np.ndarray]):
        self.sizes = np.array([len(e) + 1 for e in edges])
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        self.total = int(self.sizes.sum())

    def best(self, hist: np.ndarray, rules: Rules, features) -> tuple[float, int, int] | None:
        """(gain, feature, cut) of a node's best split; of equal ones the first."""
        best = None
        g, h, n = hist[self.offsets[0]:self.offsets[0] + self.sizes[0]].sum(axis=0)
        for f in features:
            part = hist[self.offsets[f]:self.offsets[f] + self.sizes[f]]
            left = np.cumsum(part[:-1], axis=0)
            if not len(left):
                continue
            lg, lh, ln = left.T
            rg, rh, rn = g - lg, h - lh, n - ln
            ok = ((ln >= rules.min_leaf) & (rn >= rules.min_leaf) & (lh >= rules.min_hessian) & (rh >= rules.min_hessian)
                  & (lh + rules.l2 > 0) & (rh + rules.l2 > 0))
            if not ok.any():
                continue
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = lg * lg / (lh + rules.l2) + rg * rg / (rh + rules.l2) - g * g / (h + rules.l2)
            gain[~ok] = -np.inf
            c = int(np.argmax(gain))
            if gain[c] > 1e-9 and (best is None or gain[c] > best[0]):
                best = (float(gain[c]), int(f), c)
        return best


def _histograms(blocks: DataFrame, width: int, cells: Cells, trees, slots, gradients) -> dict[int, np.ndarray]:
    """Histograms of the wanted nodes. ``slots``: per tree, node to histogram number;
    ``gradients(bins, y, w, margin, k, tree)`` gives g, h and copies of each row."""
    n_slots = sum(len(s) for s in slots)
    size = cells.total

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((3, n_slots * size), np.int64)
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                bins, y, w, margin, k = _read(row, width)
                for t, (tree, wanted) in enumerate(zip(trees, slots)):
                    of = np.full(len(tree[0]), -1, np.int64)
                    of[list(wanted)] = list(wanted.values())
                    slot = of[walk(tree, bins)]
                    g, h, n = gradients(bins, y, w, margin, k, t)
                    at = np.flatnonzero((slot >= 0) & (n > 0))
                    where = ((slot[at] * size)[:, None] + cells.offsets + bins[at]).ravel()
                    for i, x in enumerate((np.rint(g / UNIT), np.rint(h / UNIT), n)):
                        # each partial sum is a whole number well below 2**53
                        sums[i] += np.bincount(where, np.repeat(x[at], width), n_slots * size).astype(np.int64)
        some = np.flatnonzero(sums.any(axis=0))
        yield pd.DataFrame({"cell": some, "g": sums[0, some], "h": sums[1, some], "n": sums[2, some]})

    merged = (blocks.mapInPandas(add, "cell long, g long, h long, n long")
              .groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toPandas())
    out = np.zeros((n_slots * size, 3))
    out[merged["cell"].to_numpy(np.int64)] = np.column_stack(
        [merged["g"].to_numpy(float) * UNIT, merged["h"].to_numpy(float) * UNIT, merged["n"].to_numpy(float)])
    return dict(enumerate(out.reshape(n_slots, size, 3)))


def grow(blocks: DataFrame, width: int, cells: Cells, rules: Rules, gradients, columns, n_trees: int = 1,
         max_cells: int = 2_000_000) -> list[Tree]:
    """Grow ``n_trees`` trees together, a level at a time. ``columns(tree, node)``: the features
    a node may be split by. ``max_cells`` bounds the cells of one job; wider levels
    take several jobs."""
    trees = [Tree() for _ in range(n_trees)]

    def leaf(hist: np.ndarray) -> tuple[float, int]:
        g, h, n = hist[:cells.sizes[0]].sum(axis=0)
        return (float(-g / (h + rules.l2)) if h + rules.l2 > 0 else 0.0), int(n)

    for tree in trees:
        tree.add(0.0, 0)
    # (tree, node, its sibling, the parent's histogram): the sibling is what the parent has left
    level = [(t, 0, None, None) for t in range(n_trees)]
    for depth in range(rules.depth + 1):
        ready: list[tuple[int, int, np.ndarray]] = []
        step = max(1, max_cells // max(cells.total, 1))
        for i in range(0, len(level), step):
            some = level[i:i + step]
            slots: list[dict[int, int]] = [{} for _ in trees]
            for s, (t, node, _, _) in enumerate(some):
                slots[t][node] = s
            hist = _histograms(blocks, width, cells, [t.arrays() for t in trees], slots, gradients)
            for s, (t, node, sibling, parent) in enumerate(some):
                ready.append((t, node, hist[s]))
                if sibling is not None:
                    ready.append((t, sibling, parent - hist[s]))
        level = []
        for t, node, hist in ready:
            tree = trees[t]
            tree.value[node], tree.rows[node] = leaf(hist)
            if depth == rules.depth or tree.rows[node] < max(rules.min_split, 2):
                continue
            found = cells.best(hist, rules, columns(t, node))
            if found is None:
                continue
            _, f, cut = found
            tree.feature[node], tree.cut[node] = f, cut
            left, right = tree.add(0.0, 0), tree.add(0.0, 0)
            tree.left[node], tree.right[node] = left, right
            part = hist[cells.offsets[f]:cells.offsets[f] + cells.sizes[f], 2]
            small, large = (left, right) if part[:cut + 1].sum() * 2 <= part.sum() else (right, left)
            level.append((t, small, large, hist))
        if not level:
            break
    return trees


# -- learners -------------------------------------------------------------------------
class Ensemble:
    """Trees with their edges. ``boosted``: the score is the logistic function of
    ``rate`` times the sum of the leaf values, else their mean."""

    def __init__(self, edges, trees: list[Tree], boosted: bool, rate: float = 1.0):
        self.edges, self.trees, self.boosted, self.rate = [np.asarray(e, float) for e in edges], trees, boosted, rate

    def staged(self, x: np.ndarray, rounds: list[int] | None = None) -> np.ndarray:
        """Scores after each of ``rounds`` (by default all): rows, rounds."""
        bins = binned(x, self.edges) if len(self.edges) else np.zeros((len(x), 0), np.uint8)
        leaves = np.column_stack([a[4][walk(a, bins)] for a in (t.arrays() for t in self.trees)])
        sums = np.cumsum(leaves, axis=1)
        if self.boosted:
            out = 1.0 / (1.0 + np.exp(-self.rate * sums))
        else:
            out = sums / np.arange(1, len(self.trees) + 1)
        return out if rounds is None else out[:, [r - 1 for r in rounds]]

    def score(self, features: str = "features", vector: bool = True) -> Column:
        """Probability of label 1."""
        model = self

        @F.pandas_udf("double")
        def scores(x: pd.Series) -> pd.Series:
            return pd.Series(model.staged(np.stack(x.to_numpy()), [len(model.trees)])[:, 0] if len(x) else [], dtype=float)

        return scores(vector_to_array(features) if vector else F.col(features))

    def nodes(self) -> list[tuple]:
        """(tree, node, feature, edge, left, right, value, rows)."""
        return [(t, i, tree.feature[i], float(self.edges[tree.feature[i]][tree.cut[i]]) if tree.feature[i] >= 0 else None,
                 tree.left[i], tree.right[i], float(tree.value[i]), tree.rows[i])
                for t, tree in enumerate(self.trees) for i in range(len(tree.feature))]

    def to_json(self) -> str:
        return json.dumps({"edges": [e.tolist() for e in self.edges], "trees": [vars(t) for t in self.trees],
                           "boosted": self.boosted, "rate": self.rate})

    @staticmethod
    def from_json(text: str) -> "Ensemble":
        d = json.loads(text)
        return Ensemble(d["edges"], [Tree(**t) for t in d["trees"]], d["boosted"], d["rate"])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def boost(rows: DataFrame, rounds: int = 300, depth: int = 6, rate: float = 0.05, row_share: float = 0.8,
          column_share: float = 0.8, l2: float = 1.0, min_hessian: float = 1.0, max_bins: int = 64, seed: int = 42,
          refresh: int = 20) -> Ensemble:
    """Boosting on ``training_rows``; the defaults are the reference's settings.
    ``refresh``: after so many trees the blocks are written with their new margins."""
    edges = bin_edges(rows, max_bins)
    blocks, width, cells = _blocks(rows, edges), len(edges), Cells(edges)
    rules, rng, trees, recent = Rules(depth, min_hessian=min_hessian, l2=l2), np.random.default_rng(seed), [], []

    def margins(bins, margin, since):
        return margin + sum((rate * t[4][walk(t, bins)] for t in since), np.zeros(len(bins)))

    for r in range(rounds if width else 0):
        mine = np.sort(rng.permutation(width)[:max(1, round(column_share * width))]).tolist()
        since, salt = [t.arrays() for t in recent], seed * 1_000_003 + r

        def gradients(bins, y, w, margin, k, t, since=since, salt=salt):
            p = _sigmoid(margins(bins, margin, since))
            return w * (p - y), w * p * (1 - p), (uniform(k, salt) < row_share).astype(float)

        tree = grow(blocks, width, cells, rules, gradients, lambda t, node, mine=mine: mine)[0]
        trees.append(tree)
        recent.append(tree)
        if len(recent) == refresh and r + 1 < rounds:
            since = [t.arrays() for t in recent]

            def renew(batches, since=since):
                for pdf in batches:
                    fresh = []
                    for row in pdf.itertuples(index=False):
                        bins, _, _, margin, _ = _read(row, width)
                        fresh.append(margins(bins, margin, since).tobytes())
                    yield pdf.assign(margin=fresh)

            blocks, recent = _kept(blocks.mapInPandas(renew, _BLOCK)), []
    return Ensemble(edges, trees, True, rate)


def forest(rows: DataFrame, trees: int = 200, depth: int = 10, min_split: int = 5, min_leaf: int = 2,
           node_features: int | None = None, max_bins: int = 32, seed: int = 42, together: int = 20) -> Ensemble:
    """Random forest on ``training_rows``; the defaults are the reference's settings
    (``node_features``: by default the square root of their number). ``together``: trees
    grown in the same jobs."""
    edges = bin_edges(rows, max_bins)
    blocks, width, cells = _blocks(rows, edges), len(edges), Cells(edges)
    few = node_features or max(1, int(width ** 0.5))
    rules, grown = Rules(depth, min_split, min_leaf), []
    for first in range(0, trees if width else 0, together):

        def gradients(bins, y, w, margin, k, t, first=first):
            copies = poisson_one(k, seed * 1_000_003 + first + t)
            return -w * y * copies, w * copies, copies.astype(float)

        def columns(t, node, first=first):
            return np.random.default_rng([seed, first + t, node]).permutation(width)[:few].tolist()

        grown += grow(blocks, width, cells, rules, gradients, columns, min(together, trees - first))
    return Ensemble(edges, grown, False)


# -- evaluation after each round ----------------------------------------------------------
def staged_scores(model: Ensemble, rows: DataFrame, rounds: list[int]) -> DataFrame:
    """round, label, score of every row after each of ``rounds``, from one pass."""
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 1_000):
                part = pdf.iloc[i:i + 1_000]
                told = model.staged(np.stack(part["x"].to_numpy()), rounds)
                yield pd.DataFrame({"round": np.tile(rounds, len(part)), "label": np.repeat(part["y"].to_numpy(int), len(rounds)),
                                    "score": told.ravel()})
    return rows.select("x", "y").mapInPandas(score, "round int, label int, score double")


def staged_metrics(model: Ensemble, sets: dict[str, DataFrame], name: str = "GradientBoosting",
                   every: int = 1) -> DataFrame:
    """(model, data, round, metric, value): log loss and exact ROC-AUC of each data set
    after every ``every``-th round and the last. ``sets``: ``training_rows`` by name."""
    last = len(model.trees)
    rounds = sorted({*range(every, last + 1, every), last})
    scored = None
    for data, rows in sets.items():
        part = staged_scores(model, rows, rounds).withColumn("data", F.lit(data))
        scored = part if scored is None else scored.unionByName(part)
    at = F.concat_ws("|", "data", "round")
    scored = _kept(scored.select(at.alias("model"), "label", "score", (F.col("score") >= 0.5).cast("int").alias("prediction")))
    p = F.when(F.col("label") == 1, F.col("score")).otherwise(1 - F.col("score"))
    loss = scored.groupBy("model").agg(F.avg(-F.log(F.greatest(p, F.lit(1e-15)))).alias("value")).withColumn(
        "metric", F.lit("log_loss"))
    auc = M.evaluate(scored).select("model", F.col("roc_auc").alias("value"), F.lit("roc_auc").alias("metric"))
    both = loss.unionByName(auc)
    return both.select(F.lit(name).alias("model"), F.substring_index("model", "|", 1).alias("data"),
                       F.substring_index("model", "|", -1).cast("int").alias("round"), "metric", "value")
