"""Boosters against brute-force fits on raw values, and the rules that end a fit."""

import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import boosting
from panelcast.operators import models as mod
from panelcast.operators.boosting import BoostedModel, Features, Job, TreeConfig, _Fit, _Growing, fit_all
from panelcast.session import scratch_path

PLAIN = TreeConfig(max_depth=3, max_iter=4, step_size=0.3, subsample=1.0, feature_share=1.0, l2=0.0, max_bins=512)
FEATS = Features(("a", "b"), "y", ("c",))


def data(n=400, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.randrange(40) / 4, rng.randrange(25) - 7, rng.choice(["n", "s", "e", "w"])
        y = 3 * a + (b > 4) * 11 + {"n": 9, "s": -4, "e": 0, "w": 2}[c] + (a > 6) * (c == "e") * 8 + rng.gauss(0, 2)
        rows.append((i, a, float(b), c, y))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, a double, b double, c string, y double")


class Brute:
    """Exact greedy trees on raw values: every midpoint, every category against the rest."""

    def __init__(self, rows, cfg, leafwise=False):
        self.rows, self.cfg = rows, cfg
        self.y = np.array([r[4] for r in rows])
        self.base = self.y.mean()
        self.tests = [(0, x) for x in self.mids(1)] + [(1, x) for x in self.mids(2)] + [(2, x) for x in sorted({r[3] for r in rows})]
        self.sides = np.array([[self.left(r, t) for r in rows] for t in self.tests])
        self.trees, margin = [], np.full(len(rows), self.base)
        for _ in range(cfg.max_iter):
            tree = self.grow(margin - self.y)
            self.trees.append(tree)
            margin += np.array([self.value(tree, r) for r in rows])

    def mids(self, i):
        v = sorted({r[i] for r in self.rows})
        return [(x + y) / 2 for x, y in zip(v, v[1:])]

    @staticmethod
    def left(r, t):
        return r[3] == t[1] if t[0] == 2 else r[1 + t[0]] <= t[1]

    def quality(self, g, h):
        return max(abs(g) - self.cfg.l1, 0) ** 2 / (h + self.cfg.l2) if h + self.cfg.l2 else 0.0

    def best(self, err, at):
        g, h = err[at].sum(), len(at)
        top = (self.cfg.min_gain + 1e-12, None)
        for k, side in enumerate(self.sides):
            l = at[side[at]]
            if min(len(l), h - len(l)) < max(self.cfg.min_child_weight, 1):
                continue
            gl = err[l].sum()
            gain = 0.5 * (self.quality(gl, len(l)) + self.quality(g - gl, h - len(l)) - self.quality(g, h))
            if gain > top[0] * (1 + 1e-9):
                top = (gain, k)
        return top

    def leaf(self, err, at):
        g = err[at].sum()
        return -math.copysign(max(abs(g) - self.cfg.l1, 0), g) / (len(at) + self.cfg.l2) * self.cfg.step_size

    def grow(self, err):
        root = {"at": np.arange(len(err)), "depth": 0}
        leaves = [root]
        while True:
            open_ = [x for x in leaves if self.cfg.max_depth <= 0 or x["depth"] < self.cfg.max_depth]
            for x in open_:
                if "best" not in x:
                    x["best"] = self.best(err, x["at"])
            open_ = [x for x in open_ if x["best"][1] is not None]
            if not open_ or self.cfg.kind == "leafwise" and len(leaves) >= self.cfg.max_leaves:
                break
            x = max(open_, key=lambda x: x["best"][0]) if self.cfg.kind == "leafwise" else open_[0]
            side = self.sides[x["best"][1]][x["at"]]
            x["kids"] = [{"at": x["at"][s], "depth": x["depth"] + 1} for s in (side, ~side)]
            leaves = [z for z in leaves if z is not x] + x["kids"]
        for x in leaves:
            x["value"] = self.leaf(err, x["at"])
        return root

    def value(self, tree, r):
        while "kids" in tree:
            tree = tree["kids"][0 if self.left(r, self.tests[tree["best"][1]]) else 1]
        return tree["value"]

    def predict(self, r):
        return self.base + sum(self.value(t, r) for t in self.trees)


CONFIGS = [
    PLAIN, replace(PLAIN, l1=4.0, l2=2.5, min_child_weight=9), replace(PLAIN, min_gain=40.0, max_depth=5, max_iter=2),
    replace(PLAIN, kind="leafwise", max_depth=-1, max_leaves=7), replace(PLAIN, kind="leafwise", max_depth=4, max_leaves=12, min_child_weight=5, l2=1.0),
]


def test_trees_equal_a_brute_force_fit(spark):
    """All settings are fitted in one run over several partitions, rows of two groups and unlabelled ones between them."""
    rows, other = data(), [(i, a, b, c, -y) for i, a, b, c, y in data(90, 9)]
    df = frame(spark, rows).withColumns({"role": F.lit("train"), "_group": F.lit(1)})
    df = df.unionByName(frame(spark, other).withColumns({"role": F.lit("train"), "_group": F.lit(2)}))
    df = df.unionByName(df.limit(5).withColumn("y", F.lit(None).cast("double"))).repartition(20)
    models = fit_all(df, [Job(c, FEATS, 1) for c in CONFIGS] + [Job(PLAIN, FEATS, 2), Job(PLAIN, FEATS, 3)])
    for cfg, model in zip(CONFIGS, models, strict=False):
        want = Brute(rows, cfg)
        got = {r["id"]: r["prediction"] for r in model.transform(frame(spark, rows)).collect()}
        assert all(got[r[0]] == pytest.approx(want.predict(r), abs=1e-6) for r in rows), cfg
        assert [int((t.feature < 0).sum()) for t in model.trees] == [count(t) for t in want.trees]
    want = Brute(other, PLAIN)
    assert all(r["prediction"] == pytest.approx(want.predict(tuple(r)[:5]), abs=1e-6) for r in models[5].transform(frame(spark, other)).collect())
    assert models[6] is None


def count(tree):
    return sum(map(count, tree["kids"])) if "kids" in tree else 1


def test_carried_trees_and_written_margins_agree(spark, monkeypatch):
    rows, cfg = data(150), replace(PLAIN, max_iter=7, max_depth=2, subsample=0.6, feature_share=0.7)
    df = frame(spark, rows).withColumn("role", F.lit("train"))
    one = fit_all(df, [Job(cfg, FEATS)])[0]
    monkeypatch.setattr(boosting, "_CARRIED", 2)
    monkeypatch.setattr(boosting, "_FAN", 2)
    two = fit_all(df.repartition(11), [Job(cfg, FEATS)])[0]
    for a, b in zip(one.trees, two.trees, strict=True):
        assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and np.allclose(a.value, b.value)
    assert len({t.feature[0] for t in one.trees}) > 1 and one.trees[0].cover[0] < 150  # rows and features are drawn


def errors(cfg, values):
    """A fit that is told these validation errors, with a tree after each."""
    binning = boosting.Binning(("a",), frozenset(), (np.array([1.0]),))
    fit = _Fit(0, Job(cfg, Features(("a",), "y")), 0, binning, True)
    for v in [None, *values]:
        request = fit.request()
        if request is None:
            break
        while request:
            width = sum(request["widths"])
            sums = np.zeros(3 + 2 * len(request["nodes"]) * width)
            sums[:2] = (1, v * v) if request["fresh"] else (0, 0)
            if request["nodes"]:
                sums[3:] = np.array([[-2.0, 2.0], [5, 5]])[:, None, :].repeat(len(request["nodes"]), axis=1).ravel()
            done = len(fit.trees)
            fit.answer(sums, request)
            if len(fit.trees) > done or fit.done:
                break
            request = fit.request()
    return fit


def test_patience_outlasts_a_bad_round():
    cfg = replace(PLAIN, max_depth=1, max_iter=60, patience=10)
    values = [5.0, 6.0, 5.9, 5.8, 5.7, 5.6, 5.5, 5.4, 5.3, 4.0] + [4.5] * 40  # round 2 is worse, round 10 the best
    fit = errors(cfg, values)
    assert fit.done and len(fit.trees) == 10 and len(fit.history) == 20
    assert len(errors(replace(cfg, patience=3), values).trees) == 1
    rounds = errors(replace(cfg, max_iter=8, patience=30), values)
    assert rounds.request() is None and len(rounds.trees) == 1 and len(rounds.history) == 8


def test_a_watched_fit_is_cut_at_its_best_round(spark):
    rows = data(600)
    train, val = frame(spark, rows[:400]), frame(spark, rows[400:])
    cfg = replace(PLAIN, max_iter=60, step_size=0.4, patience=4, max_bins=32)
    model = mod.fit(train, FEATS, cfg, val)
    assert 4 < mod.n_trees(model) == 1 + int(np.argmin(model.history)) < 60
    assert len(model.history) == mod.n_trees(model) + 4
    err = [r["prediction"] - r["y"] for r in model.transform(val).collect()]
    assert math.sqrt(np.mean(np.square(err))) == pytest.approx(min(model.history))
    lag = np.std([r[4] for r in rows[400:]])
    assert min(model.history) < lag / 3  # far better than the mean


def test_leaf_order_needs_few_jobs():
    """Opening all selected leaves together gives the same tree as one leaf after the other."""
    gains = {}

    def gain(path):
        return gains.setdefault(path, random.Random(path).random() * 0.7 ** len(path))

    cfg = replace(PLAIN, kind="leafwise", max_depth=-1, max_leaves=24)
    tree, paths, jobs = _Growing([0], 1), {0: "r"}, 0
    while True:
        split, asked = tree.select(cfg)
        for i, n in enumerate(tree.nodes):
            if n.left >= 0:
                paths[n.left], paths[n.right] = paths[i] + "0", paths[i] + "1"
        if not asked:
            break
        jobs += 1
        for i in asked:
            n = tree.nodes[i]
            n.known, n.feature, n.gain = True, 0, gain(paths[i])
    open_, want = {"r"}, set()
    while len(open_) < 24:
        best = max(open_, key=gain)
        want.add(best)
        open_ = open_ - {best} | {best + "0", best + "1"}
    assert {paths[i] for i in split} == want and jobs < 23


def test_many_jobs_equal_single_ones(spark):
    rows = data(300)
    df = frame(spark, rows).withColumn("role", F.when(F.col("id") % 3 == 0, "val").otherwise("train"))
    jobs = [Job(replace(PLAIN, max_depth=d, max_iter=4, patience=3, subsample=0.8, feature_share=0.7), f) for d in (1, 3) for f in (FEATS, Features(("b", "a"), "y"))]
    for job, model in zip(jobs, fit_all(df, jobs), strict=True):
        alone = fit_all(df, [job])[0]
        assert np.allclose(model.history, alone.history) and len(model.trees) == len(alone.trees)


def test_a_model_comes_back_from_its_tables(spark):
    rows = data(120)
    model = mod.fit(frame(spark, rows), FEATS, PLAIN)
    path = scratch_path(spark, "model")
    mod.save(model, spark, path)
    again = mod.load(spark, path)
    odd = spark.createDataFrame([(1, None, float("nan"), "unseen", None), (2, 1e9, -1e9, None, 0.0)], "id long, a double, b double, c string, y double")
    for df in (frame(spark, rows), odd):
        a, b = ([(r["id"], r["prediction"]) for r in m.transform(df).orderBy("id").collect()] for m in (model, again))
        assert a == b and all(math.isfinite(p) for _, p in a)
    assert isinstance(again, BoostedModel) and again.cfg == model.cfg and again.gains() == model.gains()
    assert sum(model.gains().values()) == pytest.approx(1)
    assert mod.score(model, frame(spark, [])).count() == 0


def test_constant_and_empty_training_tables(spark):
    flat = spark.createDataFrame([(i, 1.0, 2.0, "x", 7.0) for i in range(20)], "id long, a double, b double, c string, y double")
    model = mod.fit(flat, FEATS, PLAIN)
    assert {r["prediction"] for r in model.transform(flat).collect()} == {7.0} and model.trees == ()
    with pytest.raises(ValueError):
        mod.fit(flat.limit(0), FEATS, PLAIN)


def test_quantile_bins_of_many_values(spark):
    df = spark.range(20000).select((F.col("id") * 37 % 20000).cast("double").alias("a"), F.lit(1.0).alias("b"), F.lit("k").alias("c"), (F.col("id") % 7).cast("double").alias("y"))
    cuts = boosting.binnings(df.withColumn("_group", F.lit(0)), ["a", "b"], ["c"], 16)[0].cuts
    assert len(cuts[0]) == 15 and np.allclose(np.diff(cuts[0]), 1250, atol=20) and len(cuts[1]) == 0 and cuts[2] == ("k",)


def test_a_weak_candidate_is_ended_early(spark):
    rows = data(300)
    folds = frame(spark, rows).withColumns({"fold": F.lit(1), "role": F.when(F.col("id") % 3 == 0, "val").otherwise("train")})
    folds = folds.unionByName(folds.withColumns({"fold": F.lit(2), "role": F.when(F.col("id") % 3 == 1, "val").otherwise("train")}))
    good = replace(PLAIN, max_iter=14, patience=30)
    candidates = [good, replace(good, max_depth=2), replace(good, step_size=0.001)]
    seen = []
    old = boosting.fit_all

    def spy(*args):
        seen.append(old(*args))
        return seen[-1]

    mod.fit_all = spy
    try:
        trials = mod.search_folds(folds, FEATS, candidates, watch=True, prune_from=5).orderBy("val_mae").collect()
    finally:
        mod.fit_all = old
    rounds = [len(m.history) for m in seen[0]]
    assert rounds[0] == 14 and max(rounds[4:]) < 10 and trials[-1]["trial"] == 2 and all(t["n_folds"] == 2 for t in trials)
