"""Stationary vectors of the link chains: every slot iterates until its own L1 change is below a tolerance.

Two forms give the same result.  The vector form holds a slot's links as one array in a task, with the kernel broadcast after a check
of its size, and needs one shuffle by slot whatever the number of steps.  The relational form joins state and kernel in every step
and serves kernels of any size.  ``stationary`` chooses.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Edges of a kernel that may be broadcast: 16 bytes each.
MAX_EDGES = 4_000_000


@dataclass(frozen=True)
class Model:
    """Which chain, and its constants.

    ``single``: v = alpha E + (1 - alpha) P v, normalised.  ``two``: up = (1 - beta) P_up up + rho E sum(down), down = beta up +
    (1 - rho) P_down down, normalised jointly, from (E, 0).  ``damped``: v = damping P v + (1 - damping) E without normalisation.
    ``to_prior`` gives the mass of links without successors to the prior instead of losing it.
    """

    kind: str = "single"
    alpha: float = 0.0508
    beta: float = 0.102
    rho: float = 0.101
    damping: float = 0.8
    to_prior: bool = False


class Push:
    """P v for many vectors at once: rows of an array over links."""

    def __init__(self, links: np.ndarray, src: np.ndarray, dst: np.ndarray, p: np.ndarray):
        at = lambda x: np.searchsorted(links, x)
        order = np.argsort(dst, kind="stable")
        self.src, self.p = at(src[order]), p[order]
        self.dst, self.first = np.unique(at(dst[order]), return_index=True)
        self.dangling = ~np.isin(np.arange(len(links)), self.src)

    def __call__(self, v: np.ndarray, e: np.ndarray, to_prior: bool) -> np.ndarray:
        out = np.zeros_like(v)
        if len(self.dst):
            out[:, self.dst] = np.add.reduceat(v[:, self.src] * self.p, self.first, axis=1)
        return out + v[:, self.dangling].sum(1, keepdims=True) * e if to_prior else out


def step(model: Model, kernels: list[Push], e: np.ndarray, state: list[np.ndarray]) -> list[np.ndarray]:
    """The next state of some slots; ``state`` has one array, or up and down."""
    if model.kind == "two":
        up, down = state
        back = down.sum(1, keepdims=True)
        new = [(1 - model.beta) * kernels[0](up, e, model.to_prior) + model.rho * e * back, model.beta * up + (1 - model.rho) * kernels[-1](down, e, model.to_prior)]
    elif model.kind == "damped":
        return [model.damping * kernels[0](state[0], e, model.to_prior) + (1 - model.damping) * e]
    else:
        new = [model.alpha * e + (1 - model.alpha) * kernels[0](state[0], e, model.to_prior)]
    total = sum(x.sum(1, keepdims=True) for x in new)
    return [x / np.where(total > 0, total, 1) for x in new]


def iterate(model: Model, kernels: list[Push], e: np.ndarray, tol: float, max_iter: int) -> tuple[np.ndarray, np.ndarray]:
    """Final v of each row of ``e``, and the steps that it took; a row stops when its own L1 change is below ``tol``."""
    state = [e.copy(), np.zeros_like(e)] if model.kind == "two" else [e.copy()]
    steps = np.full(len(e), max_iter)
    active = np.arange(len(e))
    for k in range(1, max_iter + 1):
        new = step(model, kernels, e[active], [x[active] for x in state])
        change = sum(np.abs(a - x[active]).sum(1) for a, x in zip(new, state, strict=True))
        for x, a in zip(state, new, strict=True):
            x[active] = a
        steps[active[change < tol]] = k
        active = active[change >= tol]
        if not len(active):
            break
    return sum(state), steps


def _collected(kernel: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t = kernel.select("src", "dst", F.col("p").cast("double").alias("p")).toArrow()
    return tuple(t[c].to_numpy() for c in ("src", "dst", "p"))


def vector(prior: DataFrame, kernels: list[DataFrame], model: Model, tol: float, max_iter: int, at_once: int = 32) -> DataFrame:
    """(slot, link_id, v, steps) for a prior (slot, link_id, p); links that a slot lacks have 0.  Kernels must fit in memory."""
    edges = [_collected(k) for k in kernels]
    links = np.unique(np.concatenate([prior.select("link_id").distinct().toArrow()["link_id"].to_numpy(), *(x for e in edges for x in e[:2])]))
    shared = prior.sparkSession.sparkContext.broadcast((links, edges))
    names = dict(prior.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, edges = shared.value
        kernels = [Push(links, *e) for e in edges]
        slots: list = []
        rows: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            v, steps = iterate(model, kernels, np.stack(rows), tol, max_iter)
            n = len(links)
            return pa.record_batch([pa.array(np.repeat(np.array(slots), n)), pa.array(np.tile(links, len(slots))), pa.array(v.ravel()), pa.array(np.repeat(steps, n))], names=["slot", "link_id", "v", "steps"])

        for b in batches:
            slot, link, p = (b.column(c).to_numpy(zero_copy_only=False) for c in ("slot", "link_id", "p"))
            cuts = [0, *(np.flatnonzero(slot[1:] != slot[:-1]) + 1).tolist(), len(slot)]
            for a, z in zip(cuts, cuts[1:], strict=False):
                if a == z:
                    continue
                if not slots or slots[-1] != slot[a]:
                    if len(slots) == at_once:
                        yield out()
                        slots, rows = [], []
                    slots.append(slot[a])
                    rows.append(np.zeros(len(links)))
                np.add.at(rows[-1], np.searchsorted(links, link[a:z]), p[a:z])
        if slots:
            yield out()

    rows = prior.select("slot", "link_id", F.col("p").cast("double").alias("p")).repartition("slot").sortWithinPartitions("slot")
    return rows.mapInArrow(run, f"slot {names['slot']}, link_id {names['link_id']}, v double, steps long")


def relational(prior: DataFrame, kernels: list[DataFrame], model: Model, tol: float, max_iter: int) -> DataFrame:
    """The same as joins: state and prior stand side by side, kernels are stored once, and slots that have stopped move no more."""
    base = prior.select("slot", "link_id", F.col("p").cast("double").alias("e"))
    ks = [k.select("src", "dst", "p").checkpoint() for k in kernels]
    links = base.select("link_id").unionByName(ks[0].select(F.col("src").alias("link_id"))).unionByName(ks[0].select(F.col("dst").alias("link_id"))).distinct()
    spine = base.select("slot").distinct().crossJoin(F.broadcast(links)) if links.count() <= MAX_EDGES else base.select("slot", "link_id")
    zero = F.lit(0.0)
    s = spine.join(base, ["slot", "link_id"], "left").select("slot", "link_id", F.coalesce("e", zero).alias("e"))
    s = s.withColumns({"u": F.col("e"), "d": zero, "steps": F.lit(0).cast("long"), "done": F.lit(False)}).checkpoint()
    whole = W.partitionBy("slot")

    def pushed(k: DataFrame, value: str) -> DataFrame:
        live = s.where("NOT done").select("slot", "link_id", "e", value)
        moved = live.join(k, F.col("link_id") == F.col("src")).groupBy("slot", F.col("dst").alias("link_id")).agg(F.sum(F.col("p") * F.col(value)).alias("in_" + value))
        if not model.to_prior:
            return moved.withColumn("lost_" + value, zero)
        lost = live.join(k.select(F.col("src").alias("link_id")).distinct(), "link_id", "left_anti").groupBy("slot").agg(F.sum(value).alias("lost_" + value))
        return live.select("slot", "link_id").join(moved, ["slot", "link_id"], "left").join(lost, "slot", "left")

    for k in range(1, max_iter + 1):
        now = s.join(pushed(ks[0], "u"), ["slot", "link_id"], "left")
        into = lambda c: F.coalesce("in_" + c, zero) + F.coalesce("lost_" + c, zero) * F.col("e")
        if model.kind == "two":
            now = now.join(pushed(ks[-1], "d"), ["slot", "link_id"], "left").withColumn("back", F.sum("d").over(whole))
            u, d = (1 - model.beta) * into("u") + model.rho * F.col("e") * F.col("back"), model.beta * F.col("u") + (1 - model.rho) * into("d")
        elif model.kind == "damped":
            u, d = model.damping * into("u") + (1 - model.damping) * F.col("e"), zero
        else:
            u, d = model.alpha * F.col("e") + (1 - model.alpha) * into("u"), zero
        now = now.withColumns({"nu": u, "nd": d})
        if model.kind != "damped":
            total = F.nullif(F.sum(F.col("nu") + F.col("nd")).over(whole), zero)
            now = now.withColumn("total", F.coalesce(total, F.lit(1.0))).withColumns({"nu": F.col("nu") / F.col("total"), "nd": F.col("nd") / F.col("total")})
        now = now.withColumn("change", F.sum(F.abs(F.col("nu") - F.col("u")) + F.abs(F.col("nd") - F.col("d"))).over(whole))
        keep = lambda new, old: F.when(F.col("done"), F.col(old)).otherwise(F.col(new)).alias(old)
        s = now.select("slot", "link_id", "e", keep("nu", "u"), keep("nd", "d"), F.when(F.col("done"), F.col("steps")).otherwise(F.lit(k).cast("long")).alias("steps"), (F.col("done") | (F.col("change") < tol)).alias("done")).checkpoint()
        if s.where("NOT done").isEmpty():
            break
    return s.select("slot", "link_id", (F.col("u") + F.col("d")).alias("v"), "steps")


def stationary(prior: DataFrame, kernels: list[DataFrame], model: Model = Model(), tol: float = 1e-5, max_iter: int = 200, max_edges: int = MAX_EDGES) -> DataFrame:
    """(slot, link_id, v, steps) in the vector form if all kernels have ``max_edges`` edges at most, else in the relational one.

    ``kernels`` are (src, dst, p): one, or up and down for the two-phase chain.  An empty prior gives an empty result.
    """
    edges = sum(k.count() for k in kernels)
    return (vector if edges <= max_edges else relational)(prior, kernels, model, tol, max_iter)


def uniform_prior(slots: DataFrame, links: DataFrame) -> DataFrame:
    """The prior 1/N of every slot."""
    n = links.agg(F.count("*").alias("n"))
    return slots.select("slot").distinct().crossJoin(F.broadcast(links.select("link_id").crossJoin(F.broadcast(n)))).select("slot", "link_id", (1.0 / F.col("n")).alias("p"))


def baseline_errors(truth: DataFrame, kernels: list[DataFrame], links: DataFrame, model: Model = Model(), tol: float = 1e-5, max_iter: int = 200, floor: float = 1e-6) -> DataFrame:
    """(slot, mre): one stationary vector of the uniform prior against the shares (slot, link_id, p) of every slot."""
    spark = links.sparkSession
    one = stationary(uniform_prior(spark.range(1).select(F.col("id").alias("slot")), links), kernels, model, tol, max_iter).select("link_id", "v")
    off = F.abs(F.col("p") - F.col("v")) / (F.col("p") + floor)
    return truth.join(F.broadcast(one) if links.count() <= MAX_EDGES else one, "link_id").groupBy("slot").agg(F.avg(off).alias("mre"))
