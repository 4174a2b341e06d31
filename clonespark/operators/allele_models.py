"""Usage models of allele pools, fitted to sparse evidence patterns.

A pool's reads with equal evidence are one weighted *pattern*: places of alleles and
their log evidence. Patterns are packed into blocks of bounded size. Everything a fit needs
from them is a sum over patterns of small per-allele vectors (``sums``), so a fit is a
*course*: a state that asks for one such sum at a time and moves on when it is given it.

A pool of one block runs its whole course where the block lies. The other pools, however large, move
together: a round joins the blocks with what their pools ask for, adds the parts up and
advances all states, which hold a few numbers per allele of the locus.

Two courses exist. ``DirichletCourse`` is the variational fit of a Dirichlet usage model.
``ActiveSetCourse`` has a point mass at zero: sweeps of frequency fits, inclusion
probabilities by quadrature over the positive frequencies, and removal of the least likely alleles. Both
speed their updates up by squared extrapolation and keep a step only if the objective does not fall.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.statistics import log_gamma
from ..session import cut

#: Patterns of one block.
BLOCK = 4096
#: Rounds of large pools between two looks at which are done.
ROUNDS = 4
#: States of large pools are sent to all tasks up to this many bytes, counted with ``STATE_BYTES`` an allele.
BROADCAST, STATE_BYTES = 64 << 20, 400
#: An extrapolated step leaves each component at least this share of its plain update.
LEAST_SHARE = 0.1
TINY = 1e-300
FITTED = (
    "pool string, at int, expected double, posterior_mean double, posterior_sd double, expected_assignments double, "
    "local_evidence double, inclusion double, active boolean, iterations int, converged boolean, effective_rows double"
)


class Patterns:
    """The patterns of a block as flat arrays: of the entries ``at``, ``log_evidence`` and ``of``, of the patterns ``weight``."""

    def __init__(self, value: pa.ListScalar):
        rows = value.values
        at, log_evidence = rows.field("at"), rows.field("log_evidence")
        sizes = np.diff(at.offsets.to_numpy())
        self.at = at.flatten().to_numpy().astype(np.int64)
        self.log_evidence = log_evidence.flatten().to_numpy().astype(float)
        self.weight = rows.field("weight").to_numpy().astype(float)
        self.starts = np.cumsum(sizes) - sizes
        self.of = np.repeat(np.arange(len(sizes)), sizes)
        self.evidence = np.exp(self.log_evidence)

    def by_allele(self, values: np.ndarray, k: int) -> np.ndarray:
        return np.bincount(self.at, values, k)[:k]


def sums(kind: str, patterns: Patterns, k: int, ask: dict) -> np.ndarray:
    """What a course asks for, over one block: a matrix with a row per allele, and one more for totals."""
    p = patterns
    per_entry = p.weight[p.of]
    if kind == "local":
        return _with_total(p.by_allele(per_entry * p.evidence, k), p.weight.sum())
    if kind == "dirichlet":
        x = p.log_evidence + ask["expected"][p.at]
        peak = np.maximum.reduceat(x, p.starts)
        raised = np.exp(x - peak[p.of])
        total = np.add.reduceat(raised, p.starts)
        return _with_total(p.by_allele(per_entry * raised / total[p.of], k), float(p.weight @ (peak + np.log(total))))
    mass = np.where(ask["active"], ask["theta"], 0.0)[p.at] * p.evidence
    mixture = np.add.reduceat(mass, p.starts)
    if kind == "mixture":
        dark = ~(mixture > 0)
        share = per_entry * mass / np.where(dark, 1.0, mixture)[p.of]
        if dark.any():  # all mass lost to rounding: the read goes to its best active allele
            usable = np.where(ask["active"][p.at], p.evidence, -1.0)
            best = np.maximum.reduceat(usable, p.starts)
            hit = np.flatnonzero(dark[p.of] & (usable == best[p.of]) & (usable >= 0))
            _, first = np.unique(p.of[hit], return_index=True)
            share[dark[p.of]] = 0.0
            share[hit[first]] = per_entry[hit[first]]
        return _with_total(p.by_allele(share, k), float(p.weight @ np.log(np.maximum(mixture, TINY))))
    own = ask["active"][p.at]
    if kind == "inclusion":
        frequency = ask["frequency"]
        rest = np.maximum(1 - ask["theta"][p.at], 1e-12)
        baseline = (mixture[p.of] - mass) / rest
        alone = ~(baseline > TINY)
        ratio = np.where(alone, 1.0, p.evidence / np.where(alone, 1.0, baseline))
        out = np.zeros((k + 1, len(frequency) + 2))
        for j, f in enumerate(frequency):
            out[:k, j] = p.by_allele(np.where(own, per_entry * np.log((1 - f) + f * ratio), 0.0), k)
        out[:k, -2] = p.by_allele(np.where(own, per_entry, 0.0), k)
        out[:k, -1] = p.by_allele((own & alone).astype(float), k)
        return out
    # removal: of the undecided alleles of a pattern only the one with the lowest rank may be decided now
    rank = np.where(own, ask["rank"][p.at], np.inf)
    lowest = np.minimum.reduceat(rank, p.starts)[p.of]
    undecided = np.isfinite(rank)
    last = (np.add.reduceat(own.astype(float), p.starts) <= 1)[p.of]
    out = np.zeros((k + 1, 2))
    out[:k, 0] = p.by_allele((undecided & (rank > lowest)).astype(float), k)
    out[:k, 1] = p.by_allele((undecided & last).astype(float), k)
    return out


def _with_total(values: np.ndarray, total: float) -> np.ndarray:
    return np.append(values, total)[:, None]


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of log Γ for x > 0: recurrence to large arguments, then the asymptotic series."""
    x = np.asarray(x, float)
    shifted, below = x + 8, sum(1 / (x + i) for i in range(8))
    square = 1 / (shifted * shifted)
    return np.log(shifted) - 0.5 / shifted - square * (1 / 12 - square * (1 / 120 - square * (1 / 252 - square * (1 / 240 - square / 132)))) - below


class Extrapolation:
    """Squared extrapolation of a fixed-point map, one evaluation at a time.

    ``point`` is where the map is to be evaluated next. Two plain updates give a step length; the longer step
    is kept if the objective there is not below that of the last plain point, else the second plain update is
    gone on from. ``done`` once a plain update changes the point by no more than the tolerance.
    """

    def __init__(self, point: np.ndarray):
        self.point, self.stage, self.evaluations = point, 0, 0
        self.origin = self.first = self.second = None
        self.floor = -math.inf
        self.converged = False

    def take(self, image: np.ndarray, objective: float, change: float, tolerance: float, inside) -> None:
        """The map's value at ``point``; ``inside`` moves a vector into the allowed region."""
        self.evaluations += 1
        if self.stage == 2 and not objective >= self.floor:
            self.point, self.stage = self.second, 0
            return
        if change <= tolerance:
            self.point, self.converged = image, True
            return
        if self.stage != 1:
            self.origin, self.first, self.point, self.stage = self.point, image, image, 1
            return
        step, bend = self.first - self.origin, image - 2 * self.first + self.origin
        size = float(bend @ bend)
        length = -math.sqrt(float(step @ step) / size) if size > 0 else -1.0
        if length >= -1:
            self.point, self.stage = image, 0
            return
        self.floor, self.second, self.stage = objective, image, 2
        self.point = inside(self.origin - 2 * length * step + length * length * bend)


class DirichletCourse:
    """Variational updates ``gamma = alpha + expected reads``; alleles without reads stay implicit with their prior."""

    def __init__(self, k: int, database: int, options):
        self.k, self.options = k, options
        self.alpha = max(1e-9, options.alpha)
        self.silent = max(0, database - k) * self.alpha
        self.kind, self.ask, self.done = "local", {}, False

    def _expected(self, gamma: np.ndarray) -> np.ndarray:
        return digamma(gamma) - digamma(np.array(gamma.sum() + self.silent))

    def _bound(self, gamma: np.ndarray, likelihood: float) -> float:
        """The evidence lower bound, up to a constant."""
        mass = gamma.sum() + self.silent
        return float(likelihood - log_gamma(np.array(mass)) + log_gamma(gamma).sum() - ((gamma - self.alpha) * self._expected(gamma)).sum())

    def take(self, total: np.ndarray) -> None:
        values, last = total[:-1, 0], float(total[-1, 0])
        if self.kind == "local":
            self.local, self.rows = values, last
            self.walk = Extrapolation(values + self.alpha)
        else:
            gamma = self.walk.point
            image = values + self.alpha
            change = float((np.abs(image - gamma) / np.maximum(1.0, gamma)).max())
            self.walk.take(image, self._bound(gamma, last), change, self.options.tolerance, lambda y: np.maximum(y, self.alpha + LEAST_SHARE * values))
        self.kind, self.ask = "dirichlet", {"expected": self._expected(self.walk.point)}
        self.done = self.walk.converged or self.walk.evaluations >= self.options.max_iterations

    def result(self) -> dict:
        gamma = self.walk.point
        mass = gamma.sum() + self.silent
        return {
            "expected": self._expected(gamma), "posterior_mean": gamma / mass, "posterior_sd": np.sqrt(gamma * (mass - gamma) / (mass * mass * (mass + 1))),
            "expected_assignments": gamma - self.alpha, "local_evidence": self.local, "inclusion": np.full(self.k, np.nan), "active": np.ones(self.k, bool),
            "iterations": self.walk.evaluations, "converged": self.walk.converged, "effective_rows": self.rows,
        }


def positive_frequencies(database: int, options) -> tuple[np.ndarray, np.ndarray]:
    """Quadrature of the frequencies of a present allele: points, and normalised log weights.

    Points are equally spaced in logarithms; the density is a gamma with the mean of the expected number of
    present alleles and a shape below one, which has a long tail towards rare alleles.
    """
    points = max(4, min(64, int(options.quadrature_points)))
    low = max(1e-12, min(0.05, options.frequency_floor))
    shape = max(0.05, min(10.0, options.tail_shape))
    present = max(2.0, database * _within(options.active_fraction))
    scale = min(0.5, 1 / present) / shape
    edges = np.exp(np.linspace(math.log(low), math.log(0.95), points + 1))
    frequency = np.sqrt(edges[:-1] * edges[1:])
    weight = (shape - 1) * np.log(frequency) - frequency / scale + np.log(np.maximum(np.diff(edges), np.finfo(float).tiny))
    return frequency, weight - np.logaddexp.reduce(weight)


def _within(fraction: float) -> float:
    return max(1e-6, min(1 - 1e-6, fraction))


class ActiveSetCourse:
    """Frequencies of the present alleles and exact zeros of the others.

    A sweep fits frequencies to the present alleles, takes the inclusion probability of each and removes
    those below the threshold, from the least likely on, unless a read would be left without an allele. It ends with a
    sweep that removes none, or after ``max_sweeps``; a last fit and last probabilities follow.
    """

    def __init__(self, k: int, database: int, options):
        self.k, self.options = k, options
        self.active = np.ones(k, bool)
        self.inclusion = np.ones(k)
        self.frequency, self.log_weight = positive_frequencies(database, options)
        self.sweep, self.settled, self.last, self.iterations = 0, False, False, 0
        self.kind, self.ask, self.done = "local", {}, False

    def take(self, total: np.ndarray) -> None:
        getattr(self, f"_{self.kind}")(total)

    def _local(self, total: np.ndarray) -> None:
        self.local, self.rows = total[:-1, 0], float(total[-1, 0])
        mass = self.local.sum()
        self.theta = np.where(self.local > 0, self.local / mass if mass > 0 else 0.0, 1 / self.k)
        self._fit()

    def _fit(self) -> None:
        theta = np.where(self.active, self.theta, 0.0)
        if not theta.sum() > 0:
            theta = self.active.astype(float)
        self.walk = Extrapolation(theta / theta.sum())
        self._ask("mixture", theta=self.walk.point, active=self.active)

    def _ask(self, kind: str, **ask) -> None:
        self.kind, self.ask = kind, ask

    def _mixture(self, total: np.ndarray) -> None:
        self.counts = np.where(self.active, total[:-1, 0], 0.0)
        mass = self.counts.sum()
        walk = self.walk
        image = self.counts / mass if mass > 0 else walk.point

        def inside(y):
            y = np.maximum(np.where(self.active, y, 0.0), LEAST_SHARE * image)
            return y / y.sum()

        walk.take(image, float(total[-1, 0]), float(np.abs(image - walk.point).max()), max(1e-12, self.options.tolerance), inside)
        if walk.converged or walk.evaluations >= self.options.max_iterations:
            self.iterations += walk.evaluations
            self.theta = walk.point
            self._ask("inclusion", theta=self.theta, active=self.active, frequency=self.frequency)
        else:
            self._ask("mixture", theta=walk.point, active=self.active)

    def _inclusion(self, total: np.ndarray) -> None:
        logs, incident, alone = total[:-1, :-2], total[:-1, -2], total[:-1, -1]
        outside = np.maximum(0.0, self.rows - incident)
        prior = _within(self.options.active_fraction)
        odds = math.log(prior) - math.log1p(-prior) + np.logaddexp.reduce(self.log_weight + outside[:, None] * np.log1p(-self.frequency) + logs, axis=1)
        with np.errstate(over="ignore"):
            probability = 1 / (1 + np.exp(-odds))
        probability = np.where((alone > 0) | (1 - self.theta <= 1e-12), 1.0, probability)
        self.inclusion = np.where(self.active, probability, self.inclusion)
        if self.last:
            self.done = True
            return
        doubtful = np.flatnonzero(self.active & (self.inclusion < max(0.0, min(1.0, self.options.inclusion_threshold))))
        self.rank = np.full(self.k, np.inf)
        self.rank[doubtful[np.lexsort((doubtful, self.theta[doubtful], self.inclusion[doubtful]))]] = np.arange(len(doubtful))
        self.removed = 0
        self._next_removal()

    def _next_removal(self) -> None:
        if np.isfinite(self.rank).any():
            self._ask("removal", theta=self.theta, active=self.active, rank=self.rank)
            return
        self.sweep += 1
        self.settled = not self.removed
        self.last = self.settled or self.sweep >= max(1, min(50, int(self.options.max_sweeps)))
        self._fit()

    def _removal(self, total: np.ndarray) -> None:
        decided = np.isfinite(self.rank) & (total[:-1, 0] == 0)
        out = decided & (total[:-1, 1] == 0)
        self.removed += int(out.sum())
        self.active, self.theta = self.active & ~out, np.where(out, 0.0, self.theta)
        self.rank = np.where(decided, np.inf, self.rank)
        self._next_removal()

    def result(self) -> dict:
        mean = np.where(self.active, self.theta, 0.0)
        with np.errstate(divide="ignore"):
            expected = np.where(mean > 0, np.log(mean), np.nan)
        return {
            "expected": expected, "posterior_mean": mean, "posterior_sd": np.sqrt(np.maximum(0.0, mean * (1 - mean) / max(1.0, self.rows + 1))),
            "expected_assignments": np.where(self.active, self.counts, 0.0), "local_evidence": self.local, "inclusion": self.inclusion, "active": self.active,
            "iterations": self.iterations, "converged": self.walk.converged and self.settled, "effective_rows": self.rows,
        }


COURSES = {"dirichlet": DirichletCourse, "active-set": ActiveSetCourse}


@dataclass
class Packed:
    """Patterns of all pools. ``blocks``: ``pool, patterns, n_blocks, database, k``; ``alleles``: ``pool, node, at``; ``pools``: one row each."""

    blocks: DataFrame
    alleles: DataFrame
    pools: DataFrame


def pack(rows: DataFrame, nodes: DataFrame, block: int = BLOCK) -> Packed:
    """Group evidence rows (``pool, entries, read_weight``) into weighted patterns and these into blocks.

    Evidence that agrees to six digits of its logarithm is one pattern.
    """
    rounded = F.transform("entries", lambda e: F.struct(e["node"].alias("node"), F.round(F.log(e["weight"]), 6).alias("w")))
    patterns = cut(rows.withColumn("key", rounded).groupBy("pool", "key").agg(F.min("entries").alias("entries"), F.sum("read_weight").alias("weight"), F.count(F.lit(1)).alias("n")))
    named = patterns.select("pool", F.explode("key.node").alias("node")).distinct().groupBy("pool").agg(F.array_sort(F.collect_list("node")).alias("names"))
    sizes = patterns.groupBy("pool").agg(F.count(F.lit(1)).alias("n_patterns"), F.sum("n").alias("n_rows"))
    per_locus = nodes.groupBy("locus").agg(F.count(F.lit(1)).alias("database"))
    pools = named.join(sizes, "pool").withColumn("locus", F.element_at(F.split("pool", "\t"), -1)).join(per_locus, "locus", "left")
    pools = cut(pools.withColumn("database", F.coalesce("database", F.lit(0)).cast("int")).withColumn("n_blocks", F.ceil(F.col("n_patterns") / block).cast("int")))
    placed = patterns.join(pools.select("pool", "names", "n_blocks", "database"), "pool").select(
        "pool", "n_blocks", "database", F.size("names").alias("k"),
        F.pmod(F.xxhash64("key"), F.col("n_blocks")).alias("block"),
        F.struct(
            F.transform("entries", lambda e: (F.array_position("names", e["node"]) - 1).cast("int")).alias("at"),
            F.transform("entries", lambda e: F.log(e["weight"])).alias("log_evidence"), "weight",
        ).alias("pattern"),
    )
    blocks = cut(placed.groupBy("pool", "block", "n_blocks", "database", "k").agg(F.collect_list("pattern").alias("patterns")))
    alleles = pools.select("pool", F.posexplode("names").alias("at", "node"))
    return Packed(blocks, alleles, pools)


def _rows_of(pool: str, course) -> pa.RecordBatch:
    found = course.result()
    k = course.k
    whole = {"pool": pa.array([pool] * k), "at": pa.array(np.arange(k), pa.int32())}
    for name in ("expected", "posterior_mean", "posterior_sd", "expected_assignments", "local_evidence", "inclusion"):
        values = np.asarray(found[name], float)
        whole[name] = pa.array(values, pa.float64(), mask=np.isnan(values))
    whole["active"] = pa.array(np.asarray(found["active"], bool))
    whole["iterations"] = pa.array(np.full(k, found["iterations"], np.int32))
    whole["converged"] = pa.array(np.full(k, bool(found["converged"])))
    whole["effective_rows"] = pa.array(np.full(k, float(found["effective_rows"])))
    return pa.RecordBatch.from_pydict(whole)


def fit_pools(packed: Packed, options) -> DataFrame:
    """Run the course of ``options.model`` for every pool: ``pool, node`` and the columns of a fit."""
    course_of = COURSES[options.model]

    def whole(batches):
        for batch in batches:
            for pool, database, k, value in zip(*(batch.column(c) for c in ("pool", "database", "k", "patterns")), strict=True):
                course, patterns = course_of(k.as_py(), database.as_py(), options), Patterns(value)
                while not course.done:
                    course.take(sums(course.kind, patterns, course.k, course.ask))
                yield _rows_of(pool.as_py(), course)

    small = packed.blocks.filter("n_blocks = 1").select("pool", "database", "k", "patterns").mapInArrow(whole, FITTED)
    large = packed.blocks.filter("n_blocks > 1")
    fitted = small if large.isEmpty() else small.unionByName(_fit_large(large, options))
    return fitted.join(packed.alleles, ["pool", "at"]).drop("at")


def _fit_large(blocks: DataFrame, options) -> DataFrame:
    """The courses of pools of several blocks, in rounds over the whole cluster."""
    course_of = COURSES[options.model]
    state_schema = "pool string, state binary, done boolean"

    def begin(batches):
        for batch in batches:
            courses = [course_of(k.as_py(), n.as_py(), options) for k, n in zip(batch.column("k"), batch.column("database"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("pool"), pa.array([pickle.dumps(c) for c in courses], pa.binary()), pa.array([c.done for c in courses])], names=["pool", "state", "done"])

    def part(batches):
        for batch in batches:
            for pool, value, state in zip(*(batch.column(c) for c in ("pool", "patterns", "state")), strict=True):
                course = pickle.loads(state.as_py())
                out = sums(course.kind, Patterns(value), course.k, course.ask).ravel()
                yield pa.RecordBatch.from_arrays([pa.array([pool.as_py()] * len(out)), pa.array(np.arange(len(out)), pa.int32()), pa.array(out)], names=["pool", "i", "v"])

    def advance(batches):
        for batch in batches:
            states = []
            for state, total in zip(batch.column("state"), batch.column("total"), strict=True):
                course = pickle.loads(state.as_py())
                if not course.done:
                    course.take(total.values.to_numpy().reshape(course.k + 1, -1))
                states.append(course)
            yield pa.RecordBatch.from_arrays([batch.column("pool"), pa.array([pickle.dumps(c) for c in states], pa.binary()), pa.array([c.done for c in states])], names=["pool", "state", "done"])

    def finish(batches):
        for batch in batches:
            for pool, state in zip(batch.column("pool"), batch.column("state"), strict=True):
                yield _rows_of(pool.as_py(), pickle.loads(state.as_py()))

    pools = blocks.select("pool", "database", "k").distinct()
    few = (pools.agg(F.sum("k").alias("k")).first()["k"] or 0) * STATE_BYTES <= BROADCAST
    state = cut(pools.mapInArrow(begin, state_schema))
    finished: list[DataFrame] = []
    while True:
        for _ in range(ROUNDS):
            asked = state.filter("NOT done").select("pool", "state")
            parts = blocks.select("pool", "patterns").join(F.broadcast(asked) if few else asked, "pool").mapInArrow(part, "pool string, i int, v double")
            added = parts.groupBy("pool", "i").agg(F.sum("v").alias("v")).groupBy("pool").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).getField("v").alias("total"))
            state = cut(state.join(added, "pool", "left").select("pool", "state", "total").mapInArrow(advance, state_schema))
        finished.append(state.filter("done"))
        state = state.filter("NOT done")
        if state.isEmpty():
            break
    out = finished[0]
    for frame in finished[1:]:
        out = out.unionByName(frame)
    return out.mapInArrow(finish, FITTED)
