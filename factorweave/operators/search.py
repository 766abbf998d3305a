"""Genetic search for expressions: scoring in Spark, trees and draws on the driver.

A population is a list of trees.  Scoring takes batches of expressions, each one plan over
the panel; only one row an expression comes back.  All draws come from one seeded generator.
"""

from __future__ import annotations

import logging
import random
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorweave.functions.stats import DAY, INDUSTRY, SECU
from factorweave.operators.correlation import correlated, independent
from factorweave.operators.ic import batch_ic
from factorweave.plans import ast
from factorweave.plans.population import Subtrees, evaluate_many, scores_of
from factorweave.sources.panel import read_fitness, write_fitness, write_values
from factorweave.sources.shared import Store

_LOG = logging.getLogger(__name__)

_SCORED = "factor_name string, ic double, tvalue double, valid_factor_size long, fitness_score double"


def score_batch(panel: DataFrame, trees: list[ast.Node], ret_col: str = "ret") -> DataFrame:
    """(factor_name, ic, tvalue, valid_factor_size) of each tree, from one plan.

    panel has the return to explain in ret_col; ic is the mean daily product of the held
    z-score and it, in %, and valid_factor_size the number of days that have one.
    """
    names = {f"f{i}": t for i, t in enumerate(trees)}
    values = evaluate_many(panel, names, keep=[ret_col]).where(F.col(ret_col).isNotNull())
    return scores_of(values.select(F.lit(0).alias("batch"), SECU, DAY, F.col(ret_col).cast("double").alias("ret"), F.array(*names).alias("f")), [trees])


def with_fitness(scored: DataFrame) -> DataFrame:
    """fitness_score = |ic| + 3 tanh(|t| / 3), 0 with too few days; selection_probability is its share."""
    few = F.col("valid_factor_size") < F.greatest(F.lit(100), F.floor(F.col("days") / 5))
    fitness = F.when(few, 0.0).otherwise(F.abs("ic") + 3 * F.tanh(F.abs("tvalue") / 3))
    scored = scored.withColumn("fitness_score", fitness).drop("days")
    total = F.sum("fitness_score").over(Window.partitionBy())  # one row an expression
    return scored.withColumn("selection_probability", F.when(total > 0, F.col("fitness_score") / total).otherwise(1 / F.count("*").over(Window.partitionBy())))


@dataclass
class Scored:
    tree: ast.Node
    ic: float
    tvalue: float
    days: int
    fitness: float


def score(panel: DataFrame, trees: list[ast.Node], ret_col: str = "ret", batch: int = 40, subtrees: Subtrees | None = None) -> list[Scored]:
    """Distinct trees with their fitness, best first; ties by name.

    More trees than a batch are computed with stored subtrees: those of `subtrees`, over the
    same panel and return, or ones that are made for this call.
    """
    by_name = {str(t): t for t in trees}
    distinct = list(by_name.values())
    if not distinct:
        return []
    if len(distinct) <= batch and subtrees is None:
        rows = with_fitness(score_batch(panel, distinct, ret_col)).collect()  # a row an expression
    else:
        with subtrees.borrowed() if subtrees else Subtrees(panel, ret_col) as stored:
            rows = with_fitness(stored.scores(distinct, batch)).collect()
    out = [Scored(by_name[r["factor_name"]], r["ic"], r["tvalue"], r["valid_factor_size"], r["fitness_score"]) for r in rows]
    return sorted(out, key=lambda s: (-s.fitness, str(s.tree)))


class Wheel:
    """Draws by weight without replacement; a draw costs the logarithm of the number.

    A tree of sums: node i holds the sum of its two children, leaves the weights.
    """

    def __init__(self, weights: list[float]):
        self.n = len(weights)
        self.size = 1 << max(self.n - 1, 0).bit_length()
        weights = weights if any(w > 0 for w in weights) else [1.0] * self.n  # evenly
        self.sums = [0.0] * self.size + list(weights) + [0.0] * (self.size - self.n)
        for i in range(self.size - 1, 0, -1):
            self.sums[i] = self.sums[2 * i] + self.sums[2 * i + 1]

    def put(self, i: int, weight: float) -> None:
        i += self.size
        self.sums[i] = weight
        while i > 1:
            i //= 2
            self.sums[i] = self.sums[2 * i] + self.sums[2 * i + 1]

    def place(self, rng: random.Random) -> int:
        """One place, by weight; nothing is taken."""
        i, x = 1, rng.random() * self.sums[1]
        while i < self.size:
            i *= 2
            if self.sums[i + 1] > 0 and (x >= self.sums[i] or self.sums[i] <= 0):
                x -= self.sums[i]
                i += 1
        return i - self.size

    def draw(self, k: int, rng: random.Random) -> list[int]:
        """k different places (all, if there are fewer), after which the wheel is as before.

        Places of weight 0 come after all others, evenly.
        """
        taken: dict[int, float] = {}
        while len(taken) < min(k, self.n):
            if self.sums[1] <= 0:
                left = [i for i in range(self.n) if i not in taken]
                more = rng.sample(left, min(k, self.n) - len(taken))
                taken |= {i: 0.0 for i in more}
                break
            i = self.place(rng)
            taken[i] = self.sums[i + self.size]
            self.put(i, 0.0)
        for i, w in taken.items():
            self.put(i, w)
        return list(taken)


def select(scored: list[Scored], k: int, rng: random.Random, wheel: Wheel | None = None) -> list[ast.Node]:
    """k trees by fitness without replacement; evenly if no fitness is above 0.  wheel: that of these trees, if many are drawn."""
    return [scored[i].tree for i in (wheel or Wheel([s.fitness for s in scored])).draw(k, rng)]


def evolve(scored: list[Scored], size: int, rng: random.Random, depth: int, columns: list[str], elite: float = 0.1, crossover: float = 0.8, mutation: float = 0.3, boost: int = 2, limit: int = 5, least: float = 0.3) -> list[ast.Node]:
    """The next population: the elite and offspring of selected pairs.

    A pair is crossed and mutated by chance; after boost * size draws always both.  After
    limit * size draws the population is done if `least` of it is there, else new trees fill
    it up to that.  Offspring that repeat a tree aren't taken.
    """
    next_ = {str(s.tree): s.tree for s in scored[: max(1, int(size * elite))]}
    wheel = Wheel([s.fitness for s in scored])
    for tried in range(limit * size):
        if len(next_) >= size:
            break
        always = tried >= boost * size
        pair = select(scored, 2, rng, wheel)
        pair = (pair[0], pair[-1])
        if always or rng.random() < crossover:
            pair = ast.crossover(*pair, rng)
        for child in pair:
            child = ast.mutate(child, rng, columns) if always or rng.random() < mutation else child
            child = ast.prune(child, 2 * depth, rng, columns)
            if child.op is not None and len(next_) < size:
                next_.setdefault(str(child), child)
    while len(next_) < least * size:
        t = ast.draw(rng, depth, columns)
        next_.setdefault(str(t), t)
    return list(next_.values())


def first_components(values: DataFrame, factor_cols: list[str], securities: int = 2048) -> DataFrame:
    """(factor, pc): for each factor the first principal component over days, of unit length.

    Securities are dealt over tasks, about so many each, that give the products of each day
    with all days; their sums over the tasks are the day by day matrix, whose size doesn't
    grow with the securities.  Missing values count as 0, and a factor that has no component
    gets zeros.  The component's largest entry is positive.
    """
    days = [r[0] for r in values.select(DAY).distinct().orderBy(DAY).collect()]  # a row a calendar day
    place, n_days = {d: i for i, d in enumerate(days)}, len(days)
    parts = -(-(values.agg(F.count_distinct(SECU)).first()[0] or 1) // securities)
    long = values.select(SECU, DAY, F.explode(F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).alias("v")) for c in factor_cols])).alias("x")).select(SECU, DAY, "x.*")
    long = long.where("v is not null").withColumn("part", F.pmod(F.xxhash64(SECU), F.lit(parts)))

    def products(pdf):
        """One row a day that some security of the part has: products with all days, the day's sum, the part's securities."""
        import pandas as pd

        secu = {s: i for i, s in enumerate(pdf[SECU].unique())}
        x = np.zeros((len(secu), n_days))
        x[pdf[SECU].map(secu).to_numpy(dtype=int), pdf[DAY].map(place).to_numpy(dtype=int)] = pdf["v"]
        some = np.flatnonzero(x.any(0))
        some = some if len(some) else np.arange(min(1, n_days))  # its securities count, too
        n = np.zeros(len(some), np.int64)
        n[:1] = len(secu)
        return pd.DataFrame({"factor": pdf["factor"].iloc[0], "day": some, "products": list(x[:, some].T @ x), "total": x[:, some].sum(0), "securities": n})

    def summed(key, pdf):
        import pandas as pd

        return pd.DataFrame({"factor": [key[0]], "day": [key[1]], "products": [np.sum(np.stack(pdf["products"].to_list()), axis=0)], "total": [pdf["total"].sum()], "securities": [pdf["securities"].sum()]})

    def component(key, pdf):
        import pandas as pd

        gram, total, n, v = np.zeros((n_days, n_days)), np.zeros(n_days), int(pdf["securities"].sum()), np.zeros(n_days)
        for day, row, t in zip(pdf["day"], pdf["products"], pdf["total"], strict=True):
            gram[day], total[day] = row, t
        gram = gram - np.outer(total, total) / max(n, 1)
        if n > 1 and np.isfinite(gram).all() and np.trace(gram) > 1e-12 * (total @ total):
            v = np.linalg.eigh(gram)[1][:, -1]
            v = v * np.sign(v[np.abs(v).argmax()])
        return pd.DataFrame({"factor": [key[0]], "pc": [v.tolist()]})

    schema = "factor string, day int, products array<double>, total double, securities long"
    sums = long.groupBy("factor", "part").applyInPandas(products, schema)
    if parts > 1:
        sums = sums.groupBy("factor", "day").applyInPandas(summed, schema)
    found = sums.groupBy("factor").applyInPandas(component, "factor string, pc array<double>")
    names = values.sparkSession.createDataFrame([(c,) for c in factor_cols], "factor string")
    return names.join(found, "factor", "left").select("factor", F.coalesce("pc", F.array_repeat(F.lit(0.0), n_days)).alias("pc"))


def uncorrelated(order: list[str], components: DataFrame, threshold: float = 0.9) -> list[str]:
    """Names, in order, whose component correlates with that of no kept one beyond the threshold, up or down.

    components: (factor, pc).  They stay in tasks; only pairs beyond the threshold come back.
    """
    edges = [(r["a"], r["b"]) for r in correlated(components, threshold).toLocalIterator()]
    return independent(order, edges)


@dataclass
class Search:
    """The parameters of a run.  pc_threshold: also keep only factors of unlike first components."""

    size: int = 2000
    epochs: int = 20
    depth: int = 3
    seed: int = 0
    warm_start: int = 1
    batch: int = 40
    ret_col: str = "ret"
    ic_save_threshold: float = 0.0
    pc_threshold: float | None = None
    columns: list[str] = field(default_factory=lambda: list(ast.COLUMNS))

    def start(self, panel: DataFrame, rng: random.Random, given: list[str], subtrees: Subtrees | None = None) -> list[ast.Node]:
        """Trees from strings, or drawn; with a warm start the best of so many times the size, 50,000 at most."""
        trees = {str(t): t for t in map(ast.parse, given)}
        wanted = self.size if self.warm_start <= 1 else min(self.warm_start * self.size, 50_000)
        while len(trees) < wanted:
            t = ast.draw(rng, self.depth, self.columns)
            trees.setdefault(str(t), t)
        if len(trees) > self.size:
            return [s.tree for s in score(panel, list(trees.values()), self.ret_col, self.batch, subtrees)[: self.size]]
        return list(trees.values())

    def fit(self, panel: DataFrame, given: list[str] | None = None, out: str | None = None) -> list[dict]:
        """One dict for each epoch: its report, and the scored trees, best first.

        With `out`, an epoch's fitness table and the values of its saved factors are stored
        (out/fitness, out/values) before the next one begins, so a run that breaks off leaves them.
        """
        rng, history = random.Random(self.seed), []
        kept = Store(panel.sparkSession)
        needed = {SECU, DAY, INDUSTRY, self.ret_col, *ast.COLUMNS, *self.columns, *[c for t in map(ast.parse, given or []) for c in t.columns()]}
        panel = kept.saved(panel.select(*[F.col(f"`{c}`") for c in panel.columns if c in needed]), "searched")
        subtrees = Subtrees(panel, self.ret_col) if max(self.size, self.warm_start * self.size) > self.batch else None
        try:
            trees = self.start(panel, rng, given or [], subtrees)
            _LOG.info("start with %d trees", len(trees))
            for epoch in range(self.epochs):
                scored = score(panel, trees, self.ret_col, self.batch, subtrees)
                if self.pc_threshold is not None:
                    scored = self._unlike(panel, scored, subtrees)
                history.append({"epoch": epoch, "scored": scored, "report": report(scored), "saved": [s for s in scored if s.ic > self.ic_save_threshold]})
                _LOG.info("epoch %d: %d trees, %d saved, %s", epoch, len(scored), len(history[-1]["saved"]), history[-1]["report"])
                if out:
                    self.store(panel, history[-1], out)
                if epoch + 1 < self.epochs:
                    trees = evolve(scored, self.size, rng, self.depth, self.columns)
        finally:
            if subtrees:
                subtrees.close()
            kept.close()
        return history

    def store(self, panel: DataFrame, done: dict, out: str) -> None:
        """Writes one epoch's fitness, and (SecuCode, TradingDay, factor, value) of its saved factors, a batch at a time."""
        write_fitness(fitness_table(panel.sparkSession, done["scored"]), f"{out}/fitness", done["epoch"])
        saved = [s.tree for s in done["saved"]]
        for a in range(0, len(saved), self.batch):
            names = {f"f{i}": t for i, t in enumerate(saved[a : a + self.batch])}
            own = F.array(*[F.struct(F.lit(str(t)).alias("factor"), F.col(f).alias("value")) for f, t in names.items()])
            write_values(evaluate_many(panel, names).select(SECU, DAY, F.explode(own).alias("x")).select(SECU, DAY, "x.*").where("value is not null"), f"{out}/values", done["epoch"])

    def _unlike(self, panel: DataFrame, scored: list[Scored], subtrees: Subtrees | None = None) -> list[Scored]:
        """All of scored; a tree whose first component correlates with that of a better one gets fitness 0."""
        able = [s for s in scored if s.fitness > 0]
        if not able:
            return scored
        with Store(panel.sparkSession) as store:
            folder = store.folder("components")
            for a in range(0, len(able), self.batch):
                names = {f"f{i}": s.tree for i, s in enumerate(able[a : a + self.batch])}
                own = panel.sparkSession.createDataFrame([(f, str(t)) for f, t in names.items()], "factor string, name string")
                pcs = first_components(subtrees.values(names) if subtrees else evaluate_many(panel, names), list(names))
                pcs.join(F.broadcast(own), "factor").select(F.col("name").alias("factor"), "pc").write.mode("append").parquet(folder)
            kept = set(uncorrelated([str(s.tree) for s in able], panel.sparkSession.read.parquet(folder), self.pc_threshold))
        out = [s if str(s.tree) in kept else replace(s, fitness=0.0) for s in scored]
        return sorted(out, key=lambda s: (-s.fitness, str(s.tree)))


def report(scored: list[Scored]) -> dict[str, float]:
    """Quantiles of ic, the mean |ic| and the mean depth of a population."""
    ics = np.array([s.ic for s in scored] or [0.0])
    out = {f"ic_q{int(q * 100)}": float(np.quantile(ics, q)) for q in (1, 0.9, 0.8, 0.2, 0.1, 0)}
    return out | {"mean_abs_ic": float(np.abs(ics).mean()), "mean_depth": float(np.mean([s.tree.depth for s in scored] or [0]))}


def fitness_table(spark, scored: list[Scored]) -> DataFrame:
    return spark.createDataFrame([(str(s.tree), float(s.ic), float(s.tvalue), int(s.days), float(s.fitness)) for s in scored], _SCORED)


def worth_keeping(fitness: DataFrame, share: float = 0.6, least_t: float = 3.0) -> DataFrame:
    """Of merged fitness tables the factors worth another look.

    Those of at least `share` of the largest number of days and |t| > least_t; once for each
    name, and of equal (ic, t) the shallowest expression.
    """
    most = Window.partitionBy()
    depth = F.length("factor_name") - F.length(F.regexp_replace("factor_name", r"\(", ""))
    df = fitness.withColumns({"__most": F.max("valid_factor_size").over(most), "__depth": depth}).where((F.col("valid_factor_size") >= share * F.col("__most")) & (F.abs("tvalue") > least_t))
    for keys, order in ((["factor_name"], [F.desc(F.abs("tvalue"))]), (["ic", "tvalue"], [F.col("__depth"), F.col("factor_name")])):
        df = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")
    return df.drop("__most", "__depth").orderBy(F.desc(F.abs("tvalue")))


def out_of_sample(panel: DataFrame, expressions: list[str], start: str, end: str | None = None, ret_col: str = "ret", threshold: float = 0.0) -> DataFrame:
    """batch_ic of expressions over [start, end]; values are computed over all days, so windows are warm."""
    trees = {f"f{i}": ast.parse(e) for i, e in enumerate(expressions)}
    values = evaluate_many(panel, trees, keep=[ret_col])
    day = F.col(DAY)
    values = values.where((day >= F.lit(start).cast("date")) & (day <= F.lit(end).cast("date") if end else F.lit(True))).withColumnRenamed(ret_col, "ret")
    names = F.create_map(*[F.lit(x) for f, t in trees.items() for x in (f, str(t))])
    return batch_ic(values, list(trees), threshold).withColumn("factor", names[F.col("factor")]).orderBy(F.desc(F.abs("ic")))


def revalidate(panel: DataFrame, fitness_path: str, start: str, end: str | None = None, ret_col: str = "ret", threshold: float = 1.0, share: float = 0.6, least_t: float = 3.0) -> DataFrame:
    """The factors of all stored epochs that are worth keeping, tested over [start, end]; largest |ic| first."""
    kept = worth_keeping(read_fitness(panel.sparkSession, fitness_path), share, least_t)
    names = [r["factor_name"] for r in kept.select("factor_name").collect()]  # a row an expression
    _LOG.info("%d factors are tested out of sample", len(names))
    if not names:
        names, threshold = [next(c for c in panel.columns if c in ast.COLUMNS)], float("inf")  # an empty table of the same columns
    return out_of_sample(panel, names, start, end, ret_col, threshold)
