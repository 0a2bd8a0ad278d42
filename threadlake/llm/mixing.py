"""Mixing sources to target weights by iterative proportional fitting.

Token weights are summed for each cell of (source, language, topic), the cells
are raked to the marginal targets of each dimension in turn, and each document
is then kept with its cell's calibrated probability.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.llm.common import drop_written, narrow, uniform, written

ARRAY = 200_000  # cells times values that are raked as one row of arrays
BLOCK = 30  # rounds between two looks at the marginals
STALLED = 0.9  # a block that leaves more of the difference than that takes off too little to go on


def rake(cells: DataFrame, dims: list[str], targets: Mapping[str, DataFrame], tolerance: float = 1e-9, array: int = ARRAY) -> DataFrame:
    """``cells`` (``dims``, ``weight``) with ``fitted``, the weights raked to ``targets``.

    ``targets[d]`` has the columns ``d, share``; shares are rescaled to the
    values that occur. Rounds go on in blocks of ``BLOCK`` until no marginal is
    off by more than ``tolerance`` of the total, or until a block leaves more than
    ``STALLED`` of the difference: then the cells that are empty rule the targets
    out (or all but), which is reported as a warning with what is left. Cells of
    weight 0 stay 0. While its cells times values are at most ``array``, the cell
    table is one row of arrays and a block is one expression; a larger one is
    raked by window sums, three rounds for each written table. Both stop by the
    same rule at the same rounds.
    """
    state = cells.withColumn("fitted", F.col("weight").cast("double"))
    values = cells.agg(F.count("*").alias("n"), *[F.countDistinct(F.struct(d)).alias(d) for d in dims]).first()
    for d in dims:
        found = targets[d].groupBy(d).agg(F.sum("share").alias("share"))
        joined = state.join(narrow(found.withColumnRenamed(d, "t_value"), 100, values[d]), F.col(d).eqNullSafe(F.col("t_value")), "left").drop("t_value")
        once = F.coalesce(F.col("share"), F.lit(0.0)) / F.count("*").over(Window.partitionBy(d))
        state = joined.withColumn("share", once)
        state = state.withColumn(f"want_{d}", F.sum("share").over(Window.partitionBy(d)) / F.sum("share").over(Window.partitionBy())).drop("share")
    state = written(state)
    total = F.sum("fitted").over(Window.partitionBy())
    off = F.greatest(*[F.abs(F.sum("fitted").over(Window.partitionBy(d)) / total - F.col(f"want_{d}")) for d in dims], F.lit(0.0))
    residual = lambda df: df.select(off.alias("off")).agg(F.max("off")).first()[0] or 0.0
    small = values.n * sum(values[d] for d in dims) <= array
    left, before = residual(state), None
    while left > tolerance and (before is None or left <= STALLED * before):
        for step in [BLOCK] if small else [3] * (BLOCK // 3):
            nxt = written(raked_arrays(state, dims, step) if small else raked_windows(state, dims, step))
            drop_written(state)
            state = nxt
        left, before = residual(state), left
    if left > tolerance:
        warnings.warn(f"raking ended with a marginal off by {left:.3g} of the total", stacklevel=2)
    return state.drop(*[f"want_{d}" for d in dims])


def raked_windows(state: DataFrame, dims: list[str], rounds: int) -> DataFrame:
    """``state`` after some rounds, by window sums."""
    total = F.sum("fitted").over(Window.partitionBy())
    for d in dims * rounds:
        own = F.sum("fitted").over(Window.partitionBy(d))
        state = state.withColumn("fitted", F.when(own > 0, F.col("fitted") * F.col(f"want_{d}") * total / own).otherwise(0.0))
    return state


def raked_arrays(state: DataFrame, dims: list[str], rounds: int) -> DataFrame:
    """The same on one row of arrays, in a fixed order of the cells."""
    numbered = state.withColumns({f"at_{d}": (F.dense_rank().over(Window.partitionBy().orderBy(F.col(d).asc_nulls_first())) - 1).cast("int") for d in dims})
    columns = [*dims, "weight", "fitted", *[f"{p}_{d}" for d in dims for p in ("at", "want")]]
    one = numbered.agg(F.array_sort(F.collect_list(F.struct(*[F.col(f"at_{d}") for d in dims], F.struct(*columns).alias("cell")))).alias("s")).select(F.transform("s", lambda x: x.cell).alias("cells"))
    one = one.withColumns({n: F.col(f"cells.{n}") for d in dims for n in (f"at_{d}", f"want_{d}")} | {"fit": F.col("cells.fitted"), "all": F.aggregate("cells.fitted", F.lit(0.0), lambda a, x: a + x)})
    for d in dims:  # the wanted total of each value, by its number
        by_value = F.array_sort(F.array_distinct(F.arrays_zip(f"at_{d}", f"want_{d}")))
        one = one.withColumn(f"want_{d}", F.transform(by_value[f"want_{d}"], lambda x: F.col("all") * x))

    def step(fit: Column, d: str) -> Column:
        at, want = F.col(f"at_{d}"), F.col(f"want_{d}")
        sums = F.transform(want, lambda _, k: F.aggregate(F.zip_with(fit, at, lambda f, i: F.when(i == k, f).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x))
        # a lambda over one element binds the sums, so that they are taken once
        return F.aggregate(F.array(sums), fit, lambda _, s: F.zip_with(fit, at, lambda f, i: F.when(F.get(s, i) > 0, f * F.get(want, i) / F.get(s, i)).otherwise(0.0)))

    turns = F.sequence(F.lit(1), F.lit(rounds * len(dims)))

    def turn(fit: Column, n: Column) -> Column:
        out = step(fit, dims[-1])
        for i, d in reversed(list(enumerate(dims[:-1], 1))):
            out = F.when(n % len(dims) == i, step(fit, d)).otherwise(out)
        return out

    fitted = one.select("cells", F.aggregate(turns, F.col("fit"), turn).alias("fit")).select(F.explode(F.arrays_zip("cells", "fit")).alias("x"))
    return fitted.select(*[F.col(f"x.cells.{c}").alias(c) for c in dims], F.col("x.cells.weight").alias("weight"), F.col("x.fit").alias("fitted"), *[F.col(f"x.cells.want_{d}").alias(f"want_{d}") for d in dims])


def flat_targets(cells: DataFrame, dim: str, power: float = 0.5) -> DataFrame:
    """Default targets: each value's share of the weight to the given power (1 keeps it, 0 is uniform)."""
    return cells.groupBy(dim).agg(F.pow(F.sum("weight"), F.lit(power)).alias("share"))


def mix(docs: DataFrame, dims: Mapping[str, Column], tokens: Column, targets: Mapping[str, DataFrame] | None = None, keep: float = 0.5, tolerance: float = 1e-9, id_col: str = "doc_id", seed: int = 1) -> DataFrame:
    """The sampled rows of ``docs`` with ``mix_<dim>``, ``mix_tokens`` and ``mix_probability``.

    A cell's probability is proportional to fitted/actual weight and at most 1;
    the factor is set, cell by cell with those at 1 held, so that ``keep`` of
    the tokens are expected to stay. A document's draw depends on its id and
    ``seed`` alone, so repeated rows share their fate, and so do all rows of a
    null id. Null dimensions form a
    value of their own. An empty table gives an empty one. Clashing names are
    avoided by the ``mix_`` prefix.
    """
    names = [f"mix_{d}" for d in dims]
    tagged = docs.withColumns({f"mix_{d}": c for d, c in dims.items()} | {"mix_tokens": tokens.cast("double")})
    cells = written(tagged.groupBy(*names).agg(F.sum("mix_tokens").alias("weight")))
    wanted = {n: (targets or {}).get(n[4:], None) for n in names}
    wanted = {n: t.withColumnRenamed(n[4:], n) if t is not None else flat_targets(cells, n) for n, t in wanted.items()}
    fitted = rake(cells, names, wanted, tolerance=tolerance)
    # water-filling on the cells: scale = (budget - weight of full cells) / fitted of the others, by falling need
    need = F.when(F.col("weight") > 0, F.col("fitted") / F.col("weight")).otherwise(0.0)
    falling = Window.partitionBy().orderBy(F.col("need").desc(), *names)
    ranked = fitted.withColumn("need", need).withColumns({
        "full": F.coalesce(F.sum("weight").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "left": F.sum("fitted").over(falling.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        "all": F.sum("weight").over(Window.partitionBy()),
    })
    scale = F.when(F.col("left") > 0, (F.col("all") * F.lit(keep) - F.col("full")) / F.col("left"))
    fits = ranked.withColumn("scale", scale).withColumn("scale", F.max(F.when(F.col("scale") * F.col("need") <= 1, F.col("scale"))).over(Window.partitionBy()))
    chance = fits.select(*[F.col(n).alias("c_" + n) for n in names], F.least(F.lit(1.0), F.coalesce(F.col("scale"), F.lit(1.0)) * F.col("need")).alias("mix_probability"))
    chance = written(chance.coalesce(1))
    match = None
    for n in names:
        one = F.col(n).eqNullSafe(F.col("c_" + n))
        match = one if match is None else match & one
    # as many rows as cells: broadcast only while that is a small table
    side = F.broadcast(chance) if chance.count() <= 50_000 else chance
    joined = tagged.join(side, match, "left").drop(*["c_" + n for n in names])
    return joined.where(uniform(F.col(id_col), seed=seed) < F.coalesce(F.col("mix_probability"), F.lit(0.0)))
