"""Preparation recipes: named steps with contracts, checked in order before Spark runs and compiled into one lazy plan.

A recipe works on tables: expr (spot, gene, value), obs (a row a spot). A step says which facts about them it needs, which it makes true and which it
makes untrue; a recipe whose steps stand in a wrong order raises before any plan is made. Steps hold no actions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import log_normalised
from . import contracts, sampling

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Step:
    name: str
    run: Callable[..., Tables]
    needs: frozenset
    gives: frozenset
    ends: frozenset


_STEPS: dict[str, Step] = {}


def step(name: str, needs: str = "", gives: str = "", ends: str = "") -> Callable:
    """Makes run(tables, **parameters) -> changed tables known under a name."""

    def put(f: Callable[..., Tables]) -> Callable[..., Tables]:
        if name in _STEPS:
            raise ValueError(f"step {name!r} is registered twice")
        _STEPS[name] = Step(name, f, *(frozenset(x.split()) for x in (needs, gives, ends)))
        return f

    return put


@step("filter", needs="expr.counts", gives="expr.filtered")
def _filter(tables: Tables, min_spots: int, min_genes: int) -> Tables:
    expr = contracts.quality_filter(tables["expr"], min_spots, min_genes)
    out = {"expr": expr}
    return out | {"obs": tables["obs"].join(expr.select("spot").distinct(), "spot", "left_semi")} if "obs" in tables else out


@step("drop_unlabelled", needs="obs.label", gives="obs.labelled")
def _drop_unlabelled(tables: Tables) -> Tables:
    obs = contracts.labelled(tables["obs"])
    return {"obs": obs, "expr": tables["expr"].join(obs.select("spot"), "spot", "left_semi")}


@step("normalise", needs="expr.counts", gives="expr.log", ends="expr.counts")
def _normalise(tables: Tables, target: float = 1e4) -> Tables:
    expr = tables["expr"]
    total = expr.groupBy("spot").agg(F.sum("value").alias("_total"))
    return {"expr": expr.join(total, "spot").select("spot", "gene_idx", log_normalised(F.col("value"), F.col("_total"), target).alias("value"))}


@step("select_genes", needs="expr.log", gives="expr.selected")
def _select_genes(tables: Tables, n: int) -> Tables:
    """The n genes of largest variance over the spots that have them, ties by gene."""
    top = tables["expr"].groupBy("gene_idx").agg(F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("_v")).orderBy(F.desc(F.round("_v", 9)), "gene_idx").limit(n)
    return {"expr": tables["expr"].join(top.select("gene_idx"), "gene_idx", "left_semi")}


@step("split_strata", needs="obs.label", gives="obs.split")
def _split_strata(tables: Tables, by: list[str], fraction: float, seed: int = 42) -> Tables:
    return {"obs": sampling.stratified_split(tables["obs"], by, fraction, seed, "spot")}


@step("split_groups", needs="obs.label obs.group", gives="obs.split")
def _split_groups(tables: Tables, group: str, shares: tuple[float, float], seed: int = 42) -> Tables:
    return {"obs": sampling.group_split(tables["obs"], group, "label", shares, seed)}


@step("split_none", gives="obs.split", ends="obs.label")
def _split_none(tables: Tables) -> Tables:
    """All rows; what tells a label goes, so that an unsupervised step can't see it."""
    obs = tables["obs"].withColumn("split", F.lit("all"))
    return {"obs": obs.drop(*(c for c in obs.columns if c.lower() in {x.lower() for x in contracts.LABEL_LIKE}))}


@step("view", needs="expr.selected obs.split", gives="view")
def _view(tables: Tables, columns: list[str]) -> Tables:
    """What one model is given: the asked columns of obs beside the expression."""
    return {"view": tables["expr"].join(contracts.require_columns(tables["obs"], "spot", *columns).select("spot", *columns), "spot")}


def check(recipe: list[tuple[str, dict]], given: set[str]) -> set[str]:
    """The facts that hold after the recipe; a ValueError names the first step that is unknown or lacks what it needs."""
    facts = set(given)
    for k, (name, _) in enumerate(recipe, 1):
        if name not in _STEPS:
            raise ValueError(f"step {k}: {name!r} is not known; known are {sorted(_STEPS)}")
        now = _STEPS[name]
        if lacking := now.needs - facts:
            raise ValueError(f"step {k}: {name!r} needs {sorted(lacking)}, which does not hold there")
        facts = (facts - now.ends) | now.gives
    return facts


def prepared(recipe: list[tuple[str, dict]], tables: Tables, given: set[str]) -> Tables:
    """The tables after all steps, as one plan; nothing runs before the caller asks for rows."""
    check(recipe, given)
    for name, parameters in recipe:
        tables = tables | _STEPS[name].run(tables, **parameters)
    return tables


#: Which split a data set gets, by its kind and mode.
_SPLITS = {
    ("spots", "supervised"): ("split_strata", {"by": ["slice_id", "label"], "fraction": 0.5}),
    ("spots", "unsupervised"): ("split_none", {}),
    ("samples", "supervised"): ("split_groups", {"group": "sample", "shares": (0.6, 0.2)}),
}


def split_step(kind: str, mode: str, **parameters) -> tuple[str, dict]:
    """The split step of a kind of data set in a mode; parameters replace the usual ones."""
    if (kind, mode) not in _SPLITS:
        raise ValueError(f"no split of {kind!r} in mode {mode!r}; known are {sorted(_SPLITS)}")
    name, usual = _SPLITS[kind, mode]
    return name, usual | parameters


#: Preparation of spots within slices, and of samples of patients.
SPOTS = [("filter", {"min_spots": 100, "min_genes": 12}), ("normalise", {}), ("select_genes", {"n": 20}), split_step("spots", "supervised"), ("view", {"columns": ["slice_id", "label", "split"]})]
SAMPLES = [("drop_unlabelled", {}), ("normalise", {"target": 1e3}), ("select_genes", {"n": 15}), split_step("samples", "supervised"), ("view", {"columns": ["sample", "split"]})]
