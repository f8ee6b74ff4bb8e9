"""One entry for all solvers, by the names of index and solver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohesio.operators.neighbours import parse_index
from cohesio.plans import lazy, rounds, sequential
from cohesio.plans.rounds import Solution
from cohesio.sources.problem import Problem
from cohesio.storage import keeper

#: Which kinds of index each solver takes: 'brute_force', or any other.
SOLVERS = {"gaec": {"brute_force"}, "dense_gaec": {"brute_force", "other"}, "dense_gaec_inc": {"brute_force", "other"}, "dense_laec": {"brute_force", "other"}, "dense_laec_bf_later": {"other"}, "parallel_gaec": {"brute_force", "other"}}


def check_choice(solver: str, index: str, precision: str = "double") -> None:
    """Raises where a solver is unknown or doesn't go with the index, or the precision doesn't."""
    if solver not in SOLVERS:
        raise ValueError(f"unknown solver {solver!r}")
    parse_index(index)
    if ("brute_force" if index == "brute_force" else "other") not in SOLVERS[solver]:
        raise ValueError(f"solver {solver!r} doesn't take the index {index!r}")
    if precision == "double" and index != "brute_force":
        raise ValueError("double precision takes the index 'brute_force' only")


def solve(problem: Problem, solver: str, index: str = "brute_force", k: int = 5, k_cap: int = 5) -> Solution:
    """Labels by a solver's name; clusters are named by their least node id."""
    check_choice(solver, index, "single")
    if solver == "parallel_gaec":
        return rounds.parallel_gaec(problem, index)
    if solver == "dense_laec":
        return lazy.dense_laec(problem, k, k_cap, index)
    if solver == "dense_laec_bf_later":
        return lazy.dense_laec(problem, k, k_cap, index, later="faiss_brute_force")
    # Sequential by nature: an exact search within the instance's task, whatever the index.
    found = keeper(problem.nodes.sparkSession, "sequential")(sequential.solve(problem.nodes, problem.offset, solver, k, k_cap), "labels")
    n = found.select("contractions").first()
    return Solution(problem, found.select("node_id", "cluster"), [1] * (n["contractions"] if n else 0))


def dense_multicut(df: DataFrame, offset: float, k: int, index: str, solver: str, k_cap: int, id_col: str = "vec_id", feature_col: str = "embedding") -> DataFrame:
    """node_id, cluster of the vectors in df, features in single precision."""
    check_choice(solver, index, "single")
    return solve(Problem.from_table(df, offset, id_col, feature_col, "single"), solver, index, k, k_cap).labels


def dense_multicut_double(df: DataFrame, offset: float, k: int, index: str, solver: str, k_cap: int, id_col: str = "vec_id", feature_col: str = "embedding") -> DataFrame:
    """As dense_multicut, in double precision, which takes the index 'brute_force' only."""
    check_choice(solver, index, "double")
    return solve(Problem.from_table(df, offset, id_col, feature_col, "double"), solver, index, k, k_cap).labels


def dense_multicut_flat(spark, features, num_nodes: int, dim: int, offset: float, k: int, index: str, solver: str, k_cap: int, precision: str = "single") -> list[int]:
    """Labels of a flat row-major sequence, as a list in node order; it fits the driver, as the input did."""
    check_choice(solver, index, precision)
    problem = Problem.from_flat(spark, features, num_nodes, dim, offset)
    if precision == "single":
        problem = Problem(problem.nodes.select("node_id", F.col("features").cast("array<float>").cast("array<double>").alias("features")), problem.offset)
    return [r["cluster"] for r in solve(problem, solver, index, k, k_cap).labels.orderBy("node_id").collect()]
