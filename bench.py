"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

The solver parallel_gaec_rounds is parallel_gaec with every round distributed.
"""

from __future__ import annotations

import json
import os
import time

from cohesio import queries
from cohesio.operators import objective
from cohesio.plans import api, rounds
from cohesio.session import local_session
from cohesio.sources.problem import Problem

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
TIMED = ("nn1", "knn5", "knn_ivf", "cost_disconnected", "labeling_cost_fast", "cluster_sums", "contiguous_labels", "greedy_matching", "gaec_by_label")
SOLVERS = (("gaec", "brute_force"), ("dense_gaec", "brute_force"), ("dense_gaec_inc", "brute_force"), ("dense_laec", "brute_force"), ("dense_laec_bf_later", "HNSW"), ("parallel_gaec", "brute_force"), ("parallel_gaec_rounds", "brute_force"))


def main() -> None:
    spark = local_session(CPUS)
    problem = Problem.from_table(spark.read.parquet(f"{SF_DIR}/embeddings.parquet"), queries.OFFSET)
    objective.all_cut_cost(problem.nodes, problem.offset).collect()
    queries.QUERIES["nn1"](spark, SF_DIR).collect()  # starts the workers
    took, found = {}, {}
    for name in TIMED:
        began = time.perf_counter()
        queries.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    for solver, index in SOLVERS:
        began = time.perf_counter()
        solution = rounds.parallel_gaec(problem, small=0) if solver == "parallel_gaec_rounds" else api.solve(problem, solver, index)
        solution.labels.write.format("noop").mode("overwrite").save()
        took[solver] = round(time.perf_counter() - began, 3)
        found[solver] = {"clusters": solution.clusters(), "objective": round(solution.cost(), 6), "rounds": len(solution.rounds)}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "solutions": found, "sf": os.path.basename(SF_DIR).removeprefix("sf")}))


if __name__ == "__main__":
    main()
