"""python -m cohesio.cli -f FILE -i INDEX -s SOLVER [-k K] [-K CAP] [-t OFFSET] [-o LABELS] [-d]"""

from __future__ import annotations

import argparse
import math
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cohesio.plans.api import check_choice, solve
from cohesio.sources.problem import Problem, write_labels


def main(args: list[str] | None = None) -> dict[str, float]:
    p = argparse.ArgumentParser(description="Solves a multicut instance from a text file.")
    p.add_argument("-f", "--file", required=True)
    p.add_argument("-i", "--index_str", required=True)
    p.add_argument("-s", "--contraction_type", required=True)
    p.add_argument("-k", "--knn", type=int, default=5)
    p.add_argument("-K", "--knn_cap", type=int, default=5)
    p.add_argument("-t", "--thresh", type=float, default=math.inf, help="in place of the file's offset")
    p.add_argument("-o", "--output_file")
    p.add_argument("-d", "--double", action="store_true")
    o = p.parse_args(args)
    if o.thresh < 0:
        p.error("the offset must not be negative")
    check_choice(o.contraction_type, o.index_str, "double" if o.double else "single")
    spark = SparkSession.builder.getOrCreate()
    began = time.perf_counter()
    problem = Problem.from_text(spark, o.file, None if math.isinf(o.thresh) else o.thresh)
    if not o.double:
        problem = Problem(problem.nodes.select("node_id", F.col("features").cast("array<float>").cast("array<double>").alias("features")), problem.offset)
    found = solve(problem.checked(), o.contraction_type, o.index_str, o.knn, o.knn_cap)
    if o.output_file:
        write_labels(found.labels, o.output_file)
    said = {"clusters": found.clusters(), "objective": found.cost(), "rounds": len(found.rounds), "contractions": found.contractions, "contractions_per_round": found.per_round(), "seconds": time.perf_counter() - began}
    print(*(f"{k}: {v:g}" for k, v in said.items()), sep="\n")
    return said


if __name__ == "__main__":
    main()
