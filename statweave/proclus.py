"""python -m statweave.proclus --input TABLE --output FOLDER --k 5 --l 4: projected clustering of a written table's numeric columns."""

from __future__ import annotations

import argparse

from .plans.jobs import run_job
from .session import build_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="python -m statweave.proclus", description="Projected clustering (PROCLUS).")
    p.add_argument("--input", required=True, help="a Parquet table")
    p.add_argument("--output", required=True, help="gets the folders clusters, clustered-points and folded-points")
    p.add_argument("--k", type=int, required=True, help="clusters")
    p.add_argument("--l", type=int, required=True, help="dimensions of a cluster on average")
    p.add_argument("--maxIterations", type=int, default=10)
    p.add_argument("--minDeviation", type=float, default=0.1)
    p.add_argument("--splitSize", type=float, default=0.2, help="share of the points from which medoids are chosen")
    p.add_argument("--minThreshold", type=float, default=0.0, help="objective at which to stop")
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--columns", nargs="*", help="all but text, if none are named")
    return p


def main(arguments: list[str] | None = None) -> None:
    o = parser().parse_args(arguments)
    job = run_job(
        build_session("proclus"), "proclus", table=o.input, output_path=o.output, k=o.k, l=o.l, num_iterations=o.maxIterations, min_deviation=o.minDeviation,
        split_size=o.splitSize, min_threshold=o.minThreshold, seed=o.seed, columns=o.columns,
    )
    print(f"objective {job.output('objective')}")


if __name__ == "__main__":
    main()
