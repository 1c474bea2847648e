"""python -m attrweave.cli MODE DATASET OUT [--ini FILE]...: a run over <DATASET>/<site>/<category>_spec.json and linkage files.

Writes cluster_detail, cluster_synthesis and the instance graph to OUT. evaluate CLUSTER_DETAIL TRUTH compares two of them.
"""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from attrweave import config
from attrweave.operators import clustering as K
from attrweave.operators import evaluation as E
from attrweave.plans import pipelines
from attrweave.sources import readers as R
from attrweave.sources import writers as W


def report(state: pipelines.State, out: str) -> dict[str, float]:
    rows = state.clusters.join(state.claims.select(*pipelines.SA).distinct().withColumn("node", pipelines.node()), "node")
    held = rows.select("cid", *pipelines.SA)
    names = rows.select("node", "name")
    W.csv(W.cluster_detail(held, state.claims, state.linkage), f"{out}/cluster_detail", ["cluster_id", "cluster_size", "source", "full_name"])
    W.csv(W.cluster_synthesis(state.clusters, K.top_names(state.clusters, names)), f"{out}/cluster_synthesis", ["cluster_id"])
    W.json(W.instance_graph(state.claims, state.linkage, held, K.name_of(state.clusters, names)), f"{out}/ikgpp")
    return {"clusters": state.clusters.select("cid").distinct().count(), "rounds": state.rounds}


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run")
    run.add_argument("mode")
    run.add_argument("dataset")
    run.add_argument("out")
    run.add_argument("--ini", action="append", default=[])
    judge = commands.add_parser("evaluate")
    judge.add_argument("computed")
    judge.add_argument("truth")
    given = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    start = time.time()
    if given.command == "run":
        options = config.load(*given.ini)
        state = pipelines.run(given.mode, R.specs(spark, given.dataset), R.linkage(spark, given.dataset), options)
        print(json.dumps(report(state, given.out) | {"seconds": round(time.time() - start, 1)}))
    else:
        computed = R.schema_truth(R.csv(spark, given.computed).withColumn("cluster_id", F.when(~F.col("cluster_id").startswith("ISOLATED"), F.col("cluster_id"))), "cluster_id")
        print(E.schema_level(computed, R.schema_truth(R.csv(spark, given.truth))).toJSON().first())


if __name__ == "__main__":
    main()
