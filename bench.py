"""Times the headline queries; prints one JSON line.

Each query is run twice and written to the no-op sink; the second run counts.
"""

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])

HEADLINE = [
    "ps_inc_sum", "ps_apply_upsert", "dense_row_merge", "sorted_row_topk", "ssp_view", "update_budget_cut", "topk_important_rows", "staleness_sliding",
    "dot_dense", "dot_sparse_sparse", "softmax", "matvec", "kmeans_assign", "kmeans_minibatch", "lr_batch_grad", "mlr_batch_step", "gain_ratio",
    "forest_vote", "nmf_step", "sc_step", "dml_grad", "mlp_forward", "mlp_backprop_last", "quantile_labels", "libsvm_parse",
]


def main() -> None:
    from quern.catalog import QUERIES
    from quern.session import build_session

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", master=f"local[{cpus}]", partitions=int(cpus), **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        for _ in range(2):
            began = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
