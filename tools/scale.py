"""How run time grows with the data, with hot keys.

    python tools/scale.py --copies 1,10,40

Repeats the people of a test folder, gives a third of all rows one role, one id and
one score, and times the shuffling operators. Writes to a new folder below the
session's scratch place.
"""

import argparse
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from strainwise.functions import indices  # noqa: E402
from strainwise.operators import attribution, breakdown as bd, clean, evaluate, policy, scoring  # noqa: E402
from strainwise.operators.align import align, fit_defaults  # noqa: E402
from strainwise.plans.bounds import write_scratch  # noqa: E402
from strainwise.plans.quantiles import exact_medians  # noqa: E402
from strainwise.registry import catalog  # noqa: E402
from strainwise.schema import STRAIN_WEIGHTS, TRACKED  # noqa: E402
from strainwise.session import local_session  # noqa: E402


def grown(spark, folder, copies):
    """The canonical tech table repeated; rows of a third of the copies share role, id and score."""
    copy = F.explode(F.sequence(F.lit(1), F.lit(copies * 3))).alias("copy")
    base = catalog.tech(spark, folder).select("*", copy)
    hot = F.col("copy") % 3 == 0
    return base.withColumns({
        "row_id": F.concat("employee_id", F.lit("-"), F.col("copy").cast("string")),
        "employee_id": F.when(hot, "the same").otherwise(F.concat("employee_id", F.lit("-"), F.col("copy").cast("string"))),
        "job_role": F.when(hot, "software engineer").otherwise(F.col("job_role")),
        "strain_score": F.when(hot, 5.0).otherwise(F.col("strain_score")),
        "sleep_hours": F.col("sleep_hours") + F.rand(7) * 1e-3,  # nearly all values distinct
    })


def main():
    p = argparse.ArgumentParser()
    p.add_argument("--folder", default="/root/testdata/sf0.1")
    p.add_argument("--copies", default="1,10")
    a = p.parse_args()
    spark = local_session(8)

    def drain(df):
        df.write.format("noop").mode("overwrite").save()

    for copies in map(int, a.copies.split(",")):
        table = spark.read.parquet(write_scratch(grown(spark, a.folder, copies)))
        defaults, scorer = fit_defaults(table), scoring.linear_scorer(table)
        features = align(table, defaults, keep=["row_id", "employee_id", "strain_score"])
        scored = scorer(features)
        judged = scored.where("strain_score is not null").select(
            (F.col("strain_score") >= 4.5).cast("int").alias("label"), "probability")
        runs = {
            "role_medians": lambda: drain(exact_medians(table, TRACKED, by="job_role")),
            "preprocess": lambda: drain(indices.with_indices(clean.preprocess(table))),
            "keep_first": lambda: drain(clean.keep_first(table, order_by=["copy"])),
            "breakdown_all": lambda: drain(bd.breakdown_all(scored, ["job_role", "work_mode", "company_size"])),
            "role_drivers": lambda: drain(policy.role_drivers(scored)),
            "policy_whatif": lambda: drain(policy.policy_whatif(features, scorer)),
            "classification": lambda: drain(evaluate.classification_metrics(judged)),
            "permutation": lambda: drain(attribution.permutation_importance(
                features, scorer, [c for c, _, _ in STRAIN_WEIGHTS], "strain_score", id_col="row_id")),
        }
        times = {}
        for name, run in runs.items():
            start = time.time()
            run()
            times[name] = round(time.time() - start, 1)
        print(table.count(), times, flush=True)


if __name__ == "__main__":
    main()
