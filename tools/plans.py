"""Print the formatted physical plans of the main operators (pushdown, pruning, exchanges).

usage: python tools/plans.py [sf_dir]
"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main():
    d = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from pyspark.sql import functions as F

    from tabreg import catalog
    from tabreg.frames import frame_a, frame_b, frame_l
    from tabreg.operators import stats as S
    from tabreg.operators.prepare import Preparer
    from tabreg.operators.split import train_test_split
    from tabreg.session import get_spark

    spark = get_spark("local[8]", shuffle_partitions=8)
    a = frame_a(spark, d)
    prep = Preparer(label="label", key="doc_id", drop=["text"]).fit(a)
    cases = {
        "drop_lenient (frame B, p_name dropped)": catalog.q_drop_lenient(spark, d),
        "prepare transform + split (frame A)": train_test_split(prep.transform(a), "doc_id"),
        "value counts for modes/domains (frame A)": S.value_counts(a, ["lang", "source"]),
        "metrics on fixed prediction (frame A)": catalog.q_metrics(spark, d),
        "line items, two features only (frame L)": frame_l(spark, d).select("label", "l_quantity")
            .where(F.col("l_quantity") > 10),
        "best_k top-5 report": catalog.q_best_k(spark, d),
    }
    for name, df in cases.items():
        print(f"==== {name}")
        df.explain("formatted")


if __name__ == "__main__":
    main()
