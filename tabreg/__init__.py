"""tabreg: Spark-native tabular regression.

Preparation (fill, scale, one-hot), reproducible key-hash splits, linear / boosted / leaf-wise /
forest regressors, k-fold grid search, scores and report tables, written with DataFrame, SQL and
Spark ML operations throughout.
"""

__version__ = "0.1.0"
