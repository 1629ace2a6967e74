"""Composite plans: model registry, leaf-wise boosting, grid search, reports, runs."""
