"""Feature preparation (T1-T6) as an estimator: ``Preparer.fit(df) -> FittedPrep``.

``fit`` runs a fixed, small number of aggregate jobs whatever the column count (ranges, median
refinement, one value-count job for modes and domains, one scale job). ``transform`` is pure column
expressions with the fitted values inlined as literals: one projection, whole-stage codegen, no
shuffle, so it scores any number of rows (or a stream) at scan speed.

Semantics follow the reference pipeline: drop listed columns, split off the label before any fit,
median-fill numeric gaps, mode-fill text gaps, scale numeric columns by population std (zero std
divides by 1), then one-hot every text column keeping every category as ``<column>_<value>``.
Booleans without gaps pass through as 0/1; booleans with gaps are treated as text ``False``/``True``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DummyNameClash, UnsupportedColumn
from ..names import column as _q
from ..names import number
from . import columns as C
from . import stats as S


def fill_median_expr(c: str, median: float) -> Column:
    return F.coalesce(number(c), F.lit(float(median)))


def fill_mode_expr(c: str, mode: str) -> Column:
    return F.coalesce(_q(c), F.lit(mode))


def scale_expr(col: Column, mean: float, std: float) -> Column:
    return (col - F.lit(float(mean))) / F.lit(S.safe_std(std))


def one_hot_exprs(c: str, col: Column, domain: list[str]) -> list[Column]:
    """One 0/1 int column per category; a null or unseen value is all zeros."""
    return [F.when(col == F.lit(v), F.lit(1)).otherwise(F.lit(0)).alias(f"{c}_{v}") for v in domain]


def dummy_names(categorical: list[str], domains: dict[str, list[str]], kept: list[str]) -> list[str]:
    names = [f"{c}_{v}" for c in categorical for v in domains[c]]
    seen, clash = set(kept), []
    for n in names:
        if n in seen:
            clash.append(n)
        seen.add(n)
    if clash:
        raise DummyNameClash(f"one-hot column names collide: {sorted(set(clash))}")
    return names


@dataclass
class FittedPrep:
    key: str | None
    label: str
    numeric: list[str]
    categorical: list[str]
    passthrough: list[str]
    medians: dict[str, float]
    modes: dict[str, str]
    scale: dict[str, tuple[float, float]]
    domains: dict[str, list[str]]
    feature_names: list[str]
    bool_as_text: list[str] = field(default_factory=list)
    scaled: bool = True
    drop_last: bool = False

    def _text(self, c: str) -> Column:
        if c in self.bool_as_text:
            return F.when(_q(c), F.lit("True")).when(~_q(c), F.lit("False"))
        return _q(c)

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """Key, label (if present) and the named feature columns in fitted order."""
        out = []
        if self.key:
            out.append(_q(self.key))
        if self.label in df.columns:
            out.append(_q(self.label).cast("double").alias(self.label))
        for c in keep or []:
            out.append(_q(c))
        num, passing = set(self.numeric), set(self.passthrough)
        for c in self.feature_names:
            if c in num:
                v = fill_median_expr(c, self.medians[c])
                if self.scaled:
                    v = scale_expr(v, *self.scale[c])
                out.append(v.alias(c))
            elif c in passing:
                out.append(_q(c).cast("double").alias(c))
        for c in self.categorical:
            filled = F.coalesce(self._text(c), F.lit(self.modes[c]))
            domain = self.domains[c][:-1] if self.drop_last else self.domains[c]
            out.extend(one_hot_exprs(c, filled, domain))
        return df.select(*out)

    def to_vector(self, df: DataFrame, out: str = "features", sparse: bool = True,
                  keep: list[str] | None = None) -> DataFrame:
        """Key, label and one feature vector in ``feature_names`` order.

        ``sparse=True`` is the path for wide text columns: each is mode-filled, indexed against its
        fitted (sorted) domain with a ``StringIndexerModel`` and one-hot encoded by a
        ``OneHotEncoderModel`` into a sparse vector, so thousands of categories never become
        thousands of columns. Unseen values take the extra 'keep' slot, which the encoder drops, so
        they encode to all zeros as in the dense path."""
        from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler

        head = [c for c in (self.key, self.label) if c and c in df.columns] + list(keep or [])
        if not sparse or not self.categorical:
            dense = self.transform(df, keep=keep)
            return C.assemble(dense, self.feature_names, out).select(*[_q(c) for c in head], out)
        num, passing = set(self.numeric), set(self.passthrough)
        cols = [_q(c) for c in head]
        kept = []
        for c in self.feature_names:
            if c in num or c in passing:
                kept.append(f"_num{len(kept)}")
                v = fill_median_expr(c, self.medians[c]) if c in num else _q(c).cast("double")
                cols.append((scale_expr(v, *self.scale[c]) if c in num and self.scaled else v).alias(kept[-1]))
        txt = [f"_txt{i}" for i in range(len(self.categorical))]
        cols += [F.coalesce(self._text(c), F.lit(self.modes[c])).alias(t) for c, t in zip(self.categorical, txt)]
        rows = df.select(*cols)
        idx = [f"_idx{i}" for i in range(len(txt))]
        vec = [f"_vec{i}" for i in range(len(txt))]
        for c, t, i in zip(self.categorical, txt, idx):
            labels = self.domains[c][:-1] if self.drop_last else self.domains[c]
            # One model per column: the multi-column constructor pads shorter label lists with nulls.
            rows = StringIndexerModel.from_labels(labels, inputCol=t, outputCol=i, handleInvalid="keep").transform(rows)
        # Each index column's nominal metadata is its labels plus '__unknown' (the 'keep' slot), so
        # this fit reads no rows; dropLast removes exactly that slot: unseen values are all zeros.
        enc = OneHotEncoder(inputCols=idx, outputCols=vec, dropLast=True, handleInvalid="error")
        rows = enc.fit(rows).transform(rows)
        return VectorAssembler(inputCols=kept + vec, outputCol=out, handleInvalid="error").transform(rows).select(*[_q(c) for c in head], out)


class Preparer:
    """Fit fill, scale and encoding statistics, then transform with them.

    The reference fits on all rows before the split (parity, ``fit_scope='all'`` in the runs); fit
    on the training rows only (``fit_scope='train'``) for a leak-free variant, in which case unseen
    test categories encode to all zeros. ``drop_last`` leaves out each text column's last category
    so linear coefficients are identifiable (the reference keeps every category).
    """

    def __init__(self, label: str = C.REFERENCE_LABEL, key: str | None = None, drop=C.REFERENCE_DROP,
                 strict_drop: bool = False, scale: bool = True, approx_median: bool = False,
                 max_categories: int | None = None, drop_last: bool = False):
        self.drop_last = drop_last
        self.label, self.key, self.drop = label, key, list(drop)
        self.strict_drop, self.scale = strict_drop, scale
        self.approx_median, self.max_categories = approx_median, max_categories

    def select_features(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        # The reference drops its ``Id``; here the key is kept as the row key (never a feature).
        drop = [c for c in self.drop if c != self.key]
        df = C.drop_strict(df, drop) if self.strict_drop else C.drop_lenient(df, drop)
        return C.split_label(df, self.label, self.key)

    def fit(self, df: DataFrame) -> FittedPrep:
        # Like Spark ML's multi-pass estimators: an input that is not persisted is projected to
        # the features and persisted for the fit's passes only.
        own_cache = df.storageLevel == StorageLevel.NONE
        df, features = self.select_features(df)
        if own_cache:
            df = df.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return self._fit(df, features)
        finally:
            if own_cache:
                df.unpersist()

    def _fit(self, df: DataFrame, features: list[str]) -> FittedPrep:
        roles = C.column_roles(df, features)
        if other := {c: t for c, t in df.dtypes if c in roles and roles[c] == "other"}:
            raise UnsupportedColumn(other)
        numeric = [c for c in features if roles[c] == "numeric"]
        text = [c for c in features if roles[c] == "categorical"]
        bools = [c for c in features if roles[c] == "boolean"]
        # Booleans with gaps become text; find which ones in the same pass as the ranges.
        bool_gaps = []
        if bools:
            row = df.agg(*[F.count(F.when(_q(c).isNull(), 1)).alias(f"g{i}") for i, c in enumerate(bools)]).collect()[0]
            bool_gaps = [c for i, c in enumerate(bools) if row[f"g{i}"] > 0]
        passthrough = [c for c in bools if c not in bool_gaps]
        categorical = [c for c in features if c in text or c in bool_gaps]

        cat_df = df.select(*[_q(c) for c in numeric], *[
            (F.when(_q(c), F.lit("True")).when(~_q(c), F.lit("False")).alias(c) if c in bool_gaps else _q(c))
            for c in categorical])
        # One job: numeric ranges and moments plus text value counts; then the median refinement.
        ranges, moments, counts, total = S.profile(cat_df, numeric, categorical, self.max_categories)
        medians = S.fit_medians(df, numeric, approx=self.approx_median, ranges=ranges)
        modes, domains = S.modes_and_domains(counts, self.max_categories)
        scale = {c: S.filled_moments(total, moments[c], medians[c]) for c in numeric} if self.scale else {}
        kept = [c for c in features if c in numeric or c in passthrough]
        names = kept + dummy_names(categorical, domains, kept)
        if self.drop_last:     # identifiable linear coefficients: leave out each column's last category
            last = {f"{c}_{domains[c][-1]}" for c in categorical}
            names = [n for n in names if n not in last]
        return FittedPrep(self.key, self.label, numeric, categorical, passthrough, medians, modes, scale,
                          domains, names, bool_gaps, self.scale, self.drop_last)


def prepare(df: DataFrame, label: str, key: str | None = None, drop=C.REFERENCE_DROP, scale: bool = True,
            **kw) -> tuple[DataFrame, FittedPrep]:
    """The reference pipeline in one call: fit on ``df`` and transform ``df``."""
    fitted = Preparer(label=label, key=key, drop=drop, scale=scale, **kw).fit(df)
    return fitted.transform(df), fitted
