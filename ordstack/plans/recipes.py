"""Feature-set recipes: each turns the raw train/test table into ``(row_id, is_test, target, …)``.

A set is built in three steps. ``_part_*`` appends what it looks up to a frame that still holds the raw
columns, its ``finish`` the columns that follow from a row alone, and the public function selects them. Combined
sets chain the parts of their members on one frame, so combining them needs no join and reads the raw table once;
they finish after the last lookup, so a lookup too large to broadcast moves raw rows, not wide ones.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordstack.constants import (
    COMPOSITE,
    DROP_BASIC,
    DROP_WIDE,
    FOLD,
    IS_TEST,
    J1_INTERACTIONS,
    J4_INTERACTIONS,
    J8_INTERACTIONS,
    N_FOLD,
    ROW_ID,
    STATS,
    TARGET,
)
from ordstack.functions import dates, ids
from ordstack.functions.numeric import (
    below_labels,
    exact_labels,
    ident,
    pairwise_names,
    quoted,
    row_max,
    row_median,
    row_min,
    with_pairwise,
)
from ordstack.functions.splits import fold_of
from ordstack.models.embed import deal, embed, embed_rows, learn_basis, project
from ordstack.operators import encode
from ordstack.operators.columns import (
    column_roles,
    drop_constant,
    feature_columns,
    fill_missing,
    listed_roles,
)
from ordstack.operators.combine import CellSet, combine
from ordstack.session import store
from ordstack.sources.feature_map import from_names

KEYS = (ROW_ID, IS_TEST, TARGET)


Finish = Callable[[DataFrame], DataFrame]


@dataclass
class FeatureSet:
    """A wide table, which of its columns are whole numbers or indicators, and its fold features."""

    table: DataFrame
    whole: list[str] = field(default_factory=list)
    folds: DataFrame | None = None

    def feature_map(self) -> DataFrame:
        """Columns of the table, then the numeric fold features."""
        typed = [(c, "int" if c in self.whole else "q") for c in feature_columns(self.table)]
        if self.folds is not None:
            typed += [(c, "q") for c in feature_columns(self.folds)]
        return from_names(self.table.sparkSession, typed)


def _select(df: DataFrame, prefix: str, names: Sequence[str]) -> DataFrame:
    return df.selectExpr(*KEYS, *[f"{ident(prefix + n)} AS {ident(n)}" for n in names])


def _dated(df: DataFrame, prefix: str = "") -> DataFrame:
    """Raw columns plus ``year_2017`` and ``month``."""
    day = dates.parse_mdy(F.col("date"))
    return df.withColumns(
        {f"{prefix}year_2017": dates.year_offset(day), f"{prefix}month": dates.month_of(day)}
    )


def _raw(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("~")]


def _with_folds(df: DataFrame) -> DataFrame:
    return df if FOLD in df.columns else df.withColumn(FOLD, fold_of(F.col(ROW_ID)))


def _named(df: DataFrame, exprs: dict[str, str]) -> DataFrame:
    """Append columns given as SQL text."""
    return df.selectExpr("*", *[f"{e} AS {ident(n)}" for n, e in exprs.items()])


# --- h1 -----------------------------------------------------------------------------------------


def h1(raw: DataFrame, num: float = -1, cat: str = "NA") -> FeatureSet:
    """Fixed role lists, month and year by arithmetic, id prefixes, missing values filled."""
    df = raw.withColumns(
        {
            "month": dates.month_arith(F.col("date")).cast("string"),
            "year": dates.year_arith(F.col("date")).cast("string"),
            **ids.id_prefixes(F.col("customer_id")),
        }
    )
    roles = listed_roles(df)
    df = fill_missing(df, roles.integer, roles.categorical, num, cat)
    return FeatureSet(
        df.select(*KEYS, *[quoted(c) for c in [*roles.integer, *roles.categorical]]),
        whole=roles.categorical,
    )


# --- j0, j1, j2 ---------------------------------------------------------------------------------


def _part_j0(df: DataFrame, p: str) -> tuple[DataFrame, list[str], list[str], Finish]:
    view = _dated(df.select(*_raw(df))).drop(*DROP_BASIC)
    roles = column_roles(view, ["customer_id"])
    fitted = encode.fit_categories(view, roles.categorical, min_obs=10)
    out = df
    for c in roles.categorical:
        out = fitted.apply(out, c, {"label": f"{p}{c}"})
    names = feature_columns(view)
    made = {*roles.categorical, "year_2017", "month"}

    def finish(rows: DataFrame) -> DataFrame:
        return _named(_dated(rows, p), {f"{p}{c}": ident(c) for c in names if c not in made})

    return out, names, roles.categorical, finish


def j0(raw: DataFrame) -> FeatureSet:
    """Labels of the customer id and the text columns, numbers as they are, year and month."""
    df, names, _, finish = _part_j0(raw, "~j0_")
    return FeatureSet(_select(finish(df), "~j0_", names))  # the map of this set calls every column numeric


def _part_j1(
    df: DataFrame, p: str, keep_id: bool = False
) -> tuple[DataFrame, list[str], list[str], Finish]:
    view = _dated(df.select(*_raw(df))).withColumn("cid_8", ids.cid8(F.col("customer_id")))
    view = view.drop(*DROP_BASIC, "customer_id")
    roles = column_roles(view, ["cid_8"])
    fitted = encode.fit_categories(view, roles.categorical, min_obs=10)
    scaler = encode.MinMax(roles.floating).fit(df.filter(~F.col(IS_TEST)))
    out = df.withColumn("~cid_8", ids.cid8(F.col("customer_id")))
    for c in roles.categorical:
        key = "~cid_8" if c == "cid_8" else c
        fields = {"label": f"{p}{c}"}
        out = _apply_as(fitted, out, c, key, fields)
    base = feature_columns(view)
    names = [*base, "f_5+f_21", *pairwise_names(J1_INTERACTIONS)]

    def finish(rows: DataFrame) -> DataFrame:
        rows = _named(
            _dated(rows, p),
            {
                **{f"{p}{c}": scaler.expr(c) for c in roles.floating},
                **{f"{p}{c}": ident(c) for c in roles.integer if c not in ("year_2017", "month")},
            },
        )
        rows = _named(rows, {f"{p}f_5+f_21": f"{ident(p + 'f_5')} + {ident(p + 'f_21')}"})
        rows = with_pairwise(rows, J1_INTERACTIONS, p)
        return rows.withColumn(f"{p}customer_id", F.col("customer_id")) if keep_id else rows

    if keep_id:
        names.append("customer_id")
    return out.drop("~cid_8"), names, [*roles.categorical, *roles.integer], finish


def _apply_as(
    fitted: encode.FittedCategories, df: DataFrame, col: str, key: str, fields: dict[str, str]
) -> DataFrame:
    """Lookup of fitted column ``col`` by a frame column of another name."""
    if key == col:
        return fitted.apply(df, col, fields)
    renamed = df.withColumnRenamed(key, col)
    return fitted.apply(renamed, col, fields).withColumnRenamed(col, key)


def j1(raw: DataFrame) -> FeatureSet:
    """Labels, scaled doubles, and 25 interaction columns."""
    df, names, whole, finish = _part_j1(raw, "~j1_")
    return FeatureSet(_select(finish(df), "~j1_", names), whole)


def j2(raw: DataFrame) -> FeatureSet:
    """``j1`` plus the original customer id."""
    df, names, whole, finish = _part_j1(raw, "~j2_", keep_id=True)
    return FeatureSet(_select(finish(df), "~j2_", names), whole)


# --- j4, j6, j8 ---------------------------------------------------------------------------------


def with_row_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Smallest, largest and median encoding of a row, missing ones left out."""
    values = [quoted(c) for c in cols]
    return df.withColumns(dict(zip(STATS, [row_min(values), row_max(values), row_median(values)])))


def _part_j4(df: DataFrame, p: str) -> tuple[DataFrame, list[str], list[str], Finish]:
    view = df.select(*_raw(df)).drop(*DROP_WIDE, "customer_id")
    roles = column_roles(view)
    scaler = encode.MinMax(roles.floating).fit(df.filter(~F.col(IS_TEST)))
    need = ["f_5", *J4_INTERACTIONS]

    def finish(rows: DataFrame) -> DataFrame:
        rows = _named(
            rows,
            {f"{p}{c}": scaler.expr(c) if c in scaler.bounds else ident(c) for c in need},
        )
        rows = _named(
            rows,
            {f"{p}f_5+{c}": f"{ident(p + 'f_5')} * 10 + {ident(p + c)}" for c in J4_INTERACTIONS},
        )
        return with_pairwise(rows, J4_INTERACTIONS, p)

    names = [*[f"f_5+{c}" for c in J4_INTERACTIONS], *pairwise_names(J4_INTERACTIONS)]
    return df, names, [], finish


def j4_folds(raw: DataFrame) -> DataFrame:
    """Per fold, mean targets of the raw categories and their row statistics."""
    view = _with_folds(raw).withColumns(
        {"cid_5": ids.cid5(F.col("customer_id")), "cid_3": ids.cid3(F.col("customer_id"))}
    )
    cols = column_roles(view.drop(*DROP_WIDE, "customer_id"), ["cid_5", "cid_3"]).categorical
    return with_row_stats(encode.target_encode_folds(view, cols), cols)


def j4(raw: DataFrame) -> FeatureSet:
    """28 interaction columns of scaled doubles; per fold, mean targets of the raw categories."""
    df, names, _, finish = _part_j4(raw, "~j4_")
    return FeatureSet(_select(finish(df), "~j4_", names), [], j4_folds(raw))


def _with_composite_keys(df: DataFrame) -> DataFrame:
    month = dates.month_of(dates.parse_mdy(F.col("date")))
    cid, market = F.col("customer_id"), F.col("market")
    return df.withColumns(
        {
            "cid_5_month_market": ids.composite_key(ids.cid5(cid), month, market),
            "cid_3_month_market": ids.composite_key(ids.cid3(cid), month, market),
        }
    )


def _part_j6(
    df: DataFrame, p: str, min_obs: int = 10
) -> tuple[DataFrame, list[str], list[str], Finish]:
    out = _with_composite_keys(df)
    fitted = encode.fit_categories(
        out, ["customer_id", *COMPOSITE], min_obs=min_obs, target=TARGET, overlap=True
    )
    out = fitted.apply(out, "customer_id", {"both": f"{p}cid_both"})
    for c in COMPOSITE:
        out = fitted.apply(out, c, {"te": f"{p}mt_{c}", "label": f"{p}{c}"})
    names = ["cid_both", *[f"mt_{c}" for c in COMPOSITE], *COMPOSITE]
    return out.drop(*COMPOSITE), names, list(COMPOSITE), lambda rows: rows


def j6(raw: DataFrame, min_obs: int = 10) -> FeatureSet:
    """Overlap flag, labels of two composite keys, mean target of each label."""
    df, names, whole, finish = _part_j6(raw, "~j6_", min_obs)
    return FeatureSet(_select(finish(df), "~j6_", names), whole)


def j8(raw: DataFrame, min_obs: int = 10) -> FeatureSet:
    """Everything: flag, labels of nine categories, scaled doubles, 120 interaction columns, and
    mean targets of the labels per fold. One aggregate fits flag, labels and means together."""
    df = _with_composite_keys(
        _with_folds(_dated(raw)).withColumns(
            {"cid_5": ids.cid5(F.col("customer_id")), "cid_3": ids.cid3(F.col("customer_id"))}
        )
    ).drop(*DROP_WIDE)
    roles = column_roles(df, ["customer_id", "cid_5", "cid_3", *COMPOSITE])
    cats = roles.categorical
    fitted = encode.fit_categories(
        df, cats, min_obs=min_obs, target=TARGET, n_fold=N_FOLD, overlap=True
    )
    scaler = encode.MinMax(roles.floating).fit(df.filter(~F.col(IS_TEST)))
    out = df
    for c in sorted(cats, key=lambda c: -fitted.sizes[c]):  # those that move rows come while rows are short
        fields = {"label": f"~{c}", "te_folds": f"_te_{c}"}
        if c == "customer_id":
            fields["both"] = "cid_both"
        out = fitted.apply(out, c, fields)
    folds = with_row_stats(encode.explode_folds(out, KEYS, cats), cats)
    wide = out.selectExpr(
        *KEYS,
        *[f"{ident('~' + c)} AS {c}" for c in cats],
        *[f"{scaler.expr(c)} AS {c}" for c in roles.floating],
        *roles.integer,
        "cid_both",
    )
    wide = _named(wide, {f"f_5+{c}": f"f_5 * 10 + {c}" for c in J8_INTERACTIONS})
    return FeatureSet(with_pairwise(wide, J8_INTERACTIONS), [], folds)


# --- n1 -----------------------------------------------------------------------------------------


@dataclass
class SparseSet:
    """Scaled doubles followed by one-hot columns: as cells or as a vector."""

    source: DataFrame
    floating: list[str]
    encoder: encode.OneHot
    scaled: DataFrame

    @property
    def width(self) -> int:
        return len(self.floating) + self.encoder.width

    def feature_map(self) -> DataFrame:
        """Positions as names: numeric for the doubles, indicators for the one-hot columns."""
        numeric = len(self.floating)
        typed = [(str(i), "q" if i < numeric else "i") for i in range(self.width)]
        return from_names(self.source.sparkSession, typed)

    def rows(self) -> DataFrame:
        """``(row_id, is_test, target, cells)``: per row the array of its non-missing cells. No row moves."""
        pairs = [
            F.struct(F.lit(i).cast("bigint").alias("idx"), quoted(c).cast("double").alias("value"))
            for i, c in enumerate(self.floating)
        ]
        wide, hot = self.encoder.indexed(self.scaled, first=len(self.floating))
        pairs += [F.struct(h.alias("idx"), F.lit(1.0).alias("value")) for h in hot]
        held = F.filter(F.array(*pairs), lambda x: x["idx"].isNotNull() & x["value"].isNotNull())
        return wide.select(*KEYS, held.alias("cells"))

    def cells(self) -> DataFrame:
        """``(row_id, idx, value)`` of the non-missing cells."""
        return self.rows().select(ROW_ID, F.inline("cells"))

    def cell_set(self) -> CellSet:
        """As a member of combined sparse sets; zeros have no cell."""
        cells = self.rows().select(ROW_ID, IS_TEST, F.inline("cells")).filter("value <> 0")
        numeric = len(self.floating)
        return CellSet(cells, tuple((str(i), "q" if i < numeric else "i") for i in range(self.width)))

    def vectors(self) -> DataFrame:
        """``(row_id, is_test, target, features)``; a missing double is 0 in the vector."""
        filled = self.scaled.na.fill(0.0, self.floating)
        return self.encoder.transform_vector(filled, self.floating).select(*KEYS, "features")


def n1(raw: DataFrame) -> SparseSet:
    """One-hot of whole numbers and categories, min-max of the doubles, both over all rows."""
    df = _dated(raw).withColumn("customer_id", ids.cid5(F.col("customer_id"))).drop(*DROP_BASIC)
    roles = column_roles(df, ["customer_id"])
    encoder = encode.OneHot(min_obs=100).fit(df, [*roles.integer, *roles.categorical])
    scaler = encode.MinMax(roles.floating).fit(df)
    return SparseSet(df, roles.floating, encoder, scaler.transform(df))


def n2(raw: DataFrame, k: int = 64, learned: bool = False) -> FeatureSet:
    """``n1`` embedded in ``k`` columns, whatever its width: by a seeded projection (``project``), or
    ``learned`` from all rows (``learn_basis``)."""
    sparse = n1(raw)
    if not learned:
        return FeatureSet(project(sparse.rows(), k))
    rows = deal(store(sparse.rows(), "cells"), sparse.width)
    return FeatureSet(embed_rows(rows, learn_basis(rows, sparse.width, k), KEYS, k))


def n3(raw: DataFrame, k: int = 128, learned: bool = False) -> FeatureSet:
    return n2(raw, k, learned)


def n4(raw: DataFrame, k: int = 1024, learned: bool = False) -> FeatureSet:
    return n2(raw, k, learned)


def principal(raw: DataFrame, k: int) -> FeatureSet:
    """``k`` principal components of ``n1``, for widths a driver can hold a square matrix of."""
    sparse = n1(raw)
    return FeatureSet(embed(sparse.vectors(), k, sparse.width))


# --- combined sets ------------------------------------------------------------------------------

Part = Callable[[DataFrame, str], tuple[DataFrame, list[str], list[str], Finish]]


def _part_j2(df: DataFrame, p: str) -> tuple[DataFrame, list[str], list[str], Finish]:
    return _part_j1(df, p, keep_id=True)


def _combined(raw: DataFrame, parts: dict[str, Part], drop_constants: bool = True) -> FeatureSet:
    """Parts side by side with prefixed names, constant columns dropped unless told otherwise."""
    df, picked, whole, finishes = raw, [], [], []
    for path, part in parts.items():
        p = f"~{path}~"
        df, names, w, finish = part(df, p)
        finishes.append(finish)
        picked += [(f"{p}{n}", f"{path}_{n}") for n in names]
        whole += [f"{path}_{n}" for n in w]
    for finish in finishes:
        df = finish(df)
    wide = df.selectExpr(*KEYS, *[f"{ident(a)} AS {ident(b)}" for a, b in picked])
    kept = drop_constant(wide) if drop_constants else wide
    return FeatureSet(kept, [c for c in whole if c in kept.columns])


def j3(raw: DataFrame, k: int = 128, drop_constants: bool = True, learned: bool = False) -> FeatureSet:
    """``j2`` and the embedding (``n3``) side by side. Both are stored first, the embedding as the cells it is made of:
    the row check and the join read them, and rows are embedded after the join, so that nothing dense moves."""
    left, sparse = j2(raw), n1(raw)
    sets = {"j2": store(left.table, "j2"), "n3": store(sparse.rows(), "cells")}
    both = combine(sets, drop_constants=False).withColumnRenamed("n3_cells", "cells")
    if learned:
        basis = learn_basis(sets["n3"], sparse.width, k)
        made = embed_rows(both, basis, [c for c in both.columns if c != "cells"], k)
    else:
        made = project(both, k)
    named = {f"e_{i}": f"n3_e_{i}" for i in range(k)}
    wide = made.select(*[quoted(c).alias(named.get(c, c)) for c in made.columns])
    table = drop_constant(wide) if drop_constants else wide
    return FeatureSet(table, [f"j2_{c}" for c in left.whole if f"j2_{c}" in table.columns])


def j5(raw: DataFrame, with_folds: bool = False) -> FeatureSet:
    """``j2`` and ``j4`` side by side, on request with the fold features of ``j4``."""
    made = _combined(raw, {"j2": _part_j2, "j4": _part_j4})
    made.folds = j4_folds(raw) if with_folds else None
    return made


def j7(raw: DataFrame, min_obs: int = 10, drop_constants: bool = True) -> FeatureSet:
    """``j5`` and ``j6`` side by side."""
    parts = {"j5_j2": _part_j2, "j5_j4": _part_j4, "j6": partial(_part_j6, min_obs=min_obs)}
    return _combined(raw, parts, drop_constants)


# --- binary targets -----------------------------------------------------------------------------


def binary_targets(df: DataFrame, exact_max: int = 10, below_max: int = 10) -> DataFrame:
    """0/1 columns: target equal to 0..exact_max, then target below 2..below_max."""
    y = F.col(TARGET)
    new = {**exact_labels(y, exact_max), **below_labels(y, below_max)}
    return df.select(*[quoted(c) for c in df.columns], *[c.alias(n) for n, c in new.items()])
