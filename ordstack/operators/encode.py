"""Encoders: fit on one table, apply to another.

Fitting reads the data once for all columns: one aggregate over grouping sets gives, per value of
each column, its count, its first row and its target sums per fold. Everything else (labels, mean
targets in every fold, the overlap flag) follows from that table of categories. Applying is one
lookup per column.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ordstack.constants import FOLD, IS_TEST, N_FOLD, ROW_ID, SEED, TARGET
from ordstack.functions.numeric import ident, number, quoted
from ordstack.functions.splits import row_hash
from ordstack.operators.columns import min_max
from ordstack.operators.lookup import Mapping, lookup, mapping
from ordstack.operators.ordering import number_within
from ordstack.session import store


def _mean(s: str, n: str) -> str:
    return f"CAST({s} AS DOUBLE) / nullif({n}, 0)"


def category_stats(
    df: DataFrame,
    cols: Sequence[str],
    both_sides: bool = True,
    target: str | None = None,
    n_fold: int = 0,
) -> DataFrame:
    """Stored row per column (``_set``, its position) and value (``_k<position>``)."""
    train = ~F.col(IS_TEST)
    if not both_sides:
        df = df.filter(train)
    keys = [f"_k{i}" for i in range(len(cols))]
    slim = df.selectExpr(
        ROW_ID,
        IS_TEST,
        *[f"{ident(c)} AS {k}" for c, k in zip(cols, keys)],
        *([f"CAST({ident(target)} AS BIGINT) AS _y"] if target else []),
        *([FOLD] if n_fold else []),
    )
    aggs = [
        f"count_if(NOT {IS_TEST}) AS n_train",
        f"count_if({IS_TEST}) AS n_test",
        f"min(CASE WHEN NOT {IS_TEST} THEN {ROW_ID} END) AS first_train",
        f"min({ROW_ID}) AS first_any",
    ]
    if target:
        # means are over the rows that have a label
        aggs.append(f"coalesce(sum(CASE WHEN NOT {IS_TEST} THEN _y END), 0) AS s")
        aggs.append(f"count_if(NOT {IS_TEST} AND _y IS NOT NULL) AS m")
        for i in range(1, n_fold + 1):
            mine = f"NOT {IS_TEST} AND {FOLD} = {i}"
            aggs.append(f"coalesce(sum(CASE WHEN {mine} THEN _y END), 0) AS s_{i}")
            aggs.append(f"count_if({mine} AND _y IS NOT NULL) AS n_{i}")
    grouped = slim.groupingSets([[k] for k in keys], *keys).agg(
        F.grouping_id().alias("_gid"), *[F.expr(a) for a in aggs]
    )
    # the grouping id has a 0 bit at the grouped column, the first column being the highest bit
    full = (1 << len(keys)) - 1
    at = " ".join(
        f"WHEN {full - (1 << (len(keys) - 1 - i))} THEN {i}" for i in range(len(keys))
    )
    position = F.expr(f"CASE _gid {at} END")
    return store(
        grouped.withColumn("_set", position).drop("_gid"), "categories", partition_by="_set"
    )


@dataclass(frozen=True)
class FittedCategories:
    """Stored mapping of every fitted column, with the values unseen categories get."""

    cols: tuple[str, ...]
    table: DataFrame
    sizes: dict[str, int]
    max_label: dict[str, int]
    unseen: dict[str, dict[str, object]]
    by_label: bool

    def mapping(self, col: str) -> Mapping:
        i = self.cols.index(col)
        return Mapping(self.table.filter(F.col("_set") == i), f"_k{i}", self.sizes[col])

    def apply(self, df: DataFrame, col: str, fields: dict[str, str]) -> DataFrame:
        """Append ``fields`` (label, te, te_folds, both) of column ``col`` under new names."""
        unseen = self.unseen[col]
        defaults = {new: unseen[f] for f, new in fields.items() if unseen.get(f) is not None}
        return lookup(df, self.mapping(col), col, fields, defaults, null_safe=self.by_label)


def fit_categories(
    df: DataFrame,
    cols: Sequence[str],
    min_obs: int | None = None,
    fit_all: bool = False,
    target: str | None = None,
    n_fold: int = 0,
    overlap: bool = False,
) -> FittedCategories:
    """Fit encoders of ``cols`` in one pass.

    With ``min_obs``, values with at least that many rows are numbered by first appearance, all
    others are label 0, null is a value like any other, and where no value is rare the last label
    becomes 0; target means are then taken per label. Without it they are taken per value. Counts
    are over the train rows, or over all rows with ``fit_all``.
    """
    stats = category_stats(df, cols, fit_all or overlap, target, n_fold)
    n, first = ("n_train + n_test", "first_any") if fit_all else ("n_train", "first_train")
    stats = stats.selectExpr("*", f"{n} AS n", f"{first} AS first_row")
    frequent = f"n >= {min_obs or 1}"
    keys = [f"_k{i}" for i in range(len(cols))]
    facts = _column_facts(stats, keys, frequent, target, n_fold, overlap, min_obs is not None)
    demoted: list[int | None] = [None] * len(cols)
    if min_obs is None:
        labelled = stats if overlap else stats.filter(frequent)
    else:
        for i, f in enumerate(facts):
            if f and f["frequent"] and not f["rare"]:
                demoted[i] = f["frequent"]
        numbered = number_within(stats.filter(frequent), "_set", "first_row", "label")
        last = [f"(_set = {i} AND label = {k})" for i, k in enumerate(demoted) if k is not None]
        label = f"CASE WHEN {' OR '.join(last)} THEN 0 ELSE label END" if last else "label"
        labelled = numbered.withColumn("label", F.expr(f"CAST({label} AS INT)"))
        if overlap:
            rest = stats.filter(f"NOT ({frequent})").withColumn("label", F.lit(0))
            labelled = labelled.unionByName(rest)

    unseen: list[dict[str, object]] = [
        {"label": 0 if min_obs is not None else None, "both": 0} for _ in cols
    ]
    fields = ["label"] if min_obs is not None else []
    if overlap:
        fields.append("CAST(n_train > 0 AND n_test > 0 AS INT) AS both")
    if target:
        means = [_mean("s", "m")] + [
            _mean(f"(s - s_{i})", f"m - n_{i}") for i in range(1, n_fold + 1)
        ]
        if min_obs is not None:
            pools = [_pooled_means(f, d is not None, n_fold) for f, d in zip(facts, demoted)]
            for u, pool in zip(unseen, pools):
                u["te"], u["te_folds"] = pool[0], pool[1:]
            means = [_label_mean(m, k, pools) for k, m in enumerate(means)]
        fields.append(f"{means[0]} AS te")
        if n_fold:
            fields.append(f"array({', '.join(means[1:])}) AS te_folds")
    table = labelled.selectExpr("_set", *keys, *fields)
    if min_obs is not None:
        table = store(table, "mapping", partition_by="_set")
    width = 16 + 8 * (3 + n_fold)
    rows = [f["rows"] if f else 0 for f in facts]
    return FittedCategories(
        tuple(cols),
        table,
        {c: (f["bytes"] if f else 0) + width * n for c, f, n in zip(cols, facts, rows)},
        {
            c: (f["frequent"] if f else 0) - (d is not None)
            for c, f, d in zip(cols, facts, demoted)
        },
        dict(zip(cols, unseen)),
        min_obs is not None,
    )


def _sums(n_fold: int) -> list[str]:
    return ["s", "m"] + [f"{x}_{i}" for i in range(1, n_fold + 1) for x in ("s", "n")]


def _column_facts(
    stats: DataFrame,
    keys: Sequence[str],
    frequent: str,
    target: str | None,
    n_fold: int,
    keep_all: bool,
    by_label: bool,
) -> list[Row | None]:
    """What fitting needs to know of each column, one row per column: how many values are frequent
    and rare, the size of the mapping, and the target sums of the values that become label 0."""
    kept = "true" if keep_all else frequent
    rare = f"NOT ({frequent}) AND n > 0"
    text = " + ".join(f"coalesce(octet_length(CAST({k} AS STRING)), 0)" for k in keys)
    aggs = [
        f"count_if({frequent}) AS frequent",
        f"count_if({rare}) AS rare",
        f"count_if({kept}) AS rows",
        f"coalesce(sum(CASE WHEN {kept} THEN {text} END), 0) AS bytes",
    ]
    if target and by_label:
        sums = _sums(n_fold)
        aggs += [f"sum(CASE WHEN {rare} THEN {c} END) AS {c}" for c in sums]
        order = f"CASE WHEN {frequent} THEN first_row END"
        aggs.append(f"max_by(struct({', '.join(sums)}), {order}) AS last")
    aggs = [F.expr(a) for a in aggs]
    found = {r["_set"]: r for r in stats.groupBy("_set").agg(*aggs).collect()}
    return [found.get(i) for i in range(len(keys))]


def _pooled_means(facts: Row | None, demoted: bool, n_fold: int) -> list[float | None]:
    """Target means of label 0, overall and outside each fold: over the rare values, or, where none
    is rare, of the last frequent one."""
    if facts is None:
        return [None] * (n_fold + 1)
    pool = facts["last"] if demoted else facts

    def mean(total: int, n: int) -> float | None:
        return total / n if n else None

    s, n = pool["s"] or 0, pool["m"] or 0
    return [mean(s, n)] + [
        mean(s - (pool[f"s_{i}"] or 0), n - (pool[f"n_{i}"] or 0)) for i in range(1, n_fold + 1)
    ]


def _label_mean(own: str, k: int, pools: list[list[float | None]]) -> str:
    """A label above 0 is one value and has that value's mean; label 0 has the pooled one."""
    pooled = " ".join(
        f"WHEN _set = {i} THEN {number(pool[k])}" for i, pool in enumerate(pools) if pool[k] is not None
    )
    pooled = f"CASE {pooled} END" if pooled else "CAST(NULL AS DOUBLE)"
    return f"CASE WHEN label = 0 THEN {pooled} ELSE {own} END"


class LabelEncoder:
    """Numbers frequent values by first appearance; see :func:`fit_categories`."""

    def __init__(self, min_obs: int = 10):
        self.min_obs = min_obs

    def fit(self, df: DataFrame, cols: Sequence[str], fit_all: bool = False) -> "LabelEncoder":
        self.fitted = fit_categories(df, cols, self.min_obs, fit_all)
        return self

    def transform(self, df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
        """Replace the columns by their labels, or add the labels under ``names``."""
        for c in self.fitted.cols:
            df = self.fitted.apply(df, c, {"label": (names or {}).get(c, c)})
        return df


class MinMax:
    """Scales columns to [0, 1] of the fitted range; other data may fall outside. A column with a
    single value becomes 0."""

    def __init__(self, cols: Sequence[str]):
        self.cols = list(cols)

    def fit(self, df: DataFrame) -> "MinMax":
        rows = min_max(df, self.cols).collect() if self.cols else []  # a row per column
        self.bounds = {r["column"]: (r["lo"], r["hi"]) for r in rows}
        return self

    def expr(self, c: str) -> str:
        """Scaled column as SQL text."""
        lo, hi = self.bounds[c]
        if lo is None:
            return "CAST(NULL AS DOUBLE)"
        return f"({ident(c)} - {number(lo)}) / {number(hi - lo if hi != lo else 1.0)}"

    def column(self, c: str) -> Column:
        return F.expr(self.expr(c))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.column(c) for c in self.bounds})


class OneHot:
    """One column per label of at least ``min_obs`` rows, over train and test together; label 0
    gets none. Columns follow the order of the source columns, then of the labels."""

    def __init__(self, min_obs: int = 100):
        self.min_obs = min_obs

    def fit(self, df: DataFrame, cols: Sequence[str]) -> "OneHot":
        self.fitted = fit_categories(df, cols, self.min_obs, fit_all=True)
        self.width = sum(self.fitted.max_label.values())
        return self

    def _labels(self, df: DataFrame) -> DataFrame:
        for c in self.fitted.cols:
            df = self.fitted.apply(df, c, {"label": f"_label_{c}"})
        return df

    def indexed(self, df: DataFrame, first: int = 0) -> tuple[DataFrame, list[Column]]:
        """``df`` with its labels, and per source column the position of a row's one, null where it has
        none; positions count from ``first``."""
        cells, offset = [], first
        for c in self.fitted.cols:
            label = quoted(f"_label_{c}")
            cells.append(F.when(label > 0, label + (offset - 1)).cast("bigint"))
            offset += self.fitted.max_label[c]
        return self._labels(df), cells

    def transform_long(self, df: DataFrame, first: int = 0) -> DataFrame:
        """``(row_id, idx, value)`` of the ones, with columns numbered from ``first``."""
        wide, cells = self.indexed(df.select(ROW_ID, *[quoted(c) for c in self.fitted.cols]), first)
        return (
            wide.select(ROW_ID, F.explode(F.array(*cells)).alias("idx"))
            .filter("idx IS NOT NULL")
            .withColumn("value", F.lit(1.0))
        )

    def transform_vector(
        self, df: DataFrame, leading: Sequence[str] = (), out: str = "features"
    ) -> DataFrame:
        """Sparse vector of ``leading`` numeric columns followed by the one-hot columns."""
        cols = [c for c in self.fitted.cols if self.fitted.max_label[c] > 0]
        wide = self._labels(df)
        # label 0 moves to the last position, which the encoder drops
        indexed = []
        for c in cols:
            top = self.fitted.max_label[c]
            label = quoted(f"_label_{c}")
            meta = {"ml_attr": {"type": "nominal", "num_vals": top + 1, "name": f"_idx_{c}"}}
            index = F.when(label == 0, top).otherwise(label - 1).cast("double")
            indexed.append(index.alias(f"_idx_{c}", metadata=meta))
        wide = wide.select(*[quoted(c) for c in df.columns], *indexed)
        encoder = OneHotEncoder(
            inputCols=[f"_idx_{c}" for c in cols], outputCols=[f"_hot_{c}" for c in cols]
        )
        hot = encoder.fit(wide).transform(wide)
        assembler = VectorAssembler(
            inputCols=[*leading, *[f"_hot_{c}" for c in cols]], outputCol=out
        )
        return assembler.transform(hot).select(*[quoted(c) for c in df.columns], out)


def value_counts(df: DataFrame, c: str) -> DataFrame:
    return df.groupBy(quoted(c).alias(c)).agg(F.count("*").alias("n"))


def frequent(df: DataFrame, c: str, min_obs: int) -> DataFrame:
    return value_counts(df, c).filter(F.col("n") >= min_obs)


def null_category(c: Column) -> Column:
    """Text key in which null is a value of its own, apart from every real value."""
    return F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), c.cast("string")))


def target_encode(
    df: DataFrame, cols: Sequence[str], names: dict[str, str] | None = None
) -> DataFrame:
    """Mean target of all train rows per value, as new columns ``mt_<column>``."""
    fitted = fit_categories(df, cols, target=TARGET)
    for c in cols:
        df = fitted.apply(df, c, {"te": (names or {}).get(c, f"mt_{c}")})
    return df


def with_fold_means(df: DataFrame, fitted: FittedCategories, cols: Sequence[str]) -> DataFrame:
    """Append ``_te_<column>``: the means of every fold as one array."""
    for c in cols:
        df = fitted.apply(df, c, {"te_folds": f"_te_{c}"})
    return df


def target_encode_folds(
    df: DataFrame, cols: Sequence[str], n_fold: int = N_FOLD, fitted: FittedCategories | None = None
) -> DataFrame:
    """All rows once per fold i, encoded with the means over the train rows outside fold i:
    ``(fold, row_id, is_test, target, <column>…)``. One lookup per column serves all folds."""
    fitted = fitted or fit_categories(df, cols, target=TARGET, n_fold=n_fold)
    keys = [c for c in (ROW_ID, IS_TEST, TARGET) if c in df.columns]
    source = df.select(*keys, *[quoted(c) for c in cols])
    return explode_folds(with_fold_means(source, fitted, cols), keys, cols, n_fold)


def explode_folds(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], n_fold: int = N_FOLD
) -> DataFrame:
    rows = [
        f"struct({i + 1} AS {FOLD}, "
        + ", ".join(f"get({ident('_te_' + c)}, {i}) AS {ident(c)}" for c in cols)
        + ")"
        for i in range(n_fold)
    ]
    return df.selectExpr(*keys, f"inline(array({', '.join(rows)}))")


def target_encode_oof(
    df: DataFrame, cols: Sequence[str], n_fold: int = N_FOLD, names: dict[str, str] | None = None
) -> DataFrame:
    """Train rows, each encoded with the means over the other folds, as ``te_<column>``."""
    fitted = fit_categories(df, cols, target=TARGET, n_fold=n_fold)
    train = with_fold_means(df.filter(~F.col(IS_TEST)), fitted, cols)
    new = [
        F.get(quoted(f"_te_{c}"), F.col(FOLD) - 1).alias((names or {}).get(c, f"te_{c}"))
        for c in cols
    ]
    return train.select(*[quoted(c) for c in df.columns], *new)


# --- ordered target statistics ------------------------------------------------------------------

RUN_ROWS = 100_000  # rows of the order per bucket: no window holds more than a bucket's rows of a value


def ordered_target_stats(
    df: DataFrame,
    cols: Sequence[str],
    n_fold: int = 0,
    prior_weight: float = 1.0,
    seed: int = SEED + 1,
    run_rows: int = RUN_ROWS,
) -> DataFrame:
    """``(row_id, stats)``: per fold left out (or once, without folds) an array with a number per column.

    Train rows are put in a seeded random order, that of a hash of the row id. A train row's number is the
    mean target of the rows of its category strictly before it, so its own target takes no part; with folds,
    of those outside the fold. Test rows, and the rows of the fold left out, get the mean over all train rows
    outside it. ``prior_weight`` rows of the overall mean are mixed into every mean, which is what the first
    row of a category and unseen ones get. Null is a category; rows without a target count nowhere.

    Two levels: sums per category and bucket of the order, running over the buckets, then a window inside
    each bucket. A hot category is so spread over the buckets, whose number follows the rows.
    """
    sums = ["", *[str(i) for i in range(1, n_fold + 1)]]
    train = df.filter(~F.col(IS_TEST) & quoted(TARGET).isNotNull())
    y = quoted(TARGET).cast("bigint")
    by_fold = [F.when(F.col(FOLD) == i, y) for i in range(1, n_fold + 1)]
    whole = train.agg(
        *[F.sum(v).alias(f"s{f}") for f, v in zip(sums, [y, *by_fold])],
        *[F.count(v).alias(f"n{f}") for f, v in zip(sums, [y, *by_fold])],
    ).first()
    buckets = max(1, -(-whole["n"] // run_rows))
    pairs = ", ".join(f"struct({i} AS _c, {_tagged(c)} AS _v)" for i, c in enumerate(cols))
    keep = [ROW_ID, IS_TEST, *([FOLD] if n_fold else [])]
    long = df.select(
        *keep,
        F.when(~F.col(IS_TEST), y).alias("_y"),
        row_hash(F.col(ROW_ID), seed).alias("_at"),
        F.expr(f"inline(array({pairs}))"),
    ).withColumn("_b", F.expr(f"CAST((_at * {buckets}) div 4294967296 AS INT)"))
    known = long.filter("_y IS NOT NULL")
    parts = {f"_s{f}": "_y" if not f else f"CASE WHEN {FOLD} = {f} THEN _y END" for f in sums}
    parts |= {f"_n{f}": "1" if not f else f"CASE WHEN {FOLD} = {f} THEN 1 END" for f in sums}
    per = store(
        known.groupBy("_c", "_v", "_b").agg(*[F.expr(f"coalesce(sum({e}), 0)").alias(n) for n, e in parts.items()]),
        "ordered-sums",
    )
    buckets_before = Window.partitionBy("_c", "_v").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select(
        "_c", "_v", "_b", *[F.coalesce(F.sum(n).over(buckets_before), F.lit(0)).alias(f"{n}_0") for n in parts]
    )
    rows_before = (
        Window.partitionBy("_c", "_v", "_b").orderBy("_at", ROW_ID).rowsBetween(Window.unboundedPreceding, -1)
    )
    running = known.join(starts, ["_c", "_v", "_b"]).select(
        *keep, "_c", "_v",
        *[(F.col(f"{n}_0") + F.coalesce(F.sum(F.expr(e)).over(rows_before), F.lit(0))).alias(n)
          for n, e in parts.items()],
    )
    key = F.concat_ws("/", "_c", "_v")
    totals = per.groupBy(key.alias("_key")).agg(*[F.sum(n).alias(n) for n in parts])
    totals = mapping(totals, "_key", "ordered-totals")
    # test rows need the totals; with folds, so do the train rows of the fold left out
    rest = long if n_fold else long.filter("_y IS NULL")
    wanted = {n: f"{n}_all" for n in parts}
    full = lookup(rest.withColumn("_k", key), totals, "_k", wanted, dict.fromkeys(wanted.values(), 0))
    full = full.select(*keep, "_c", "_v", *wanted.values())
    blank = [F.lit(None).cast("bigint").alias(n) for n in parts]
    empty = [F.lit(None).cast("bigint").alias(n) for n in wanted.values()]
    both = running.select(ROW_ID, "_c", *parts, *empty).unionByName(full.select(ROW_ID, "_c", *blank, *wanted.values()))
    fold = [F.max(F.col(FOLD)).alias(FOLD)] if n_fold else []
    if n_fold:
        both = running.select(ROW_ID, FOLD, "_c", *parts, *empty).unionByName(
            full.select(ROW_ID, FOLD, "_c", *blank, *wanted.values())
        )
    one = both.groupBy(ROW_ID, "_c").agg(*fold, *[F.max(n).alias(n) for n in [*parts, *wanted.values()]])
    outside = [str(i) for i in range(1, n_fold + 1)] or [""]
    values = []
    for f in outside:
        s, n = (whole[f"{x}"] or 0 for x in ("s", "n"))
        if f:
            s, n = s - (whole[f"s{f}"] or 0), n - (whole[f"n{f}"] or 0)
        prior = number(s / n if n else 0.0)
        ran = [f"({x} - {x}{f})" if f else x for x in ("_s", "_n")]
        all_ = [f"({x}_all - {x}{f}_all)" if f else f"{x}_all" for x in ("_s", "_n")]
        before = f"_s IS NOT NULL{f' AND {FOLD} <> {f}' if f else ''}"
        chosen = [f"CASE WHEN {before} THEN {r} ELSE {a} END" for r, a in zip(ran, all_)]
        w = number(prior_weight)
        values.append(f"CAST((coalesce({chosen[0]}, 0) + {w} * {prior}) / (coalesce({chosen[1]}, 0) + {w}) AS DOUBLE)")
    turned = one.select(ROW_ID, "_c", F.expr(f"array({', '.join(values)})").alias("_a")).groupBy(ROW_ID).agg(
        *[F.max(F.when(F.col("_c") == i, F.col("_a"))).alias(f"_{i}") for i in range(len(cols))]
    )
    per_fold = [F.array(*[F.get(f"_{i}", F.lit(j)) for i in range(len(cols))]) for j in range(len(outside))]
    return turned.select(ROW_ID, F.array(*per_fold).alias("stats"))


def _tagged(c: str) -> str:
    """Text key of a value, null included."""
    return f"CASE WHEN {ident(c)} IS NULL THEN 'n' ELSE concat('v', CAST({ident(c)} AS STRING)) END"
