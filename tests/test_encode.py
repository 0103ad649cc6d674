"""Encoders against plain Python, and the paths large mappings take."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ordstack.functions.splits import assign_folds
from ordstack.operators import encode, lookup, ordering

SCHEMA = "row_id bigint, is_test boolean, fold int, target int, c string, k bigint"


def sample(n=600):
    """A third of the rows share one key; nulls, rare, test-only and one-fold-only values."""
    rows = []
    for i in range(n):
        c = "hot" if i % 3 == 0 else None if i % 7 == 0 else f"v{i % 23}"
        k = 7 if i % 3 == 1 else i % 41
        test = i % 5 == 4
        if test and i % 11 == 0:
            c = "only-test"
        fold = (i * 31) % 5 + 1
        if i % 97 == 1 and not test:
            c, fold = "one-fold", 2
        rows.append((i, test, fold, (i * i) % 9, c, k))
    return rows


@pytest.fixture(scope="module")
def rows():
    return sample()


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(6).persist()


def expected_labels(values, min_obs):
    seen, counts = list(dict.fromkeys(values)), Counter(values)
    frequent = [v for v in seen if counts[v] >= min_obs]
    labels = {v: i + 1 for i, v in enumerate(frequent)}
    if len(frequent) == len(seen) and frequent:
        labels[frequent[-1]] = 0
    return labels


@pytest.fixture(params=["broadcast", "shuffled"])
def path(request, monkeypatch):
    if request.param == "shuffled":
        monkeypatch.setattr(lookup, "BROADCAST_BYTES", -1)
    return request.param


@pytest.mark.parametrize("min_obs", [1, 10, 20, 10_000])
def test_labels(df, rows, path, min_obs):
    want = {c: expected_labels([r[i] for r in rows if not r[1]], min_obs) for c, i in (("c", 4), ("k", 5))}
    out = encode.LabelEncoder(min_obs).fit(df, ["c", "k"]).transform(df, {"c": "lc", "k": "lk"})
    got = {r.row_id: (r.lc, r.lk) for r in out.collect()}
    assert len(got) == len(rows)
    for r in rows:
        assert got[r[0]] == (want["c"].get(r[4], 0), want["k"].get(r[5], 0))


def test_adding_a_row_makes_a_label_frequent(spark):
    def labels(n):
        data = [(i, False, 1, 0, "a", 0) for i in range(30)] + [
            (100 + i, False, 1, 0, "b", 0) for i in range(n)
        ] + [(999, False, 1, 0, "z", 0)]
        d = spark.createDataFrame(data, SCHEMA)
        out = encode.LabelEncoder(10).fit(d, ["c"]).transform(d)
        return {r.c for r in out.filter("row_id BETWEEN 100 AND 200").collect()}

    assert labels(9) == {0}
    assert labels(10) == {2}


def fold_means(rows, key):
    s, n = defaultdict(int), defaultdict(int)
    for r in rows:
        if not r[1]:
            for f in range(1, 6):
                if r[2] != f:
                    s[key(r), f] += r[3]
                    n[key(r), f] += 1
    return {k: s[k] / n[k] for k in n}


def test_target_means_per_fold(df, rows, path):
    want = fold_means(rows, lambda r: r[4])
    got = encode.target_encode_folds(df, ["c"]).collect()
    assert len(got) == 5 * len(rows)
    value = {r[0]: r[4] for r in rows}
    for g in got:
        v = value[g.row_id]
        expected = None if v is None else want.get((v, g.fold))
        assert g.c == pytest.approx(expected) if expected is not None else g.c is None
    one_fold = [g for g in got if value[g.row_id] == "one-fold"]
    assert {g.c for g in one_fold if g.fold == 2} == {None}
    assert None not in {g.c for g in one_fold if g.fold != 2}


def test_target_means_of_labels(df, rows, path):
    labels = expected_labels([r[4] for r in rows if not r[1]], 20)
    want = fold_means(rows, lambda r: labels.get(r[4], 0))
    fitted = encode.fit_categories(df, ["c"], min_obs=20, target="target", n_fold=5)
    out = fitted.apply(df, "c", {"label": "l", "te_folds": "t"}).collect()
    for g in out:
        assert g.l == labels.get(g.c, 0)
        assert list(g.t) == pytest.approx([want[g.l, f] for f in range(1, 6)])


def test_own_target_does_not_leak(spark, rows):
    def encoded(data):
        d = spark.createDataFrame(data, SCHEMA)
        return {r.row_id: r.te_k for r in encode.target_encode_oof(d, ["k"]).collect()}

    changed = [r if r[0] != 10 else (*r[:3], 20, *r[4:]) for r in rows]
    assert encoded(rows)[10] == encoded(changed)[10]
    assert encoded(rows) != encoded(changed)


def test_overlap_flag(df, rows, path):
    train, test = {r[5] for r in rows if not r[1]}, {r[5] for r in rows if r[1]}
    got = {r.row_id: r.cid_both for r in lookup.overlap_flag(df, "k").collect()}
    assert got == {r[0]: int(r[5] in (train & test)) for r in rows}


def test_hot_values_are_found(df):
    assert "hot" in lookup.hot_values(df, "c")
    assert 7 in lookup.hot_values(df, "k")


def test_shuffled_lookup_spreads_the_hot_key(df, monkeypatch):
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", -1)
    m = lookup.mapping(df.groupBy("k").agg(F.max("target").alias("v")), "k")
    out = lookup.lookup(df, m, "k", {"v": "v"})
    plan = out._jdf.queryExecution().toString()
    assert "_salt_l" in plan
    assert out.count() == df.count()


def test_min_max(df, spark):
    d = spark.createDataFrame(
        [(1, False, 5.0, 3.0, None), (2, False, 7.0, 3.0, None), (3, True, 11.0, 4.0, 2.0)],
        "row_id bigint, is_test boolean, a double, b double, c double",
    )
    out = encode.MinMax(["a", "b", "c"]).fit(d.filter("NOT is_test")).transform(d)
    got = {r.row_id: (r.a, r.b, r.c) for r in out.collect()}
    assert got == {1: (0.0, 0.0, None), 2: (1.0, 0.0, None), 3: (3.0, 1.0, None)}


def test_one_hot_cells_equal_vectors(df):
    hot = encode.OneHot(min_obs=20).fit(df, ["c", "k"])
    cells = {(r.row_id, r.idx) for r in hot.transform_long(df).collect()}
    vectors = set()
    for r in hot.transform_vector(df).select("row_id", "features").collect():
        assert r.features.size == hot.width
        vectors |= {(r.row_id, int(i)) for i in r.features.toArray().nonzero()[0]}
    assert cells == vectors


def test_folds_partition_the_rows(df):
    out = assign_folds(df.drop("fold"))
    assert {r.fold for r in out.select("fold").distinct().collect()} == {1, 2, 3, 4, 5}
    assert out.filter("fold IS NULL").count() == 0
