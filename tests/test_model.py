from __future__ import annotations

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from ticketlens import catalog
from ticketlens.operators.encoding import cyclical
from ticketlens.operators.ordering import row_numbers
from ticketlens.plans import enrich, report, training
from ticketlens.plans import features as FT
from ticketlens.plans.scoring import Thresholds, flag_for_review, risk_band
from ticketlens.sources.testdata import FEATURE_LEVELS
from ticketlens.streaming.scoring import score_records, start_scoring

RECORD = {
    "ticket_type": "incident", "severity": "major", "channel": "email", "tier": "gold",
    "industry": "retail", "region": "ontario", "province": "ON", "service_type": "sd_wan",
    "assignment_group": "field_ontario", "customer_id": "c1", "priority": "2",
    "open_backlog_at_creation": "40", "sla_target_hours": "12.0", "creation_hour_local": "22",
    "creation_dow_local": "6", "has_active_outage": "true", "is_weekend": "true",
    "is_after_hours": "true", "has_requested_resolution_date": "false",
}
MUTATIONS = [
    ({"severity": None}, "severity", "missing"),
    ({"severity": "urgent"}, "severity", "value_error"),
    ({"channel": "fax"}, "channel", "value_error"),
    ({"priority": "5"}, "priority", "less_than_equal"),
    ({"priority": "0"}, "priority", "greater_than_equal"),
    ({"creation_hour_local": "24"}, "creation_hour_local", "less_than_equal"),
    ({"creation_dow_local": "-1"}, "creation_dow_local", "greater_than_equal"),
    ({"open_backlog_at_creation": "-3"}, "open_backlog_at_creation", "greater_than_equal"),
    ({"sla_target_hours": "0"}, "sla_target_hours", "greater_than"),
    ({"priority": "two"}, "priority", "int_parsing"),
    ({"has_active_outage": "maybe"}, "has_active_outage", "bool_parsing"),
    ({"sla_breached": "true"}, "sla_breached", "extra_forbidden"),
    ({"reopen_count": "1"}, "reopen_count", "extra_forbidden"),
]


def records(spark, *changes):
    cols = [*RECORD, "sla_breached", "reopen_count"]
    rows = [(i, *[{**RECORD, **c}.get(k) for k in cols]) for i, c in enumerate(changes)]
    return spark.createDataFrame(rows, "k int, " + ", ".join(f"{c} string" for c in cols))


def test_contract_is_creation_time_only():
    assert not set(FT.FEATURES) & set(enrich.OUTCOME_FIELDS)
    assert len(FT.FEATURES) == len(set(FT.FEATURES)) == 19
    assert [f["name"] for f in FT.feature_schema()] == FT.FEATURES


def test_each_defect_is_named(spark):
    df = records(spark, {}, {"tier": " GOLD "}, *[m for m, _, _ in MUTATIONS])
    good, bad = FT.split_valid(FT.validate_records(df, "k"), "k")
    assert sorted(r["k"] for r in good.collect()) == [0, 1]
    assert {r["tier"] for r in good.collect()} == {"gold"}
    want = {(i + 2, f, e) for i, (_, f, e) in enumerate(MUTATIONS)}
    assert {tuple(r) for r in bad.collect()} == want


def test_preparation_errors_name_columns_and_levels(spark):
    df = records(spark, {}).drop("sla_breached", "reopen_count")
    with pytest.raises(ValueError, match="missing feature columns: .*tier"):
        FT.prepare_features(df.drop("tier"))
    with pytest.raises(ValueError, match="'tier': 1") as error:
        FT.prepare_features(records(spark, {"tier": "Diamond"}))
    listed = spark.read.parquet(str(error.value).rsplit(" ", 1)[1])
    assert [tuple(r) for r in listed.collect()] == [("tier", "diamond")]
    with pytest.raises(ValueError, match="is_weekend"):
        FT.prepare_features(records(spark, {"is_weekend": "perhaps"}))
    ids = df.drop("has_active_outage").withColumn("active_outage_id", F.lit(" "))
    assert FT.prepare_features(ids).first()["has_active_outage"] is False


def test_outcome_is_three_valued(spark):
    c = datetime(2025, 3, 1)
    rows = [
        (1, "closed", c, datetime(2025, 3, 2), datetime(2025, 3, 1, 12), 24),
        (2, "closed", c, datetime(2025, 3, 2), datetime(2025, 3, 3), 24),
        (3, "in_progress", c, datetime(2025, 3, 2), None, 24),
        (4, "in_progress", c, datetime(2025, 3, 20), None, 456),
        (5, "cancelled", c, datetime(2025, 3, 2), None, 24),
        (6, "closed", c, datetime(2025, 3, 2), datetime(2025, 3, 2), 24),
    ]
    df = spark.createDataFrame(
        rows,
        "id int, status string, creation_date timestamp_ntz, expected_resolution_date timestamp_ntz,"
        " resolution_date timestamp_ntz, sla_target_hours int",
    )
    got = enrich.add_outcome(df, datetime(2025, 3, 10)).orderBy("id").collect()
    assert [r["sla_breached"] for r in got] == [False, True, True, None, None, False]
    assert float(got[0]["resolution_hours"]) == 12.0 and got[2]["resolution_hours"] is None


def test_local_time_uses_the_site_zone(spark):
    ts = datetime(2025, 3, 8, 2, 30)
    df = spark.createDataFrame(
        [(1, ts, "America/Vancouver"), (2, ts, "Asia/Tokyo"), (3, ts, None)],
        "id int, creation_date timestamp_ntz, timezone string",
    )
    got = enrich.local_time_features(df).orderBy("id").collect()
    assert [r["creation_dow_local"] for r in got] == [4, 5, 4]
    assert [r["creation_hour_local"] for r in got] == [18, 11, 21]
    assert [r["is_weekend"] for r in got] == [False, True, False]
    assert [r["is_after_hours"] for r in got] == [True, False, True]


def test_split_boundaries(spark):
    stamps = [datetime(2025, 12, 31, 23, 59, 59), datetime(2026, 1, 1), datetime(2026, 4, 1)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(stamps)], "i int, t timestamp_ntz")
    got = df.orderBy("i").select(enrich.split_of("t", "2025-12", "2026-03")).collect()
    assert [r[0] for r in got] == ["train", "validation", "test"]


def test_band_uses_raw_and_flag_uses_rounded_probability(spark):
    cuts = Thresholds(0.3, 0.5000001)
    df = spark.createDataFrame([(0.5,), (0.49999996,), (0.3,), (0.1,)], "p double")
    got = df.select(risk_band("p", cuts), flag_for_review("p", 0.5)).collect()
    assert [tuple(r) for r in got] == [
        ("medium", True), ("medium", True), ("medium", False), ("low", False),
    ]


def test_cyclical_time_lies_on_the_circle(spark):
    df = spark.range(24).select(
        F.col("id").alias("creation_hour_local"), (F.col("id") % 7).alias("creation_dow_local")
    ).withColumns(cyclical())
    for r in df.collect():
        assert r["hour_sin"] ** 2 + r["hour_cos"] ** 2 == pytest.approx(1)
        assert r["dow_sin"] ** 2 + r["dow_cos"] ** 2 == pytest.approx(1)


@pytest.fixture(scope="module")
def parts(desk):
    return catalog._parts(desk)


@pytest.fixture(scope="module")
def model(desk):
    train, valid, _ = catalog._parts(desk)
    counts = training.check_splits(catalog.model_rows(desk))
    return training.train_model(train, valid, training.Spec(params={"C": 1.0}), "lr-1", counts)


def test_empty_split_is_an_error(desk):
    rows = catalog.model_rows(desk)
    with pytest.raises(ValueError, match="no labelled rows for test"):
        training.check_splits(rows.filter("split <> 'test'"))


def test_the_stated_encoding_is_the_one_that_runs(parts):
    few = parts[0].filter("customer_id % 2 = 0")
    for rows in (parts[0], few):
        fitted = training.fit(rows, training.Spec(params={"maxIter": 2}))
        assert list(fitted.statistics) == ["customer_id"]
        hashed = training.Spec(target_encoded=(), bucketed=("customer_id",), params={"maxIter": 2})
        assert not training.fit(rows, hashed).statistics


def test_unseen_levels_are_scored(parts, model):
    strange = parts[1].limit(5).withColumn("customer_id", F.lit("never seen"))
    assert all(0 <= r["p"] <= 1 for r in model.predict(strange).collect())


def test_model_ranks_and_probabilities_are_valid(parts, model):
    test = training.evaluate(model.fitted, parts[2])
    rate = parts[2].agg(F.avg("y")).first()[0]
    assert 0.5 < test["roc_auc"] <= 1 and test["pr_auc"] > rate
    assert model.cuts.medium <= model.cuts.high


def test_shuffled_labels_are_a_permutation_without_signal(parts):
    mixed = training.shuffle_labels(parts[0])
    assert mixed.count() == parts[0].count()
    assert mixed.agg(F.sum("y")).first() == parts[0].agg(F.sum("y")).first()
    both = mixed.select("ticket_id", F.col("y").alias("z")).join(parts[0], "ticket_id")
    assert abs(both.agg(F.corr("y", "z")).first()[0]) < 0.06
    assert abs(both.agg(F.corr("sla_target_hours", "z")).first()[0]) < 0.06


def test_an_outcome_column_is_caught_by_the_positive_control(parts):
    spec = training.Spec(
        family="gbt", categorical=("tier", "severity"), params={"maxIter": 3, "maxDepth": 3}
    )
    leak = training.Spec(**{**spec.__dict__, "extra_numeric": ("resolution_hours",)})
    plain = training.fit_and_evaluate(parts[0], parts[1], spec)
    leaky = training.fit_and_evaluate(parts[0], parts[1], leak)
    assert leaky["roc_auc"] > plain["roc_auc"] + 0.05


@pytest.mark.parametrize(
    "spec",
    [
        training.Spec(time_encoding="onehot", params={"maxIter": 3}),
        training.Spec(time_encoding="cyclical", balanced=True, params={"maxIter": 3}),
        training.Spec(
            family="gbt", target_encoded=("site_id",), time_encoding="onehot",
            params={"maxIter": 2, "maxDepth": 2},
        ),
    ],
)
def test_encodings_fit_and_predict(parts, spec):
    fitted = training.fit(parts[0], spec)
    out = fitted.predict(parts[1])
    assert out.columns == [*parts[1].columns, "p"]
    assert out.filter("p is null or p < 0 or p > 1").count() == 0


def test_saved_model_scores_the_same_and_a_wrong_card_is_refused(spark, parts, model, tmp_path):
    path = str(tmp_path / "model")
    training.save_model(model, spark, path)
    loaded = training.load_model(spark, path)
    a = model.predict(parts[2]).select("ticket_id", "p")
    b = loaded.predict(parts[2]).select("ticket_id", "p")
    assert a.exceptAll(b).count() == 0
    training._write_text(spark, f"{path}/model_card", json.dumps({**model.card, "threshold": 0.1}))
    with pytest.raises(ValueError, match="threshold"):
        training.load_model(spark, path)


def test_importance_covers_every_feature(parts, model):
    rows = training.permutation_importance(model.fitted, parts[1], repeats=1).collect()
    assert {r["feature"] for r in rows} == set(FT.FEATURES)
    means = [r["importance_mean"] for r in rows]
    assert means == sorted(means, reverse=True) and means[0] > 0


def test_stream_scores_like_the_batch(spark, desk, model, tmp_path):
    text = FT.project_features(desk.tickets.limit(300), ["ticket_id"])
    text = text.select("ticket_id", *[F.col(c).cast("string").alias(c) for c in FT.FEATURES])
    broken = text.withColumn(
        "priority", F.when(F.col("ticket_id") % 5 == 0, "two").otherwise(F.col("priority"))
    )
    source = str(tmp_path / "in")
    broken.repartition(3).write.json(source)
    schema = broken.schema
    stream = spark.readStream.schema(schema).json(source)
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    start_scoring(stream, "ticket_id", model, out, mark, FEATURE_LEVELS).awaitTermination(120)
    got = spark.read.parquet(f"{out}/scores").drop("batch")
    bad = spark.read.parquet(f"{out}/rejected").drop("batch")
    batch = spark.read.schema(schema).json(source)
    scored, errors = score_records(batch, "ticket_id", model, FEATURE_LEVELS)
    assert got.exceptAll(scored).count() == 0 and got.count() == scored.count()
    assert bad.exceptAll(errors).count() == 0 and bad.count() == errors.count()


def test_report_week_is_checked(desk):
    last = report.last_week(desk)
    assert report.check_week(desk, None) == last == date(2001, 7, 29)
    with pytest.raises(ValueError, match="named by its Sunday"):
        report.check_week(desk, date(2000, 6, 5))
    with pytest.raises(ValueError, match="outside the complete weeks"):
        report.check_week(desk, date(2001, 8, 5))
    with pytest.raises(ValueError, match="no earlier week"):
        report.check_week(desk, date(1995, 1, 1))
    early = report.weeks_up_to(desk, date(1995, 1, 15), 13)
    assert early.size == 3 and early.first == datetime(1995, 1, 2)


def test_registered_model_queries_do_the_whole_job(desk, monkeypatch):
    asked = []

    def fits(jobs, parallelism=4):
        asked.append([spec for _, _, spec in jobs])
        scores = {"roc_auc": 0.5, "brier": 0.2, "log_loss": 0.5}
        # One-hot time wins for trees, cyclical time for the linear family.
        best = {("gbt", "onehot"), ("lr", "cyclical")}
        return [{**scores, "pr_auc": 0.6 if (s.family, s.time_encoding) in best else 0.5} for _, _, s in jobs]

    def rounds(specs):
        return {s.params.get("maxIter", training.GBT_DEFAULTS["maxIter"]) for s in specs if s.family != "lr"}

    monkeypatch.setattr(training, "fit_many", fits)
    monkeypatch.setattr(desk, "_built", {**desk._built})
    assert catalog.model_grid(desk).count() == len(training.LR_GRID) + len(training.GBT_GRID)
    experiments, grid = asked
    assert len(experiments) == 17 and rounds(experiments) == {100} and rounds(grid) == {200}
    assert {(s.family, s.time_encoding) for s in grid} == {("gbt", "onehot"), ("lr", "cyclical")}
    assert all("maxIter" not in s.params for s in grid if s.family == "lr")
    catalog.leakage_checks(desk)
    assert rounds(asked[-1]) == {100}
    made, repeats = [], []

    def train(train, valid, spec, version, counts, fitted=None, facts=None):
        made.append(spec)
        return training.BreachModel(None, None, {})

    def importance(fitted, rows, repeats_=5, **kw):
        repeats.append(repeats_)
        return rows.select("ticket_id").limit(1)

    monkeypatch.setattr(training, "train_model", train)
    monkeypatch.setattr(training, "permutation_importance", importance)
    splits = {r.split for r in catalog.permutation_importance(desk).collect()}
    assert splits == {"validation", "test"} and repeats == [5, 5]
    assert made == [desk._built["tuned"][1][desk._built["tuned"][2]][0]]


def test_card_tells_levels_weights_and_facts(parts, model):
    assert model.card["training_levels"]["tier"] == sorted(model.card["training_levels"]["tier"])
    assert model.card["class_weight"] is None and model.card["features"] == FT.feature_schema()
    balanced = training.train_model(
        parts[0], parts[1], training.Spec(balanced=True), "b", {}, fitted=model.fitted, facts={"test_metrics": {"lr": 1}}
    )
    assert balanced.card["class_weight"] == "balanced" and balanced.card["test_metrics"] == {"lr": 1}


def test_importance_equals_permuting_by_hand(parts, model):
    rows = parts[1].limit(400)
    got = {r.feature: r for r in training.permutation_importance(model.fitted, rows, repeats=2, seed=3).collect()}
    base = row_numbers(rows, ["ticket_id"], name="_rn")
    whole = training.evaluate(model.fitted, rows)["pr_auc"]
    for c in ("severity", "customer_id", "creation_hour_local"):
        drops = []
        for r in range(2):
            lent = base.select(F.col("_rn").alias("_from"), F.col(c).alias("_lent"))
            mixed = training.donors(base, r, 3, rows.count()).join(lent, "_from").withColumn(c, F.col("_lent"))
            drops.append(whole - training.evaluate(model.fitted, mixed)["pr_auc"])
        assert got[c].importance_mean == pytest.approx(sum(drops) / 2, abs=1e-9)


def test_saved_trees_score_the_same(spark, parts, tmp_path):
    spec = training.Spec(family="gbt", params={"maxIter": 3, "maxLeaves": 6})
    made = training.train_model(parts[0], parts[1], spec, "gbt-1", {})
    training.save_model(made, spark, f"file://{tmp_path}/trees")
    loaded = training.load_model(spark, f"file://{tmp_path}/trees")
    a, b = (m.predict(parts[2]).select("ticket_id", "p") for m in (made, loaded))
    assert a.exceptAll(b).count() == 0 and b.count() == parts[2].count()
