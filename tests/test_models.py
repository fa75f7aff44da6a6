import numpy as np
import pytest
from pyspark.sql import functions as F

from eventwarden import constants as K
from eventwarden.adapter import scorer_events
from eventwarden.models import registry
from eventwarden.models.drift import auc, psi, replace_decision
from eventwarden.models.forest import expected_path, fit_forest, load_forest, raw_score
from eventwarden.models.sequence import label_join, sequence_windows
from eventwarden.operators.dedup import throttle
from eventwarden.operators.ordered import SlicePolicy
from eventwarden.plans.features import feature_matrix
from eventwarden.plans.scoring import current_forest, score_events, retrain_forest, select_alerts, train_forest
from eventwarden.session import cut_lineage


def test_expected_path():
    assert expected_path(1) == 0.0 and expected_path(2) == 1.0
    assert expected_path(256) == pytest.approx(10.244770920116851)


@pytest.mark.parametrize("rows", [200, 20_000])
def test_planted_outliers_score_lowest(spark, rows):
    rng = np.random.RandomState(1)
    data = [(i, *map(float, rng.normal(size=3))) for i in range(rows)]
    data += [(rows + i, 9.0 + i, -9.0, 9.0) for i in range(5)]
    df = spark.createDataFrame(data, "event_id bigint, a double, b double, c double")
    table = fit_forest(df, columns=("a", "b", "c"), trees=50, sample=128).persist()
    again = fit_forest(df, columns=("a", "b", "c"), trees=50, sample=128)
    assert table.orderBy("tree").collect() == again.orderBy("tree").collect()
    forest = load_forest(table)
    scored = df.select("event_id", raw_score(spark, forest, ("a", "b", "c")).alias("s"))
    lowest = {r.event_id for r in scored.orderBy("s").limit(5).collect()}
    assert lowest == {rows + i for i in range(5)}
    low, high = scored.agg(F.min("s"), F.max("s")).first()
    assert -1 < low < high < 0


def test_every_tree_uses_distinct_rows(spark):
    from eventwarden.models.forest import _walks

    for pool in (50, 97, 1000, 51_200):
        for _, stride, start in _walks(20, pool, 3):
            taken = {(stride * i + start) % pool for i in range(min(256, pool))}
            assert len(taken) == min(256, pool)


def _psi(old, new):
    edges = np.linspace(0, 1, 11)

    def share(values):
        part = np.histogram(values, bins=edges)[0] / len(values)
        return np.where(part == 0, 1e-4, part)
    e, a = share(old), share(new)
    return float(((a - e) * np.log(a / e)).sum())


def test_psi_with_values_outside(spark):
    rng = np.random.RandomState(3)
    old, new = rng.normal(0.4, 0.2, 500), rng.normal(0.6, 0.3, 500)
    old[0], new[0] = 1.0, 0.0
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(old, new)], "o double, n double")
    assert psi(df, "o", "n").first()["psi"] == pytest.approx(_psi(old, new))
    found = replace_decision(df, "o", "n").first()
    assert found.psi_alert and found.decision == "replaced with drift"


def test_replace_decision_stops_a_blown_rate(spark):
    df = spark.createDataFrame([(0.05, 0.05)] * 997 + [(0.9, 0.9)] + [(0.49, 0.51)] * 3, "o double, n double")
    assert replace_decision(df, "o", "n").first().decision == "aborted"
    assert replace_decision(df, "o", "n", force=True).first().decision == "replaced"


def test_auc_with_ties(spark):
    rng = np.random.RandomState(4)
    rows = [(float(rng.randint(0, 6)), int(rng.randint(0, 2))) for _ in range(300)]
    df = spark.createDataFrame(rows, "s double, t int")
    pos = [s for s, t in rows if t == 1]
    neg = [s for s, t in rows if t == 0]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert auc(df, "s", "t", SlicePolicy(target_rows=2)).first()["auc"] == pytest.approx(want)


@pytest.mark.parametrize("count,span", [(1, 10), (400, 2000), (3000, 3000), (500, 10 ** 6)])
def test_throttle_equals_greedy(spark, count, span):
    rng = np.random.RandomState(count)
    times = sorted(int(t) for t in rng.randint(0, span, size=count))
    rows = [(i, K.NOISY_CLASSES[i % 2], t) for i, t in enumerate(times)] + [(10 ** 6, "other", 5), (10 ** 6 + 1, "other", 5)]
    df = spark.createDataFrame(rows, "event_id bigint, classification string, us bigint")
    found = throttle(df, gap_us=30, policy=SlicePolicy(target_rows=40)).collect()
    want = []
    last: dict = {}
    for _, cls, t in rows[:-2]:
        if cls not in last or t - last[cls] >= 30:
            want.append((cls, t))
            last[cls] = t
    want += [("other", 5)] * 2
    assert sorted((r.classification, r.us) for r in found) == sorted(want)


def test_label_join_last_wins(spark):
    events = spark.sql("SELECT 1 AS event_id, 'a' AS user, timestamp'2024-01-01 00:00:00.9' AS ts UNION ALL "
                       "SELECT 2, 'a', timestamp'2024-01-01 00:00:01' UNION ALL SELECT 3, 'b', timestamp'2024-01-01 00:00:00'")
    labels = spark.sql("SELECT 'a' AS user, timestamp'2024-01-01 00:00:00' AS ts, 'normal' AS label, 1 AS seq UNION ALL "
                       "SELECT 'a', timestamp'2024-01-01 00:00:00.5', 'anomaly', 2 UNION ALL "
                       "SELECT 'b', timestamp'2024-01-01 00:00:00', 'real_unknown', 3")
    assert [(r.event_id, r.label) for r in label_join(events, labels).collect()] == [(1, "anomaly")]


def test_train_score_retrain(spark, small, tmp_path):
    folder = str(tmp_path)
    matrix = cut_lineage(feature_matrix(scorer_events(spark, small)))
    assert current_forest(spark, folder) is None
    first = train_forest(matrix, folder, trees=30)
    assert first["status"] == "replaced" and first["min"] <= first["p90"] <= first["max"]
    second = retrain_forest(matrix, folder, trees=30, seed=9)
    assert "psi" in second
    model = current_forest(spark, folder)
    assert model.version == second["version"]
    scored = score_events(matrix, model)
    assert scored.count() == matrix.count()
    assert scored.where("seq_active").count() == 0
    assert select_alerts(scored, 0.0).where("alert_record IS NULL OR alert_text IS NULL").count() == 0
    assert registry.report(spark, folder).count() == 1
    with pytest.raises(ValueError):
        registry.check_features(registry.latest(spark, folder, "forest"), ["other"])
    assert train_forest(matrix.limit(20), folder)["status"] == "skipped"
    assert retrain_forest(matrix.limit(100), folder)["status"] == "skipped"
