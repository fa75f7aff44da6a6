"""The registered sequence query fits on the earliest events, whatever their ids."""

from pyspark.sql import functions as F

from eventwarden import constants as K
from eventwarden.catalog import queries


def test_fit_is_split_by_time(spark, small, monkeypatch):
    seen = {}
    fit = queries.fit_sequence

    def keep(train, *args, **named):
        seen["train"] = [(r.event_id, r.us) for r in train.select("event_id", "us").collect()]
        return fit(train, *args, iterations=1, **named)

    monkeypatch.setattr(queries, "fit_sequence", keep)
    scored = queries.all_queries()["sequence_scores"](spark, small)
    rows = [(r.event_id, r.us) for r in queries.scorer_events(spark, small).select("event_id", "us").collect()]
    rows.sort(key=lambda r: (r[1], r[0]))
    assert sorted(seen["train"]) == sorted(rows[:int(len(rows) * K.TRAIN_SHARE)])
    assert scored.where(F.col("seq_active")).count() > 0 and scored.count() == len(rows)
