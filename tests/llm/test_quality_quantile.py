"""op6 keeps the documents above a quantile of the scores of the whole table."""

from eventwarden.llm.queries import llm_queries
from eventwarden.llm.samples import class_counts


def test_kept_share_of_all_documents(spark, small):
    folder = small.replace("0.001", "0.01")
    out = llm_queries()["op6_quality_classifier"](spark, folder)
    assert out.columns == ["doc_id", "held_out", "score", "predicted", "kept"]
    rows = out.collect()
    zeros, ones = class_counts(spark.read.parquet(f"{folder}/labels.parquet"), "quality", 5, 0)
    share = ones / (zeros + ones)
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    ordered = sorted(r.score for r in rows)
    limit = min(r.score for r in rows if r.kept)
    assert all(r.kept == (r.score >= limit) for r in rows)
    # The lowest kept score stands at the quantile; rows that tie with it are kept too.
    below = sum(s < limit for s in ordered) / len(rows)
    upto = sum(s <= limit for s in ordered) / len(rows)
    assert 0 < share < 1 and below - 2 / len(rows) <= 1 - share <= upto + 2 / len(rows)
