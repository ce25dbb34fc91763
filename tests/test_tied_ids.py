"""Ids of turns that meet are told apart by their conversation."""

from quillmill.plans import sample_queries


def test_mispaired_rows_of_tied_ids_follow_conversations(spark, tmp_path):
    rows = [(2, 1, "user", "second"), (1, 101, "user", "first")]  # both have the id 201
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sample_queries.mispaired_rows(spark, str(tmp_path)).collect()
    want = {(201, True, "first", "second"), (201, True, "second", "first"), (201, False, "first", "second"), (201, False, "second", "first")}
    assert len(got) == 4 and {tuple(r) for r in got} == want
    pairs = sample_queries.labelled(spark, str(tmp_path)).collect()
    assert {(r.id.id, r.id.conv_id) for r in pairs} == {(201, 1), (201, 2)}
