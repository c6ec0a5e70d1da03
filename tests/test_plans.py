"""Queries over rows of their own."""

from draftlens.plans import load


def test_exports_give_a_row_for_each_turn(spark, tmp_path):
    rows = [(7, 0, "user", "ab"), (7, 1, "assistant", None), (7, 2, "user", "c"), (8, 5, "user", "d")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = load().QUERIES["src_story_json"](spark, str(tmp_path)).orderBy("game_pid", "turn").collect()
    assert [(r.game_pid, r.turn, r.scenes, r.last_text, r.all_scenes, r.end_text, r.chars) for r in got] == [
        ("c7", 0, 0, "", 3, "c", 3), ("c7", 1, 1, "ab", 3, "c", 3), ("c7", 2, 2, "", 3, "c", 3), ("c8", 5, 0, "", 1, "d", 1)]


def test_units_are_cut_one_at_a_time(spark, tmp_path):
    spark.createDataFrame([(1, "Oh no. He ran."), (2, None), (3, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = load().QUERIES["chunk_units"](spark, str(tmp_path))
    assert "posexplode" in df._jdf.queryExecution().toString()
    assert [r.chunk for r in df.where("unit = 'words'").orderBy("pos").collect()] == ["Oh", "no", ".", "He", "ran", "."]
    assert {(r.doc_id, r.unit) for r in df.where("doc_id <> 1").collect()} >= {(3, "sentences")}
