"""Queries must see the whole of their input."""

from weftline.plans import catalog, relations


def test_granularity_takes_all_turns(spark, tmp_path):
    """The only words in common stand in the fifth and sixth turn."""
    spark.createDataFrame([(1, "Alpha engine overview.\nZebra quantum lattice.")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    turns = [(1, i, ("user", "assistant")[i % 2], "hello friend" if i < 4 else "zebra quantum lattice") for i in range(6)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    best = catalog.placement_granularity(spark, str(tmp_path)).where("rank = 1").collect()[0]
    assert best["candidate_id"].split("-")[0] == "1" and best["score"] > 0


def test_markdown_keeps_whole_lines(spark, tmp_path):
    """Headings and table rows aren't cut."""
    spark.createDataFrame([(11, "h" * 50 + "\nx\n" + "t" * 50)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    text = relations.md_text(spark, str(tmp_path)).collect()[0]["text"].split("\n")
    assert text[0] == "###### " + "h" * 50 and text[2] == "| " + "t" * 50 + " |"
