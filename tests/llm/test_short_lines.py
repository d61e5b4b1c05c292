"""Lines too short for the edit join."""

from offerloom.llm import line_dedup


def test_copies_of_short_lines_go(spark):
    long_ = "a line that is long enough to be compared"
    rows = [(1, "All rights reserved.\n\nown"), (2, f"漢字漢字\n{long_}"), (3, f"漢字漢字\n\nAll rights reserved.\n{long_}s\nAll rights reserved!\nown")]
    got = {r.doc_id: r for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), short=True).collect()}
    assert [got[i].text for i in (1, 2)] == [t for _, t in rows[:2]] and got[3].text == "\nAll rights reserved!"
    assert [tuple(x) for x in got[3].removed] == [(0, 2, 0), (2, 1, 0), (3, 2, 1), (5, 1, 2)]
    assert got[3].n_removed == 4 and not got[1].removed
