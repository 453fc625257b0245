"""Copies of a document and the lines of a site."""

from cellweave.llm.line_dedup import without_boilerplate

from cases import documents


def test_copies_keep_their_text(spark):
    story = "the first line of the story\nand its second line"
    rows = [(k, f"menu\nown text {k}", "a") for k in range(50)] + [(100 + k, "menu\n" + story, "a") for k in range(25)] + [(200 + k, None, "a") for k in range(40)]
    got = {r.doc_id: r.kept_text for r in without_boilerplate(documents(spark, rows)).collect()}
    assert all(got[100 + k] == story for k in range(25))
    assert all(got[k] == f"own text {k}" for k in range(50))


def test_share_is_of_different_texts(spark):
    # 3 of 52 different texts hold the line, of 1,049 rows in all
    rows = [(k, "copied page", None) for k in range(1000)] + [(2000 + k, f"page {k}" + ("\nshared line" if k < 11 else ""), None) for k in range(51)]
    got = {r.doc_id: r.n_dropped for r in without_boilerplate(documents(spark, rows), ratio=0.2).collect()}
    assert {k for k, n in got.items() if n} == {2000 + k for k in range(11)}
