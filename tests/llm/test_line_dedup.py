"""Short lines: exact copies go at any length, near ones if the caller asks for no minimum; columns of any name stay."""

from callweave.llm import line_dedup


def test_short_copies(spark):
    docs = ["Read more\nA first text.", "x\n\nRead more \n \t \nRead more", "Read mare\nx\n\n \t \nPage 1", "Page 2\nPage 1\nnineteen characters", "nineteen characters\nNineteen characters", None]
    want = ["Read more\nA first text.", "x\n\n \t ", "Read mare\n\n \t \nPage 1", "Page 2\nnineteen characters", "Nineteen characters", None]
    removed = [0, 2, 1, 1, 1, 0]
    got = line_dedup.drop_repeated_lines(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), min_chars=20, counts=True)
    rows = {r.doc_id: r for r in got.collect()}
    assert [rows[i].text for i in range(len(docs))] == want
    assert [rows[i].n_removed for i in range(len(docs))] == removed


def test_near_short_lines(spark):
    docs = ["a\nPage 1\nab", "Page 2\nb\nabc\nxyz", "Page 11\nxz\nabcde", "b\n\u00e9\u00e8\n\u00e9", ""]
    want = ["a\nPage 1", "xyz", "abcde", "\u00e9\u00e8", ""]
    got = line_dedup.drop_repeated_lines(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"))
    assert [r.text for r in got.orderBy("doc_id").collect()] == want


def test_clashing_columns(spark):
    rows = [(1, "the same line\nfirst", 5, 6, 7, 8, "x"), (2, "the same line\nother", 15, 16, 17, 18, "y")]
    table = spark.createDataFrame(rows, "doc_id long, text string, __doc int, __VERSION int, __dropped int, doc int, pos string")
    got = line_dedup.drop_repeated_lines(table).orderBy("doc_id")
    assert got.columns == table.columns
    assert [tuple(r) for r in got.collect()] == [rows[0], (2, "other", 15, 16, 17, 18, "y")]
