from lectern.llm.linededup import dedup_lines


def _brute(docs):
    first, spots = {}, []
    for i, text in sorted(docs, key=lambda d: d[0]):
        if text is None:
            continue
        at = [k for k, x in enumerate(text.split("\n")) if x.strip(" \t\r\x0b\x0c")]
        lines = [text.split("\n")[k].strip(" \t\r\x0b\x0c") for k in at]
        for k in range(len(lines) - 2):
            spots.append((tuple(lines[k : k + 3]), i, k, at[k : k + 3]))
    for w, i, k, _ in spots:
        first.setdefault(w, (i, k))
    gone = {(i, a) for w, i, k, at in spots if first[w] != (i, k) for a in at}
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in docs}


def test_against_brute_force(spark):
    docs = [
        (1, "a\nb\nc\nd"), (2, "x\n a\n\nb \nc\ny"), (3, "b\nc\nd\ne"), (4, "r\nr\nr\nr\nr"), (5, None), (6, ""), (7, "\n\n\n"), (8, "a\nb"), (9, "a\nb\nc\nd"),
        (10, "\n".join(f"line {k % 50}" for k in range(5000))), (11, "one line " * 5000),
    ]
    found = dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.text for r in found} == _brute(docs)
    by = {r.doc_id: r for r in found}
    assert (by[1].n_removed, by[4].n_removed, by[5].n_lines, by[6].n_lines) == (0, 4, 0, 1)


def test_a_shared_passage_goes_whole_from_a_group_of_copies(spark):
    """Windows over the edges of the passage are first occurrences in the first copy; the passage goes all the same."""
    passage = ["p1 x", "p2 x", "p3 x", "p4 x"]
    copy = "\n".join(["a b", "c d", *passage, "e f", "g h"])
    docs = [(1, "\n".join(["z z", *passage, "y y"])), *((k, copy) for k in range(2, 6))]
    found = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(2)).collect()}
    assert found == _brute(docs)
    assert found[1] == docs[0][1] and found[2] == "a b\nc d\ne f\ng h" and {found[k] for k in (3, 4, 5)} == {""}
    lines = {x for _, t in docs for x in t.split("\n")}
    assert lines == {x for t in found.values() for x in t.split("\n")} - {""}


def test_repeated_rows_empty_table_and_clashing_columns(spark):
    rows = [(1, "a\nb\nc", 5), (1, "a\nb\nc", 6), (None, "q\na\nb\nc", 7)]
    found = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, n_removed int")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in found) == [(0, "q\na\nb\nc"), (1, ""), (1, "")]
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
