"""Pointers and fragments with odd rows; faults of node tables, each planted alone."""

import pytest

from treeline.operators import consistency, xpointer
from treeline.sources import markup

TEXT = "<r><a k='1' m='2'>t<b/><!-- c --></a><a><b>u</b></a></r>"


@pytest.fixture(scope="module")
def tree(spark):
    return markup.xml_nodes(spark.createDataFrame([(1, TEXT), (2, "<x/>")], "doc_id long, text string")).toPandas()


def faults(spark, rows):
    df = spark.createDataFrame([tuple(None if v != v else int(v) if isinstance(v, float) else v for v in r) for r in rows.astype(object).itertuples(index=False)], "doc_id long, pre long, end long, level int, parent long, kind string, ns string, prefix string, name string, value string, ord int, line int")
    return sorted((r.doc_id, r.pre, r.fault) for r in consistency.faults(df).collect())


def test_read_documents_have_no_fault(spark, tree):
    assert faults(spark, tree) == []
    assert faults(spark, tree.head(0)) == []


# Numbers: 0 document, 1 r, 2 a, 3 @k, 4 @m, 5 text, 6 b, 7 comment, 8 a, 9 b, 10 text.
@pytest.mark.parametrize(("pre", "column", "value", "want"), [
    (6, "end", 5, [(6, "no interval")]), (6, "end", None, [(6, "no interval")]), (5, "end", 6, [(5, "leaf with an interval"), (6, "overlaps its sibling")]), (6, "level", 9, [(6, "wrong level")]),
    (9, "end", 11, [(9, "outside its parent")]), (6, "name", None, [(6, "without a name")]), (4, "name", "k", [(4, "attribute twice")]), (7, "kind", "text", []), (6, "kind", "text", [(6, "text beside text")]),
    (10, "parent", 99, [(10, "no parent")]), (10, "parent", 7, [(10, "outside its parent"), (10, "parent holds nothing")]), (7, "kind", "attr", [(7, "attribute after a child"), (7, "without a name")]), (0, "level", 1, [(0, "wrong level"), (1, "wrong level")]),
])
def test_planted_faults(spark, tree, pre, column, value, want):
    broken = tree.astype(object)
    broken.loc[(broken.doc_id == 1) & (broken.pre == pre), column] = value
    assert [(p, f) for d, p, f in faults(spark, broken) if d == 1] == want


def test_numbers_twice(spark, tree):
    import pandas as pd

    assert [f for _, _, f in faults(spark, pd.concat([tree, tree[(tree.doc_id == 2) & (tree.pre == 1)]]))] == ["number twice", "number twice", "overlaps its sibling"]


def test_pointers_with_odd_rows(spark):
    rows = [(1, TEXT, "/1/2/1"), (2, None, "/1"), (3, "<r>", "/1"), (4, TEXT, None), (5, TEXT, "element(/1/0)"), (6, TEXT, "xpointer(/r/a[@k='1'])"), (7, "<é>ü<b>ß</b></é>", "/1/1"), (7, "<é>ü<b>ß</b></é>", "/1"), (8, "<a><b c='>'/><d>x</d ></a>", "/1/2"), (9, TEXT, "x(a^)b)element(/1/2)")]
    got = {(r.doc_id, r.value, r.n_found, r.part, r.error) for r in xpointer.resolve(spark.createDataFrame(rows, "doc_id long, text string, pointer string")).collect()}
    assert got == {
        (1, "u", 1, 0, None), (2, None, 0, None, "not well-formed"), (3, None, 0, None, "not well-formed"), (4, None, 0, None, "nothing found"), (5, None, 0, None, "nothing found"),
        (6, "t", 1, 0, None), (7, "ß", 1, 0, None), (7, "üß", 1, 0, None), (8, "x", 1, 0, None), (9, "u", 1, 1, None),
    }


def test_fragments_with_odd_rows(spark):
    rows = [(1, "<r xmlns='u'/>", "/1", "<a/>"), (2, "<r/>", "/1", None), (3, "<r/>", "/1", "t"), (4, "<r/>", "/2", "<a/>"), (5, None, "/1", "<a/>"), (6, "<r/>", "/1", "<a>")]
    got = sorted((r.doc_id, r.kind, r.ns, r.name, r.error) for r in xpointer.fragments(spark.createDataFrame(rows, "doc_id long, text string, pointer string, fragment string")).collect())
    assert got == [(1, "element", "u", "a", None), (3, "text", None, None, None), (4, None, None, None, "nothing found"), (5, None, None, None, "not well-formed"), (6, None, None, None, "fragment: mismatched tag")]
