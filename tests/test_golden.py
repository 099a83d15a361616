"""Expressions with their expected values, and outlines of node-sets."""

import pytest

from treeline.operators import output
from treeline.plans.xpath import XPath, parse
from treeline.sources import markup

# Expressions and their results as strings.
STRINGS = [
    ('string(5)', '5'), ('string(0.5)', '0.5'), ('string(-0.5)', '-0.5'), ('string(true())', 'true'), ('string(false())', 'false'),
    ('string(12345678901234567890)', '1.23456789012346e+19'), ('string(-12345678901234567890)', '-1.23456789012346e+19'),
    ('concat("titi","toto")', 'tititoto'), ('concat("titi","toto","tata")', 'tititototata'), ('concat("titi",\'toto\')', 'tititoto'),
    ('concat("titi",\'toto\',"tata","last")', 'tititototatalast'), ('starts-with("tititoto","titi")', 'true'),
    ('starts-with("tititoto","to")', 'false'), ('contains("tititototata","titi")', 'true'), ('contains("tititototata","toto")', 'true'),
    ('contains("tititototata","tata")', 'true'), ('contains("tititototata","tita")', 'false'), ('substring("12345",2,3)', '234'),
    ('substring("12345",2)', '2345'), ('substring("12345",-4)', '12345'), ('substring("12345",3.4)', '345'), ('substring("12345",3.6)', '45'),
    ('substring("12345",1.5,2.6)', '234'), ('substring("12345",2.2,2.2)', '23'), ('substring("12345",0,3)', '12'), ('substring("12345",-8,10)', '1'),
    ('substring("12345",4,-10)', ''), ('substring("12345",0 div 0, 3)', ''), ('substring("12345",1, 0 div 0)', ''),
    ('substring("12345",1 div 0, 3)', ''), ('substring("12345",3,-1 div 0)', ''), ('substring("12345",-42, 1 div 0)', '12345'),
    ('substring("12345",-1 div 0, 1 div 0)', ''), ('substring("12345",-1 div 0,5)', ''), ('substring("12345",-0.7,4)', '12'),
    ('substring("12345",-5000000000,5000000004)', '123'), ('substring-after("12345678","345")', '678'), ('substring-after("12345678","999")', ''),
    ('substring-before("12345678","345")', '12'), ('substring-before("12345678","999")', ''), ('string-length("")', '0'),
    ('string-length("titi")', '4'), ('normalize-space("  abc  def  ")', 'abc def'), ('normalize-space("  abc  def")', 'abc def'),
    ('normalize-space("abc  def  ")', 'abc def'), ('normalize-space(" abcdef   ")', 'abcdef'), ('normalize-space("   abcdef")', 'abcdef'),
    ('normalize-space("abcdef ")', 'abcdef'),
]
FLOATS = [
    ('1', '1'), ('123', '123'), ('1.23', '1.23'), ('0.123', '0.123'), ('4.', '4'), ('.4', '0.4'), ('1.23e3', '1230'), ('1.23e-3', '0.00123'),
    ('1 div 0', 'Infinity'), ('-1 div 0', '-Infinity'), ('0 div 0', 'NaN'), ('1 div -0', '-Infinity'), ('(1 div 0) > 0', 'true'),
    ('(1 div 0) < 0', 'false'), ('(-1 div 0) > 0', 'false'), ('(-1 div 0) < 0', 'true'), ('(0 div 0) > 0', 'false'), ('(0 div 0) < 0', 'false'),
    ('(1 div -0) > 0', 'false'), ('(1 div -0) < 0', 'true'), ('0 div 0 = 0 div 0', 'false'), ('0 div 0 != 0 div 0', 'true'),
    ('0 div 0 > 0 div 0', 'false'), ('0 div 0 < 0 div 0', 'false'), ('0 div 0 >= 0 div 0', 'false'), ('0 div 0 <= 0 div 0', 'false'),
    ('1 div 0 = -1 div 0', 'false'), ('1 div 0 != -1 div 0', 'true'), ('1 div 0 > -1 div 0', 'true'), ('1 div 0 < -1 div 0', 'false'),
    ('1 div 0 >= -1 div 0', 'true'), ('1 div 0 <= -1 div 0', 'false'), ('1 div 0 = 1 div 0', 'true'), ('1 div 0 != 1 div 0', 'false'),
    ('1 div 0 > 1 div 0', 'false'), ('1 div 0 < 1 div 0', 'false'), ('1 div 0 >= -1 div 0', 'true'), ('1 div 0 <= -1 div 0', 'false'),
    ('-2 div 0 = -1 div 0', 'true'), ('1 div floor(0.1)', 'Infinity'), ('1 div floor(-0.1)', '-1'), ('1 div floor(-0)', '-Infinity'),
    ('1 div floor(0)', 'Infinity'), ('1 div ceiling(0.1)', '1'), ('1 div ceiling(-0.1)', '-Infinity'), ('1 div ceiling(-0)', '-Infinity'),
    ('1 div ceiling(0)', 'Infinity'), ('1 div round(0.1)', 'Infinity'), ('1 div round(-0.1)', '-Infinity'), ('1 div round(-0)', '-Infinity'),
    ('1 div round(0)', 'Infinity'), ("1 div number('f')", 'NaN'), ("number('f') div 1", 'NaN'), ('1 div (1 div 0)', '0'),
    ('(1 div 0) div 1', 'Infinity'), ('-(1 div 0) div 1', '-Infinity'), ('5 mod 2', '1'), ('5 mod -2', '1'), ('-5 mod 2', '-1'), ('-5 mod -2', '-1'),
    ('8 mod 3 = 2', 'true'), ('12345678901234567890', '1.23456789012346e+19'), ('-12345678901234567890', '-1.23456789012346e+19'),
]
FUNCTIONS = [
    ('true()', 'true'), ('false()', 'false'), ('number("1.5")', '1.5'), ("number('abc')", 'NaN'), ("-number('abc')", 'NaN'), ("number('-')", 'NaN'),
    ('floor(0.1)', '0'), ('floor(-0.1)', '-1'), ('floor(-0)', '0'), ('floor(0)', '0'), ('floor(5.2)', '5'), ('floor(-5.2)', '-6'),
    ('floor(100000000000000000000)', '1e+20'), ('floor(-100000000000000000000)', '-1e+20'), ('floor(0 div 0)', 'NaN'), ('floor(1 div 0)', 'Infinity'),
    ('floor(-1 div 0)', '-Infinity'), ('ceiling(0.1)', '1'), ('ceiling(-0.1)', '0'), ('ceiling(-0)', '0'), ('ceiling(0)', '0'), ('ceiling(5.2)', '6'),
    ('ceiling(-5.2)', '-5'), ('ceiling(100000000000000000000)', '1e+20'), ('ceiling(-100000000000000000000)', '-1e+20'), ('ceiling(0 div 0)', 'NaN'),
    ('ceiling(1 div 0)', 'Infinity'), ('ceiling(-1 div 0)', '-Infinity'), ('round(0.1)', '0'), ('round(5.2)', '5'), ('round(5.5)', '6'),
    ('round(5.6)', '6'), ('round(-0.1)', '0'), ('round(-5.2)', '-5'), ('round(-5.5)', '-5'), ('round(-5.6)', '-6'), ('round(0.5)', '1'),
    ('round(-0.5)', '0'), ('round(100000000000000000000)', '1e+20'), ('round(-100000000000000000000)', '-1e+20'), ('round(0 div 0)', 'NaN'),
    ('round(1 div 0)', 'Infinity'), ('round(-1 div 0)', '-Infinity'),
]


@pytest.mark.parametrize("cases", [STRINGS, FLOATS, FUNCTIONS], ids=["strings", "floats", "functions"])
def test_expressions(spark, cases):
    n = markup.xml_nodes(spark.createDataFrame([(1, "<a/>")], "doc_id long, text string"))
    x = XPath(n)
    got = x.values([(parse(e), "string") for e, _ in cases], x.roots()).first()
    assert [(e, got[f"v{k}"]) for k, (e, _) in enumerate(cases)] == [(e, want) for e, want in cases]


CHAPTERS = """<EXAMPLE prop1="gnome is great" prop2="&amp; linux too"><head><title>Welcome to Gnome</title></head>
<chapter id="chapter1"><title>The Linux adventure</title><p>bla bla bla ...</p><image href="linus.gif"/><p>...</p></chapter><chapter id="chapter2"><title>Chapter 2</title><p>this is chapter 2 ...</p></chapter></EXAMPLE>"""


@pytest.mark.parametrize(("path", "want"), [
    ("/child::EXAMPLE", "Set contains 1 nodes:\n1  ELEMENT EXAMPLE\n    ATTRIBUTE prop1\n      TEXT\n        content=gnome is great\n    ATTRIBUTE prop2\n      TEXT\n        content=& linux too\n"),
    ("/child::EXAMPLE/child::head", "Set contains 1 nodes:\n1  ELEMENT head\n"), ("/child::EXAMPLE/child::head/child::title/child::text()", "Set contains 1 nodes:\n1  TEXT\n    content=Welcome to Gnome\n"),
    ("//chapter/@id", "Set contains 2 nodes:\n1  ATTRIBUTE id\n    TEXT\n      content=chapter1\n2  ATTRIBUTE id\n    TEXT\n      content=chapter2\n"), ("//p[2] | //chapter[2]/title", "Set contains 2 nodes:\n1  ELEMENT p\n2  ELEMENT title\n"),
])
def test_outlines(spark, path, want):
    n = markup.xml_nodes(spark.createDataFrame([(1, CHAPTERS)], "doc_id long, text string"))
    assert output.dump(XPath(n).select(path), n).first().dump == "Object is a Node Set :\n" + want


def test_scalars_are_printed(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(output.scalar_dump(F.lit(2.5), "number").alias("a"), output.scalar_dump(F.lit(True), "boolean").alias("b"), output.scalar_dump(F.lit("x"), "string").alias("c")).first()
    assert tuple(row) == ("Object is a number : 2.5", "Object is a Boolean : true", "Object is a string : x")
