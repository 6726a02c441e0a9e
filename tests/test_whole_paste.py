"""Pasted Office markup: a fixture for each rewrite of the reference, with the results read off it."""

from pyspark.sql import functions as F

from lectern.functions import html as H

REWRITES = [
    ("<![if !supportLists]>a", "a"), ("a<![endif]>", "a"), ("a<!--[if gte mso 9]>x\ny<![endif]-->b", "ab"), ("a<!--x-->b", "a<!--x-->b"), ("a<o:p></o:p>b", "ab"), ("a<o:p>&nbsp;</o:p>b", "ab"),
    ("<o:x>a</o:x>", "a"), ("<v:rect id='1'>a</v:rect>", "a"), ("<w:x/>a", "a"), ("<m:r>a</m:r>", "a"), ('<p class="MsoNormal">a</p>', "<p>a</p>"), ("a<span > </span>b", "ab"),
    ('<p style="font-family:Arial;color:red">a</p>', '<p style="color:red">a</p>'), ('<p style="color:red;font-size:12.0pt">a</p>', '<p style="color:red;">a</p>'), ('<p style="font-family:Arial;font-size: 9pt">a</p>', "<p>a</p>"),
    ('a<img alt=" x<y & z " class="my-equation">b<img alt="q" src="s" class="equation" />', 'a<span class="math-inline" data-latex="x&lt;y &amp; z">x&lt;y &amp; z</span>b<span class="math-inline" data-latex="q">q</span>'),
    ('<img alt=" " class="equation"> c', '<img alt=" " class="equation"> c'), ('<v:shape id="1">a</v:shape>', "a"), ("<p>&nbsp;</p><p></p>x", "<p>&nbsp;</p><p></p>x"), ("<p>&nbsp;</p> <p> </p><p></p>\n<p> </p>x", "<p>&nbsp;</p>x"),
    ('<b style="font-weight:normal">a</b><b>c</b>', "a<b>c</b>"), ("", ""), (None, None),
]


def test_rewrites(spark):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(REWRITES)], "i int, html string").select("i", H.word_html(F.col("html")).alias("out")).collect()
    assert [r.out for r in sorted(rows)] == [want for _, want in REWRITES]
