from thicket.sources.html import parse_html
from thicket.sources.xml import parse_xml


def xml(spark, *texts, options=None):
    return parse_xml(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), options=options)


def html(spark, *texts):
    return parse_html(spark.createDataFrame(list(enumerate(texts)), "page_id long, html string"))


def pres(df):
    return sorted((r.doc_id, r.pre) for r in df.select("doc_id", "pre").collect())
