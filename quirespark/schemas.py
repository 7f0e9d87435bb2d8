"""The tables that parsers fill and operators read."""

from pyspark.sql import types as T

SPAN = T.StructType([T.StructField("text", T.StringType()), T.StructField("font", T.StringType()), T.StructField("size", T.DoubleType()), T.StructField("flags", T.IntegerType())])
LINES = T.ArrayType(T.StructType([T.StructField("spans", T.ArrayType(SPAN))]))
BBOX = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "x1", "y1")])


KINDS = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "binary": T.BinaryType()}


def table(columns: str) -> T.StructType:
    """A schema from ``name kind, name kind``; needs no session, so that workers can import it."""
    return T.StructType([T.StructField(name, KINDS[kind]) for name, kind in (c.split() for c in columns.split(","))])


DOCS = table("doc_id string, path string, ext string, mime string, stem string, content binary")
PAGES = table("doc_id string, page_no int, width double, height double")
BLOCKS = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("page_no", T.IntegerType()), T.StructField("block_no", T.IntegerType()), T.StructField("type", T.IntegerType()), T.StructField("bbox", BBOX), T.StructField("lines", LINES)])
REGIONS = table("doc_id string, page_no int, seq int, label string, confidence double, x0 int, y0 int, x1 int, y1 int")
ITEMS = table("doc_id string, page_no int, item_no int, kind string, x0 double, y0 double, x1 double, y1 double, width double, text string")
ASSETS = table("doc_id string, rel_path string, mime string, content binary")
PROGRESS = table("run_id string, seq bigint, stage string, current int, total int, message string")
MARKDOWN = table("doc_id string, markdown string, title string, error string")
