"""Files and pages as tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One cell, table and page of an extraction, whatever tool made it.
CELL = "struct<row_index:int,column_index:int,text:string,confidence:double,row_span:int,column_span:int>"
CLASSIC = (
    "text string, pages array<struct<pageNumber:int,tables:array<struct<"
    "headerRows:array<struct<cells:array<struct<layout:struct<confidence:double,textAnchor:struct<textSegments:array<struct<startIndex:string,endIndex:string>>>>,rowSpan:int,colSpan:int>>>>,"
    "bodyRows:array<struct<cells:array<struct<layout:struct<confidence:double,textAnchor:struct<textSegments:array<struct<startIndex:string,endIndex:string>>>>,rowSpan:int,colSpan:int>>>>>>>>"
)


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, size, sha256 and content of binary files; the hash is their identity."""
    held = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return held.select("path", "length", F.sha2("content", 256).alias("sha256"), "content")


def page_range(pages: DataFrame, page: str, text: str, first: int | None = None, last: int | None = None, limit: int | None = None) -> DataFrame:
    """Pages of a range, with whether they have digital text (over 20 characters)."""
    held = pages
    if first is not None:
        held = held.filter(F.col(page) >= first)
    if last is not None:
        held = held.filter(F.col(page) <= last)
    held = held.withColumn("has_digital_text", F.length(F.trim(F.coalesce(text, F.lit("")))) > 20)
    return held.orderBy(page).limit(limit) if limit is not None else held


def extraction_kind(raw: str) -> F.Column:
    """classic (text anchors), layout (nested blocks) or unknown."""
    return F.when(F.get_json_object(raw, "$.documentLayout.blocks").isNotNull(), "layout").when(F.get_json_object(raw, "$.pages").isNotNull(), "classic").otherwise("unknown")


def classic_cells(raw: DataFrame, key: str, body: str) -> DataFrame:
    """Cells of classic extractions: text by its anchors into the document's text."""
    doc = raw.filter(extraction_kind(body) == "classic").select(key, F.from_json(body, CLASSIC).alias("d"))
    page = doc.select(key, F.col("d.text").alias("text"), F.explode("d.pages").alias("p"))
    table = page.select(key, "text", F.col("p.pageNumber").alias("page_number"), F.posexplode("p.tables").alias("table_index", "t"))
    rows = F.concat(F.coalesce("t.headerRows", F.expr("slice(t.bodyRows, 1, 0)")), F.coalesce("t.bodyRows", F.expr("slice(t.headerRows, 1, 0)")))
    row = table.select(key, "text", "page_number", "table_index", F.posexplode(rows).alias("row_index", "r"))
    cell = row.select(key, "text", "page_number", "table_index", "row_index", F.posexplode("r.cells").alias("column_index", "c"))
    parts = F.transform(
        "c.layout.textAnchor.textSegments",
        lambda s: F.substr(F.col("text"), F.coalesce(s["startIndex"].cast("int"), F.lit(0)) + 1, s["endIndex"].cast("int") - F.coalesce(s["startIndex"].cast("int"), F.lit(0))),
    )
    return cell.select(key, "page_number", "table_index", "row_index", "column_index", F.trim(F.array_join(parts, "")).alias("text"), F.col("c.layout.confidence").alias("confidence"))


#: Levels of nested blocks that are read at once; deeper ones come as JSON and are read in the next round.
DEPTH = 6


def _block_type(depth: int) -> str:
    inner = f"array<{_block_type(depth - 1)}>" if depth else "array<string>"
    return f"struct<textBlock:struct<text:string,type:string,blocks:{inner}>,tableBlock:struct<bodyRows:array<struct<cells:array<struct<blocks:array<struct<textBlock:struct<text:string>>>>>>>>,pageSpan:struct<pageStart:int,pageEnd:int>>"


def layout_blocks(raw: DataFrame, key: str, body: str) -> DataFrame:
    """(key, path, page_number, kind, text) of all text blocks, nested ones after their parents."""
    schema = f"documentLayout struct<blocks:array<{_block_type(DEPTH)}>>"
    doc = raw.filter(extraction_kind(body) == "layout").select(key, F.from_json(body, schema).alias("d"))
    level = doc.select(key, F.posexplode("d.documentLayout.blocks").alias("i", "b")).select(key, F.format_string("%04d", "i").alias("path"), F.col("b.pageSpan.pageStart").alias("page_number"), "b")
    out = None
    while True:
        for depth in range(DEPTH, -1, -1):
            found = level.filter("b.textBlock is not null").select(key, "path", "page_number", F.col("b.textBlock.type").alias("kind"), F.col("b.textBlock.text").alias("text"))
            out = found if out is None else out.unionByName(found)
            inner = level.select(key, "path", "page_number", F.posexplode("b.textBlock.blocks").alias("i", "b"))
            path = F.concat("path", F.lit("."), F.format_string("%04d", "i")).alias("path")
            if not depth:
                break
            level = inner.select(key, path, F.coalesce("b.pageSpan.pageStart", "page_number").alias("page_number"), "b")
        if not inner.agg(F.count("i")).first()[0]:
            return out
        level = inner.select(key, path, "page_number", F.from_json("b", _block_type(DEPTH)).alias("b"))
        level = level.select(key, "path", F.coalesce("b.pageSpan.pageStart", "page_number").alias("page_number"), "b")


def layout_cells(raw: DataFrame, key: str, body: str) -> DataFrame:
    """Cells of the tables among the outer blocks."""
    schema = f"documentLayout struct<blocks:array<{_block_type(DEPTH)}>>"
    doc = raw.filter(extraction_kind(body) == "layout").select(key, F.from_json(body, schema).alias("d"))
    table = doc.select(key, F.posexplode("d.documentLayout.blocks").alias("table_index", "b")).filter("b.tableBlock is not null")
    row = table.select(key, F.col("b.pageSpan.pageStart").alias("page_number"), "table_index", F.posexplode("b.tableBlock.bodyRows").alias("row_index", "r"))
    cell = row.select(key, "page_number", "table_index", "row_index", F.posexplode("r.cells").alias("column_index", "c"))
    return cell.select(key, "page_number", "table_index", "row_index", "column_index", F.trim(F.array_join(F.transform("c.blocks", lambda x: x["textBlock"]["text"]), " ")).alias("text"), F.lit(None).cast("double").alias("confidence"))


def adapt_extractions(raw: DataFrame, key: str, body: str) -> DataFrame:
    """Cells of either kind of extraction, with one schema."""
    return classic_cells(raw, key, body).unionByName(layout_cells(raw, key, body))


HTML_BLOCKS = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("block", T.IntegerType()), T.StructField("tag", T.StringType()), T.StructField("text", T.StringType())])


def html_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, block, tag, text) of the blocks that a page shows; scripts and styles are left out."""
    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from html.parser import HTMLParser

        shown = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "pre", "blockquote", "title", "div", "article", "section"}

        class Blocks(HTMLParser):
            def __init__(self):
                super().__init__(convert_charrefs=True)
                self.hidden, self.tags, self.parts, self.found = 0, ["body"], [], []

            def cut(self):
                text = " ".join("".join(self.parts).split())
                if text:
                    self.found.append((self.tags[-1], text))
                self.parts = []

            def handle_starttag(self, tag, attrs):
                if tag in ("script", "style", "noscript"):
                    self.hidden += 1
                elif tag in shown:
                    self.cut()
                    self.tags.append(tag)
                elif tag == "br":
                    self.parts.append(" ")

            def handle_endtag(self, tag):
                if tag in ("script", "style", "noscript"):
                    self.hidden = max(0, self.hidden - 1)
                elif tag in shown:
                    self.cut()
                    if len(self.tags) > 1:
                        self.tags.pop()

            def handle_data(self, data):
                if not self.hidden:
                    self.parts.append(data)

        for frame in frames:
            rows = []
            for page, body in zip(frame["page_id"], frame["html"]):
                parser = Blocks()
                parser.feed(body or "")
                parser.close()
                parser.cut()
                rows += [(page, i, tag, text) for i, (tag, text) in enumerate(parser.found)]
            yield pd.DataFrame(rows, columns=HTML_BLOCKS.names)

    return pages.select(F.col(key).cast("long").alias("page_id"), F.col(html).alias("html")).mapInPandas(run, HTML_BLOCKS)
