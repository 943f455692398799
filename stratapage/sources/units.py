"""Sources of units: text lines, HTML pages, rows of any table, and PDF behind an optional reader."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratapage.functions.dialect import run
from stratapage.operators import sections, structured


def lines(documents: DataFrame) -> DataFrame:
    """Units of documents (doc_id, text): one for each line that isn't blank."""
    return run([*structured.LINES, ("result", "SELECT * FROM units")], documents=documents)


def html(pages: DataFrame) -> DataFrame:
    """Units of pages (page_id, html): one for each block element with text."""
    return run([*sections.HTML, ("result", "SELECT * FROM html_units")], pages=pages)


def rows_as_grid(table: DataFrame, name: str, order: str, columns: Sequence[str]) -> DataFrame:
    """(grid_id, ord, cells): each row of a table as a grid row of the given columns' texts."""
    cells = F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    return table.select(F.lit(name).alias("grid_id"), F.col(order).cast("long").alias("ord"), cells.alias("cells"))


def expand(spark: SparkSession, patterns: Sequence[str], suffix: str = ".pdf") -> list[str]:
    """The files that paths and globs name, in order, each once; only names with the suffix, in any case."""
    out: set[str] = set()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for pattern in patterns:
        path = hadoop(pattern)
        for status in path.getFileSystem(conf).globStatus(path) or []:
            name = status.getPath().toString()
            if name.lower().endswith(suffix):
                out.add(name)
    return sorted(out)


def first_pages(units: DataFrame, pages: int | None, zero_is_all: bool) -> DataFrame:
    """units of the first pages; None is all of them. 0 is all where zero_is_all (structured path), else none (native path, which takes less than 0 as 0)."""
    if pages is None or (zero_is_all and pages == 0):
        return units
    return units.where(F.col("page") <= max(0, pages))


def page_table(units: DataFrame) -> DataFrame:
    """(document_id, page, width, height, raw_units, grids, heading_like) of every page from 1 to a document's last one, zeros for pages without units; a page without a size has the document's first, or 612 by 792."""
    first = units.where("pw IS NOT NULL AND ph IS NOT NULL").groupBy("document_id").agg(F.min_by("pw", F.struct("page", "ord")).alias("first_width"), F.min_by("ph", F.struct("page", "ord")).alias("first_height"))
    all_pages = units.groupBy("document_id").agg(F.max("page").cast("int").alias("n")).select("document_id", F.explode(F.sequence(F.lit(1), "n")).alias("page")).withColumn("page", F.col("page").cast("long"))
    counts = units.groupBy("document_id", "page").agg(
        F.max("pw").alias("width"), F.max("ph").alias("height"), F.count(F.lit(1)).alias("raw_units"), F.countDistinct("grid_id").alias("grids"), F.count_if(F.col("layout").isin("section-header", "page-header")).alias("heading_like"))
    joined = all_pages.join(first, "document_id", "left").join(counts, ["document_id", "page"], "left")
    sizes = [F.coalesce(c, f"first_{c}", F.lit(d)).alias(c) for c, d in (("width", 612.0), ("height", 792.0))]
    return joined.select("document_id", "page", *sizes, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("raw_units", "grids", "heading_like")))


#: What a reader says of a page besides its boxes; a part that it can't read is empty.
PAGE_DETAILS = "document_id string, page long, rotation int, links array<string>, images int, metadata map<string,string>"


def pdf(spark: SparkSession, path: str | Sequence[str], extract: Callable[[bytes], Iterator[dict]], schema: str, pages: int | None = None, zero_is_all: bool = True) -> DataFrame:
    """Units of the PDF files under paths or globs, by a reader that yields a row for each box.

    No PDF library is needed here: the reader is the caller's, run where the
    file is read. A file that it fails on gives the rows that came before.
    """
    import pandas as pd

    columns = [c.strip().split()[0] for c in schema.split(", ")]

    def boxes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, content in zip(frame["path"], frame["content"], strict=True):
                rows: list[dict] = []
                try:
                    for row in extract(bytes(content)):
                        rows.append({"document_id": file.rsplit("/", 1)[-1], **row})
                except Exception as error:  # a reader's own errors, whatever they are
                    print(f"{file}: {error}")
                yield pd.DataFrame(rows, columns=columns)

    paths = [path] if isinstance(path, str) else list(path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(paths).select("path", "content")
    return first_pages(files.mapInPandas(boxes, schema), pages, zero_is_all)
