"""The whole run over a collection, its exports and its searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stratapage.functions.dialect import Step
from stratapage.plans import block_queries as b
from stratapage.plans.materialize import materialize
from stratapage.plans.registry import group_rows, plan
from stratapage.plans.reports import export  # noqa: F401
from stratapage.operators import clustering, consolidate, sections
from stratapage.operators.embedding import TERMS, nearest

#: Named results of a run over documents, and of a run over pages.
DOCUMENT_TABLES = ("units", "doc_stats", "features", "decisions", "segmented", "content_units", "consolidation_decisions", "explained", "merged_blocks", "merged_fields", "parents", "section_rows")
PAGE_TABLES = ("html_units", "heads", "parents", "section_rows")


def run_documents(documents: DataFrame) -> dict[str, DataFrame]:
    """The structured path over documents (doc_id, text), each result written once."""
    return _run([*b.TO_MERGED, *consolidate.EXPLAIN, *consolidate.MERGED_FIELDS, *b.DOCUMENT_BLOCKS, *sections.HEADINGS, *sections.TREE], DOCUMENT_TABLES, documents=documents)


def run_collection(documents: DataFrame) -> dict[str, DataFrame]:
    """As run_documents over documents (doc_id, text, source), with the patterns and groups of each source's content units."""
    out = run_documents(documents)
    done = {k: out[k] for k in ("units", "segmented", "content_units")} | {"documents": documents}
    units = materialize(plan(b.TO_GROUPED, "SELECT * FROM grouped_units", **done))
    idf = materialize(plan(TERMS, "SELECT * FROM idf", units=out["units"]))
    patterned = materialize(units.join(clustering.by_size(materialize(clustering.leader_patterns(units, idf)), "pattern").drop("size"), ["collection", "ord"]))
    leaders = materialize(clustering.leader_groups(patterned, idf))
    numbered = clustering.by_size(leaders, "group_no").drop("size").join(leaders.select("collection", "ord", "likeness"), ["collection", "ord"])
    out["grouped"] = materialize(patterned.join(numbered, ["collection", "ord"]))
    out["patterns"] = clustering.pattern_evidence(patterned.withColumn("prominence", F.lit(0.0)))
    out["groups"] = group_rows(out["grouped"])
    return out


def run_pages(pages: DataFrame) -> dict[str, DataFrame]:
    """Units, headings and section tree of pages (page_id, html)."""
    return _run(sections.TO_SECTIONS, PAGE_TABLES, pages=pages)


def _run(steps: list[Step], names: tuple[str, ...], **frames: DataFrame) -> dict[str, DataFrame]:
    done = dict(frames)
    out = {}
    for name in names:
        # what is done already is read, not run again
        out[name] = done[name] = materialize(plan(steps, f"SELECT * FROM {name}", **done))
    return out


def search(units: DataFrame, query: str, k: int = 10, least: float = 0.0, document_id: str | None = None, pattern: int | None = None) -> DataFrame:
    """(document_id, ord, score) of the k units nearest to a query, by hashed embeddings with the units' own idf; ties in order. ``pattern`` needs a column of that name."""
    idf = materialize(plan(TERMS, "SELECT * FROM idf", units=units))
    if document_id is not None:
        units = units.where(F.col("document_id") == document_id)
    if pattern is not None:
        units = units.where(F.col("pattern") == pattern)
    found = nearest(units, query, idf).select("document_id", "ord", "score")
    return found.where(F.col("score") >= least).orderBy(F.desc("score"), "document_id", "ord").limit(k)


def blocks_in_group(tables: dict[str, DataFrame], collection: str, group_no: int) -> DataFrame:
    """The members of a group, in order."""
    return tables["grouped"].where((F.col("collection") == collection) & (F.col("group_no") == group_no)).orderBy("ord")


def blocks_in_section(tables: dict[str, DataFrame], document_id: str, section: int) -> DataFrame:
    """The blocks directly under a section."""
    return tables["parents"].where((F.col("document_id") == document_id) & (F.coalesce("section", F.lit(-1)) == section) & F.col("score").isNull()).orderBy("ord")


def sections_by_label(tables: dict[str, DataFrame], lexicon: dict[str, str], label: str) -> DataFrame:
    """The sections whose heading is nearest to a label of the lexicon, whatever its case."""
    found = clustering.labelled(tables["section_rows"].select("document_id", "section", "heading"), "heading", lexicon, sections.LABEL_LEAST)
    return found.where(F.lower("label") == label.lower())


def related_to(tables: dict[str, DataFrame], document_id: str, segment: int, other_documents_only: bool = True) -> DataFrame:
    """The other members of a content unit's group, of other documents only or of all."""
    grouped = tables["grouped"]
    own = grouped.where((F.col("document_id") == document_id) & (F.col("segment") == segment)).select("collection", "group_no").limit(1)
    rest = grouped.join(F.broadcast(own), ["collection", "group_no"])  # one row
    return rest.where(F.col("document_id") != document_id if other_documents_only else (F.col("document_id") != document_id) | (F.col("segment") != segment))


def trace(tables: dict[str, DataFrame], document_id: str, block_no: int) -> DataFrame:
    """A block with the content units and lines it came from."""
    block = tables["merged_blocks"].where((F.col("document_id") == document_id) & (F.col("block_no") == block_no))
    segments = block.select("document_id", "block_no", "block_id", "page", "text", F.explode(F.split("sources", ",")).alias("segment")).withColumn("segment", F.col("segment").cast("long"))
    lines = tables["segmented"].select("document_id", "segment", F.struct("ord", "page", F.col("text").alias("line"), "x0", "y0", "x1", "y1").alias("source"))
    return segments.join(lines, ["document_id", "segment"]).groupBy("document_id", "block_no", "block_id", "page", "text").agg(F.array_sort(F.collect_list("source")).alias("sources"))
