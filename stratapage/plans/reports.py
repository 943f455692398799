"""Reports and exports of a run: nested trees, outlines, logs and event streams, each a table written by Spark."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType

from stratapage import audit

#: Confidence below which an event has a companion that says so.
LOW = 0.5
PREVIEW = 80

Tables = dict[str, DataFrame]


def preview(text: Column) -> Column:
    """The first letters of a text on one line."""
    return F.substring(F.regexp_replace(text, r"\n", " "), 1, PREVIEW)


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """df with its numbers rounded for reading."""
    return df.select(*(F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name) for f in df.schema))


def _event(df: DataFrame, name: str, ids: Column, decision: str | Column, confidence: Column | None = None, reason: Column | None = None) -> DataFrame:
    return df.select(
        F.lit(name).alias("event"), "document_id", F.array(ids.cast("string")).alias("ids"), (F.lit(decision) if isinstance(decision, str) else decision).alias("decision"),
        (F.lit(None).cast("double") if confidence is None else confidence.cast("double")).alias("confidence"), (F.lit(None).cast("string") if reason is None else reason).alias("reason"),
    )


def events(tables: Tables, low: float = LOW) -> DataFrame:
    """(event, document_id, ids, decision, confidence, reason) of what a run decided; each of low confidence has a low_confidence_decision besides."""
    c, out = F.col, []
    if "features" in tables:
        out.append(_event(tables["features"], "candidate_unit_created", c("ord"), "CANDIDATE", F.least(F.lit(1.0), 0.6 + 0.2 * F.least(F.lit(1.0), c("chars") / 60.0) + 0.2 * F.least(F.lit(1.0), c("n_cells") / 3.0)), c("shape")))
        out.append(_event(tables["features"].where("furniture"), "content_unit_rejected", c("ord"), "REJECT", None, F.lit("recurs at one height of many pages")))
    if "decisions" in tables:
        out.append(_event(tables["decisions"], "boundary_evaluated", c("ord"), F.when(c("split"), "split").otherwise("group"), c("confidence"), F.nullif(c("force"), F.lit(""))))
        form = (c("spatial") + c("alignment") + c("typography") + c("spacing") + c("structural") + c("container")) / 6
        out.append(_event(tables["decisions"].where((form >= 0.75) & (c("semantic") < 0.25)), "over_grouping_warning", c("ord"), "WARN", None, F.lit("form alike, meaning not")))
        same = tables["decisions"].where("grid_id IS NOT NULL AND a_grid_id = grid_id")
        out.append(_event(same, "record_boundary_evaluated", c("ord"), F.when(c("split"), "START_NEW_RECORD").otherwise("CONTINUE_RECORD"), c("confidence")))
    if "content_units" in tables:
        out.append(_event(tables["content_units"], "content_unit_refined", c("segment"), F.when(c("n_blocks") == 1, "PRESERVE").otherwise("MERGE"), c("confidence")))
    if "consolidation_decisions" in tables:
        out.append(_event(tables["consolidation_decisions"], "logical_block_continuation_evaluated", c("seq"), F.when(c("merge"), "MERGE").otherwise("KEEP_SEPARATE"), c("confidence"), c("veto")))
    if "merged_blocks" in tables:
        out.append(_event(tables["merged_blocks"], "logical_block_created", c("block_id"), "CREATE", c("confidence")))
        out.append(_event(tables["merged_blocks"].where("n_sources > 1"), "logical_block_merged", c("block_id"), "MERGE", c("confidence"), c("sources")))
    if "section_rows" in tables:
        out.append(_event(tables["section_rows"], "section_group_created", c("section"), "CREATE", c("confidence"), c("heading")))
    if "patterns" in tables:
        out.append(_event(tables["patterns"].withColumnRenamed("collection", "document_id"), "pattern_discovered", c("pattern"), "CREATE", c("purity"), c("signature")))
    if "groups" in tables:
        out.append(_event(tables["groups"].withColumnRenamed("collection", "document_id"), "logical_group_created", c("group_no"), "CREATE", c("likeness")))
    all_ = out[0]
    for df in out[1:]:
        all_ = all_.unionByName(df)
    doubted = all_.where(F.col("confidence") < low)
    return all_.unionByName(doubted.withColumn("reason", F.concat(F.lit("low confidence of "), "event")).withColumn("event", F.lit("low_confidence_decision")))


def section_tree(tables: Tables) -> DataFrame:
    """A row for each section: heading, depth, parent, children, pages, and previews of its own items."""
    sections = tables["section_rows"]
    items = tables["parents"].where("score IS NULL").groupBy("document_id", F.coalesce("section", F.lit(-1)).alias("section")).agg(F.array_sort(F.collect_list(F.struct("ord", preview(F.col("text")).alias("preview")))).alias("items"))
    children = sections.where("parent IS NOT NULL").groupBy("document_id", F.col("parent").alias("section")).agg(F.array_sort(F.collect_list(F.col("section").alias("child"))).alias("children"))
    joined = sections.join(items, ["document_id", "section"], "left").join(children, ["document_id", "section"], "left")
    none = F.array().cast("array<bigint>")
    return joined.select("document_id", "section", "heading", "depth", "parent", F.coalesce("children", none).alias("children"), F.concat_ws("-", "page", "end_page").alias("pages"), "items")


def group_tree(tables: Tables) -> DataFrame:
    """A row for each group: its pattern, and for each document the members with previews."""
    own = F.struct("segment", "pattern", F.round("likeness", 3).alias("confidence"), preview(F.col("text")).alias("preview"))
    by_document = tables["grouped"].groupBy("collection", "group_no", "document_id").agg(F.array_sort(F.collect_list(own)).alias("blocks"))
    nested = by_document.groupBy("collection", "group_no").agg(F.array_sort(F.collect_list(F.struct("document_id", "blocks"))).alias("documents"))
    return nested.join(tables["groups"].select("collection", "group_no", "size", "dominant_pattern"), ["collection", "group_no"])


def outline(tables: Tables) -> DataFrame:
    """(document_id, value): the sections of a document as indented lines, each with the whole text of its items."""
    heads = tables["section_rows"].select("document_id", F.col("section").alias("at"), F.lit(-1).cast("long").alias("ord"), "depth", F.concat(F.expr("repeat('  ', CAST(depth AS INT))"), F.lit("# "), F.regexp_replace("heading", r"\s+", " ")).alias("line"))
    depths = tables["section_rows"].select("document_id", F.col("section").alias("at"), "depth")
    items = tables["parents"].where("score IS NULL").select("document_id", F.coalesce("section", F.lit(-1)).cast("long").alias("at"), F.col("ord").cast("long").alias("ord"), "text").join(depths, ["document_id", "at"])
    items = items.select("document_id", "at", "ord", "depth", F.concat(F.expr("repeat('  ', CAST(depth AS INT) + 1)"), F.lit("- "), F.regexp_replace("text", r"\s+", " ")).alias("line"))
    lines = heads.unionByName(items).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("at", "ord", "line"))).alias("lines"))
    return lines.select("document_id", F.concat_ws("\n", F.col("document_id"), F.array_join("lines.line", "\n")).alias("value"))


def consolidation_log(tables: Tables) -> DataFrame:
    """(document_id, value): the chains of a document's blocks and each pair's decision, as lines."""
    pairs = tables["explained"].select("document_id", F.col("seq").alias("at"), F.format_string("%s %d-%d: %s (confidence %.3f, continuation %.3f, boundary %.3f)", F.when(F.col("merge"), "MERGE").otherwise("KEEP_SEPARATE"), F.col("p_seq"), F.col("seq"), "reasons", "confidence", "continuation", "separation").alias("line"))
    chains = tables["merged_blocks"].where("n_sources > 1").select("document_id", F.col("first_seq").alias("at"), F.format_string("CHAIN %s: %s", "block_id", "sources").alias("line"))
    lines = pairs.unionByName(chains).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("lines"))
    return lines.select("document_id", F.array_join("lines.line", "\n").alias("value"))


def summary(tables: Tables) -> DataFrame:
    """(document_id, value): counts of a document through the steps of a run, as a paragraph."""
    def count(name: str, alias: str, condition: str = "true") -> DataFrame:
        return tables[name].groupBy("document_id").agg(F.count_if(F.expr(condition)).alias(alias))

    parts = [count("features", "units"), count("features", "rejected", "furniture"), count("decisions", "boundaries"), count("decisions", "splits", "split"), count("content_units", "content"), count("content_units", "records", "block_type = 'structured_record'"), count("merged_blocks", "blocks"), count("merged_blocks", "merged", "n_sources > 1")]
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.join(part, "document_id", "left")
    names = [c for c in joined.columns if c != "document_id"]
    return joined.select("document_id", F.concat_ws(", ", *(F.concat(F.coalesce(F.col(c), F.lit(0)).cast("string"), F.lit(f" {c}")) for c in names)).alias("value"))


def export(tables: Tables, folder: str) -> list[str]:
    """Write every table as JSON lines, and what they allow of trees, outlines, logs and events; the names written.

    Texts are written one file set a report, a row for each document. Numbers
    are rounded to four digits here and nowhere else.
    """
    done = []

    def dump(name: str, df: DataFrame) -> None:
        rounded(df).write.mode("overwrite").json(f"{folder}/{name}")
        done.append(name)

    def text(name: str, df: DataFrame) -> None:
        df.select(F.concat(F.lit("== "), "document_id", F.lit("\n"), "value").alias("value")).write.mode("overwrite").text(f"{folder}/{name}")
        done.append(name)

    for name, df in tables.items():
        dump(name, df)
    if {"section_rows", "parents"} <= set(tables):
        dump("collection_tree", section_tree(tables))
        text("human_readable", outline(tables))
    if {"grouped", "groups"} <= set(tables):
        dump("group_tree", group_tree(tables))
    if {"explained", "merged_blocks"} <= set(tables):
        text("block_consolidation", consolidation_log(tables))
    if {"features", "decisions", "content_units", "merged_blocks"} <= set(tables):
        text("discovery", summary(tables))
    if set(tables) & {"features", "decisions", "section_rows"}:
        dump("events", events(tables))
    spark = next(iter(tables.values())).sparkSession
    found = audit.report(audit.audit(Path(__file__).parents[1] / "operators", discovers={"structured.py", "native.py", "sections.py"}))
    dump("audit", spark.createDataFrame([(found["violations"], found["generic"], len(found["findings"]))], "violations long, generic long, findings long"))
    return done
