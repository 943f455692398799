"""A whole run over a few documents: tables, look-ups, exports, the command line."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stratapage import __main__ as cli
from stratapage.plans import engine
from stratapage.sources.units import expand, first_pages, lines, page_table, pdf

NOTE = "The service keeps each request in order until"
DOCUMENTS = [
    (1, f"# Alpha service\n{NOTE}\nthe queue has been drained.\n| Name | Size |\n|---|---|\n| one | 10 |\n| two | 20 |\n| three | 30 |", "s"),
    (2, f"# Beta service\n{NOTE}\nthe queue has been drained.\nAnother closing line about the river.", "s"),
    (3, "| Kind |  |\n| of thing | Count |\n| a | 1 |\n| b | 2 |", "s"),
    (4, None, "s"), (5, "", "s"),
]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame(DOCUMENTS, "doc_id long, text string, source string")


@pytest.fixture(scope="module")
def tables(documents):
    return engine.run_collection(documents)


def test_lines_drop_rules_and_merge_labels(documents):
    rows = {(r.document_id, r.ord): r.cells for r in lines(documents).where("cells IS NOT NULL").collect()}
    assert rows["3", 0] == ["Kind of thing", "Count"] and rows["3", 2] == ["b", "2"]
    assert [rows["1", i] for i in (3, 4)] == [["Name", "Size"], ["one", "10"]] and len(rows) == 7


def test_tables_and_lookups(tables):
    units = tables["grouped"]
    assert units.select("document_id").distinct().count() == 3
    assert tables["patterns"].agg(F.sum("size")).first()[0] == units.count() == tables["groups"].agg(F.sum("size")).first()[0]
    merged = tables["merged_blocks"].where("n_sources > 1").collect()
    assert all(r.block_id.startswith(f"{r.document_id}_consolidated_block_") for r in merged)
    first = units.orderBy("ord").first()
    assert engine.blocks_in_group(tables, "s", first.group_no).count() >= 1
    assert engine.related_to(tables, first.document_id, first.segment).where(F.col("document_id") == first.document_id).count() == 0
    traced = engine.trace(tables, "1", 1).first()
    assert traced.sources[0].line in traced.text
    section = tables["section_rows"].where("document_id = '1' AND heading LIKE '%Alpha%'").first()
    assert section is not None and engine.blocks_in_section(tables, "1", section.section).count() == section.item_count
    assert engine.sections_by_label(tables, {"Greek": "alpha beta service", "other": "zzz"}, "greek").count() == 2
    found = engine.search(tables["units"], "closing river", k=2).collect()
    assert "river" in tables["units"].where((F.col("document_id") == found[0].document_id) & (F.col("ord") == found[0].ord)).first().text
    assert engine.search(tables["units"], "closing river", document_id="1").where("document_id <> '1'").count() == 0


def test_export(spark, tables, tmp_path):
    done = engine.export(tables, str(tmp_path))
    assert {"merged_blocks", "collection_tree", "group_tree", "human_readable", "block_consolidation", "discovery", "events", "audit"} <= set(done)
    tree = spark.read.json(f"{tmp_path}/collection_tree").where("document_id = '1'").collect()
    assert any("Alpha" in r.heading and r["items"] for r in tree)
    text = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/human_readable").collect())
    assert "== 2" in text and "# Beta service" in text and "  - " in text
    events = spark.read.json(f"{tmp_path}/events")
    doubted = events.where("event <> 'low_confidence_decision' AND confidence < 0.5").count()
    assert events.where("event = 'low_confidence_decision'").count() == doubted
    assert {"boundary_evaluated", "logical_block_created", "pattern_discovered", "section_group_created"} <= {r.event for r in events.select("event").distinct().collect()}


def test_command_line(documents, tmp_path, monkeypatch, capsys):
    documents.drop("source").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(sys, "argv", ["stratapage", "ingest", f"{tmp_path}/documents.parquet", f"{tmp_path}/out"])
    cli.main()
    assert "merged_blocks" in capsys.readouterr().out and Path(f"{tmp_path}/out/events").is_dir()
    monkeypatch.setattr(sys, "argv", ["stratapage", "search", f"{tmp_path}/documents.parquet", "queue drained", "--top-k", "1"])
    cli.main()


def test_files_and_pages(spark, tmp_path):
    for name in ("b.pdf", "a.PDF", "c.txt"):
        (tmp_path / name).write_bytes(b"2" if name != "a.PDF" else b"bad")
    assert [Path(p).name for p in expand(spark, [f"{tmp_path}/*", f"{tmp_path}/b.pdf", f"{tmp_path}/none*"])] == ["a.PDF", "b.pdf"]

    def read(raw):
        for page in (1, 3):
            yield {"page": page, "ord": page, "text": "t", "layout": "text", "pw": 100.0, "ph": 200.0, "grid_id": None}
            int(raw)

    units = pdf(spark, str(tmp_path), read, "document_id string, page long, ord long, text string, layout string, pw double, ph double, grid_id string")
    assert sorted((r.document_id, r.page) for r in units.collect()) == [("a.PDF", 1), ("b.pdf", 1), ("b.pdf", 3)]
    pages = sorted((r.document_id, r.page, r.width, r.raw_units) for r in page_table(units).collect())
    assert pages == [("a.PDF", 1, 100.0, 1), ("b.pdf", 1, 100.0, 1), ("b.pdf", 2, 100.0, 0), ("b.pdf", 3, 100.0, 1)]
    assert [first_pages(units, n, z).count() for n, z in ((None, True), (1, True), (0, True), (0, False), (-2, False))] == [3, 2, 3, 0, 0]
