"""Accessibility findings on a small document, with sides that are missing."""

from sparkfolio.operators import accessible


def test_findings_of_a_small_document(spark):
    docs = spark.createDataFrame([(1, True, False, ["copy_for_accessibility"]), (2, None, None, None), (3, False, True, ["print"]), (4, True, None, [])], "doc int, marked boolean, suspects boolean, permissions array<string>")
    nodes = spark.createDataFrame([(1, 1, "Document"), (1, 1, None), (1, 1, " H2 "), (1, 2, "Figure")], "doc int, page int, role string")
    found = {(r["doc"], r["type"], r["severity"]) for r in accessible.document_findings(docs, nodes, ["doc"]).collect()}
    assert found == {
        (2, "mark_info_missing", "medium"), (2, "structure_tree_missing", "medium"), (3, "untagged_pdf", "high"), (3, "suspect_tags", "high"), (3, "structure_tree_missing", "medium"),
        (3, "accessibility_permission", "high"), (4, "structure_tree_missing", "medium"),
    }
    pages = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (1, 3), (1, 4)], "doc int, page int")
    elements = spark.createDataFrame([(1, 1, "text"), (1, 1, "text"), (1, 1, "text"), (1, 2, "image"), (1, 3, "image")], "doc int, page int, type string")
    outline = spark.createDataFrame([(1, "a"), (1, "b")], "doc int, title string")
    facts = accessible.page_facts(pages, elements, nodes, outline, ["doc"])
    assert {r["page"]: (r["tagged"], r["headings"], r["figures"], r["contents"], r["visible"], r["images"], r["coverage"]) for r in facts.collect()} == {
        1: (True, 1, 0, 1, 3, 0, 0.33), 2: (True, 0, 1, 0, 1, 1, 0.0), 3: (False, 0, 0, 0, 1, 1, 0.0), 4: (False, 0, 0, 0, 0, 0, 0.0),
    }
    links = spark.createDataFrame([(1, 1, "u", None, None), (1, 1, "u", "label", None), (1, 1, None, None, None), (1, 9, "u", None, None)], "doc int, page int, url string, contents string, title string")
    fields = spark.createDataFrame([(1, 1, None, True), (1, 1, "Field7", None), (1, 1, "Field7b", True), (1, 1, "Unnamed", False)], "doc int, page int, name string, required boolean")
    got = accessible.page_findings(facts, links, fields, ["doc"])
    assert sorted((r["page"], r["type"], r["severity"]) for r in got.collect()) == [
        (1, "form_field_label", "low"), (1, "form_field_label", "low"), (1, "form_field_label", "medium"), (1, "link_label", "low"), (1, "tagged_content_mismatch", "medium"), (2, "heading_structure", "low"),
        (2, "tagged_content_mismatch", "medium"), (3, "image_alt_text", "high"), (3, "untagged_page", "medium"), (4, "untagged_page", "medium"),
    ]
    assert accessible.type_counts(got, ["doc"]).first()["types"]["form_field_label"] == 3
