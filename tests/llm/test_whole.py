"""Rows, pages and notices that must not be lost, against given results."""

import corpus_pipeline
from ruleloom.llm.html_text import blocks, extract
from ruleloom.llm.licences import ENDORSEMENT, TEMPLATES, scan_licences, scan_windows


def test_stages_tell_rows_apart(spark):
    sf = "/root/testdata/sf0.001"
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("length(text) > 60").orderBy("item_id").first()["text"]
    one, two, three = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(None, one), (1, two), (1, two), (2, three), (2, two), (None, three), (3, None), (3, ""), (None, None), (4, item), (4, one + " other"), (None, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[1] is None)
    kept = [tuple(r) for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()]
    assert sorted(kept, key=key) == sorted([(1, two), (2, three), (3, None), (3, ""), (None, None), (4, item), (4, one + " other")], key=key)
    clean = [tuple(r) for r in corpus_pipeline.decontamination(spark, docs, sf).collect()]
    assert sorted(clean, key=key) == sorted([r for r in rows if r[1] != item], key=key)


def test_pages_lose_no_text_to_elements(spark):
    texts = lambda page: [b.text for b in blocks(page)]
    assert texts('<p>one <svg width="1"/>two <math/>three</p><p>four') == ["one two three", "four"]
    assert texts("<p>a <button-group>b</button-group> c <template-x>d</template-x> <object-card>e</p><p>f") == ["a b c d e", "f"]
    for name in ("button", "object", "svg", "math", "noscript", "select", "template", "iframe", "canvas", "textarea"):
        assert " ".join(texts(f"<p>before <{name}>within</{name}> after</p><p>end")) == "before within after end"
        assert " ".join(texts(f"<p>before <{name}>within</p><p>end")) == "before within end"
    assert texts("<p>x <svg><title>icon</title><path/></svg> y</p>") == ["x icon y"]
    assert texts("<p>kept<script>cut") == texts("<p>kept<style >cut") == texts("<p>kept<!-- cut") == ["kept"]
    assert texts("<p>a<scripted>b</scripted>c") == ["abc"]
    body = "The first long sentence of the article stands here, with words and an end. "
    page = f"<html><body><article><h1>Head</h1><p>{body}<svg/></p><p>{body}<math><mi>x</mi></math> more of it.</p><p>{body}<button>unclosed</p><p>{body}last.</p></article></body></html>"
    got = extract(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).first()["text"]
    assert got.count("The first long sentence") == 4 and "x more of it." in got and got.endswith("last.")


def test_licences_within_longer_passages(spark):
    gpl = next(b for i, b in TEMPLATES if i == "GPL-2.0" and b.startswith("This program"))
    bsd = next(b for i, b in TEMPLATES if i == "BSD-2-Clause")
    rows = [
        (1, "Foo v2. Released under the MIT License. See docs."),
        (2, "word " * 300 + "Licensed under CC BY 4.0. " + "tail " * 300),
        (3, "Copyright me " + bsd + " source must retain the notice " + ENDORSEMENT),
        (4, "Copyright me " + bsd + " source must retain the notice"),
        (5, "The MIT people released a License."), (6, None), (7, ""), (8, "one"), (8, "one"), (None, "Licensed under the MIT License."),
        (9, "# " + gpl.replace("; ", ";\n#\n# ").replace(", ", ",\n# ") + "\n#\n# Further words of another kind stand in this header, so that it is far longer than its notice alone, by quite some way, as all headers are."),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["licences"]) for r in scan_windows(docs).collect())
    assert got == [(0, "MIT"), (1, "MIT"), (2, "CC-BY-4.0"), (3, "BSD-3-Clause"), (4, "BSD-2-Clause"), (5, ""), (6, ""), (7, ""), (8, ""), (8, ""), (9, "GPL-2.0,GPL-3.0")]  # those two notices are alike by more than the threshold
    assert scan_windows(docs).where("doc_id = 9").first()["licence"] == "GPL-2.0"
    assert scan_licences(docs.where("doc_id in (1, 2, 9)")).where("licence is not null").count() == 0
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    was = {r["doc_id"]: set(r["licences"].split(",")) - {""} for r in scan_licences(table).collect()}
    now = {r["doc_id"]: set(r["licences"].split(",")) - {""} for r in scan_windows(table).collect()}
    assert now.keys() == was.keys() and all(was[i] <= now[i] for i in was)
