"""Word documents: written, read again as packages, replaced, and broken off."""

import io
import os
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from tracewright import queries as core
from tracewright.operators import documents
from tracewright.sources import wordfiles

SF = "/root/testdata/sf0.001"
W = f"{{{wordfiles.NAMESPACE}}}"


def read(data):
    """(style, text) of each paragraph."""
    with zipfile.ZipFile(io.BytesIO(data)) as file:
        assert file.testzip() is None and {"[Content_Types].xml", "_rels/.rels", "word/document.xml", "word/styles.xml"} <= set(file.namelist())
        body = ElementTree.fromstring(file.read("word/document.xml"))
    return [(p.find(f"{W}pPr/{W}pStyle").get(f"{W}val"), "".join(t.text or "" for t in p.iter(f"{W}t"))) for p in body.iter(f"{W}p")]


def files(path):
    return {x: open(os.path.join(path, x), "rb").read() for x in os.listdir(path) if x.endswith(".docx")}


def test_sections(spark, tmp_path):
    rows = core.queries()["document_paragraphs"](spark, SF)
    rows = spark.createDataFrame(rows.collect(), rows.schema)  # once
    wordfiles.write_word(rows, f"file://{tmp_path}/out")
    found = files(f"{tmp_path}/out")
    want = {}
    for r in rows.orderBy("job_id", "section", "at", "line").collect():
        want.setdefault(f"{r.job_id}.docx", []).append((r.style, f"{r.label}: {r.text}" if r.label else r.text))
    assert {name: read(data) for name, data in found.items()} == want and os.listdir(f"{tmp_path}/out") == list(found)
    for lines in want.values():
        heads = [t for s, t in lines if s in ("Heading1", "Heading2") and t in documents.HEADINGS.values()]
        assert heads == [h for h in documents.HEADINGS.values() if h in heads] and lines[0][0] == "Title"
        always = {k for k in documents.HEADINGS if k not in ("warnings", "removed", "merged")}
        assert {documents.HEADINGS[k] for k in always} <= set(heads)
        numbers = [int(t.split()[1]) for s, t in lines if s == "Heading3"]
        assert numbers == list(range(1, len(numbers) + 1))


BLOCK = "job_id long, section int, at int, line int, style string, label string, text string"


def test_replace_and_break(spark, tmp_path):
    path = f"{tmp_path}/out"
    one = spark.createDataFrame([(1, 0, 0, 0, "Title", None, 'a < b & "c" \x00\x0b ퟿ é'), (1, 0, 0, 1, "Normal", "Key", None), (2, 0, 0, 0, "Title", None, "second")], BLOCK)
    wordfiles.write_word(one, f"file://{path}")
    assert read(files(path)["1.docx"]) == [("Title", 'a < b & "c"  ퟿ é'), ("Normal", "Key: ")]
    before = files(path)
    fails = F.udf(lambda x: 1 // 0 if x == "9" else x)
    with pytest.raises(Exception):
        wordfiles.write_word(spark.createDataFrame([(i, 0, 0, 0, "Title", None, str(i)) for i in range(10)], BLOCK).withColumn("text", fails("text")), f"file://{path}")
    assert files(path) == before and sorted(os.listdir(path)) == ["1.docx", "2.docx"]  # nothing of the broken write is left
    wordfiles.write_word(one.where("job_id = 1").withColumn("text", F.lit("new")), f"file://{path}")
    assert read(files(path)["1.docx"])[0] == ("Title", "new") and files(path)["2.docx"] == before["2.docx"]
    wordfiles.write_word(one.where("job_id = 2"), f"file://{path}", "overwrite")
    assert set(files(path)) == {"2.docx"}
    wordfiles.write_word(one.limit(0), f"file://{path}")
    assert set(files(path)) == {"2.docx"}
