"""A sink of Word documents: one .docx for each job, from rows of paragraphs.

    documents.write_word(blocks, "file:///shared/out")

Rows are (job_id, style, label, text) and lie in order, each job's together. A task writes its jobs' packages to a
folder of its attempt; only when all tasks are done are the files moved to their places, where they replace older ones
of the same jobs. A write that is broken off leaves none of its files. Task attempts that died are deleted with it.
"""

from __future__ import annotations

import io
import sys
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from xml.sax.saxutils import escape

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

# The sink travels with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NAMESPACE = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
STYLES = {"Title": 32, "Heading1": 28, "Heading2": 24, "Heading3": 22, "Normal": 20}  # with their sizes in half points
ATTEMPTS = "_attempts"


def plain(text: str | None) -> str:
    """Text that may stand in XML."""
    return escape("".join(c for c in text or "" if c in "\t\n" or c >= " " and c not in "￾￿" and not "\ud800" <= c <= "\udfff"))


def paragraph(style: str, label: str | None, text: str | None) -> str:
    run = lambda t, bold: f'<w:r>{"<w:rPr><w:b/></w:rPr>" if bold else ""}<w:t xml:space="preserve">{plain(t)}</w:t></w:r>'
    runs = (run(f"{label}: ", True) if label else "") + run(text, False)
    return f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr>{runs}</w:p>'


def package(rows: Iterator[Row]) -> bytes:
    """A WordprocessingML package of the paragraphs."""
    body = "".join(paragraph(r["style"], r["label"], r["text"]) for r in rows)
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    kind = "application/vnd.openxmlformats-officedocument.wordprocessingml"
    link = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package_links = "http://schemas.openxmlformats.org/package/2006/relationships"
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="{s}"><w:name w:val="{s}"/><w:rPr><w:rFonts w:ascii="Arial" w:hAnsi="Arial"/>{"<w:b/>" if s != "Normal" else ""}<w:sz w:val="{n}"/></w:rPr></w:style>' for s, n in STYLES.items())
    parts = {
        "[Content_Types].xml": f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="{kind}.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="{kind}.styles+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package_links}"><Relationship Id="rId1" Type="{link}/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/_rels/document.xml.rels": f'<Relationships xmlns="{package_links}"><Relationship Id="rId1" Type="{link}/styles" Target="styles.xml"/></Relationships>',
        "word/document.xml": f'<w:document xmlns:w="{NAMESPACE}"><w:body>{body}<w:sectPr/></w:body></w:document>',
        "word/styles.xml": f'<w:styles xmlns:w="{NAMESPACE}">{styles}</w:styles>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as file:
        for name, text in parts.items():
            file.writestr(zipfile.ZipInfo(name), head + text, zipfile.ZIP_DEFLATED)
    return out.getvalue()


@dataclass
class Written(WriterCommitMessage):
    attempt: str
    names: list[str]


class WordWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def files(self):
        from pyarrow.fs import FileSystem

        return FileSystem.from_uri(self.path)

    def write(self, iterator):
        fs, root = self.files()
        done = Written(uuid.uuid4().hex, [])
        folder = f"{root}/{ATTEMPTS}/{done.attempt}"
        fs.create_dir(folder, recursive=True)
        for job, rows in groupby(iterator, key=lambda r: r["job_id"]):
            with fs.open_output_stream(f"{folder}/{job}.docx") as file:
                file.write(package(rows))
            done.names.append(f"{job}.docx")
        return done

    def commit(self, messages):
        from pyarrow.fs import FileSelector

        fs, root = self.files()
        names = {name for m in messages if m for name in m.names}
        for m in messages:
            for name in m.names if m else ():
                fs.move(f"{root}/{ATTEMPTS}/{m.attempt}/{name}", f"{root}/{name}")
        if self.overwrite:
            for x in fs.get_file_info(FileSelector(root)):
                if x.base_name.endswith(".docx") and x.base_name not in names:
                    fs.delete_file(x.path)
        self.clear()

    def abort(self, messages):
        self.clear()

    def clear(self) -> None:
        from pyarrow.fs import FileType

        fs, root = self.files()
        if fs.get_file_info(f"{root}/{ATTEMPTS}").type == FileType.Directory:
            fs.delete_dir(f"{root}/{ATTEMPTS}")


class WordFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wordfiles"

    def schema(self) -> str:
        return "job_id long, style string, label string, text string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return WordWriter(self.options["path"], overwrite)


def write_word(blocks: DataFrame, path: str, mode: str = "append") -> None:
    """Paragraphs (job_id, section, at, line, style, label, text) as ``path``/<job_id>.docx; ``path`` is a URI that all tasks reach."""
    spark: SparkSession = blocks.sparkSession
    spark.dataSource.register(WordFiles)
    order = ["job_id", "section", "at", "line"]
    rows = blocks.repartition("job_id").sortWithinPartitions(*order).select("job_id", "style", "label", "text")
    rows.write.format("wordfiles").mode(mode).option("path", path).save()
