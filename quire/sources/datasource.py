"""``spark.read.format("pdf")``: pages of PDF files as a Spark data source.

    register(spark)
    spark.read.format("pdf").option("dpi", 72).option("mode", "rgb").load("/shared/*.pdf")

Options: dpi, first, last, mode (gray, mono or rgb), antialias, deskew, annotations,
page_seconds (a page that takes longer gives an error row) and bytes_per_partition.

The driver lists files and their sizes, nothing more: a file of many bytes is several
partitions, each of which draws its share of the pages, and how many there are is found in
the tasks. Paths must be visible to the executors; files in other stores are read by
:func:`quire.sources.pdf_tables.read_files` through Spark itself. To draw some pages only, give
first and last: filters are not handed to the reader, as Spark 4.1 keeps a filter of one query
in the reader of others on the same DataFrame. A damaged file gives one error row, a damaged
page too.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quire.sources.pdf import Document, PdfError
from quire.sources.pdf_tables import RENDERED, check_options, named, page_row

SCHEMA = f"doc_id string, {RENDERED}"


class Share(InputPartition):
    """The pages of a file from ``k / n`` to ``(k + 1) / n`` of them."""

    def __init__(self, path: str, k: int, n: int):
        super().__init__((path, k, n))
        self.path, self.k, self.n = path, k, n


class PdfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.dpi, self.each = options["path"], float(options.get("dpi", 150)), int(options.get("bytes_per_partition", 8 << 20))
        self.low, self.high = int(options.get("first", 1)), int(options.get("last", 1 << 30))
        flag = lambda name, default: str(options.get(name, default)).lower() == "true"
        self.mode, self.antialias, self.deskew, self.annotations = options.get("mode", "gray"), flag("antialias", False), flag("deskew", False), flag("annotations", True)
        self.seconds = float(options["page_seconds"]) if "page_seconds" in options else None
        check_options(self.dpi, self.low, self.high, None, self.mode, self.deskew)

    def partitions(self) -> list[Share]:
        out = []
        for path in sorted(glob.glob(self.path)):
            n = max(1, -(-os.path.getsize(path) // self.each))
            out += [Share(path, k, n) for k in range(n)]
        return out

    def read(self, partition: Share) -> Iterator[tuple]:
        try:
            with open(partition.path, "rb") as f:
                doc = Document(f.read())
            if doc.encrypted:
                raise PdfError("EncryptedDocument", "not opened")
            pages = doc.pages()
            if not pages:
                raise PdfError("NoPages", "no page in the tree")
        except Exception as e:  # whatever a damaged file leads to, it is a row
            if partition.k == 0:
                yield (partition.path, *(None,) * 16, *named(e))
            return
        first, last = (len(pages) * (partition.k + d) // partition.n for d in (0, 1))
        for n in range(max(first + 1, self.low), min(last, self.high) + 1):
            _, page, own = pages[n - 1]
            yield (partition.path, *page_row(doc, n, page, own, self.dpi, self.mode, self.antialias, self.deskew, self.annotations, self.seconds))


class PdfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pdf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PdfReader:
        return PdfReader(dict(self.options))


def register(spark) -> None:
    """Lets the session read ``pdf``."""
    spark.dataSource.register(PdfSource)
