"""Page files as a data source: `spark.read.format("pagefiles").load(folder)` has a row for each page of each file.

Every page is a partition of its own, so pages of one long file are rendered by as many executors as those of many files. Page counts
come from the files' own trees, nothing is rendered for them; filters on `page` and `path` are taken before partitions are made.

Options: `pattern` of file names (*.pdf), `dpi` (300), `renderer` as module:function of (bytes, page, dpi) to (gray bytes, height, width), or `none` for rows without
images, `index`, a Parquet table of (path, pages) made once by `write_index` for folders too large for the driver to look into, and `unknown`, what becomes of
files without a count: `error` or `skip`.
"""

from __future__ import annotations

import fnmatch
import importlib
import re
import subprocess
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from gridloom.sources import pages

SCHEMA = "path string, page int, image binary, height int, width int"
COUNT = re.compile(rb"/Type\s*/Pages\b[^>]*?/Count\s+(\d+)|/Count\s+(\d+)[^>]*?/Type\s*/Pages\b")
LISTED_AT_ONCE = 16
TESTS: dict[type, Callable] = {
    EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v,
    GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v,
}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def content_of(path: str) -> bytes:
    at, inner = opened(path)
    with at.open_input_file(inner) as f:
        return f.read()


def pages_of(content: bytes) -> int:
    """The pages of a file by its page tree, or else by pdfinfo where that program is there; 0 if neither tells."""
    found = [int(a or b) for a, b in COUNT.findall(content)]
    if found:
        return max(found)
    try:
        told = subprocess.run(["pdfinfo", "-"], input=content, capture_output=True, timeout=120).stdout
    except (OSError, subprocess.SubprocessError):
        return 0
    m = re.search(rb"^Pages:\s+(\d+)", told, re.M)
    return int(m[1]) if m else 0


def poppler(content: bytes, page: int, dpi: int) -> tuple[bytes, int, int]:
    """A page as gray pixels, by the program pdftoppm."""
    made = subprocess.run(["pdftoppm", "-gray", "-r", str(dpi), "-f", str(page + 1), "-l", str(page + 1), "-"], input=content, capture_output=True, check=True, timeout=600).stdout
    m = re.match(rb"P5\s+(\d+)\s+(\d+)\s+255\s", made)
    if not m:
        raise ValueError(f"pdftoppm gave no gray image of page {page}")
    width, height = int(m[1]), int(m[2])
    return made[m.end() : m.end() + width * height], height, width


def named(renderer: str) -> Callable[[bytes, int, int], tuple[bytes, int, int]]:
    module, _, name = renderer.partition(":")
    return getattr(importlib.import_module(module), name)


@dataclass
class Page(InputPartition):
    path: str
    number: int


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.pattern = options["path"], options.get("pattern", "*.pdf").lower()
        self.dpi, self.renderer = int(options.get("dpi", 300)), options.get("renderer", f"{__name__}:poppler")
        self.index, self.unknown = options.get("index"), options.get("unknown", "error")
        self.tests: list[tuple[str, Callable, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            test = TESTS.get(type(f))
            if test and f.attribute in (("page",), ("path",)):
                self.tests.append((f.attribute[0], test, f.value))
            else:
                yield f

    def wanted(self, column: str, value: object) -> bool:
        return all(test(value, x) for name, test, x in self.tests if name == column)

    def listed(self) -> list[tuple[str, int]]:
        """(path, pages) of the files that no filter on the path excludes."""
        if self.index:
            at, inner = opened(self.index)
            table = pq.read_table(inner, filesystem=at, columns=["path", "pages"])
            return sorted((p, n) for p, n in zip(*(table[c].to_pylist() for c in ("path", "pages"))) if self.wanted("path", p))
        at, inner = opened(self.folder)
        prefix = self.folder[: len(self.folder) - len(inner)] if self.folder.endswith(inner) else "file://" * (self.folder != inner)
        found = [f.path for f in at.get_file_info(fs.FileSelector(inner, recursive=True)) if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name.lower(), self.pattern)]
        paths = sorted(p for p in (prefix + x for x in found) if self.wanted("path", p))
        with ThreadPoolExecutor(LISTED_AT_ONCE) as pool:
            return list(zip(paths, pool.map(lambda p: pages_of(content_of(p)), paths)))

    def partitions(self) -> list[Page]:
        out = []
        for path, n in self.listed():
            if not n and self.unknown != "skip":
                raise ValueError(f"no page count in {path}")
            out += [Page(path, i) for i in range(n) if self.wanted("page", i)]
        return out or [Page("", -1)]  # Spark asks for one at least

    def read(self, partition: Page) -> Iterator[tuple]:
        if partition.number < 0:
            return
        if self.renderer == "none":
            yield partition.path, partition.number, None, None, None
            return
        image, height, width = named(self.renderer)(content_of(partition.path), partition.number, self.dpi)
        yield partition.path, partition.number, bytes(image), height, width


class PageFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pagefiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)


def read(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """The pages of a folder's files; filters on page and path reach the listing."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageFiles)
    return spark.read.format("pagefiles").options(**options).load(folder)


def write_index(spark: SparkSession, folder: str, index: str, pattern: str = "*.{pdf,PDF}") -> None:
    """(path, pages) of all files, counted by the executors; files without a count have 0."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    found.select("path", pages.page_count(F.col("content")).alias("pages")).write.mode("overwrite").parquet(index)
