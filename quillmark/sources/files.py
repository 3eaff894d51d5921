"""Annotation files as a data source: planned by size, read and parsed once; documents written as a file each."""

from __future__ import annotations

import fnmatch
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

from quillmark.sources.annotations import MISSING, read_yaml

#: Bytes of files that a task reads, about.
TASK_BYTES = 32 << 20


def _open(uri: str):
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def qualified(spark: SparkSession, path: str) -> str:
    """A path as Spark shows it in file tables."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


@dataclass
class Files(InputPartition):
    """Files of one task: (path, whether it is there)."""

    files: list[tuple[str, bool]]


class AnnotationReader(DataSourceReader):
    """(path, doc as JSON text, error) of YAML files.  Filters on path choose files before any is opened."""

    def __init__(self, options: dict):
        self.root, self.glob = options.get("path"), options.get("glob", "*.yaml")
        self.skip = options.get("skip", "reviews")
        self.paths = json.loads(options["paths"]) if "paths" in options else None
        self.bytes = int(options.get("task_bytes", TASK_BYTES))
        self.filters = []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo | In | StringStartsWith) and f.attribute == ("path",):
                self.filters.append(f)
            else:
                yield f

    def _wanted(self, path: str) -> bool:
        return all(path == f.value if isinstance(f, EqualTo) else path in f.value if isinstance(f, In) else path.startswith(f.value) for f in self.filters)

    def _listed(self) -> list[tuple[str, bool, int]]:
        """(path, there, bytes) of all files, by path."""
        import pyarrow.fs as pafs

        if self.paths is not None:
            found = []
            for path in filter(self._wanted, self.paths):
                fs, at = _open(path)
                info = fs.get_file_info(at)
                found.append((path, info.type == pafs.FileType.File, info.size or 0))
            return found
        fs, at = _open(self.root)
        infos = fs.get_file_info(pafs.FileSelector(at, recursive=True))
        head = self.root[: len(self.root) - len(at)] if self.root.endswith(at) else ""
        inside = lambda p: self.skip and self.skip in posixpath.relpath(p, at).split("/")[:-1]
        files = [(head + i.path, True, i.size) for i in infos if i.type == pafs.FileType.File and fnmatch.fnmatch(i.base_name, self.glob) and not inside(i.path)]
        return sorted(f for f in files if self._wanted(f[0]))

    def partitions(self) -> list[Files]:
        out, size = [Files([])], 0
        for path, there, n in self._listed():
            if out[-1].files and size + n > self.bytes:
                out, size = [*out, Files([])], 0
            out[-1].files.append((path, there))
            size += n
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        for path, there in partition.files:
            if not there:
                yield path, None, MISSING
                continue
            try:
                fs, at = _open(path)
                with fs.open_input_stream(at) as f:
                    text = f.read().decode("utf-8")
            except (OSError, UnicodeDecodeError) as e:
                yield path, None, str(e)
                continue
            yield path, *read_yaml(text)


class AnnotationFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "annotation_files"

    def schema(self) -> str:
        return "path string, doc string, error string"

    def reader(self, schema) -> AnnotationReader:
        return AnnotationReader(dict(self.options))


def scan_annotation_files(spark: SparkSession, path: str | None = None, paths: list[str] | None = None, **options) -> DataFrame:
    """(path, doc variant, error) of the files below path, or of a list of paths, in which one without a file gives a row.

    Tasks get files of about task_bytes together; a file is opened, read and parsed once, and what is wrong with it is
    its row's error.  Filters on path reach the listing.  glob chooses file names, skip leaves out folders of a name.
    Files must be in a store that pyarrow opens; scan_documents reads any that Spark does.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(AnnotationFiles)
    reader = spark.read.format("annotation_files").options(**{k: str(v) for k, v in options.items()})
    if paths is not None:
        reader = reader.option("paths", json.dumps([qualified(spark, p) for p in paths]))
    else:
        reader = reader.option("path", qualified(spark, path))
    return reader.load().withColumn("doc", F.try_parse_json("doc"))


@dataclass
class Written(WriterCommitMessage):
    files: int


class DocumentWriter(DataSourceWriter):
    """A file for each row (name, text), below the root by its name, which may have folders.

    A task writes its files aside and moves them to their places when it is through, so each is whole or not there;
    a task that runs twice writes the same.  The commit takes what lies aside away and leaves _SUCCESS.
    """

    def __init__(self, root: str):
        self.root, self.aside = root.rstrip("/"), f"_aside-{uuid.uuid4().hex}"

    def write(self, rows) -> Written:
        fs, root = _open(self.root)
        own, names = f"{root}/{self.aside}/{uuid.uuid4().hex}", []
        for row in rows:
            at = f"{own}/{row['name']}"
            fs.create_dir(posixpath.dirname(at), recursive=True)
            with fs.open_output_stream(at) as f:
                f.write((row["text"] or "").encode("utf-8"))
            names.append(row["name"])
        for name in names:
            fs.create_dir(posixpath.dirname(f"{root}/{name}"), recursive=True)
            fs.move(f"{own}/{name}", f"{root}/{name}")
        return Written(len(names))

    def _clear(self):
        import pyarrow.fs as pafs

        fs, root = _open(self.root)
        if fs.get_file_info(f"{root}/{self.aside}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{self.aside}")
        return fs, root

    def commit(self, messages) -> None:
        fs, root = self._clear()
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/_SUCCESS") as f:
            f.write(str(sum(m.files for m in messages if m)).encode())

    def abort(self, messages) -> None:
        self._clear()


class DocumentFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "document_files"

    def writer(self, schema, overwrite) -> DocumentWriter:
        return DocumentWriter(self.options["path"])


def file_name(path: Column, base: str, suffix: str) -> Column:
    """A document's place below base with another suffix: base/v0/x.yaml is v0/x.ttl; a path elsewhere goes by all its folders."""
    plain = lambda p: F.regexp_replace(p, "^[a-z0-9]+:/+", "/")
    below, own = plain(F.lit(base.rstrip("/"))), plain(path)
    rest = F.when(F.startswith(own, F.concat(below, F.lit("/"))), F.substring(own, F.length(below) + 2, F.length(own))).otherwise(F.ltrim(own, F.lit("/")))
    return F.concat(F.regexp_replace(rest, r"\.[^./]*$", ""), F.lit(suffix))


def write_documents(docs: DataFrame, out: str, base: str = "", suffix: str = ".ttl") -> None:
    """Writes the text of each (path, text) to a file below out, by its path below base; files that are there are replaced.

    Two documents of one place, or one that would leave out by "..", are an error before anything is written.
    """
    spark = docs.sparkSession
    named = docs.select(file_name(F.col("path"), base, suffix).alias("name"), "text")
    bad = named.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n").__gt__(1) | F.array_contains(F.split("name", "/"), "..")).orderBy("name").limit(3).collect()
    if bad:
        raise ValueError(f"no file of its own for: {', '.join(r['name'] for r in bad)}")
    spark.dataSource.register(DocumentFiles)
    named.write.format("document_files").mode("append").save(qualified(spark, out))
