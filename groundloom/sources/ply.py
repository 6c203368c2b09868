"""PLY point tables as a Spark data source: ``spark.read.format("ply")`` and ``df.write.format("ply")``.

``read_table`` takes two passes. The first one, in tasks, reads headers and counts the lines that begin in each stretch of an ASCII file;
sums over the stretches give each its first line. The second one reads: a binary file's rows have a fixed size, so it is cut into row
ranges; an ASCII file is cut into the counted stretches, and its first lines, as many as the header says, are its vertices. Only the
properties in the requested schema are decoded. A task takes as many small files or stretches as make up its share of the bytes. Without the first pass (a plain ``spark.read.format("ply")``) headers are read on the
driver, and a stretch of an ASCII file counts the lines before it by itself. A written table is a folder of complete PLY files, one or
more per task and scene.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import ByteType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructField, StructType

# property types of the format: fixed values
TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "<i2", "int16": "<i2", "ushort": "<u2", "uint16": "<u2",
    "int": "<i4", "int32": "<i4", "uint": "<u4", "uint32": "<u4", "float": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8",
}
SPARK_OF = {"i1": ByteType(), "u1": ShortType(), "<i2": ShortType(), "<u2": IntegerType(), "<i4": IntegerType(), "<u4": LongType(), "<f4": FloatType(), "<f8": DoubleType()}
EXTRA = {"path": StringType(), "row": LongType()}


@dataclass
class Header:
    binary: bool
    count: int
    fields: list[tuple[str, str]]
    size: int
    comments: list[str]
    more: bool = False  # other elements follow the vertices

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(self.fields)


def parse_header(head: bytes, path: str) -> Header:
    end = head.find(b"end_header")
    if not head.startswith(b"ply") or end < 0:
        raise ValueError(f"{path}: no PLY header")
    size = head.index(b"\n", end) + 1
    kind, count, fields, comments, inside, more = None, None, [], [], False, False
    for line in head[:end].decode("ascii", "replace").splitlines():
        words = line.split()
        if not words:
            continue
        if words[0] == "format":
            kind = words[1]
        elif words[0] == "comment":
            comments.append(line[8:])
        elif words[0] == "element":
            inside = words[1] == "vertex"
            if inside:
                count = int(words[2])
            elif count is None and int(words[2]):
                raise ValueError(f"{path}: vertices have to come first")
            else:
                more = more or int(words[2]) > 0
        elif words[0] == "property" and inside:
            if words[1] == "list":
                raise ValueError(f"{path}: list properties on vertices are not supported")
            fields.append((words[2], TYPES[words[1]]))
    if kind not in ("binary_little_endian", "ascii"):
        raise ValueError(f"{path}: format {kind} is not supported")
    if not count or not fields:
        raise ValueError(f"{path}: no vertices")
    return Header(kind != "ascii", count, fields, size, comments, more)


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if re.match(r"^[a-z0-9+.-]+:", path):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def _files(path: str) -> list[tuple[str, int]]:
    fs, p = _filesystem(path)
    info = fs.get_file_info(p)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    done = fs.get_file_info(p.rstrip("/") + "/_committed.json")
    found = [f for f in fs.get_file_info(pafs.FileSelector(p, recursive=True)) if f.type == pafs.FileType.File and f.path.endswith(".ply")]
    if done.type == pafs.FileType.File:  # a table of ours: only committed files count
        with fs.open_input_stream(done.path) as fh:
            good = set(json.loads(fh.read()))
        found = [f for f in found if f.path.rsplit("/", 1)[1] in good]
    scheme = path[: len(path) - len(p)] if path.endswith(p) and path != p else ""
    return sorted((scheme + f.path, f.size) for f in found)


def read_header(path: str) -> Header:
    fs, p = _filesystem(path)
    with fs.open_input_stream(p) as fh:
        head = b""
        while b"end_header\n" not in head and b"end_header\r\n" not in head:
            more = fh.read(4096)
            if not more or len(head) > 1 << 20:
                break
            head += more
    return parse_header(head, path)


@dataclass
class Bundle(InputPartition):
    """Slices, in the order of their files, that one task reads."""

    slices: list[Slice]


@dataclass
class Slice:
    path: str
    header: Header
    start: int  # first row (binary) or byte (ascii)
    stop: int
    last: bool = False  # of an ascii file
    before: int | None = None  # lines before an ascii stretch, where they are counted


#: Bytes of an ASCII row at the least, for the length of stretches.
ROW_BYTES = 16
#: A task's bytes at the most, unless one slice has more, and tasks at the least, where there are as many slices.
TASK_BYTES, TASKS = 8 << 20, 32
SURVEY = "path string, start bigint, lines bigint, size bigint, header string"


def line_start(fh, at: int) -> int:
    """The first byte from ``at`` on that begins a line; the end of the file where none does."""
    fh.seek(at - 1)
    while block := fh.read(1 << 16):
        if (k := block.find(b"\n")) >= 0:
            return at + k
        at += len(block)
    return at - 1


def stretch(chunk: int, files: list[tuple[str, int]]) -> int:
    """Bytes of an ASCII file that are read at once: ``chunk``, or as many whole ones as a share of the files or half a task's bytes hold."""
    return chunk * max(1, min(TASK_BYTES // 2, sum(size for _, size in files) // TASKS) // chunk)


def bundled(slices: list[tuple[int, Slice]]) -> list[Bundle]:
    """Neighbouring slices (each with its bytes) put together, so that the number of tasks follows bytes, not files or stretches."""
    most = min(TASK_BYTES, sum(n for n, _ in slices) // TASKS)
    out, held = [], 0
    for n, s in slices:
        if not out or held + n > most:
            out.append(Bundle([]))
            held = 0
        out[-1].slices.append(s)
        held += n
    return out


class PlyReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options

    def __getstate__(self):
        """Tasks have their slices: what the first pass found stays behind."""
        return {"schema": self.schema, "options": {k: v for k, v in self.options.items() if k != "surveyed"}}

    def partitions(self):
        step = int(self.options.get("rowspersplit", 2_000_000))
        if self.options.get("survey") == "true":
            chunk = step * ROW_BYTES
            files = _files(self.options["path"])
            long = stretch(chunk, files)
            return bundled([(min(long, size - a), Slice(path, None, a, min(size, a + long), a + long >= size)) for path, size in files for a in range(0, max(size, 1), long)])
        out = []
        for path, size, h, lines in self._surveyed() if "surveyed" in self.options else ((path, size, read_header(path), None) for path, size in _files(self.options["path"])):
            missing = [f.name for f in self.schema if f.name not in EXTRA and f.name not in dict(h.fields)]
            if missing:
                raise ValueError(f"{path}: no properties {missing}")
            if h.binary:
                if size < h.size + h.count * h.dtype.itemsize:
                    raise ValueError(f"{path}: truncated, {size} bytes for {h.count} vertices")
                out += [((min(h.count, a + step) - a) * h.dtype.itemsize, Slice(path, h, a, min(h.count, a + step))) for a in range(0, h.count, step)]
            else:
                starts = sorted(lines) if lines else list(range(0, max(size, 1), stretch(step * ROW_BYTES, [(path, size)])))
                before = 0
                for a, b in zip(starts, [*starts[1:], size]):
                    out.append((b - a, Slice(path, h, max(a, h.size), b, b == size, before if lines else None)))
                    before += lines[a] if lines else 0
        return bundled(out)

    def _surveyed(self):
        """path, size, header and lines by stretch, from the rows of the first pass."""
        files: dict = {}
        for path, start, lines, size, header in json.loads(self.options["surveyed"]):
            own = files.setdefault(path, [size, None, {}])
            own[2][start] = lines
            if header:
                kind = json.loads(header)
                own[1] = Header(kind["binary"], kind["count"], [tuple(f) for f in kind["fields"]], kind["size"], [], kind["more"])
        return [(path, size, h, lines) for path, (size, h, lines) in sorted(files.items())]

    @staticmethod
    def _survey(fh, part: Slice):
        h = read_header(part.path)
        lines = 0
        if not h.binary and part.stop > h.size:
            begin = h.size if part.start <= h.size else line_start(fh, part.start)
            end = line_start(fh, part.stop) if not part.last else part.stop
            lines = PlyReader._lines(fh, begin, end) if begin < part.stop else 0
        elif h.binary and part.start:
            return
        header = json.dumps({"binary": h.binary, "count": h.count, "fields": h.fields, "size": h.size, "more": h.more}) if part.start == 0 else None
        fh.seek(0, 2)
        yield pa.RecordBatch.from_pydict({"path": [part.path], "start": pa.array([part.start], pa.int64()), "lines": pa.array([lines], pa.int64()), "size": pa.array([fh.tell()], pa.int64()), "header": pa.array([header], pa.string())})

    def read(self, part: Bundle):
        for s in part.slices:
            yield from self._read(s)

    def _read(self, part: Slice):
        fs, p = _filesystem(part.path)
        with fs.open_input_file(p) as fh:
            if part.header is None:
                yield from self._survey(fh, part)
                return
            blocks = self._binary(fh, part) if part.header.binary else self._ascii(fh, part)
            for rows, numbers in blocks:
                cols = []
                for f in self.schema:
                    if f.name == "path":
                        cols.append(pa.repeat(part.path, len(rows)))
                    elif f.name == "row":
                        cols.append(pa.array(numbers, pa.int64()))
                    else:
                        kind = {"double": "f8", "float": "f4", "bigint": "i8", "int": "i4", "smallint": "i2", "tinyint": "i1"}[f.dataType.simpleString()]
                        cols.append(pa.array(np.ascontiguousarray(rows[f.name]).astype(kind)))
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in self.schema])

    @staticmethod
    def _binary(fh, part: Slice):
        dt = part.header.dtype
        for a in range(part.start, part.stop, 65536):
            b = min(part.stop, a + 65536)
            fh.seek(part.header.size + a * dt.itemsize)
            yield np.frombuffer(fh.read((b - a) * dt.itemsize), dtype=dt), np.arange(a, b)

    @staticmethod
    def _ascii(fh, part: Slice):
        """Vertex lines that begin inside the byte range; ``row`` is a vertex's number. A file's vertices are as many as
        its header says; fewer are refused."""
        h = part.header
        begin = part.start if part.start <= h.size else line_start(fh, part.start)
        end = part.stop if part.last else line_start(fh, part.stop)
        before = PlyReader._lines(fh, h.size, begin) if part.before is None else part.before
        fh.seek(begin)
        data = fh.read(max(0, end - begin)) if begin < part.stop else b""
        lines = [words for line in data.split(b"\n") if (words := line.split())]
        if part.last and before + len(lines) < h.count:
            raise ValueError(f"{part.path}: {before + len(lines)} vertices of {h.count}")
        lines = lines[: max(0, h.count - before)]
        for k, words in enumerate(lines):
            if len(words) != len(h.fields):
                raise ValueError(f"{part.path}: {len(words)} values in vertex {before + k}, {len(h.fields)} expected")
        if lines:
            wide = np.array(lines, dtype="S").astype("f8")
            yield np.rec.fromarrays(list(wide.T), names=[n for n, _ in h.fields]), before + np.arange(len(lines))

    @staticmethod
    def _lines(fh, start: int, stop: int) -> int:
        """Lines with content between two line starts."""
        fh.seek(start)
        n, open_ = 0, False
        while start < stop:
            data = fh.read(min(1 << 22, stop - start))
            if not data:
                break
            start += len(data)
            parts = data.split(b"\n")
            for k, x in enumerate(parts):
                open_ = open_ or bool(x.strip())
                if k < len(parts) - 1:
                    n, open_ = n + open_, False
        return n + open_


@dataclass
class Written(WriterCommitMessage):
    files: list[str]
    rows: int


class PlyWriter(DataSourceArrowWriter):
    """Each task writes complete files of at most ``rowsperfile`` rows of one scene; the commit lists which ones count,
    so a retried task leaves no duplicates."""

    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.schema, self.options = schema, options
        fs, p = _filesystem(options["path"])
        if not overwrite and fs.get_file_info(p.rstrip("/") + "/_committed.json").type == pafs.FileType.File:
            raise ValueError(f"{options['path']} already holds a table")

    def write(self, iterator):
        from pyspark import TaskContext

        fs, root = _filesystem(self.options["path"])
        fs.create_dir(root, recursive=True)
        limit, attempt = int(self.options.get("rowsperfile", 4_000_000)), TaskContext.get().taskAttemptId()
        names = [f.name for f in self.schema if f.name != "scene_id"]
        kinds = {"double": "<f8", "float": "<f4", "bigint": "<f8", "int": "<i4", "smallint": "<i2", "tinyint": "i1"}  # the format has no 64-bit integers
        dt = np.dtype([(f.name, kinds[f.dataType.simpleString()]) for f in self.schema if f.name != "scene_id"])
        words = {"<f8": "double", "<f4": "float", "<i4": "int", "<i2": "short", "i1": "char"}
        files, total, held, scene = [], 0, [], None
        text = self.options.get("ascii") == "true"

        def flush():
            nonlocal held, total
            n = sum(len(b) for b in held)
            if not n:
                return
            name = f"scene-{scene}-{attempt}-{len(files)}.ply"
            head = ["ply", f"format {'ascii' if text else 'binary_little_endian'} 1.0", f"comment scene {scene}", f"element vertex {n}"]
            head += [f"property {words[dt[k].str.lstrip('|')]} {k}" for k in names] + ["end_header"]
            with fs.open_output_stream(f"{root.rstrip('/')}/{name}") as fh:
                fh.write(("\n".join(head) + "\n").encode("ascii"))
                for b in held:
                    fh.write("".join(" ".join(map(repr, r)) + "\n" for r in b.tolist()).encode("ascii") if text else b.tobytes())
            files.append(name)
            total += n
            held = []

        for batch in iterator:
            scenes = batch.column("scene_id").to_numpy(zero_copy_only=False) if "scene_id" in batch.schema.names else np.zeros(batch.num_rows, int)
            rows = np.empty(batch.num_rows, dtype=dt)
            for k in names:
                column = batch.column(k)
                if column.null_count:
                    raise ValueError(f"{k}: the format has no nulls")
                values = column.to_numpy(zero_copy_only=False)
                if values.dtype.kind == "i" and dt[k].kind == "f" and len(values) and max(abs(int(values.min())), abs(int(values.max()))) > 1 << 53:
                    raise ValueError(f"{k}: integers beyond 2^53 cannot be kept in a double")
                rows[k] = values
            cuts = np.flatnonzero(np.diff(scenes)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(rows)]):
                if a == b:
                    continue
                if scenes[a] != scene or sum(len(x) for x in held) >= limit:
                    flush()
                    scene = scenes[a]
                held.append(rows[a:b])
        flush()
        return Written(files, total)

    def commit(self, messages):
        fs, root = _filesystem(self.options["path"])
        names = [f for m in messages if m for f in m.files]
        with fs.open_output_stream(root.rstrip("/") + "/_committed.json") as fh:
            fh.write(json.dumps(names).encode())

    def abort(self, messages):
        fs, root = _filesystem(self.options["path"])
        for m in messages:
            for f in m.files if m else []:
                fs.delete_file(f"{root.rstrip('/')}/{f}")


class PlySource(DataSource):
    @classmethod
    def name(cls):
        return "ply"

    def schema(self):
        files = _files(self.options["path"])
        if not files:
            raise ValueError(f"no PLY files under {self.options['path']}")
        h = read_header(files[0][0])
        return StructType([StructField(n, t) for n, t in EXTRA.items()] + [StructField(n, SPARK_OF[k]) for n, k in h.fields])

    def reader(self, schema):
        return PlyReader(schema, self.options)

    def writer(self, schema, overwrite):
        return PlyWriter(schema, self.options, overwrite)


# column order of a splat file: fixed values of the public format
def splat_columns(rest: int) -> list[str]:
    return (["x", "y", "z", "nx", "ny", "nz", "f_dc_0", "f_dc_1", "f_dc_2"] + [f"f_rest_{k}" for k in range(rest)]
            + ["opacity", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3"])


def qualified(spark, path: str) -> str:
    """``path`` with the scheme of the file system that Spark itself would use for it."""
    if re.match(r"^[a-z0-9+.-]+:", path):
        return path
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return re.sub(r"^file:/+", "file:///", full)


def write_table(df: DataFrame, path: str, columns: list[str], **options) -> None:
    """Write scene_id + columns; rows are spread by scene and row so that no scene needs one task. ``ascii="true"`` writes text."""
    df.sparkSession.dataSource.register(PlySource)
    order = [c for c in ("scene_id", "row", "point_id", "splat_id") if c in df.columns]
    df.repartitionByRange(*order).sortWithinPartitions(*order).select("scene_id", *columns).write.format("ply").options(**options).mode("append").save(qualified(df.sparkSession, path))


def read_table(spark, path: str, schema: str | None = None, **options) -> DataFrame:
    """The points under ``path`` (a file or a folder), in two passes; the first one's rows, one for each stretch, pass through the driver."""
    spark.dataSource.register(PlySource)
    path = qualified(spark, path)
    found = spark.read.format("ply").options(**options).option("survey", "true").schema(SURVEY).load(path).collect()
    surveyed = json.dumps(sorted(tuple(r) for r in found), separators=(",", ":"))
    r = spark.read.format("ply").options(**options).option("surveyed", surveyed)
    return (r.schema(schema) if schema else r).load(path)
