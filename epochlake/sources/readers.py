"""Recordings, logs and configuration files as DataFrames."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual


def subjects(paths: DataFrame, path: str = "path") -> DataFrame:
    """Subjects (sub-*) that paths name."""
    return paths.select(F.regexp_extract(path, r"(sub-[0-9A-Za-z]+)", 1).alias("subject")).where("subject != ''").distinct()


def read_table(spark: SparkSession, path: str, schema: T.StructType, required: Sequence[str], fmt: str = "csv") -> DataFrame:
    """A stored table by a declared schema. Columns in ``required`` must be there, and ``task``, where declared but absent,
    comes from the file's name. NaN becomes null."""
    reader = spark.read.option("header", True)
    have = (reader.csv(path) if fmt == "csv" else spark.read.format(fmt).load(path)).columns
    if missing := [c for c in required if c not in have]:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    own = T.StructType([f for f in schema if f.name in have])
    order = T.StructType([own[c] if c in own.names else T.StructField(c, T.StringType()) for c in have])
    df = reader.schema(order).csv(path) if fmt == "csv" else spark.read.format(fmt).load(path)
    if "task" in schema.names and "task" not in have:
        df = df.withColumn("task", F.regexp_extract(F.input_file_name(), r"task-([A-Za-z0-9]+)", 1))
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def write_table(df: DataFrame, path: str, by: Sequence[str] = (), fmt: str = "parquet") -> None:
    df.write.mode("overwrite").partitionBy(*by).format(fmt).option("header", True).save(path)


def log_frames(lines: DataFrame, file: str = "file", number: str = "line_no", line: str = "line") -> DataFrame:
    """A row per frame of experiment logs: (file, frame, fields map). A frame is what stands between its start and end marks.

    Frames are numbered by a running count of start marks of a file, and their lines gathered by that number.
    """
    w = Window.partitionBy(file).orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    start, end = F.col(line).contains("LogFrame Start"), F.col(line).contains("LogFrame End")
    numbered = lines.withColumn("frame", F.sum(start.cast("int")).over(w)).withColumn("ended", F.sum(end.cast("int")).over(w))
    blank = F.lit(" \t\r\ufeff")
    parts = F.split(F.btrim(F.col(line), blank), ":", 2)
    inside = numbered.where((F.col("frame") > F.col("ended")) & ~start & (F.size(parts) == 2))
    entry = F.struct(F.col(number).alias("n"), F.btrim(parts[0], blank).alias("k"), F.btrim(parts[1], blank).alias("v"))
    got = inside.groupBy(file, "frame").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    last = F.aggregate("e", F.create_map().cast("map<string,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["k"]), F.create_map(x["k"], x["v"])))
    return got.select(file, "frame", last.alias("fields"))


def trials(frames: DataFrame, keep: Sequence[str] = ("membase", "regtest")) -> DataFrame:
    """Trials of a recognition experiment: procedure, accuracy, reaction time (0 is none), answer and right answer."""
    f = F.col("fields")
    stim = F.when(f["Procedure"] == "regtest", F.lit("stim2")).otherwise(F.lit("stim1"))
    field = lambda name: f[F.concat(stim, F.lit(f".{name}"))]
    rt = field("RT").try_cast("double")
    out = frames.where(f["Procedure"].isin(*keep) & ~F.coalesce(f["Running"], F.lit("")).contains("prac"))
    return out.select(
        *[c for c in frames.columns if c != "fields"],
        f["Procedure"].alias("procedure"),
        f["marker"].try_cast("int").alias("marker"),
        field("ACC").try_cast("int").alias("acc"),
        F.when(rt != 0, rt).alias("rt"),
        F.when(field("RESP") != "", field("RESP")).alias("resp"),
        field("CRESP").alias("cresp"),
    )


def parse_bins(text: str) -> list[tuple[int, int, str]]:
    """(code, bin, label) of a bin descriptor: groups of a bin's number, its label and its codes in braces."""
    out, number, name = [], None, None
    for line in map(str.strip, text.splitlines()):
        if m := re.fullmatch(r"(?i)bin\s*(\d+)", line):
            number, name = int(m[1]), None
        elif number is not None and name is None and line:
            name = line
        elif number is not None:
            for group in re.findall(r"\{([^}]*)\}", line):
                out += [(int(c), number, name or "") for c in re.findall(r"\d+", group)]
    return out


def parse_equations(text: str) -> dict[str, dict[str, float]]:
    """New channels or bins as weighted sums of old: lines ``name = sum label ...`` with terms such as ``b2 - 0.5*(b1+b3)/2``."""
    out: dict[str, dict[str, float]] = {}
    for line in text.splitlines():
        if m := re.match(r"\s*(\w+)\s*=\s*(.+)", line):
            body = re.sub(r"(?i)\s+label\s+.*$", "", m[2])
            names = sorted(set(re.findall(r"[A-Za-z]\w*", body)))
            at = lambda x: eval_sum(body, dict(zip(names, x, strict=True)))  # noqa: B023, E731
            zero = at([0.0] * len(names))
            out[m[1]] = {n: at([float(n == k) for k in names]) - zero for n in names}
    return out


def eval_sum(text: str, values: dict[str, float]) -> float:
    """Value of an expression of names, numbers, + - * / and parentheses."""
    tokens = re.findall(r"\d+\.?\d*|[A-Za-z]\w*|[-+*/()]", text)
    at = 0

    def peek() -> str:
        return tokens[at] if at < len(tokens) else ""

    def take() -> str:
        nonlocal at
        at += 1
        return tokens[at - 1]

    def factor() -> float:
        t = take()
        if t == "-":
            return -factor()
        if t == "+":
            return factor()
        if t == "(":
            v = total()
            take()
            return v
        return values[t] if t in values else float(t)

    def product() -> float:
        v = factor()
        while peek() in ("*", "/"):
            v = v * factor() if take() == "*" else v / factor()
        return v

    def total() -> float:
        v = product()
        while peek() in ("+", "-"):
            v = v + product() if take() == "+" else v - product()
        return v

    return total()


def edf_header(data: bytes) -> dict:
    """Header of a European Data Format file: fixed widths of ASCII."""
    text = data[:256].decode("latin-1")
    n = int(text[252:256])
    rest, at = data[256 : 256 * (n + 1)].decode("latin-1"), 0
    out: dict = {"records": int(text[236:244]), "seconds": float(text[244:252]), "n": n, "size": int(text[184:192])}
    for name, width in (("label", 16), ("transducer", 80), ("unit", 8), ("pmin", 8), ("pmax", 8), ("dmin", 8), ("dmax", 8), ("filter", 80), ("samples", 8), ("reserved", 32)):
        out[name] = [rest[at + i * width : at + (i + 1) * width].strip() for i in range(n)]
        at += n * width
    for name in ("pmin", "pmax", "dmin", "dmax"):
        out[name] = [float(x) for x in out[name]]
    out["samples"] = [int(x) for x in out["samples"]]
    return out


def edf_channels(data: bytes) -> Iterator[tuple[str, float, np.ndarray]]:
    """(label, rate, values in physical units) of each signal."""
    h = edf_header(data)
    per = sum(h["samples"])
    raw = np.frombuffer(data[h["size"] : h["size"] + 2 * per * h["records"]], "<i2")
    raw = raw[: len(raw) // per * per].reshape(-1, per)
    at = 0
    for i in range(h["n"]):
        k = h["samples"][i]
        scale = (h["pmax"][i] - h["pmin"][i]) / (h["dmax"][i] - h["dmin"][i])
        yield h["label"][i], k / h["seconds"], (raw[:, at : at + k].ravel() - h["dmin"][i]) * scale + h["pmin"][i]
        at += k


def edf_bytes(signals: Sequence[tuple[str, np.ndarray]], per_record: int = 1, seconds: float = 1.0) -> bytes:
    """A file of (label, 16-bit numbers) signals of one length, in records of ``per_record`` samples; what doesn't fill a record
    is left out. Physical values are the numbers themselves."""
    n, records = len(signals), len(signals[0][1]) // per_record if signals else 0
    head = [("0", 8), ("", 80), ("", 80), ("01.01.24", 8), ("00.00.00", 8), (str(256 * (n + 1)), 8), ("", 44), (str(records), 8), (f"{seconds:g}", 8), (str(n), 4)]
    same = (("", 80), ("", 8), ("-32768", 8), ("32767", 8), ("-32768", 8), ("32767", 8), ("", 80), (str(per_record), 8), ("", 32))
    head += [(label, 16) for label, _ in signals] + [field for field in same for _ in signals]
    data = [np.asarray(v, "<i2")[: records * per_record].reshape(records, per_record) for _, v in signals]
    return "".join(f"{text:<{width}.{width}}" for text, width in head).encode("latin-1") + (np.concatenate(data, 1).tobytes() if data else b"")


#: Samples of a batch that a reader passes on.
BLOCK = 200_000


def sample_batches(t: np.ndarray, values: np.ndarray, first: int = 0, **of: pa.Scalar) -> Iterator[pa.RecordBatch]:
    """A channel's samples in batches, numbered from ``first``, with columns ``of`` of the whole channel before them."""
    for at in range(0, len(values), BLOCK):
        part = np.ascontiguousarray(values[at : at + BLOCK], np.float64)
        columns = {c: pa.repeat(v, len(part)) for c, v in of.items()}
        columns |= {"idx": pa.array(np.arange(first + at, first + at + len(part))), "t": pa.array(t[at : at + BLOCK], pa.float64()), "value": pa.array(part)}
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def edf_batches(path: str, data: bytes) -> Iterator[pa.RecordBatch]:
    for label, rate, values in edf_channels(data):
        yield from sample_batches(np.arange(len(values)) / rate, values, path=pa.scalar(path, pa.string()), channel=pa.scalar(label, pa.string()))


def edf_samples(files: DataFrame) -> DataFrame:
    """(path, channel, idx, t, value) of files as Spark's ``binaryFile`` reads them, wherever they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*batch.columns, strict=True):
                yield from edf_batches(path.as_py(), content.as_py())

    return files.select("path", "content").mapInArrow(run, "path string, channel string, idx bigint, t double, value double")


def opened(path: str):
    """(file system, path in it) of a local path, or of one that its scheme names."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


@dataclass
class EdfPart(InputPartition):
    """Bytes of a file; the records that begin in them are read."""

    path: str
    begin: int
    end: int


def edf_part(file, path: str, begin: int, end: int, channels: set[str] | None = None, since: float = -math.inf, until: float = math.inf) -> Iterator[pa.RecordBatch]:
    """Samples of the records of ``file`` that begin in ``begin`` to before ``end``: of ``channels`` only, if given, and of records
    that reach into ``since`` to ``until`` seconds. Where a few of many signals are asked for, only their bytes are read."""
    file.seek(0)
    head = file.read(256)
    h = edf_header(head + file.read(int(head[184:192]) - 256))
    per = sum(h["samples"])
    first = max(0, -(-(begin - h["size"]) // (2 * per))) if per else 0
    last = min(h["records"], -(-(end - h["size"]) // (2 * per))) if per else 0
    if h["seconds"] > 0:
        first = max(first, math.floor(max(0.0, since) / h["seconds"]))
        last = last if until == math.inf else min(last, math.floor(max(-1.0, until) / h["seconds"]) + 1)
    starts = np.r_[0, np.cumsum(h["samples"])]
    asked = [i for i in range(h["n"]) if channels is None or h["label"][i] in channels]
    if first >= last or not asked:
        return
    step = max(1, 4 * BLOCK // max(1, max(h["samples"][i] for i in asked)))
    few = 4 * sum(h["samples"][i] for i in asked) < per
    for at in range(first, last, step):
        n = min(step, last - at)
        place = h["size"] + 2 * per * at
        if few:
            parts: dict[int, list[np.ndarray]] = {i: [] for i in asked}
            for r in range(n):
                for i in asked:
                    file.seek(place + 2 * (per * r + int(starts[i])))
                    parts[i].append(np.frombuffer(file.read(2 * h["samples"][i]), "<i2"))
            data = {i: np.concatenate(v) for i, v in parts.items()}
        else:
            file.seek(place)
            raw = np.frombuffer(file.read(2 * per * n), "<i2")
            raw = raw[: len(raw) // per * per].reshape(-1, per)
            data = {i: raw[:, starts[i] : starts[i + 1]].ravel() for i in asked}
        for i in asked:
            k = h["samples"][i]
            scale = (h["pmax"][i] - h["pmin"][i]) / (h["dmax"][i] - h["dmin"][i])
            values = (data[i] - h["dmin"][i]) * scale + h["pmin"][i]
            of = {"path": pa.scalar(path, pa.string()), "channel": pa.scalar(h["label"][i], pa.string())}
            yield from sample_batches(np.arange(at * k, at * k + len(values)) / (k / h["seconds"]), values, first=at * k, **of)


class EdfSource(DataSource):
    """``spark.read.format("edf").option("path", folder or file)``, on a mounted file system or one that the path's scheme names.

    A file is read by many tasks, each the records that begin in its bytes (option ``bytes``, 16 MB). With the option ``filters``
    set to true, filters on channel and t are taken by the reader: other channels' bytes and other times' records aren't read
    then. Spark asks for ``spark.sql.python.filterPushdown.enabled`` with it.
    """

    @classmethod
    def name(cls) -> str:
        return "edf"

    def schema(self) -> str:
        return "path string, channel string, idx bigint, t double, value double"

    def reader(self, schema) -> DataSourceReader:
        return (EdfFilters if self.options.get("filters", "").lower() == "true" else EdfReader)(self.options)


class EdfReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.bytes = int(options.get("bytes", 16 << 20))
        self.channels: set[str] | None = None
        self.since, self.until = -math.inf, math.inf

    def files(self, *endings: str) -> list[tuple[str, int]]:
        from pyarrow import fs

        system, path = opened(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.File:
            return [(self.path, info.size)]
        found = system.get_file_info(fs.FileSelector(path, recursive=True))
        return sorted((self.path.rstrip("/") + f.path.removeprefix(path.rstrip("/")), f.size) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(endings))

    def partitions(self) -> list[InputPartition]:
        return [EdfPart(path, at, min(size, at + self.bytes)) for path, size in self.files(".edf") for at in range(0, size, self.bytes)]

    def read(self, partition: EdfPart):
        system, path = opened(partition.path)
        with system.open_input_file(path) as f:
            yield from edf_part(f, partition.path, max(0, partition.begin), partition.end, self.channels, self.since, self.until)


class EdfFilters(EdfReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("channel",) and isinstance(f, (EqualTo, In)):
                asked = set(f.value) if isinstance(f, In) else {f.value}
                self.channels = asked if self.channels is None else self.channels & asked
            elif column == ("t",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.since = max(self.since, f.value)
                yield f  # records are taken whole: Spark cuts within them
            elif column == ("t",) and isinstance(f, (LessThan, LessThanOrEqual)):
                self.until = min(self.until, f.value)
                yield f
            else:
                yield f


class SnirfSource(DataSource):
    """``spark.read.format("snirf")``: needs the optional h5py package."""

    @classmethod
    def name(cls) -> str:
        return "snirf"

    def schema(self) -> str:
        return "path string, channel int, src int, det int, wl int, idx bigint, t double, value double"

    def reader(self, schema) -> DataSourceReader:
        return SnirfReader(self.options)


class SnirfReader(EdfReader):
    def partitions(self) -> list[InputPartition]:
        return [InputPartition(path.removeprefix("file://")) for path, _ in self.files(".snirf")]

    def read(self, partition):
        import h5py

        with h5py.File(partition.value) as f:
            data = f["nirs/data1"]
            t, v = np.asarray(data["time"]).ravel(), data["dataTimeSeries"]
            turned = v.shape[0] != len(t)
            for k in range(v.shape[0 if turned else 1]):
                m = data[f"measurementList{k + 1}"]
                src, det, wl = (pa.scalar(int(np.asarray(m[x]).ravel()[0]), pa.int32()) for x in ("sourceIndex", "detectorIndex", "wavelengthIndex"))
                values = np.asarray(v[k, :] if turned else v[:, k])
                yield from sample_batches(t, values, path=pa.scalar(partition.value, pa.string()), channel=pa.scalar(k + 1, pa.int32()), src=src, det=det, wl=wl)


def register(spark: SparkSession) -> None:
    for source in (EdfSource, SnirfSource):
        spark.dataSource.register(source)
