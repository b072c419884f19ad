"""Spectra from mzML, mzXML and the binary splib library.

mzML and mzXML files are cut by Spark's text reader at the ends (starts) of spectra, so a file is read by as many tasks as it has
byte ranges; a record is one spectrum's element, parsed by itself. Places in a file come from the counts of its ranges.

A splib file has no marks to find a spectrum from the middle. Its offset table (id, position, size) is made once by a scan in
bounded memory; after that spectra are read by position: whole libraries in ranges over many tasks, some ids by seeks
that read no more than their spectra. Files are opened by path or URI (``pyarrow.fs``), so tasks must reach them.
"""

from __future__ import annotations

import base64
import re
import struct
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave.schema import PEAK, SPECTRUM
from ionweave.sources import versions
from ionweave.sources.export import ROWS, by_rows

_ROWS = "id string, source_index int, precursor_mz double, precursor_charge int, retention_time double, peptide string, is_decoy boolean, mz array<double>, intensity array<double>, ion array<string>"
_TYPES = {
    "id": pa.string(), "source_index": pa.int32(), "precursor_mz": pa.float64(), "precursor_charge": pa.int32(), "retention_time": pa.float64(), "peptide": pa.string(), "is_decoy": pa.bool_(), "mz": pa.list_(pa.float64()),
    "intensity": pa.list_(pa.float64()), "ion": pa.list_(pa.string()), "file": pa.string(), "start": pa.int64(),
}
WINDOW = 1 << 22  # bytes read at a time by a scan
GAP = 1 << 16  # bytes between two wanted spectra that are read over instead of sought


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["id", "source_index", "precursor_mz", "precursor_charge", "retention_time", "peptide", "is_decoy", "mz", "intensity", "ion"]).astype({"source_index": "Int32", "precursor_charge": "Int32", "precursor_mz": "Float64", "retention_time": "Float64"})


def _spectra(raw: DataFrame, *more: str) -> DataFrame:
    """Parsed rows in the schema of spectra, and ``more`` columns."""
    from ionweave.functions.sequences import fragment_annotation

    note = lambda p: fragment_annotation(p["ion"])
    zipped = F.arrays_zip("mz", "intensity", "ion")
    peak = lambda p: F.struct(p["mz"].alias("mz"), p["intensity"].alias("intensity"), note(p)["ion_type"].alias("ion_type"), note(p)["ion_index"].alias("ion_index"), note(p)["charge"].alias("ion_charge"))
    return raw.select(*[c for c in SPECTRUM.names if c != "peaks"], F.array_sort(F.transform(zipped, peak)).cast(f"array<{PEAK}>").alias("peaks"), *more)


def _elements(spark: SparkSession, path: str, separator: str, mark: str, parse) -> DataFrame:
    """Spectra of the records between separators that hold ``mark``; their index counts from 0 in each file."""
    raw = spark.read.option("lineSep", separator).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")).where(F.col("value").contains(mark))
    ranges = raw.groupBy("file", "start").agg(F.count("*").alias("n"))
    before = ranges.groupBy("file").agg(F.collect_list(F.struct("start", "n")).alias("all"))  # a row a byte range

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, place = None, 0
        for b in by_rows(batches, ROWS):
            rows, keys = [], []
            for value, file, start in zip(*(c.to_pylist() for c in b.columns)):
                at, place = (file, start), place + 1 if at == (file, start) else 0
                row = parse(value)
                if row is not None:
                    rows.append((row[0], place, *row[1:]))
                    keys.append((file, start))
            columns = list(zip(*(r + k for r, k in zip(rows, keys)))) or [()] * len(_TYPES)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _TYPES.values())], list(_TYPES))

    parsed = raw.mapInArrow(run, f"{_ROWS}, file string, start long").join(F.broadcast(before), "file")  # a row a byte range of files
    earlier = F.aggregate(F.filter("all", lambda p: p["start"] < F.col("start")), F.lit(0).cast("long"), lambda a, p: a + p["n"])
    placed = parsed.withColumn("source_index", (F.col("source_index") + earlier).cast("int"))
    return _spectra(placed.withColumn("id", F.coalesce("id", F.col("source_index").cast("string"))))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2].rpartition(":")[2]


def _numbers(text: str, wide: bool, packed: bool, order: str = "<") -> list[float]:
    data = base64.b64decode(text or "")
    data = zlib.decompress(data) if packed else data
    size = 8 if wide else 4
    return list(struct.unpack(f"{order}{len(data) // size}{'d' if wide else 'f'}", data))


def parse_mzml(record: str) -> tuple | None:
    """An MS2 spectrum element, which ends with the record; None for others and for those that cannot be read."""
    try:
        node = ET.fromstring(record[record.rindex("<spectrum ") :] + "</spectrum>")
        own = {p.get("name"): p.get("value") for p in node if _local(p.tag) == "cvParam"}
        if own.get("ms level") != "2":
            return None
        deep = {p.get("name"): p for p in node.iter() if _local(p.tag) == "cvParam"}
        value = lambda name: deep[name].get("value") if name in deep else None
        arrays = {}
        for a in node.iter():
            if _local(a.tag) == "binaryDataArray":
                kinds = {p.get("name") for p in a if _local(p.tag) == "cvParam"}
                data = next((b.text for b in a if _local(b.tag) == "binary"), "")
                key = "mz" if "m/z array" in kinds else "intensity" if "intensity array" in kinds else None
                if key:
                    arrays[key] = _numbers(data, "64-bit float" in kinds, "zlib compression" in kinds)
        found = re.search(r"(?:scan|index)=(\d+)", node.get("id", ""))
        charge = value("charge state") or value("possible charge state")
        time = deep.get("scan start time")
        rt = float(time.get("value")) * (60 if time.get("unitName") == "minute" else 1) if time is not None else None
        return found and found.group(1), float(value("selected ion m/z")), int(charge) if charge else None, rt, None, False, arrays["mz"], arrays["intensity"], [None] * len(arrays["mz"])
    except (KeyError, TypeError, ValueError, zlib.error, struct.error, ET.ParseError):
        return None


_SCAN = re.compile(r"^[^<]*?>")
_OWN = re.compile(r"<(?:\w+:)?(precursorMz|peaks)\b([^>]*?)(/?)>([^<]*)")


def parse_mzxml(record: str) -> tuple | None:
    """An MS2 scan from what follows ``<scan``, up to the next scan, which may lie inside it."""
    try:
        attributes = lambda text: dict(re.findall(r'([\w:]+)\s*=\s*"([^"]*)"', text))
        own = attributes(_SCAN.match(record).group(0))
        if own.get("msLevel") != "2":
            return None
        part = {m[1]: (attributes(m[2]), m[4]) for m in _OWN.finditer(record)}
        (kind, data), (about, mz) = part["peaks"], part["precursorMz"]
        flat = _numbers(data, kind.get("precision") == "64", kind.get("compressionType") == "zlib", ">")
        rt = re.fullmatch(r"PT([\d.]+)S", own.get("retentionTime", ""))
        charge = about.get("precursorCharge")
        return own.get("num"), float(mz), int(charge) if charge else None, float(rt.group(1)) if rt else None, None, False, flat[::2], flat[1::2], [None] * (len(flat) // 2)
    except (AttributeError, KeyError, TypeError, ValueError, zlib.error, struct.error):
        return None


def open_file(path: str):
    """A file by path or URI, for reads at any place."""
    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


_ANNOTATION = re.compile(r"([aby])(\d+)(?:\^(\d+))?(?=/|$)")


def strict_annotation(note: str) -> tuple[str, int, int] | None:
    """(ion type, index, charge) of an unmodified a, b or y ion; None for losses, isotopes and everything else."""
    m = _ANNOTATION.match(note)
    return (m[1], int(m[2]), int(m[3] or 1)) if m else None


class _Short(Exception):
    """The buffer ends inside a spectrum."""


def splib_spectrum(data: bytes, at: int) -> tuple[tuple, int]:
    """(row, end) of the spectrum that starts at a place of ``data``: id, name line, precursor m/z, status line, peaks with two lines each, comment."""

    def line(at: int) -> tuple[str, int]:
        end = data.find(b"\n", at)
        if end < 0:
            raise _Short
        return data[at:end].decode("latin-1").rstrip("\r"), end + 1

    try:
        (number,) = struct.unpack_from("<i", data, at)
        name, at = line(at + 4)
        (mz,) = struct.unpack_from("<d", data, at)
        _, at = line(at + 8)
        (n,) = struct.unpack_from("<i", data, at)
        at += 4
        mzs, intensities, ions = [], [], []
        for _ in range(n):
            m, i = struct.unpack_from("<dd", data, at)
            note, at = line(at + 16)
            _, at = line(at)
            mzs.append(m)
            intensities.append(i)
            ions.append(note if strict_annotation(note) else None)
        comment, at = line(at)
    except struct.error as e:
        raise _Short from e
    peptide, _, charge = name.partition(".")[2].rpartition("/") if "." in name else name.rpartition("/")
    return (str(number), number, mz, int(charge.split()[0]), None, peptide.rpartition(".")[0] or peptide, " Remark=DECOY_" in comment, mzs, intensities, ions), at


def scan_splib(path: str, window: int = WINDOW) -> Iterator[tuple[int, int, int]]:
    """(id, position, size) of all spectra of a file; holds a window and one spectrum at a time."""
    with open_file(path) as f:
        data, base, at, lines = b"", 0, 8, None  # two version numbers first

        def more() -> bool:
            nonlocal data, base, at
            fresh = f.read(window)
            data, base, at = data[at:] + fresh, base + at, 0
            return bool(fresh)

        data = f.read(window)
        while lines is None or lines > 0:  # the file's own name, the number of comment lines, the lines
            end = data.find(b"\n", at)
            if end < 0 or end + 5 > len(data):
                if more():
                    continue
                return
            at, lines = end + 1, lines and lines - 1
            if lines is None:
                (lines,) = struct.unpack_from("<i", data, at)
                at += 4
        while True:
            try:
                row, end = splib_spectrum(data, at)
            except _Short:
                if more():
                    continue
                return
            yield row[1], base + at, end - at
            at = end


def splib_offsets(spark: SparkSession, path: str, store: str | None = None) -> DataFrame:
    """``(file, id, position, size)`` of a library, from its store if that is of these files, else by one scan of each file."""
    mark = versions.source_mark(spark, path)
    names = [str(r[0]) for r in spark.read.format("binaryFile").load(path).select("path").collect()]  # names of files

    def write(at: str) -> None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for name in b.column(0).to_pylist():
                    rows = []
                    for row in scan_splib(name):
                        rows.append(row)
                        if len(rows) == 50_000:
                            yield batch(name, rows)
                            rows = []
                    yield batch(name, rows)

        def batch(name: str, rows: list) -> pa.RecordBatch:
            ids, at, size = zip(*rows) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array(ids, pa.int64()), pa.array(at, pa.int64()), pa.array(size, pa.int64())], ["file", "id", "position", "size"])

        files = spark.createDataFrame([(n,) for n in names], "file string").repartition(max(1, len(names)), "file")
        files.mapInArrow(run, "file string, id long, position long, size long").write.parquet(at)

    return spark.read.parquet(versions.build_or_open(spark, store or f"{path.rstrip('/')}.offsets", {"source": mark}, write))


def read_splib_at(offsets: DataFrame, tasks: int | None = None) -> DataFrame:
    """The spectra of ``offsets(file, id, position, size)``, read by seeks; neighbours are read together. ``bytes`` says what a spectrum's read took."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        handle, name = None, None
        for pdf in batches:
            pdf = pdf.sort_values(["file", "position"])
            rows, took = [], []
            start, held = 0, b""
            for file, position, size in zip(pdf["file"], pdf["position"], pdf["size"]):
                if file != name:
                    handle, name, held = open_file(file), file, b""
                cost = 0
                if not (held and start <= position and position + size <= start + len(held)):
                    near = pdf[(pdf["file"] == file) & (pdf["position"] >= position) & (pdf["position"] < position + WINDOW)]
                    end = position + size
                    for p, n in zip(near["position"], near["size"]):
                        if p > end + GAP:
                            break
                        end = max(end, p + n)
                    start, held = position, handle.read_at(end - position, position)
                    cost = len(held)
                rows.append(splib_spectrum(held, position - start)[0])
                took.append(cost)
            out = _frame(rows)
            out["bytes"] = took
            yield out

    n = tasks or int(offsets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = offsets.select("file", "position", "size").repartitionByRange(n, "file", "position")
    return _spectra(dealt.mapInPandas(run, f"{_ROWS}, bytes long"), "bytes")


def read_mzml(spark: SparkSession, path: str) -> DataFrame:
    return _elements(spark, path, "</spectrum>", "<spectrum ", parse_mzml)


def read_mzxml(spark: SparkSession, path: str) -> DataFrame:
    return _elements(spark, path, "<scan ", "msLevel", parse_mzxml)


def read_splib(spark: SparkSession, path: str) -> DataFrame:
    """All spectra, in ranges of the offset table."""
    return read_splib_at(splib_offsets(spark, path)).drop("bytes")


def read_splib_ids(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """The spectra of ``ids(id)``: nothing else of the file is read, but for gaps of less than ``GAP`` bytes."""
    wanted = splib_offsets(spark, path).join(ids.select(F.col("id").cast("long").alias("id")).distinct(), "id", "left_semi")
    return read_splib_at(wanted)
