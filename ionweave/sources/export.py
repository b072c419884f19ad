"""Spectra written as MGF, mzML, mzXML, sptxt and splib files, a complete file from each partition.

Spectra have ``id, precursor_mz, precursor_charge, retention_time, peptide, is_decoy, peaks``; texts of numbers give the same doubles back.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


ROWS = 256  # spectra that are Python objects at a time


def by_rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``size`` rows."""
    for b in batches:
        for at in range(0, b.num_rows, size):
            yield b.slice(at, size)


def _line(name: str, value: Column) -> Column:
    """``name=value``, left out if the value is null."""
    return F.concat(F.lit(f"{name}="), value.cast("string"))


def _peak_lines(separator: str, *more) -> Column:
    text = lambda p: F.concat_ws(separator, p["mz"].cast("string"), p["intensity"].cast("string"), *[f(p) for f in more])
    return F.array_join(F.transform("peaks", text), "\n")


def write_mgf(spectra: DataFrame, path: str) -> None:
    block = F.concat_ws(
        "\n", F.lit("BEGIN IONS"), _line("TITLE", F.col("id")), _line("PEPMASS", F.col("precursor_mz")), F.concat(_line("CHARGE", F.col("precursor_charge")), F.lit("+")), _line("RTINSECONDS", F.col("retention_time")),
        _line("SEQ", F.col("peptide")), F.when(F.col("is_decoy"), F.lit("DECOY=1")), F.when(F.size("peaks") > 0, _peak_lines(" ")), F.lit("END IONS\n"),
    )
    spectra.select(block).write.mode("overwrite").text(path)


def write_sptxt(spectra: DataFrame, path: str) -> None:
    """A text library; peaks carry ``?`` or their ion. Peptides are plain letters."""
    ion = lambda p: F.coalesce(F.concat(p["ion_type"], p["ion_index"].cast("string"), F.when(p["ion_charge"] > 1, F.concat(F.lit("^"), p["ion_charge"].cast("string"))).otherwise(F.lit("")), F.lit("/0.0")), F.lit("?"))
    block = F.concat_ws(
        "\n", F.concat(F.lit("Name: "), "peptide", F.lit("/"), F.col("precursor_charge").cast("string")), F.concat(F.lit("PrecursorMZ: "), F.col("precursor_mz").cast("string")),
        F.concat(F.lit("Comment: Title="), F.col("id").cast("string"), F.when(F.col("is_decoy"), F.lit(" Remark=DECOY_")).otherwise(F.lit(""))), F.concat(F.lit("NumPeaks: "), F.size("peaks").cast("string")), F.when(F.size("peaks") > 0, _peak_lines("\t", ion)), F.lit(""),
    )
    spectra.select(block).write.mode("overwrite").text(path)


def _rows(spectra: DataFrame) -> DataFrame:
    part = lambda n: F.transform("peaks", lambda p: p[n].cast("double")).alias(n)
    return spectra.select(F.col("id").cast("string").alias("id"), "precursor_mz", "precursor_charge", F.col("retention_time").cast("double").alias("retention_time"), part("mz"), part("intensity"))


def _files(rows: DataFrame, path: str, head: str, one, tail: str) -> None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"value": [head]})
        place = 0
        for b in by_rows(batches, ROWS):
            yield pa.RecordBatch.from_pydict({"value": [one(place + k, r) for k, r in enumerate(b.to_pandas().itertuples(index=False))]})
            place += b.num_rows
        yield pa.RecordBatch.from_pydict({"value": [tail]})

    rows.mapInArrow(run, "value string").write.mode("overwrite").text(path)


def write_mzml(spectra: DataFrame, path: str) -> None:
    def one(k: int, r) -> str:
        cv = lambda n, v="", u="": f'<cvParam name="{n}" value="{v}"{u}/>'
        array = lambda v, kind: f'<binaryDataArray>{cv("64-bit float")}{cv("no compression")}{cv(kind)}<binary>{base64.b64encode(struct.pack(f"<{len(v)}d", *v)).decode()}</binary></binaryDataArray>'
        charge = "" if pd.isna(r.precursor_charge) else cv("charge state", int(r.precursor_charge))
        time = "" if pd.isna(r.retention_time) else "<scanList><scan>" + cv("scan start time", repr(float(r.retention_time)), ' unitName="second"') + "</scan></scanList>"
        return f'<spectrum index="{k}" id="scan={r.id}" defaultArrayLength="{len(r.mz)}">{cv("ms level", 2)}{time}<precursorList><precursor><selectedIonList><selectedIon>{cv("selected ion m/z", repr(float(r.precursor_mz)))}{charge}</selectedIon></selectedIonList></precursor></precursorList><binaryDataArrayList>{array(r.mz, "m/z array")}{array(r.intensity, "intensity array")}</binaryDataArrayList></spectrum>'

    _files(_rows(spectra), path, '<?xml version="1.0"?><mzML xmlns="http://psi.hupo.org/ms/mzml"><run><spectrumList>', one, "</spectrumList></run></mzML>")


def write_mzxml(spectra: DataFrame, path: str) -> None:
    def one(k: int, r) -> str:
        flat = [x for pair in zip(r.mz, r.intensity) for x in pair]
        charge = "" if pd.isna(r.precursor_charge) else f' precursorCharge="{int(r.precursor_charge)}"'
        time = "" if pd.isna(r.retention_time) else f' retentionTime="PT{float(r.retention_time)!r}S"'
        return f'<scan num="{r.id}" msLevel="2"{time}><precursorMz{charge}>{float(r.precursor_mz)!r}</precursorMz><peaks precision="64" byteOrder="network">{base64.b64encode(struct.pack(f">{len(flat)}d", *flat)).decode()}</peaks></scan>'

    _files(_rows(spectra), path, '<?xml version="1.0"?><mzXML><msRun>', one, "</msRun></mzXML>")


def splib_bytes(rows) -> Iterator[bytes]:
    """A binary library of ``(id, peptide, charge, precursor m/z, decoy, [(m/z, intensity, note)])``, piece by piece."""
    yield struct.pack("<ii", 4, 0) + b"library.splib\n" + struct.pack("<i", 1) + b"made from spectra\n"
    for number, peptide, charge, mz, decoy, peaks in rows:
        body = b"".join(struct.pack("<dd", m, i) + f"{note}\n\n".encode() for m, i, note in peaks)
        yield struct.pack("<i", number) + f"X.{peptide}.X/{charge}\n".encode() + struct.pack("<d", mz) + b"Normal\n" + struct.pack("<i", len(peaks)) + body + f"Mods=0{' Remark=DECOY_x' if decoy else ''}\n".encode()


def write_splib(spectra: DataFrame, folder: str) -> None:
    """A binary library file from each partition, under ``folder``; ids are whole numbers."""
    from pyarrow import fs

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, inner = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        system.create_dir(inner, recursive=True)
        name = f"{inner}/part-{context.partitionId():05d}.splib"
        with system.open_output_stream(f"{name}.{context.taskAttemptId()}.tmp") as out:
            rows = (r for pdf in batches for r in pdf.itertuples(index=False))
            for piece in splib_bytes((int(r.id), r.peptide, int(r.precursor_charge), float(r.precursor_mz), bool(r.is_decoy), list(zip(r.mz, r.intensity, r.note))) for r in rows):
                out.write(piece)
        system.move(f"{name}.{context.taskAttemptId()}.tmp", name)  # a repeated task replaces its own file
        yield pd.DataFrame({"file": [name]})

    note = F.transform("peaks", lambda p: F.coalesce(F.concat(p["ion_type"], p["ion_index"].cast("string"), F.lit("/0.0")), F.lit("?")))
    part = lambda n: F.transform("peaks", lambda p: p[n].cast("double")).alias(n)
    rows = spectra.select("id", "peptide", "precursor_charge", "precursor_mz", "is_decoy", part("mz"), part("intensity"), note.alias("note"))
    rows.mapInPandas(run, "file string").count()
