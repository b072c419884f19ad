"""Predicted library spectra: peptides go to a predictor in batches, with retries, and its fragment rows come back as spectra.

A predictor is any picklable callable of a Pandas frame ``peptide, precursor_charge, energy`` (a batch of at most ``batch_size``
rows) to a frame of fragments ``peptide, precursor_charge, energy, mz, intensity, annotation``, a row a fragment: a client of a
prediction server, or a local model. Fragments without intensity are left out, and so are peptides that it doesn't return.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionweave.functions.sequences import MONOISOTOPIC, PROTON, WATER, cleave, precursor_mz
from ionweave.schema import PEAK

Predictor = Callable[[pd.DataFrame], pd.DataFrame]
KEYS = ["peptide", "precursor_charge", "energy"]


def ladder(batch: pd.DataFrame) -> pd.DataFrame:
    """The offline predictor: b and y ions of one charge. Higher energies favour short fragments: intensity ``exp(-energy * index / 1000)``."""
    rows = []
    for peptide, charge, energy in batch[KEYS].itertuples(index=False):
        mass = np.cumsum([MONOISOTOPIC.get(c, 0.0) for c in peptide])
        for i in range(1, len(peptide)):
            level = float(np.exp(-energy * i / 1000))
            rows.append((peptide, charge, energy, mass[i - 1] + PROTON, level, f"b{i}+1"))
            rows.append((peptide, charge, energy, mass[-1] - mass[len(peptide) - i - 1] + WATER + PROTON, level, f"y{i}+1"))
    return pd.DataFrame(rows, columns=[*KEYS, "mz", "intensity", "annotation"])


class Server:
    """A prediction server's client (the ``koinapy`` package, which workers need)."""

    def __init__(self, url: str, model: str):
        self.url, self.model = url, model

    def __call__(self, batch: pd.DataFrame) -> pd.DataFrame:
        from koinapy import Koina

        names = {"peptide": "peptide_sequences", "precursor_charge": "precursor_charges", "energy": "collision_energies"}
        found = Koina(self.model, self.url).predict(batch.rename(columns=names))
        return found.rename(columns={v: k for k, v in names.items()} | {"intensities": "intensity"})


def called(predict: Predictor, batch: pd.DataFrame, tries: int, wait: float) -> pd.DataFrame:
    """The predictor's answer; a failed call is made again after a growing pause, the last failure is raised."""
    for k in range(tries):
        try:
            return predict(batch)
        except Exception:
            if k == tries - 1:
                raise
            time.sleep(wait * 2**k)
    raise ValueError("tries must be positive")


def regrouped(fragments: pd.DataFrame) -> pd.DataFrame:
    """One row a (peptide, charge, energy), its fragments as lists by rising m/z."""
    real = fragments[fragments["intensity"] > 0].sort_values([*KEYS, "mz"], kind="stable")
    return real.groupby(KEYS, sort=False).agg(mz=("mz", list), intensity=("intensity", list), annotation=("annotation", list)).reset_index()


def grid(proteins: DataFrame, charges: tuple[int, ...], energies: tuple[int, ...], missed: int) -> DataFrame:
    """``(peptide, precursor_charge, energy)`` of all distinct peptides of ``proteins(sequence)``."""
    peptides = cleave(proteins, missed=missed).select("peptide")
    return peptides.withColumn("precursor_charge", F.explode(F.array(*map(F.lit, charges)))).withColumn("energy", F.explode(F.array(*map(F.lit, energies))))


def predict_spectra(wanted: DataFrame, predict: Predictor = ladder, batch_size: int = 1000, tries: int = 3, wait: float = 1.0) -> DataFrame:
    """Library spectra of ``wanted(peptide, precursor_charge, energy)``, ids ``peptide/charge/energy``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), batch_size):
                yield regrouped(called(predict, whole.iloc[at : at + batch_size].reset_index(drop=True), tries, wait))

    found = wanted.select(F.col("peptide"), F.col("precursor_charge").cast("int"), F.col("energy").cast("int")).mapInPandas(run, "peptide string, precursor_charge int, energy int, mz array<double>, intensity array<double>, annotation array<string>")
    part = lambda note, k: F.nullif(F.regexp_extract(note, r"^([abcxyz])(\d+)(?:[+^](\d+))?$", k), F.lit(""))
    peak = lambda p: F.struct(p["mz"].alias("mz"), p["intensity"].alias("intensity"), part(p["annotation"], 1).alias("ion_type"), part(p["annotation"], 2).cast("int").alias("ion_index"), part(p["annotation"], 3).cast("int").alias("ion_charge"))
    return found.select(
        F.concat_ws("/", "peptide", "precursor_charge", "energy").alias("id"), F.lit(None).cast("int").alias("source_index"), precursor_mz(F.col("peptide"), F.col("precursor_charge")).alias("precursor_mz"), "precursor_charge",
        F.lit(None).cast("double").alias("retention_time"), "peptide", F.lit(False).alias("is_decoy"), F.transform(F.arrays_zip("mz", "intensity", "annotation"), peak).cast(f"array<{PEAK}>").alias("peaks"),
    )
