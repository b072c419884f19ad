"""Schemas of the engine's tables."""

from pyspark.sql import types as T

PEAK_TYPE = T.StructType().add("mz", "double").add("intensity", "double").add("ion_type", "string").add("ion_index", "integer").add("ion_charge", "integer")
PEAK = PEAK_TYPE.simpleString()
SPECTRUM = (
    T.StructType().add("id", "string").add("source_index", "integer").add("precursor_mz", "double").add("precursor_charge", "integer")
    .add("retention_time", "double").add("peptide", "string").add("is_decoy", "boolean").add("peaks", T.ArrayType(PEAK_TYPE))
)
MZTAB = (
    "sequence PSM_ID accession unique database database_version search_engine search_engine_score[1] search_engine_score[2] modifications retention_time charge exp_mass_to_charge calc_mass_to_charge spectra_ref pre post start end "
    "opt_ms_run[1]_cv_MS:1003062_spectrum_index opt_ms_run[1]_cv_MS:1002217_decoy_peptide opt_ms_run[1]_num_candidates"
).split()
