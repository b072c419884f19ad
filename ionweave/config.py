"""Search settings, validated once and closed over by the plans."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, fields


@dataclass(frozen=True)
class SearchConfig:
    """All settings of a search; the tolerances have no default."""

    precursor_tolerance_mass: float
    precursor_tolerance_mode: str
    fragment_mz_tolerance: float
    precursor_tolerance_mass_open: float | None = None
    precursor_tolerance_mode_open: str | None = None
    allow_peak_shifts: bool = False
    resolution: int | None = None
    min_mz: float = 11.0
    max_mz: float = 2010.0
    remove_precursor: bool = False
    remove_precursor_tolerance: float = 0.0
    min_intensity: float = 0.01
    min_peaks: int = 10
    min_mz_range: float = 250.0
    max_peaks_used: int = 50
    max_peaks_used_library: int = 50
    scaling: str = "rank"
    fdr: float = 0.01
    fdr_min_group_size: int = 100
    model: str = "rf"
    mode: str = "ann"
    bin_size: float = 0.04
    hash_len: int | None = 800
    num_candidates: int = 1024
    num_list: int = 256
    num_probe: int = 128
    add_decoys: bool = False
    seed: int = 42
    prediction_batch_size: int = 1000
    prediction_server_url: str | None = None
    prediction_model: str | None = None
    min_precursor_charge: int = 2
    max_precursor_charge: int = 3
    collision_energies: tuple[int, ...] = (32,)
    missed_cleavages: int = 2
    protease: str = "trypsin"

    def __post_init__(self) -> None:
        def one_of(name: str, *allowed: object) -> None:
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {allowed}, not {getattr(self, name)!r}")

        one_of("precursor_tolerance_mode", "Da", "ppm")
        one_of("precursor_tolerance_mode_open", None, "Da", "ppm")
        one_of("scaling", "rank", "root", "sqrt", None)
        one_of("model", "rf", "svm", "none")
        one_of("mode", "ann", "bf")
        one_of("protease", "trypsin")
        if not 1 <= self.min_precursor_charge <= self.max_precursor_charge:
            raise ValueError("min_precursor_charge must be positive and not exceed max_precursor_charge")
        if self.prediction_batch_size < 1 or self.missed_cleavages < 0 or not self.collision_energies:
            raise ValueError("prediction settings are out of range")
        if self.num_probe > self.num_list:
            raise ValueError("num_probe must not exceed num_list")

    @property
    def has_open_level(self) -> bool:
        """The open level runs only if both of its settings are given."""
        return self.precursor_tolerance_mass_open is not None and self.precursor_tolerance_mode_open is not None

    def layout_hash(self) -> str:
        """SHA-1 of the settings that fix the layout of vectors and index."""
        keys = ("min_mz", "max_mz", "bin_size", "hash_len", "num_list")
        return hashlib.sha1(json.dumps({k: getattr(self, k) for k in keys}).encode()).hexdigest()

    def processing_hash(self) -> str:
        """SHA-1 of the settings that fix what a processed library holds."""
        keys = ("min_mz", "max_mz", "resolution", "remove_precursor", "remove_precursor_tolerance", "min_intensity", "min_peaks", "min_mz_range", "max_peaks_used_library", "scaling", "add_decoys", "seed", "prediction_model", "min_precursor_charge", "max_precursor_charge", "collision_energies", "missed_cleavages", "protease")
        return hashlib.sha1(json.dumps({k: getattr(self, k) for k in keys}).encode()).hexdigest()

    @classmethod
    def from_pairs(cls, pairs: dict[str, str]) -> SearchConfig:
        """Settings from ``key = value`` texts, as result files and config files hold them."""
        kinds = {f.name: str(f.type) for f in fields(cls)}

        def read(key: str, text: str) -> object:
            text = text.strip()
            if text in ("None", ""):
                return None
            kind = kinds[key]
            if kind.startswith("tuple"):
                return tuple(int(x) for x in re.findall(r"-?\d+", text))
            return text == "True" if kind.startswith("bool") else int(text) if kind.startswith("int") else float(text) if kind.startswith("float") else text

        return cls(**{k: read(k, v) for k, v in pairs.items() if k in kinds})

    def settings(self) -> dict[str, object]:
        return asdict(self)
