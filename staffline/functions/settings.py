"""Class parameters as a table, a session's default class and checked overrides; no global state."""

from __future__ import annotations

import json
import shutil
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import regulations as R

_EACH = tuple(R.NEW_K)
#: fixed values: the parameters of each class, H1 to H6 in order
FIELDS: dict[str, tuple] = {
    "tolerance_coefficient": tuple(R.NEW_K.values()),
    "max_line_length_km": (None, 60.0, 24.0, 10.0, 5.0, 4.0),
    "max_sight_distance_geometric_m": tuple(R.MAX_SIGHT_M.values()),
    "min_staff_clearance_m": (0.5, 0.5, 0.4, 0.4, None, None),
    "min_staff_upper_clearance_m": (0.4, 0.4, 0.3, 0.3, None, None),
    "max_sight_distance_trigonometric_m": (80.0, 80.0, 100.0, 150.0, 150.0, 200.0),
    "required_method": ("BFFB", "BFFB", "BFFB", "BF", "BF", "BF"),
    "min_setups": (2,) * 6,
    "requires_double_run": (True, True, True, True, True, False),
    "max_fb_difference_mm": (None,) * 6,
    "max_single_distance_imbalance_m": tuple(R.SINGLE_IMBALANCE_M.values()),
    "max_cumulative_distance_imbalance_m": tuple(R.TOTAL_IMBALANCE_M.values()),
    "max_instrument_error_mm_per_km": (0.3, 1.0, None, None, None, None),
    "max_days_for_double_run": (30, 30, 30, None, None, None),
    "requires_invar_staff": (True, True, False, False, False, False),
    "requires_staff_supports": (True, True, False, False, False, False),
    "requires_calibration_monthly": (True, True, False, False, False, False),
    "requires_orthometric_correction": (True, True, False, False, False, False),
}
_TYPES = {"required_method": "string", "min_setups": "int", "max_days_for_double_run": "int"} | {f: "boolean" for f in FIELDS if f.startswith("requires_")}
#: fields that a user may change
EDITABLE = (
    "tolerance_coefficient", "max_line_length_km", "max_sight_distance_geometric_m", "max_sight_distance_trigonometric_m", "min_staff_clearance_m", "min_staff_upper_clearance_m",
    "max_single_distance_imbalance_m", "max_cumulative_distance_imbalance_m", "max_instrument_error_mm_per_km", "max_days_for_double_run",
)


@dataclass(frozen=True)
class EngineConfig:
    """default_class 1 to 6; overrides: class -> field -> value. A line length of 0 means no limit; negatives are errors."""

    default_class: int = 3
    overrides: dict[int, dict[str, float]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for cls in (self.default_class, *self.overrides):
            if cls not in R.NEW_K:
                raise ValueError(f"no leveling class {cls!r}")
        for own in self.overrides.values():
            for name, value in own.items():
                if name not in EDITABLE:
                    raise ValueError(f"{name!r} can't be changed")
                if value < 0:
                    raise ValueError(f"{name} is negative")

    def value(self, cls: int, name: str):
        if cls not in R.NEW_K:
            raise ValueError(f"no leveling class {cls!r}")
        v = self.overrides.get(cls, {}).get(name, FIELDS[name][_EACH.index(cls)])
        return None if name == "max_line_length_km" and v == 0 else v

    def of_class(self, name: str, cls: Column) -> Column:
        """The value of a field as a column of the class."""
        out = F.lit(None).cast(_TYPES.get(name, "double"))
        for c in _EACH:
            out = F.when(cls == c, F.lit(self.value(c, name)).cast(_TYPES.get(name, "double"))).otherwise(out)
        return out

    def tolerance(self, distance_m: Column, cls: Column) -> Column:
        """k * sqrt(km) in mm under the session's coefficients."""
        return self.of_class("tolerance_coefficient", cls) * F.sqrt(distance_m / 1000.0)

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per class: class_level, class_name and all fields."""
        rows = [(c, f"H{c}", *(self.value(c, n) for n in FIELDS)) for c in _EACH]
        return spark.createDataFrame(rows, "class_level int, class_name string, " + ", ".join(f"{n} {_TYPES.get(n, 'double')}" for n in FIELDS))

    def save(self, path: str) -> None:
        """Writes the default class and the overrides as JSON on the driver's machine."""
        Path(path).write_text(json.dumps({"default_class": self.default_class, "overrides": {str(c): v for c, v in self.overrides.items()}}, indent=1), encoding="utf-8")

    @classmethod
    def load(cls, path: str) -> "EngineConfig":
        """The saved settings; the defaults if there are none. Raises on fields that can't be changed."""
        if not Path(path).exists():
            return cls()
        raw = json.loads(Path(path).read_text(encoding="utf-8"))
        return cls(int(raw.get("default_class", 3)), {int(c): dict(v) for c, v in raw.get("overrides", {}).items()})

    def info(self) -> dict:
        return {"default_class": self.default_class, "changed_classes": sorted(self.overrides), "changed_fields": sum(len(v) for v in self.overrides.values())}


def backup(path: str, at: str) -> str:
    """Copies saved settings beside themselves; `at` marks the copy."""
    copy = f"{path}.{at}.bak"
    shutil.copyfile(path, copy)
    return copy


def class_by_name(name: str) -> int:
    """`H3`, `h3` or `3` -> 3."""
    text = name.strip().upper().removeprefix("H")
    if not text.isdigit() or int(text) not in R.NEW_K:
        raise ValueError(f"no leveling class {name!r}")
    return int(text)
