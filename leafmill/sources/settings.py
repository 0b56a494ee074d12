"""Runtime settings in a file beside the defaults, and what the engine can do as a row."""

from __future__ import annotations

import json
import os
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from ..config import DEFAULTS, FORMATS, MEDIA, Settings


class SettingsStore:
    """Overrides of the defaults on the driver. A file that can't be read counts as none."""

    def __init__(self, path: str, defaults: Settings = DEFAULTS):
        self.path, self.defaults = path, defaults

    def stored(self) -> dict:
        try:
            with open(self.path, encoding="utf-8") as f:
                found = json.load(f)
        except (OSError, ValueError):
            return {}
        return found if isinstance(found, dict) else {}

    def effective(self) -> Settings:
        return self.defaults.with_overrides(self.stored())

    def update(self, **values: int) -> Settings:
        """Lays values over those that are stored; the file appears whole, and only its owner reads it."""
        bad = [k for k, v in values.items() if k not in self.defaults.__dataclass_fields__ or not isinstance(v, (int, float)) or v < 0]
        if bad:
            raise ValueError(f"no such setting, or not a number: {', '.join(bad)}")
        text = json.dumps(self.stored() | values)
        with open(os.open(f"{self.path}.tmp", os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(f"{self.path}.tmp", self.path)
        return self.effective()

    def reset(self) -> Settings:
        if os.path.exists(self.path):
            os.remove(self.path)
        return self.effective()


def capabilities(spark: SparkSession, settings: Settings = DEFAULTS) -> DataFrame:
    """One row: limits, media types with their engines, and output formats."""
    schema = "limits map<string,double>, engines map<string,string>, formats array<string>"
    limits = {k: float(v) for k, v in asdict(settings).items() if not isinstance(v, bool)}
    return spark.createDataFrame([(limits, {m: e for m, (e, _) in MEDIA.items()}, list(FORMATS))], schema)
