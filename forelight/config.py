"""Settings: an explicit value, else the config file's, else the environment's, else the default."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields

from pyspark.sql import SparkSession

PREFIX = "FORELIGHT_"


@dataclass
class Config:
    """Sections of a TOML file. Names in the environment are ``FORELIGHT_<SECTION>_<KEY>``."""

    sections: dict = field(default_factory=dict)
    env: dict = field(default_factory=lambda: dict(os.environ))

    @classmethod
    def load(cls, spark: SparkSession, path: str | None = None) -> Config:
        """From wherever Spark reads; without a path, only the environment and defaults."""
        if path is None:
            return cls()
        return cls(tomllib.loads(spark.read.text(path, wholetext=True).first()["value"]))

    def pick(self, explicit, section: str, key: str, default=None):
        if explicit is not None:
            return explicit
        if key in self.sections.get(section, {}):
            return self.sections[section][key]
        told = self.env.get(f"{PREFIX}{section}_{key}".upper())
        return default if told is None else _like(told, default)

    def fill(self, section: str, spec: type, **explicit):
        """A dataclass whose fields are picked one by one."""
        defaults = spec()
        return spec(**{f: self.pick(explicit.get(f), section, f, getattr(defaults, f)) for f in (x.name for x in fields(spec))})


def _like(text: str, default):
    """Text from the environment as the default's type."""
    if isinstance(default, bool):
        if text.lower() not in ("1", "true", "yes", "0", "false", "no"):
            raise ValueError(f"neither true nor false: {text!r}")
        return text.lower() in ("1", "true", "yes")
    return type(default)(text) if isinstance(default, int | float) else text
