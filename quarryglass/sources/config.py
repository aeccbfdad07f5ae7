"""Settings from YAML, with defaults and checks."""

from __future__ import annotations

import copy
from pathlib import Path
from typing import Any

# Names of settings, their defaults, and what they may be.
DEFAULTS: dict[str, Any] = {
    "ml": {"batch_size": 8, "min_confidence": 0.6, "precision": "fp32"},
    "deduplication": {"hash_algorithm": "sha256", "keep_strategy": "highest_quality", "perceptual_threshold": 8},
    "naming": {"pattern": "{datetime}_{tags}", "max_filename_length": 200},
    "formats": {"photo": "jpg", "graphic": "png", "jpeg_quality": 95, "png_compression": 6},
    "report": {"format": "json"},
}
CHECKS = {
    "ml.batch_size": lambda x: 1 <= x <= 64,
    "ml.min_confidence": lambda x: 0 <= x <= 1,
    "ml.precision": lambda x: x in ("fp16", "fp32"),
    "deduplication.hash_algorithm": lambda x: x in ("sha256", "md5"),
    "deduplication.keep_strategy": lambda x: x in ("highest_quality", "oldest", "newest", "largest"),
    "naming.max_filename_length": lambda x: 50 <= x <= 255,
    "formats.photo": lambda x: x in ("jpg", "png"),
    "formats.graphic": lambda x: x in ("jpg", "png"),
    "formats.jpeg_quality": lambda x: 0 <= x <= 100,
    "formats.png_compression": lambda x: 0 <= x <= 9,
    "report.format": lambda x: x in ("json", "csv", "html"),
}


class Settings:
    """A tree of settings with dotted paths. Unknown keys are kept; a value that fails its check raises ``ValueError``."""

    def __init__(self, tree: dict[str, Any] | None = None):
        self.tree = _merged(copy.deepcopy(DEFAULTS), tree or {})
        for path, ok in CHECKS.items():
            value = self.get(path)
            try:
                good = ok(value)
            except TypeError:
                good = False
            if not good:
                raise ValueError(f"{path} can't be {value!r}")

    @classmethod
    def load(cls, path: str) -> Settings:
        """From a YAML file; the defaults if it is missing or empty."""
        import yaml

        p = Path(path)
        return cls(yaml.safe_load(p.read_text()) if p.exists() else None)

    def save(self, path: str) -> None:
        import yaml

        Path(path).write_text(yaml.safe_dump(self.tree, sort_keys=True))

    def get(self, path: str, default: Any = None) -> Any:
        at: Any = self.tree
        for part in path.split("."):
            if not isinstance(at, dict) or part not in at:
                return default
            at = at[part]
        return at

    def set(self, path: str, value: Any) -> None:
        *above, last = path.split(".")
        at = self.tree
        for part in above:
            at = at.setdefault(part, {})
        at[last] = value


def _merged(base: dict, over: dict) -> dict:
    for k, v in over.items():
        base[k] = _merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v
    return base
