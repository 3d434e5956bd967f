"""Monitor rule configuration (S6) and the rule -> suggestion table."""

from __future__ import annotations

import copy
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# Default thresholds of the six rules, the monitoring settings
# and the output settings.
DEFAULT_CONFIG = {
    "warning_rules": {
        "highfreq_threshold": 0.8236,
        "diversity_threshold": 25333.93,
        "meteor_threshold": 0.3727,
        "diversity_change_threshold": 0.5513,
        "highfreq_change_threshold": 0.2373,
        "relation_residual_threshold": 1.5585,
    },
    "monitoring": {
        "check_interval": 10,
        "history_window": 20,
        "warning_level_thresholds": [1, 2, 3],
    },
    "output": {
        "log_dir": "monitor_logs",
        "visualization": False,
    },
}

# Rule number -> severity, and the rule groups of the
# suggestion table with their target and priority (the advice is our own).  A
# composite suggestion is added when at least 3 rules fire.
RULE_SEVERITY = {1: "medium", 2: "high", 3: "high", 4: "medium", 5: "medium", 6: "high"}
SUGGESTIONS = [
    ([1, 5], "high_frequency_ratio",
     "a few words dominate the output: look at the decoding settings and at repeated training text", "high"),
    ([2, 4], "diversity",
     "fewer distinct n-grams than before: widen decoding or mix more human text into the next corpus", "high"),
    ([3], "semantic_quality",
     "overlap with the references fell: check the prompts and the share of generated text", "medium"),
    ([6], "metric_relation",
     "diversity left its usual relation to word frequency: inspect the last training run's log", "high"),
]
COMPOSITE = ("composite", "several signs at once: stop the chain and resume from the last good generation",
             "critical")
COMPOSITE_MIN_WARNINGS = 3
LEVELS = ("notice", "warning", "severe")


@dataclass
class MonitorRules:
    highfreq_threshold: float = 0.8236
    diversity_threshold: float = 25333.93
    meteor_threshold: float = 0.3727
    diversity_change_threshold: float = 0.5513
    highfreq_change_threshold: float = 0.2373
    relation_residual_threshold: float = 1.5585
    history_window: int = 20
    level_thresholds: list = field(default_factory=lambda: [1, 2, 3])
    check_interval: int = 10

    @classmethod
    def from_config(cls, config: dict) -> "MonitorRules":
        w = config["warning_rules"]
        # a section that replaced the default may leave settings out
        m = DEFAULT_CONFIG["monitoring"] | config["monitoring"]
        return cls(**{k: float(v) for k, v in w.items()},
                   history_window=int(m["history_window"]),
                   level_thresholds=list(m["warning_level_thresholds"]),
                   check_interval=int(m["check_interval"]))


def merge_config(custom: dict, merge: str = "deep") -> dict:
    """Overlay ``custom`` on the defaults.  ``merge='shallow'`` replaces a
    whole section when it is given (the original behaviour); ``'deep'``
    replaces only the given keys."""
    cfg = copy.deepcopy(DEFAULT_CONFIG)
    for section, value in custom.items():
        if merge == "deep" and isinstance(value, dict) and isinstance(cfg.get(section), dict):
            cfg[section].update(value)
        else:
            cfg[section] = value
    return cfg


def load_rules(spark: SparkSession | None, path: str | None, merge: str = "deep") -> MonitorRules:
    """Read a JSON rule file with Spark (one multi-line JSON object) and
    overlay it on the defaults; an unreadable file gives the defaults."""
    if not path:
        return MonitorRules.from_config(DEFAULT_CONFIG)
    try:
        if spark is not None:
            raw = spark.read.option("multiLine", True).json(path).toJSON().first()
        else:
            with open(path, encoding="utf-8") as fh:
                raw = fh.read()
        custom = json.loads(raw)
    except Exception:  # noqa: BLE001 - any unreadable file falls back to defaults
        return MonitorRules.from_config(DEFAULT_CONFIG)
    return MonitorRules.from_config(merge_config(custom, merge))


def suggestion_table(spark: SparkSession) -> DataFrame:
    """``(rule, target, suggestion, priority)``, 6 fixed rows."""
    rows = [(r, t, s, p) for rules, t, s, p in SUGGESTIONS for r in rules]
    return spark.createDataFrame(rows, "rule int, target string, suggestion string, priority string")
