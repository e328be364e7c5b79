"""Rule files: YAML or JSON in a folder that Spark reads."""

from __future__ import annotations

import json
import logging

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from calltide.operators.rules import Rule

SEVERITIES = ("critical", "high", "medium", "low", "info")


def load_rules(spark: SparkSession, folder: str) -> list[Rule]:
    """Rules by file name; a file that is no rule (no id, no patterns, not readable) is logged and left out. Rule folders are
    small by nature, so the driver holds them."""
    import yaml

    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.{yaml,yml,json}").select(F.col("_metadata.file_path").alias("path"), "value")
    out = []
    for path, text in sorted((r.path, r.value) for r in files.collect()):
        try:
            x = json.loads(text) if path.endswith(".json") else yaml.safe_load(text)
            rule_id, globs = str(x["id"]), [str(g) for g in x["signaturePatterns"]]
        except Exception as e:
            logging.getLogger(__name__).warning("left out %s: %s", path, e)
            continue
        severity = str(x.get("severity") or "medium").lower()
        needs = str(x.get("requiresTaintAnalysis", False)).lower() == "true"
        out.append(Rule(rule_id, str(x.get("name") or rule_id), severity if severity in SEVERITIES else "medium", globs, str(x.get("description") or ""), str(x.get("check") or ""), [str(t) for t in x.get("tags") or []], needs))
    return out
