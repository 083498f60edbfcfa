"""Settings merged from defaults, a file and the environment, and policies read with a default."""

from __future__ import annotations

import json
from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession


def _flat(tree: Mapping, before: str = "") -> dict[str, object]:
    out: dict[str, object] = {}
    for k, v in tree.items():
        out |= _flat(v, f"{before}{k}.") if isinstance(v, Mapping) else {f"{before}{k}": v}
    return out


def read_value(text: str) -> object:
    """An environment value as JSON reads it, else as text."""
    try:
        return json.loads(text)
    except ValueError:
        return text


def merged(defaults: Mapping, file: Mapping | None, environment: Mapping[str, str], prefix: str, guarded: tuple[str, ...] = ()) -> dict[str, tuple[object, str]]:
    """Name -> (value, source): defaults, overlaid by the file, overlaid by ``prefix``ed variables of the environment.

    ``PREFIX_A_B`` stands for ``a.b``. Guarded names are never taken from the environment; names without a default are kept from the
    file and ignored in the environment.
    """
    out = {k: (v, "default") for k, v in _flat(defaults).items()}
    out |= {k: (v, "file") for k, v in _flat(file or {}).items()}
    by_variable = {prefix + k.upper().replace(".", "_"): k for k in out}
    for name, text in environment.items():
        key = by_variable.get(name)
        if key and key not in guarded:
            out[key] = (read_value(text), "environment")
    return out


POLICY = "pattern string, role string, permissions array<string>"


def policies(spark: SparkSession, path: str, default: list[tuple]) -> DataFrame:
    """(pattern, role, permissions) of a JSON file of policies; the default where it cannot be read or holds none."""
    try:
        found = spark.read.schema(POLICY).option("multiLine", "true").option("mode", "FAILFAST").json(path)
        if found.filter("pattern IS NOT NULL").isEmpty():
            raise ValueError
        return found
    except (PySparkException, Py4JJavaError, ValueError):
        return spark.createDataFrame(default, POLICY)
