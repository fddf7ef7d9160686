"""Runs on disk: where their tables are, what identifies them, their manifests, and the cache of parsed sentences.

Paths go through Hadoop's file system, so that any store works. Manifests are small JSON files.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical_json, fingerprint
from .sinks import write_ledger

CACHE_VERSION = 1
LEDGERS = ("pair_observations", "pattern_observations", "lexical_observations", "carrier_trigger_observations", "event_observations", "corpus_summary")


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file(spark, path)
    return bool(fs.exists(at))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, at = _file(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def dataset_path(registry: dict[str, str], name: str, split: str, splits: tuple[str, ...] = ("train", "test", "full")) -> str:
    """The file of a split of a registered data set: `folder/split.json`. Names go by any case; unknown ones are errors that list the known."""
    known = {k.lower(): v for k, v in registry.items()}
    if name.lower() not in known:
        raise ValueError(f"unknown data set {name!r}; known: {', '.join(sorted(known))}")
    if split not in splits:
        raise ValueError(f"unknown split {split!r}; known: {', '.join(splits)}")
    return f"{known[name.lower()].rstrip('/')}/{split}.json"


def stats_dir(spark: SparkSession, path: str) -> str:
    """The folder of a run's ledgers: the path itself, or analysis/stats or stats below it."""
    for at in (path, f"{path}/analysis/stats", f"{path}/stats"):
        if exists(spark, f"{at}/pattern_observations.csv") or exists(spark, f"{at}/corpus_summary.csv"):
            return at
    raise FileNotFoundError(f"no ledgers under {path}")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON-lines file; lines that don't parse are left out, a missing file gives no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.text(path).filter(F.trim("value") != "").select(F.from_json("value", f"struct<{', '.join(x.strip().replace(' ', ':', 1) for x in schema.split(','))}>").alias("r"), F.try_parse_json("value").alias("whole"))
    return rows.filter("whole IS NOT NULL").select("r.*")


def write_audit(families: DataFrame, path: str, support: str, signature: str) -> None:
    """Families of paths as JSON lines, most supported first."""
    families.orderBy(F.desc(support), signature).coalesce(1).write.json(path, mode="overwrite")  # a report


def read_audit(spark: SparkSession, path: str, schema: str, support: str, signature: str) -> DataFrame:
    return spark.read.schema(schema).json(path).orderBy(F.desc(support), signature)


def write_ledgers(ledgers: dict[str, DataFrame], path: str, source: str) -> None:
    """The six ledgers as CSV folders, and a README that says what each is. A ledger that isn't there is an error."""
    missing = [n for n in LEDGERS if n not in ledgers]
    if missing:
        raise ValueError(f"missing ledgers: {', '.join(missing)}")
    for name in LEDGERS:
        write_ledger(ledgers[name], f"{path}/{name}.csv", ledgers[name].columns)
    told = "\n".join(f"- `{n}.csv`: {', '.join(ledgers[n].columns)}" for n in LEDGERS)
    write_text(next(iter(ledgers.values())).sparkSession, f"{path}/README.md", f"# Statistics ledgers\n\nSource: `{source}`\n\n{told}\n\nAnalyse corpora separately unless the model has the corpus as a factor.\n")


def run_identity(mode: str, dataset: str, split: str, source_sha256: str, config: dict, code: dict[str, str]) -> dict:
    """What decides whether a run may be used again, with the fingerprint of all of it."""
    parts = {"schema": 1, "mode": mode, "dataset": dataset, "split": split, "source_sha256": source_sha256, "config": config, "code": code}
    return parts | {"fingerprint": fingerprint(parts)}


def digest(df: DataFrame, key: str) -> tuple[int, str]:
    """The number of rows of a table, and one hash of their contents that doesn't depend on their order."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    words = [F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    r = df.select(F.col(key), *(w.alias(f"w{i}") for i, w in enumerate(words))).agg(F.count(F.lit(1)), *(F.sum(f"w{i}") for i in range(4))).first()
    return int(r[0]), fingerprint([int(x or 0) for x in r[1:]])


def write_run(spark: SparkSession, path: str, run: dict, artifacts: dict[str, bool], stats: dict | None = None) -> dict:
    """run.json and manifest.json of a run. artifacts: name to whether it is required; a required one that isn't there makes the run incomplete."""
    found = {n: exists(spark, f"{path}/{n}") for n in artifacts}
    missing = sorted(n for n, needed in artifacts.items() if needed and not found[n])
    manifest = {"artifacts": [{"path": n, "required": artifacts[n], "exists": found[n]} for n in sorted(artifacts)], "missing_required": missing, "status": "incomplete" if missing else "complete"}
    write_text(spark, f"{path}/run.json", canonical_json(run | {"status": manifest["status"]}))
    write_text(spark, f"{path}/manifest.json", canonical_json(manifest))
    if stats is not None:
        write_text(spark, f"{path}/workflow_stats.json", canonical_json(stats))
    return manifest


def write_parsed(parsed: DataFrame, path: str, source_sha256: str, parser: dict, code: str) -> dict:
    """A cache of parsed sentences (sentence_id and whatever the parser gave) as Parquet, with the manifest that load_parsed checks."""
    spark = parsed.sparkSession
    parsed.write.parquet(f"{path}/records", mode="overwrite")
    n, sha = digest(spark.read.parquet(f"{path}/records"), "sentence_id")
    manifest = {"schema_version": CACHE_VERSION, "source_sha256": source_sha256, "parser": parser, "code": code, "records_sha256": sha, "record_count": n}
    write_text(spark, f"{path}/manifest.json", canonical_json(manifest))
    return manifest


def stale(spark: SparkSession, path: str, source_sha256: str, parser: dict, code: str) -> list[str]:
    """Why a cache can't be used: the parts of its manifest that differ, or that it isn't there. Empty for a good one."""
    if not exists(spark, f"{path}/manifest.json") or not exists(spark, f"{path}/records"):
        return ["missing"]
    try:
        manifest = json.loads(read_text(spark, f"{path}/manifest.json"))
    except ValueError:
        return ["manifest_unreadable"]
    wanted = {"schema_version": CACHE_VERSION, "source_sha256": source_sha256, "parser": parser, "code": code}
    reasons = [k for k, v in wanted.items() if manifest.get(k) != v]
    n, sha = digest(spark.read.parquet(f"{path}/records"), "sentence_id")
    return reasons + [k for k, v in (("records_sha256", sha), ("record_count", n)) if manifest.get(k) != v]


def load_parsed(spark: SparkSession, path: str, source_sha256: str, parser: dict, code: str) -> DataFrame | None:
    """The cached sentences, or None where the cache is stale."""
    return None if stale(spark, path, source_sha256, parser, code) else spark.read.parquet(f"{path}/records")
