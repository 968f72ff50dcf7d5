"""The dataset pipeline: from a source to silver and gold layers with quality gate, quarantine and lineage.

    python -m corduroy.pipeline --config pipeline.yaml --root file:///data/lake --as-of 2024-01-31
"""

from __future__ import annotations

import argparse
import hashlib
import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import aggregates, cleaning, quality
from .sources import files, sinks

# The names of a run's stages, in order.
STAGES = ("start", "extract", "register_raw", "profiling_before", "clean", "schema_validation", "transform", "data_quality", "quarantine", "quality_gate", "load_silver", "build_gold", "profiling_after", "generate_report", "finish")


def new_run_id(prefix: str = "run") -> str:
    return f"{prefix}-{time.strftime('%Y%m%dT%H%M%S')}-{uuid.uuid4().hex[:8]}"


def run_dataset(spark: SparkSession, name: str, spec: dict, root: str, as_of: str, run_id: str | None = None, derive=None) -> dict:
    """Run all stages for one dataset; returns status by stage, score, gate and paths.

    spec: source, clean, contract, rules, quality, aggregations, row_id, version. A failing stage ends the run with its error in the
    result. Silver is written whatever the gate says; gold only if it didn't fail. The cleaned table is written once and read by
    every later stage.
    """
    run_id, version = run_id or new_run_id(), spec.get("version", "1")
    out: dict = {"run_id": run_id, "dataset": name, "stages": {}}
    state: dict = {}
    base = f"{root}/runs/{run_id}/{name}"

    def extract():
        state["raw"] = files.read(spark, spec["source"])

    def register_raw():
        digest = hashlib.md5(json.dumps([spec["source"], sorted(r["sha256"] for r in files.file_facts(spark, spec["source"]["path"]).select("sha256").collect())]).encode()).hexdigest()
        out["bronze"], out["bronze_written"] = sinks.write_bronze(state["raw"], root, name, version, digest)
        state["raw"] = spark.read.parquet(out["bronze"])

    def clean():
        path = f"{base}/clean"
        cleaning.clean(state["raw"], spec.get("clean", {})).write.mode("overwrite").parquet(path)
        state["clean"] = spark.read.parquet(path)
        cleaning.change_log(state["raw"], state["clean"]).write.mode("overwrite").json(f"{base}/changes")
        cleaning.operation_log(state["raw"], spec.get("clean", {})).coalesce(1).write.mode("overwrite").json(f"{base}/operations")

    def schema_validation():
        broken = quality.contract_report(state["clean"], spec["contract"], as_of)
        broken.write.mode("overwrite").json(f"{base}/contract")
        out["contract_errors"] = broken.count()

    def transform():
        state["rows"] = derive(state["clean"]) if derive else state["clean"]

    def data_quality():
        state["dims"] = quality.dimensions(state["rows"], spec["quality"], as_of).first().asDict()
        out["dqs"] = state["dims"]["dqs"]

    def quarantine():
        found = quality.violations(state["rows"], spec.get("rules", []), spec["row_id"], as_of) if spec.get("rules") else None
        state["critical"] = 0
        if found is not None:
            found.write.mode("overwrite").parquet(f"{base}/violations")
            found = spark.read.schema(found.schema).parquet(f"{base}/violations")
            state["critical"] = found.where("severity = 'critical'").count()
            quality.quarantine(state["rows"], found, spec["row_id"], name).write.mode("overwrite").json(f"{root}/quarantine/{name}/{run_id}")

    def quality_gate():
        out["gate"] = quality.gate(out["dqs"], state["critical"], spec.get("threshold", 90.0))
        out["model_ready"] = quality.model_ready(not out["contract_errors"], out["gate"], True, state["critical"], out["dqs"], version)["model_ready"]

    def load_silver():
        out["silver"] = sinks.write_layer(state["rows"], root, "silver", name, version, as_of)

    def build_gold():
        if out["gate"] != "FAILED":
            out["gold"] = sinks.write_layer(spark.read.parquet(out["silver"]), root, "gold", name, version, as_of)
            if out["model_ready"]:
                out["model_ready_path"] = sinks.write_layer(spark.read.parquet(out["silver"]), root, "model_ready", name, version, as_of)
            for a in spec.get("aggregations", []):
                aggregates.aggregate(spark.read.parquet(out["silver"]), a).write.mode("overwrite").json(f"{root}/aggregations/{name}/{aggregates.safe_name(a['name'])}")

    def profiled(which, at):
        def write():
            found = quality.profile(state[which])
            found.write.mode("overwrite").json(f"{base}/profile_{at}")
            sinks.write_csv(spark.read.schema(found.schema).json(f"{base}/profile_{at}"), f"{base}/profile_{at}_csv")

        return write

    def finish():
        row = spark.createDataFrame([(run_id, name, float(out["dqs"]), out["gate"], as_of)], "run_id string, dataset string, dqs double, gate string, created_at string")
        sinks.record_lineage(spark, f"{root}/lineage/quality_scores", row, ["run_id", "dataset"])

    steps = dict(zip(STAGES, (lambda: None, extract, register_raw, profiled("raw", "before"), clean, schema_validation, transform, data_quality, quarantine, quality_gate, load_silver, build_gold, profiled("rows", "after"), lambda: out.update(report={"dimensions": state["dims"], "critical": state["critical"]}), finish)))
    for stage, step in steps.items():
        try:
            step()
            out["stages"][stage] = "OK"
        except Exception as e:  # the run's result names the stage and its error
            out["stages"][stage] = f"FAILED: {type(e).__name__}: {str(e)[:300]}"
            break
    out["status"] = "OK" if len(out["stages"]) == len(STAGES) and all(v == "OK" for v in out["stages"].values()) else "FAILED"
    manifest = {k: v for k, v in out.items() if k != "report"} | {"measurement_fingerprint": sinks.fingerprint(spec, sinks.code_digest(quality, cleaning))}
    spark.createDataFrame([(json.dumps(manifest, default=str),)], "value string").write.mode("overwrite").text(f"{base}/manifest")
    return out


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """All runs: run_id, dataset, dqs, gate, status, fingerprint."""
    m = spark.read.text(f"{root}/runs/*/*/manifest").select(F.from_json("value", "run_id string, dataset string, dqs double, gate string, status string, measurement_fingerprint string").alias("m"))
    return m.select("m.*").withColumnRenamed("measurement_fingerprint", "fingerprint")


def run_all(spark: SparkSession, datasets: dict, root: str, as_of: str, only: list[str] | None = None, retries: int = 1) -> list[dict]:
    """run_dataset() for each dataset (or those named), a failed one again up to ``retries`` times; one result each, in order."""
    out, run_id = [], new_run_id()
    for name in only or datasets:
        for attempt in range(retries + 1):
            result = run_dataset(spark, name, datasets[name], root, as_of, f"{run_id}-{attempt}" if attempt else run_id)
            if result["status"] == "OK":
                break
        out.append(result)
    return out


def load_config(path: str) -> dict:
    """The datasets of a YAML file, or of all YAML files in a folder (a file's own ``datasets``, else one named like the file)."""
    import os

    import yaml

    if os.path.isdir(path):
        found: dict = {}
        for name, config in files.read_configs(path).items():
            found |= config.get("datasets") or {name: config}
        return found
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)["datasets"]


def main() -> None:
    from .session import build_session

    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--config", required=True)
    p.add_argument("--root", required=True)
    p.add_argument("--as-of", required=True)
    p.add_argument("--dataset", action="append")
    p.add_argument("--retries", type=int, default=1)
    args = p.parse_args()
    for result in run_all(build_session("pipeline"), load_config(args.config), args.root, args.as_of, args.dataset, args.retries):
        print(json.dumps(result, default=str))


if __name__ == "__main__":
    main()
