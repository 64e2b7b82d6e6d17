"""Summarise a Spark event log: the slowest stages and jobs.

Usage: python tools/event_log_report.py EVENT_LOG_FILE [--top N]
(enable with ``BENCH_EVENT_LOG_DIR=<scratch folder> python bench.py``).
"""

from __future__ import annotations

import argparse
import json
import os


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("log")
    ap.add_argument("--top", type=int, default=15)
    args = ap.parse_args()
    stages, jobs, job_start, job_group = [], [], {}, {}
    per_group: dict[str, list[float]] = {}
    # a rolling (v2) event log is a directory of ``events_<n>_...`` files
    if os.path.isdir(args.log):
        parts = sorted((f for f in os.listdir(args.log) if f.startswith("events_")), key=lambda f: int(f.split("_")[1]))
        files = [os.path.join(args.log, f) for f in parts]
    else:
        files = [args.log]
    for path in files:
        if path.endswith(".zstd"):
            try:
                import zstandard
            except ImportError as exc:  # pragma: no cover
                raise SystemExit("zstd event log: install zstandard or set spark.eventLog.compress=false") from exc
            with open(path, "rb") as fh:
                lines = zstandard.ZstdDecompressor().stream_reader(fh).read().decode("utf-8").splitlines()
        else:
            with open(path, encoding="utf-8") as fh:
                lines = fh.readlines()
        for line in lines:
            ev = json.loads(line)
            kind = ev.get("Event")
            if kind == "SparkListenerStageCompleted":
                info = ev["Stage Info"]
                if info.get("Submission Time") and info.get("Completion Time"):
                    ms = info["Completion Time"] - info["Submission Time"]
                    stages.append((ms, info["Stage ID"], info["Number of Tasks"], info["Stage Name"][:80]))
            elif kind == "SparkListenerJobStart":
                job_start[ev["Job ID"]] = ev["Submission Time"]
                job_group[ev["Job ID"]] = (ev.get("Properties") or {}).get("spark.jobGroup.id", "-")
            elif kind == "SparkListenerJobEnd" and ev["Job ID"] in job_start:
                ms = ev["Completion Time"] - job_start[ev["Job ID"]]
                jobs.append(ms)
                per_group.setdefault(job_group.get(ev["Job ID"], "-"), []).append(ms)
    print(f"jobs: {len(jobs)}, total {sum(jobs) / 1000:.2f} s; stages: {len(stages)}, total {sum(s[0] for s in stages) / 1000:.2f} s")
    if len(per_group) > 1:
        print("per job group (jobs, total ms):")
        for group, times in sorted(per_group.items(), key=lambda kv: -sum(kv[1])):
            print(f"{len(times):6d} {sum(times):8.0f}  {group}")
    print("slowest stages (ms, id, tasks, name):")
    for ms, sid, tasks, name in sorted(stages, reverse=True)[: args.top]:
        print(f"{ms:8d} {sid:6d} {tasks:6d}  {name}")


if __name__ == "__main__":
    main()
