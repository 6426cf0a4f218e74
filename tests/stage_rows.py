"""Stages with their duration, tasks and record counts (profiling aid)."""
import sys

from job_times import events  # noqa: F401  (re-uses the reader)

rows = []
for e in events(sys.argv[1]):
    if e["Event"] == "SparkListenerStageCompleted":
        i = e["Stage Info"]
        acc = {a["Name"]: a.get("Value") for a in i.get("Accumulables", [])}
        rows.append((i["Stage ID"], round((i["Completion Time"] - i["Submission Time"]) / 1000, 2),
                     i["Number of Tasks"], acc.get("internal.metrics.input.recordsRead"),
                     acc.get("internal.metrics.shuffle.read.recordsRead"),
                     acc.get("internal.metrics.shuffle.write.recordsWritten")))
for r in sorted(rows, key=lambda r: -r[1])[:int(sys.argv[2]) if len(sys.argv) > 2 else 20]:
    print(r)
