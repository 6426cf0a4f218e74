"""Per-job wall times from a (rolled) Spark event log folder (profiling aid)."""
import glob
import io
import json
import os
import sys

import zstandard


def events(folder):
    files = sorted(p for p in glob.glob(folder + "/**/*", recursive=True) if not os.path.isdir(p))
    for f in files:
        raw = open(f, "rb").read()
        if f.endswith(".zstd"):
            raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)).read()
        for line in raw.decode("utf-8").splitlines():
            yield json.loads(line)


def main():
    jobs = {}
    first = last = None
    for e in events(sys.argv[1]):
        if e["Event"] == "SparkListenerJobStart":
            jobs[e["Job ID"]] = [e["Submission Time"], None, e.get("Properties", {}).get("callSite.short", ""),
                                 len(e.get("Stage IDs", []))]
            first = first or e["Submission Time"]
        elif e["Event"] == "SparkListenerJobEnd":
            jobs[e["Job ID"]][1] = e["Completion Time"]
            last = e["Completion Time"]
    busy = sum((b - a) for a, b, _, _ in jobs.values() if b)
    print("jobs", len(jobs), "span", round((last - first) / 1000, 1), "sum", round(busy / 1000, 1))
    for k, (a, b, c, n) in sorted(jobs.items(), key=lambda kv: -((kv[1][1] or 0) - kv[1][0]))[:int(sys.argv[2]) if len(sys.argv) > 2 else 15]:
        print(k, round(((b or a) - a) / 1000, 2), n, c)


if __name__ == "__main__":
    main()
