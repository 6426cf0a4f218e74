"""Summarise stage durations from a Spark event log folder (profiling aid)."""
import glob
import io
import json
import os
import sys

import zstandard


def lines(path):
    if path.endswith(".zstd"):
        with open(path, "rb") as fh:
            data = zstandard.ZstdDecompressor().stream_reader(fh).read()
        return io.StringIO(data.decode("utf-8"))
    return open(path)


for f in [p for p in glob.glob(sys.argv[1] + "/**/*", recursive=True) if not os.path.isdir(p)]:
    st = {}
    for line in lines(f):
        e = json.loads(line)
        if e["Event"] == "SparkListenerStageCompleted":
            i = e["Stage Info"]
            d = (i["Completion Time"] - i["Submission Time"]) / 1000
            st[i["Stage ID"]] = (round(d, 2), i["Number of Tasks"], i["Stage Name"][:70])
    print("stages", len(st), "sum", round(sum(v[0] for v in st.values()), 1))
    for k, v in sorted(st.items(), key=lambda kv: -kv[1][0])[:int(sys.argv[2]) if len(sys.argv) > 2 else 20]:
        print(k, v)
