"""Summarise a Spark event log: per stage, the longest task, total task time and task count.

usage: python tools/stage_times.py <event-log folder>   (written by bench.py with
BENCH_EVENT_LOG_DIR set). A stage whose longest task is close to its total is a single-task
bottleneck; a longest task far above the average is skew.
"""
import json, sys, glob, collections
path = sys.argv[1]
files = glob.glob(path + "/**/*", recursive=True)
jobs_group = {}   # job id -> group
stage_job = {}
stage_tasks = collections.defaultdict(list)
stage_name = {}
for f in files:
    import os, io
    if os.path.isdir(f):
        continue
    if f.endswith(".zstd"):
        import zstandard
        raw = zstandard.ZstdDecompressor().stream_reader(open(f, "rb"))
        fh = io.TextIOWrapper(raw, encoding="utf-8")
    elif "appstatus" in f:
        continue
    else:
        fh = open(f)
    for line in fh:
        e = json.loads(line)
        ev = e.get("Event")
        if ev == "SparkListenerJobStart":
            g = (e.get("Properties") or {}).get("spark.jobGroup.id")
            for sid in e.get("Stage IDs", []):
                stage_job[sid] = g
        elif ev == "SparkListenerTaskEnd":
            ti = e["Task Info"]
            stage_tasks[e["Stage ID"]].append(ti["Finish Time"] - ti["Launch Time"])
        elif ev == "SparkListenerStageCompleted":
            si = e["Stage Info"]
            stage_name[si["Stage ID"]] = si["Stage Name"][:50]
rows = []
for sid, ts in stage_tasks.items():
    rows.append((max(ts), sum(ts), len(ts), sid, stage_job.get(sid), stage_name.get(sid, "")))
rows.sort(reverse=True)
print("max_ms sum_ms ntasks stage group name")
for r in rows[:30]:
    print(*r)
