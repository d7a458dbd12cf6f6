"""The five stages one after the other against plain Python, on nulls, empty texts, repeated rows and clashing names."""

from __future__ import annotations

import math
import os
import re
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import pyspark
import pytest

import corpus_pipeline
from wattloom.llm import packing, quality, secrets

from . import brute


def _copies(rows):
    """Rows that stay: of each component that of the smallest doc_id, null last; rows without words all stay."""
    far = 1 << 60
    groups = brute.components([(far if i is None else i, t) for i, t in rows])
    own = [(i, (far if d is None else d, t or "")) for i, (d, t) in enumerate(rows)]
    best: dict = {}
    for (i, key), (n, comp) in zip(own, groups):
        if n:
            # a component's smallest id is shared by rows that link; equal keys are equal rows
            best.setdefault(comp, []).append((key, i))
    stay = {i for (i, _), (n, _) in zip(own, groups) if not n}
    return [rows[i] for i in sorted(stay | {min(x)[1] for x in best.values()})]


def _redacted(text):
    if text is None:
        return None
    spans = []
    for rule in secrets.RULES:
        spans += [m.span() for m in re.finditer(rule.regex, text) if len(m[rule.group]) >= max(1, rule.least)]
    out, at = "", 0
    for start, end in sorted(spans):
        if start >= at:
            out += text[at:start] + "[secret]"
        at = max(at, end)
    return out + text[at:]


def _rows(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_pipeline(spark, docs, labels, benchmark, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    now, names = spark.read.parquet(f"{tmp_path}/documents.parquet"), docs.columns
    scored = quality.score_quality(now, labels)
    want = sorted(((r["doc_id"], r["text"]) for r in scored.where("keep").collect()), key=str)
    items = [("" if r["item_id"] is None else r["item_id"], r["text"]) for r in benchmark.collect()]
    plain = {
        "quality": lambda rows: want,
        "near_duplicates": _copies,
        "decontamination": lambda rows: [r for r, x in zip(rows, brute.leaks([t for _, t in rows], items)) if not x[4]],
        "secrets": lambda rows: [(i, _redacted(t)) for i, t in rows],
    }
    rows = _rows(now)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        rows = sorted(plain[name](rows), key=str)
        assert now.columns == names and _rows(now) == rows, name
    from tokenizers import Tokenizer

    from wattloom.llm import packing

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    pieces = []
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        pieces += [(i, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()), len(ids)) for s in range(0, len(ids), 2048)]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((tuple(r[:5]) for r in got), key=str) == sorted(pieces, key=str)
    full: dict = {}
    for r in got:
        full.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in full.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_pipeline_empty(spark, docs, labels, benchmark, tmp_path):
    for name, df in (("documents", docs.limit(0)), ("labels", labels.limit(0)), ("benchmark", benchmark.limit(0))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("hot", [False, True])
def test_quality_plainly(spark, hot):
    """Rates and probabilities by dictionaries; hot: one site holds most rows."""
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"w{rng.integers(50)}" for _ in range(20)) + ("" if i % 3 else " ### $$$ |||" * 9), "hot" if hot and i % 4 else f"s{rng.integers(9)}", ("en", "de", None)[i % 3]) for i in range(400)]
    label = {i: int(i % 3 > 0) if i % 7 else 1 for i in range(0, 400, 2)}
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([*label.items(), (1, 0), (1, 1)], "doc_id long, quality int")
    label[1] = 1
    n, k = {}, {}
    for i, _, host, lang in rows:
        if i in label:
            for key in (host, (host, lang or "")):
                n[key], k[key] = n.get(key, 0) + 1, k.get(key, 0) + label[i]
    hosts = [x for x in n if isinstance(x, str)]
    paths = [x for x in n if not isinstance(x, str)]
    total, good = sum(n[h] for h in hosts), sum(k[h] for h in hosts)
    rate = (good + 1) / (total + 2)

    def strength(keys, prior):
        var = sum(prior(x) * (1 - prior(x)) for x in keys) / len(keys)
        spread = sum(n[x] * (k[x] / n[x] - prior(x)) ** 2 for x in keys) / total
        return min(max(var / max(spread - var * len(keys) / total, 1e-6) - 1, 1.0), 1000.0)

    s1 = strength(hosts, lambda x: rate)
    host_rate = {h: (k[h] + s1 * rate) / (n[h] + s1) for h in hosts}
    s2 = strength(paths, lambda x: host_rate[x[0]])
    path_rate = {p: (k[p] + s2 * host_rate[p[0]]) / (n[p] + s2) for p in paths}
    odds = lambda p: math.log(min(max(p, 1e-4), 1 - 1e-4) / (1 - min(max(p, 1e-4), 1 - 1e-4)))
    got = {r["doc_id"]: r for r in quality.score_quality(docs, labels).collect()}
    right = 0
    for i, _, host, lang in rows:
        h = host_rate.get(host, rate)
        p = path_rate.get((host, lang or ""), h)
        site = min(max(odds(p) - odds(rate), -1.5), 1.5)
        want = 1 / (1 + math.exp(-(got[i]["doc_logit"] + site)))
        assert np.allclose([got[i]["host_rate"], got[i]["path_rate"], got[i]["probability"]], [h, p, want], atol=1e-9)
        assert got[i]["keep"] == (want >= 0.5)
        right += got[i]["keep"] == bool(i % 3)
    assert right > 380


FREED = """
import re, pyarrow as pa
from wattloom.llm.common import slices

def mb():
    return sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

list(slices(iter([pa.record_batch({"x": [1]})])))
before, rows = mb(), [bytes(3000) for _ in range(50_000)]
last = rows.pop()  # what lies above the freed memory
rows.clear()
list(slices(iter([pa.record_batch({"x": [1]})])))
print(mb() - before)
"""


def test_worker_gives_back_memory():
    """An idle worker counts in its executor's memory: after its last batch it holds nothing of the texts it has seen."""
    out = subprocess.run([sys.executable, "-c", FREED], capture_output=True, text=True, check=True, cwd=os.path.dirname(corpus_pipeline.__file__))
    assert float(out.stdout) < 30


def test_short_batches(spark):
    """No more rows with texts go to Python at once than BATCH_ROWS; a smaller limit of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "cast(id AS string) AS text", "'a' AS lang", "'b' AS source")
    sent = lambda: docs.mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in bs), "n long").agg({"n": "max"}).first()[0]
    for before, most in (("10000", 1000), ("0", 1000), ("50", 50)):
        spark.conf.set(name, before)
        try:
            packing.pieces_of(docs)
            assert sent() == most
        finally:
            spark.conf.unset(name)


POOLS = """
import psutil
import sys
from pyspark.sql import SparkSession
import corpus_pipeline

conf = {"spark.master": "local-cluster[1,1,1024]", "spark.checkpoint.dir": f"file://{sys.argv[1]}/shared", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.driver.host": "127.0.0.1", "spark.executor.memory": "600m"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
corpus_pipeline.run(spark, sys.argv[1]).count()
daemons, workers = 0, 0
for p in psutil.Process().children(recursive=True):
    if "CoarseGrainedExecutorBackend" in " ".join(p.cmdline()):
        daemons += len(p.children())
        workers += sum(len(x.children()) for x in p.children())
print(daemons, workers)
"""


def test_executor_keeps_one_worker_a_core(spark, docs, labels, benchmark, tmp_path):
    """Idle Python processes count in their executor's memory: all stages share one pool, and a task needs one worker."""
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", benchmark)):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    root = os.path.dirname(corpus_pipeline.__file__)
    home = tmp_path / "home"  # executors' logs go to work in Spark's home
    (home / "work").mkdir(parents=True)
    for name in os.listdir(os.path.dirname(pyspark.__file__)):
        if name != "work":
            (home / name).symlink_to(os.path.join(os.path.dirname(pyspark.__file__), name))
    env = {k: v for k, v in os.environ.items() if k not in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    env |= {"PYTHONPATH": root, "PYSPARK_PYTHON": sys.executable, "SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1"}
    out = subprocess.run([sys.executable, "-c", POOLS, str(tmp_path)], capture_output=True, text=True, cwd=root, env=env, timeout=600)
    assert out.stdout.split() == ["1", "1"], out.stdout + out.stderr[-2000:]
