import os
import subprocess
import sys

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_every_sql_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_runs(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"day", "total", "ai_correct"} <= set(rows[0].asDict())


def test_matrix_and_errors_add_up(spark):
    r = entry.queries()["A03_cross_matrix"](spark, SMALL).first()
    assert r["ok_ok"] + r["ng_ok"] + r["ok_ng"] + r["ng_ng"] + r["err"] == r["total"]


def test_stream_equals_batch_totals(spark):
    n = spark.read.parquet(f"{SMALL}/events.parquet").count()
    rows = entry.queries()["T02_stream_counters"](spark, SMALL).collect()
    assert sum(r["total"] for r in rows) == n


def test_folds_keep_glasses_whole(spark):
    rows = entry.queries()["M08_group_folds"](spark, SMALL).collect()
    assert len(rows) == len({r["glass"] for r in rows}) and {r["fold"] for r in rows} <= set(range(5))


def test_entry_works_without_optional_operators(tmp_path):
    """A copy of the package without its optional folder, with or without the pipeline beside it."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    (tmp_path / "panelscope").mkdir()
    for name in os.listdir(f"{root}/panelscope"):
        if name != "llm":
            os.symlink(f"{root}/panelscope/{name}", tmp_path / "panelscope" / name)
    # real files, so that imports resolve beside them
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{root}/{name}"):
            with open(f"{root}/{name}") as f:
                (tmp_path / name).write_text(f.read())
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(x.startswith('op') or x == 'pipeline' for x in q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    queries, optional = map(int, out.stdout.split())
    assert queries > 200 and optional == 0
