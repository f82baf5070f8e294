import importlib
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from conftest import ROOT, SF0001, SF001


@pytest.fixture(scope="module")
def stages(spark):
    """The input, what each stage wrote, and the result of one ``run``."""
    import corpus_pipeline as P
    from taskwatch.session import pin
    written = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(P, "pin", lambda df, name: written.append(pin(df, name)) or written[-1])
        result = pin(P.run(spark, SF001))
    return [spark.read.parquet(f"{SF001}/documents.parquet"), *written, result]


def test_stages_keep_columns_and_shrink(stages):
    for a, b in zip(stages[:4], stages[1:5]):
        assert a.columns == b.columns
        assert b.count() <= a.count() and b.join(a, "doc_id", "left_anti").count() == 0
    assert stages[5].count() > 0 and set(stages[0].columns) < set(stages[5].columns)


def test_each_stage_acts_on_its_input(spark, stages):
    from taskwatch.llm import decontaminate, simjoin
    from taskwatch.llm.quality import signals
    d, rules, lines, near, clean, mixed = stages
    assert signals(rules).where("base_failed").count() == 0 and rules.count() < d.count()
    assert lines.count() == rules.count()
    left = simjoin.cluster(near, 5, 80)
    assert left.where("n_shingles > 0").select("component_id").distinct().count() == left.where("n_shingles > 0").count()
    items = spark.read.parquet(f"{SF001}/benchmark.parquet")
    assert decontaminate.leaks(near, items).count() > 0 == decontaminate.leaks(clean, items).count()


@pytest.mark.parametrize("name", ["op1_quality_rules", "op2_license_scan", "op3_chat_format", "op6_line_dedup", "op9_html_text",
                                  "op10_ngram_jaccard"])
def test_sql_agrees(spark, name):
    import __spark_entry__ as E
    db = duckdb.connect()
    for t in "documents labels pages conversations benchmark".split():
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF0001}/{t}.parquet'")
    a, b = E.queries()[name](spark, SF0001).toPandas(), db.sql(E.oracle_sql()[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    a, b = (x[cols].astype(str).sort_values(cols).reset_index(drop=True) for x in (a, b))
    assert a.equals(b)


def test_native_plans_run_no_python(spark):
    import __spark_entry__ as E
    for name in ("op1_quality_rules", "op2_license_scan", "op5_mixing", "op6_line_dedup"):
        plan = E.queries()[name](spark, SF0001)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoop")), name


def test_the_rest_works_without_this_part(tmp_path):
    """__spark_entry__ imports, and lists the other queries, when the folders are gone."""
    shutil.copytree(os.path.join(ROOT, "taskwatch"), tmp_path / "taskwatch", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as E; q = E.queries(); assert len(q) > 40 and not any(k.startswith('op') for k in q), q; assert set(E.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_all_eleven_are_registered():
    E = importlib.import_module("__spark_entry__")
    names = list(E.queries())
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names
