import os

import pytest

from tessera import queries as core

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.partition('.')[0]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got, want = core.queries()[name](spark, SF).toPandas(), duck.sql(core.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a, b = (t[cols].astype(str).replace("None", "nan").sort_values(cols).reset_index(drop=True) for t in (got, want))
    assert a.equals(b)


def test_entry_imports_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'sketch_fourier' in e.queries() and set(e.oracle_sql()) <= set(e.queries()) and not [n for n in e.queries() if n.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_em_and_divergence_run_with_the_operators_own_settings(spark, monkeypatch):
    from tessera import planted

    seen = []
    monkeypatch.setattr(planted.mixtures, "em", lambda df, k, cols, rounds=20, runs=1, seed=0: seen.append(rounds) or (core.MIX2, 0.0))
    monkeypatch.setattr(planted.mixtures, "symmetric_kl", lambda spark, p, q, n=500_000, seed=0: seen.append(n) or 0.0)
    core.queries()["em_gmm"](spark, SF)
    core.queries()["symm_kl"](spark, SF)
    assert seen == [20, 500_000, 500_000]
