"""Task functions travel with their code: workers that can't import the package still run every operator."""

import os
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from tessera.session import build_session
spark = build_session("away", "local[2]", spark__sql__shuffle__partitions="2", spark__ui__showConsoleProgress="false")
sys.path.remove({repo!r})

def importable(batches):
    import importlib.util
    import pandas as pd
    for _ in batches:
        yield pd.DataFrame({{"found": [importlib.util.find_spec("tessera") is not None]}})

assert not any(r.found for r in spark.range(2).mapInPandas(importable, "found boolean").collect())
sys.path.insert(0, {repo!r})
from tessera.llm import queries
for name in {names!r}:
    print(name, queries.QUERIES[name](spark, "/root/testdata/sf0.001").count(), flush=True)
"""
NAMES = ["op1_url_filter", "op3_simhash", "op5_toxicity", "op6_language_id", "op7_token_matrices", "op8_bpe", "op9_lm_score", "op11_warc", "op12_phrases", "op13_filter_audit"]


@pytest.mark.parametrize("names", [NAMES[:5], NAMES[5:]])
def test_workers_without_the_package(tmp_path, names):
    script = tmp_path / "away.py"
    script.write_text(SCRIPT.format(repo=REPO, names=names))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    if "PYTHONPATH" in os.environ:
        env["PYTHONPATH"] = os.pathsep.join(p for p in os.environ["PYTHONPATH"].split(os.pathsep) if os.path.abspath(p or ".") != REPO)
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    assert [line.split()[0] for line in done.stdout.splitlines() if line.startswith("op")] == names
