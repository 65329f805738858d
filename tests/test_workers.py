import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from millrace.session import session
from millrace.operators.learn import sgd_train
spark = session("local[2]", 2)
df = spark.createDataFrame([(1, 1.0, [1, 2])], "doc_id long, y double, features array<int>")
assert sgd_train(df, ["doc_id"]).count() == 2
"""


def test_workers_find_the_package_from_any_folder(tmp_path):
    """Only the driver's path names the package, and the working folder is another one."""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=repo)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
