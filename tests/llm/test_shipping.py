"""What tasks run must load where the package is not installed."""

import os
import subprocess
import sys

from pyspark import cloudpickle

from riskloom.llm import hardneg, htmltext, linking, neardup, ngramjoin, packing, prefixtrie, tokencount, topk, toxicity


def test_functions_load_without_the_package(tmp_path):
    shipped = [
        neardup._signed(21, 0), neardup._prune(0.85, 21), linking._parts(5, 0, []), ngramjoin._signed(4, 0, 85), hardneg._searching(5, True),
        prefixtrie._chunks, prefixtrie._hashed, packing._tokenised("file", 0), packing.fill,
        tokencount._Pack, tokencount._pieces("file"), htmltext._votes, htmltext.text_under, topk.nra_block,
        toxicity._scorer, toxicity._document_features, toxicity.Field,
    ]
    path = tmp_path / "shipped"
    path.write_bytes(cloudpickle.dumps(shipped))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = "import pickle, sys; pickle.load(open(sys.argv[1], 'rb')); assert 'riskloom' not in sys.modules"
    done = subprocess.run([sys.executable, "-c", code, str(path)], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
