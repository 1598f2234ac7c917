"""The entry module without the packages that only the corpus operators need."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
CODE = """
import sys, warnings
sys.modules[{name!r}] = None  # an import of it fails as if it were not installed
with warnings.catch_warnings(record=True) as told:
    warnings.simplefilter("always")
    import __spark_entry__ as entry
print(len(told), len(entry.queries()), sum(q.startswith("op") or q == "pipeline" for q in entry.queries()), len(entry.oracle_sql()))
"""


def names(module):
    out = subprocess.run([sys.executable, "-c", CODE.format(name=module)], cwd=ROOT, capture_output=True, text=True, check=True, timeout=300)
    return [int(v) for v in out.stdout.split()]


def test_core_queries_survive_a_missing_package():
    for module in ("sentencepiece", "public_tokenizers", "readtrace.llm", "corpus_pipeline"):
        warned, queries, corpus, oracles = names(module)
        assert warned >= 1 and queries > 150 and corpus == 0 and oracles > 140
