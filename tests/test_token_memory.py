"""Token counts hold one text's encoding at a time."""

import subprocess
import sys
from pathlib import Path

import pytest

from brasstally.operators import retrieval

SCRIPT = """
import resource, sys
import pyarrow as pa
import public_tokenizers
from brasstally.operators import retrieval

batch = pa.RecordBatch.from_pydict({"text": ["one two three four " * 500] * 3000})

class Docs:
    \"\"\"One task's batch in place of a table; aggregates aren't looked at.\"\"\"
    def select(self, *columns): return self
    def mapInPandas(self, f, schema): self.out = [b.to_dict("list") for b in f(iter([batch.to_pandas()]))]; return self
    def mapInArrow(self, f, schema): self.out = [b.to_pydict() for b in f(iter([batch]))]; return self
    def agg(self, *columns): return self.out

retrieval.F.coalesce = retrieval.F.sum = retrieval.F.lit = lambda *x: type("C", (), {"alias": lambda self, n: self})()
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
files = [public_tokenizers.path(f"byte_bpe_50k.{x}") for x in sys.argv[1:]]
out = retrieval.token_count(Docs(), *files)
print(sum(out[0]["tokens"]), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


@pytest.mark.parametrize("files", [("json",), ("json", "tiktoken")])
def test_peak_memory(files):
    pytest.importorskip("public_tokenizers")
    found = subprocess.run([sys.executable, "-c", SCRIPT, *files], cwd=Path(__file__).parent.parent, capture_output=True, text=True, timeout=300)
    tokens, mb = map(int, found.stdout.split())
    assert tokens >= 6_000_000 and mb < 250


def test_same_counts(spark):
    public = pytest.importorskip("public_tokenizers")
    docs = spark.createDataFrame([(t,) for t in ("one two", None, "", "a<|endoftext|>b", " " * 70_000, "é漢 🙂\n\n x", "three " * 50)], "text string").repartition(3)
    files = [public.path(f"byte_bpe_50k.{x}") for x in ("json", "tiktoken")]
    assert retrieval.token_count(docs, files[0]).first() == retrieval.token_count(docs, *files).first()
    assert tuple(retrieval.token_count(docs.limit(0), *files).first()) == (0, 0)
