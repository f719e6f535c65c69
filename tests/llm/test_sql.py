"""The SQL of the operators that have one, on the odd cases and on the whole small table."""

from collections import Counter

import duckdb
import pytest

from seqloom.llm import exact_dedup, mixing, secret_scan
from seqloom.llm.oracle import ORACLE

OPERATORS = {
    "op1_secret_scan": secret_scan.scan,
    "op3_source_mixing": lambda docs: mixing.plan(docs).select("doc_id", "size", "source_size", "target", "taken"),
    "op7_exact_dedup": exact_dedup.resolve,
}


def test_all_are_here():
    assert set(OPERATORS) | {"op11_url_filter", "op12_source_divergence", "op13_filter_interactions"} == set(ORACLE)  # these in test_audits.py


@pytest.mark.parametrize("docs_name", ["docs", "sample", "no_docs"])
@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_same_as_sql(request, tmp_path, name, docs_name):
    docs = request.getfixturevalue(docs_name)
    docs.write.parquet(str(tmp_path / "documents"))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    found, wanted = OPERATORS[name](docs), duck.sql(ORACLE[name])
    cols = sorted(wanted.columns)
    assert sorted(found.columns) == cols
    said = lambda x: f"{x:.9g}" if isinstance(x, float) else str(x)
    got = Counter(tuple(map(said, r)) for r in found.select(*cols).collect())
    assert got == Counter(tuple(map(said, r)) for r in wanted.select(", ".join(cols)).fetchall())
