"""The corpus queries that have SQL, on whole tables and on awkward ones."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from gridloom.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_corpus import awkward
from tests.parity import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    """Awkward documents with distinct ids: SQL numbers rows, which cannot order two rows of one id."""
    at = tmp_path_factory.mktemp("small")
    rows = {r[0]: r for r in awkward() if r[0] is not None}
    pq.write_table(pa.table({"doc_id": pa.array(list(rows), pa.int64()), "text": pa.array([r[1] for r in rows.values()], pa.string())}), at / "documents.parquet")
    words = next(r[1] for r in rows.values() if r[1] and len(r[1].split()) == 60).split()
    items = [" ".join(words[3:20]), " ".join(words[5:9]).upper(), None, "", "x", "123 !!!", " ".join(words[40:50])]
    pq.write_table(pa.table({"item_id": pa.array([10, 9, 2, 3, 4, 5, 6], pa.int64()), "text": pa.array(items, pa.string())}), at / "benchmark.parquet")
    return str(at)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_table(spark, name):
    assert compare(spark, connect(SF), name, QUERIES[name], ORACLE_SQL[name], SF) == 200


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_awkward(spark, small, name):
    compare(spark, connect(small, ["documents", "benchmark"]), name, QUERIES[name], ORACLE_SQL[name], small)
