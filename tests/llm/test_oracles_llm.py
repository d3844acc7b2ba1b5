"""What SQL can say of operators whose results it cannot express whole, at two sizes."""

import pytest
from compare import SMALL, database, rows_of_duckdb, rows_of_spark

from lexiforge.llm import queries


@pytest.mark.parametrize("name", ["quality_base", "mix_targets", "pii_base"])
@pytest.mark.parametrize("folder", [SMALL, "/root/testdata/sf0.01"])
def test_query(spark, name, folder):
    got = rows_of_spark(queries.queries()[name](spark, folder))
    assert got == rows_of_duckdb(database(folder), queries.oracle_sql()[name])


def test_parts_agree_with_the_whole(spark):
    """The parts come from the same operators: their columns are those of the whole queries."""
    whole, part = (queries.queries()[q](spark, SMALL) for q in ("op9_pii", "pii_base"))
    assert sorted(map(tuple, whole.select(*part.columns).collect())) == sorted(map(tuple, part.collect()))
    whole, part = (queries.queries()[q](spark, SMALL) for q in ("op3_quality_rules", "quality_base"))
    assert sorted(map(tuple, whole.select(*part.columns).collect())) == sorted(map(tuple, part.collect()))
