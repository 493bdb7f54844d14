import pytest
from oracle import DATA, compare, duck

from tidemark.llm.queries import QUERIES, p1_pieces, p7_containers

SF = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs_and_gives_what_its_sql_gives(spark, name):
    ok, say = compare(spark, name, SF, duck(SF))
    assert ok, say


def test_containers_are_well_filled(spark):
    rows = p7_containers(spark, f"{DATA}/sf0.01").collect()
    assert max(r.tokens for r in rows) <= 2048
    assert sum(r.tokens for r in rows) >= 0.95 * 2048 * len(rows)


def test_pieces_keep_the_limit(spark):
    assert p1_pieces(spark, SF).where("token_count > 512").count() == 0
