import pytest

from fotoloom.llm import registry

COLUMNS = {
    "p2_found": ["cluster_id", "photo_id"], "p3_found": ["probe_no", "neighbour_id"], "p4_found": ["tag_a", "tag_b"], "p5_found": ["device_key", "first_photo_id", "last_photo_id"],
    "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, small, same_as_sql, name):
    query, sql = registry.queries()[name], registry.oracle_sql().get(name)
    if sql:
        same_as_sql(spark, name, query, sql, small)
    else:
        assert query(spark, small).count() > 0
    if name in COLUMNS:
        assert query(spark, small).columns == COLUMNS[name]
