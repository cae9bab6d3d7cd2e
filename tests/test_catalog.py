import pytest
from oracle import same

from folio.plans import catalog

ONLY_ROWS = {"html_texts"}


def test_every_query_has_sql():
    assert set(catalog.QUERIES) - set(catalog.SQL) == ONLY_ROWS


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, data, name):
    same(spark, data, catalog.QUERIES[name], catalog.SQL[name])


def test_html_texts(spark, data):
    assert catalog.html_texts(spark, data).where("markdown LIKE '#%'").count() > 0
