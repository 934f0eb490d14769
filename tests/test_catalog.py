"""Every query beside its SQL at the smallest size; those without SQL run and give rows."""

import pytest
from compare import difference, views

from tonespan.plans import catalog

SF = "/root/testdata/sf0.001"
SLOW = ("g11_iterative", "h6_iterative")


@pytest.fixture(scope="module")
def duck():
    return views(SF)


@pytest.mark.parametrize("name", list(catalog.SQL))
def test_same_as_sql(spark, duck, name):
    assert difference(catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.SQL[name]).df()) == ""


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.SQL])
def test_rows_without_sql(spark, name):
    assert len(catalog.QUERIES[name](spark, SF).take(1)) == 1


def test_the_engine_doesn_t_import_the_llm_subpackage():
    import pathlib

    root = pathlib.Path(catalog.__file__).resolve().parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "llm" not in p.read_text(), p
