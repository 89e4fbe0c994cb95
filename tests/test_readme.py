from pathlib import Path

import pytest

import __spark_entry__


@pytest.mark.parametrize("name", ["SRC1", "SRC3", "PRJ3", "PRJ5", "PRJ6", "PRJ7", "FLT11", "J15", "A34"])
def test_ids_without_a_query_are_listed(name):
    listed = (Path(__file__).parents[1] / "README.md").read_text().split("## Not covered")[1].split("\n## ")[0]
    assert any(q.startswith(f"{name.lower()}_") for q in __spark_entry__.queries()) or name in listed.replace(",", " ").replace(".", " ").split()
