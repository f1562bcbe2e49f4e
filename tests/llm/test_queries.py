import re

import __spark_entry__


def test_every_operator_has_one_query():
    names = [n for n in __spark_entry__.queries() if re.match(r"op\d+_|pipeline$", n)]
    assert len(names) == 14 and "pipeline" in names
    assert {int(n[2:].split("_")[0]) for n in names if n != "pipeline"} == set(range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
