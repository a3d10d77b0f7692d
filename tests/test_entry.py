import importlib

import __spark_entry__ as entry
from strandwise.operators.events import refined
from strandwise.runtime import small_side


def test_a_package_that_does_not_import_leaves_the_rest(monkeypatch):
    whole = importlib.import_module

    def broken(name, *args):
        if name.startswith("strandwise.llm"):
            raise ImportError(name)
        return whole(name, *args)

    monkeypatch.setattr(importlib, "import_module", broken)
    names = set(entry.queries())
    assert {"p1_found", "p2_found", "j5_overlap"} <= names and not any(n.startswith(("p3_", "p4_", "p8_")) for n in names)
    assert set(entry.oracle_sql()) <= names


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_what_is_broadcast_is_small_in_rows_and_bytes(spark):
    few = spark.createDataFrame([(i, "x" * 100) for i in range(10)], "id long, text string")
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(small_side(few)) and not hinted(small_side(few, limit=9)) and not hinted(small_side(few, most_bytes=500))
    assert hinted(small_side(few.where("id < 0")))


def test_refined_bounds(spark):
    rows = [
        ("del", 1000, 5000, 90, 350, -7),  # two windows of 201 with a spacer: 900 + 89; 4900 + 350 - 300 - 2
        ("del", 1000, 1150, 90, 220, 4),  # windows meet: 900 + 219; bases between
        ("del", 1000, 5000, 0, 0, 9),  # nothing known
        ("tandem_dup", 1000, 5000, 90, 0, -3),
        ("del", 1000, 1001, 0, 0, 0),  # no size
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, event string, start long, end long, bp0 long, bp1 long, between long")
    got = {r.id: (r.event, r.start, r.end, r.size, r.inserted, r.homology) for r in refined(df, 100).collect()}
    assert got == {0: ("del", 989, 4948, 3958, None, 7), 1: ("del_ins", 989, 1119, 129, 4, None), 2: ("del", 1000, 5000, 3999, None, 1000), 3: ("tandem_dup", 989, 5000, 4011, None, 3)}
