import os

from sidelight import workspace
from sidelight.workspace import Workspace, passing


def test_tables_live_as_long_as_they_are_read(spark):
    outer = Workspace(spark, "outer")
    kept = outer.table(spark.range(3), "a")
    with passing():
        inner = Workspace(spark, "inner")
        gone = inner.table(kept, "b")
        kept2 = outer.table(gone, "c")
    plain = lambda path: path.removeprefix("file:")
    assert not os.path.exists(plain(inner.root)) and kept2.count() == kept.count() == 3
    outer.drop(kept)
    assert not os.path.exists(plain(kept._workspace_path)) and kept2.count() == 3
    workspace.clear([outer.root])
    assert not os.path.exists(plain(outer.root)) and not outer.alive
    workspace.clear(["never made"])
