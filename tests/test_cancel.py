import threading

import pytest


def test_a_tagged_query_can_be_cancelled(engine):
    engine.cancellable("slow")
    timer = threading.Timer(3, engine.cancel, ["slow"])
    timer.start()
    with pytest.raises(Exception, match="(?i)cancel"):
        engine.execute_query("SELECT COUNT(*) AS n FROM sys.all_objects a CROSS JOIN sys.all_objects b CROSS JOIN sys.all_objects c WHERE a.object_id * b.object_id % 7 + c.object_id % 11 = -1")
    timer.join()
    engine.cancellable("next")
    assert engine.execute_query("SELECT COUNT(*) AS n FROM sys.all_objects").rows == [{"n": 2000}]
