from types import SimpleNamespace

import pytest

from quern.llm.common import scratch_dir


def session(master, where=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: where), sparkContext=SimpleNamespace(master=master, applicationId=f"app of {master}"))


def test_scratch_dir():
    """A folder of its own in local mode only, the same at each call; the one that is set otherwise."""
    for master in ("local", "local[4]"):
        assert scratch_dir(session(master)) == scratch_dir(session(master))
    assert scratch_dir(session("spark://x", "file:///shared/")) == "file:///shared"
    for master in ("spark://x", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError, match="checkpoint"):
            scratch_dir(session(master))
