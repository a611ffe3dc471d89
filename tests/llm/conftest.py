import pytest

pytest.importorskip("tanglaw.llm")
