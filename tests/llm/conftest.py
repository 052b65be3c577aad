import pytest

pytest.importorskip("fathomry.llm")
