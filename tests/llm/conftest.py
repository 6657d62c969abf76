from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def tokenizer() -> str:
    from relayloom.llm.queries import tokenizer_path

    return tokenizer_path()
