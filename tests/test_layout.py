"""The package stands without its optional parts."""

import pathlib
import re

import __spark_entry__

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_nothing_else_imports_the_corpus_operators():
    for path in (ROOT / "brookline").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"(import|from)[^\n]*\bllm\b", path.read_text()), path


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
