"""The registry, and independence from the corpus subpackage."""

import os
import re

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_registry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_nothing_else_needs_the_corpus_subpackage():
    for folder, _, names in os.walk(os.path.join(ROOT, "marlstone")):
        if os.sep + "llm" in folder[len(ROOT) :]:
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as f:
                    assert not re.search(r"^\s*(from|import)\s.*\bllm\b", f.read(), re.M), name
