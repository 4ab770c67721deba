from __future__ import annotations

import pathlib

ROOT = pathlib.Path(__file__).resolve().parent.parent / "lodestrata"


def test_core_stands_without_the_subpackage():
    for p in ROOT.rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "lodestrata.llm" not in p.read_text(), p
