"""The driver's contract."""

import __spark_entry__ as entry


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_core_does_not_need_documents():
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "massweave"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "massweave.llm" in p.read_text()]
