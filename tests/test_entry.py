"""The entry works where the training-data part isn't installed, and raises what breaks inside it."""

import sys

import pytest

import __spark_entry__ as E


class Hidden:
    """Finds no module of the training-data part."""

    def find_spec(self, name, path=None, target=None):
        if name.split(".")[:2] == ["pathweave", "llm"] or (self.pipeline and name == "corpus_pipeline"):
            raise ModuleNotFoundError(f"No module named {name!r}", name="pathweave.llm" if name != "corpus_pipeline" else name)

    def __init__(self, pipeline):
        self.pipeline = pipeline


@pytest.mark.parametrize("pipeline", [True, False])
def test_queries_without_the_training_data_part(monkeypatch, pipeline):
    for name in [m for m in sys.modules if m.startswith("pathweave.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(sys, "meta_path", [Hidden(pipeline), *sys.meta_path])
    found = E.queries()
    assert "game_levels" in found and "pipeline" not in found and not any(n.startswith("op") and n[2].isdigit() for n in found)
    assert set(E.oracle_sql()) == set(found)


def test_an_error_inside_the_part_is_raised(monkeypatch):
    def broken(name):
        raise ModuleNotFoundError("No module named 'tokenizers'", name="tokenizers")

    monkeypatch.setattr(E.importlib, "import_module", broken)
    with pytest.raises(ModuleNotFoundError, match="tokenizers"):
        E.queries()
