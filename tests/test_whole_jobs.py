"""The registered queries run the operators at their own settings, not on a smaller job."""

import inspect

import pytest

from catalog import learning as q
from flowverdict.operators import explain as ex, forest as fo, gate as gt, gcn
from flowverdict.plans import compare


class Called(Exception):
    pass


def settings(monkeypatch, module, name, call):
    """Arguments with a default that ``call`` sets to another value."""
    spec = inspect.signature(getattr(module, name))

    def spy(*args, **named):
        given = spec.bind(*args, **named).arguments
        rest = given.pop("forest", {}) if name in ("compare_methods", "train_forest") else given.pop("fit", {})
        raise Called({k: v for k, v in given.items()
                      if spec.parameters[k].default not in (inspect.Parameter.empty, v)} | rest)

    monkeypatch.setattr(module, name, spy)
    with pytest.raises(Called) as found:
        call()
    return found.value.args[0]


@pytest.mark.parametrize("module, name", [(fo, "search_forest"), (gcn, "search_gcn")])
def test_searches_walk_the_whole_grid(spark, folder, monkeypatch, module, name):
    assert settings(monkeypatch, module, name, lambda: getattr(q, name)(spark, folder)) == {}


def test_comparison_at_full_size(spark, folder, monkeypatch):
    call = lambda: q.compare_methods(spark, folder)
    assert settings(monkeypatch, compare, "compare_methods", call) == {}


def test_models_at_full_size(spark, folder, monkeypatch):
    monkeypatch.setattr(q, "_MODELS", {})
    assert settings(monkeypatch, fo, "train_forest", lambda: q.models(spark, folder).forest) == {}
    call = lambda: q.models(spark, folder).gcn
    assert settings(monkeypatch, gcn, "fit_gcn", call) == {"pos_weight": "balanced"}
    assert settings(monkeypatch, gt, "fit_gate", lambda: q.fit_gate(spark, folder)) == {}


@pytest.mark.parametrize("name", ["explain_forest", "explain_batch"])
def test_explanations_draw_all_sample_points(spark, folder, monkeypatch, name):
    models = q.detect.Models(None, None, None)
    monkeypatch.setattr(q, "models", lambda *_: models)
    assert settings(monkeypatch, ex, name, lambda: getattr(q, name)(spark, folder)) == {}
