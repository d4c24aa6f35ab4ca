import pytest

from palimpsest.sources import config as cfg


def test_layers():
    text = '{"retrieval": {"top_k": 7}, "hosts": {"beta": {"retrieval": {"top_k": 8}}}}'
    assert cfg.load_config(text)["retrieval"]["top_k"] == 7
    assert cfg.load_config(text, host="beta")["retrieval"]["top_k"] == 8
    assert cfg.load_config(text, {"PALIMPSEST_RETRIEVAL_TOP_K": "9"}, "beta")["retrieval"]["top_k"] == 9


@pytest.mark.parametrize("text", ['{"retrieval": {"top_k": 11}}', '{"retrieval": {"top_k": true}}', '{"retrieval": {"top_k": 1.5}}', '{"retrieval": {"other": 1}}'])
def test_bounds(text):
    with pytest.raises(ValueError):
        cfg.load_config(text)


def test_merge():
    assert cfg.deep_merge({"a": {"b": 1, "c": [1, 2]}, "d": 1}, {"a": {"c": [3]}, "d": None}) == {"a": {"b": 1, "c": [3]}, "d": None}


def test_host():
    assert cfg.detect_host(None, ["/bin/beta-x"]) == "beta" and cfg.detect_host("alpha", []) == "alpha" and cfg.detect_host(None, []) == "alpha"
    with pytest.raises(ValueError):
        cfg.detect_host("other", [])


def test_cache():
    now, made = [0.0], []
    cache = cfg.RecallCache(2, 10, lambda: now[0])
    make = lambda: made.append(1) or len(made)
    assert [cache.get("a", make), cache.get("a", make), cache.get("b", make), cache.get("c", make)] == [1, 1, 2, 3]
    assert cache.get("a", make) == 4
    now[0] = 11
    assert cache.get("c", make) == 5
    cache.settle("c")
    assert cache.get("c", make) == 6
