from pathlib import Path

import pytest

from rinsework.plans import writer


def test_places_of_a_model(tmp_path, monkeypatch):
    monkeypatch.setattr(Path, "home", lambda: tmp_path)
    monkeypatch.delenv(writer.MODEL_DIR, raising=False)
    monkeypatch.chdir(tmp_path)
    with pytest.raises(writer.NoModel):
        writer.find_model("m.gguf")
    own = tmp_path / "models" / "m.gguf"
    own.parent.mkdir()
    own.touch()
    assert writer.find_model("m.gguf") == own
    fetched = tmp_path / "fetched.gguf"
    fetched.touch()
    assert writer.find_model("m.gguf", lambda name: fetched) == fetched
    assert writer.find_model("m.gguf", lambda name: None) == own
    cached = tmp_path / ".cache" / "rinsework" / "models" / "m.gguf"
    cached.parent.mkdir(parents=True)
    cached.touch()
    assert writer.find_model("m.gguf", lambda name: fetched) == cached
    monkeypatch.setenv(writer.MODEL_DIR, str(fetched))
    assert writer.find_model("m.gguf") == fetched


def test_no_runtime(tmp_path):
    try:
        import llama_cpp  # noqa: F401
    except ImportError:
        with pytest.raises(writer.NoModel):
            writer.local_writer(tmp_path / "m.gguf")
