"""A language model on this machine as a writer of plans. Optional: without a model or its runtime the rules write the plan."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from pathlib import Path

from rinsework.plans.ir import json_schema

MODEL_DIR = "RINSEWORK_MODEL_DIR"


class NoModel(FileNotFoundError):
    """The model is in none of the places."""


def _places(name: str) -> Iterator[Path]:
    """Before a download is tried: the folder or file that the environment names, then the user's cache."""
    if named := os.environ.get(MODEL_DIR):
        yield Path(named) if named.endswith(".gguf") else Path(named) / name
    yield Path.home() / ".cache" / "rinsework" / "models" / name


def _last_places(name: str) -> Iterator[Path]:
    yield Path("/app/models") / name
    yield Path.cwd() / "models" / name


def find_model(name: str, download: Callable[[str], Path | None] | None = None) -> Path:
    """download: brings the file from somewhere, or returns None; without one nothing leaves the machine."""
    for place in _places(name):
        if place.is_file():
            return place
    if download is not None and (got := download(name)) is not None and Path(got).is_file():
        return Path(got)
    for place in _last_places(name):
        if place.is_file():
            return place
    raise NoModel(f"{name}: set {MODEL_DIR}, or put it into {next(reversed([*_places(name)])).parent}")


def local_writer(path: Path, tokens: int = 2048) -> Callable[[str], str]:
    """A writer for make_plan(); its output is held to the plan's schema, and make_plan() checks it again."""
    try:
        from llama_cpp import Llama, LlamaGrammar
    except ImportError as e:
        raise NoModel("the runtime for local models is not installed") from e
    model = Llama(str(path), n_ctx=8192, verbose=False)
    grammar = LlamaGrammar.from_json_schema(json.dumps(json_schema()))

    def write(profile: str) -> str:
        prompt = f"Profile of a table:\n{profile}\nWrite the steps that clean it, as a JSON list.\n"
        return model(prompt, max_tokens=tokens, temperature=0.0, grammar=grammar)["choices"][0]["text"]

    return write
