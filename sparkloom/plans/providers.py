"""Text generators by name: local and hosted model servers, and ones of your own."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable, Mapping

Generator = Callable[[str], str]
# Output limit of the local generator, in tokens.
LOCAL_TOKENS = 500


def _post(url: str, body: dict, headers: dict[str, str] | None = None, timeout: float = 120) -> dict:
    req = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **(headers or {})})
    with urllib.request.urlopen(req, timeout=timeout) as r:
        return json.load(r)


class Local:
    """A server with the generate interface on this or another machine."""

    def __init__(self, env: Mapping[str, str]):
        self.url, self.model = env.get("LOCAL_MODEL_URL", "http://127.0.0.1:11434"), env.get("LOCAL_MODEL", "default")

    def __call__(self, prompt: str) -> str:
        return _post(f"{self.url}/api/generate", {"model": self.model, "prompt": prompt, "stream": False, "options": {"num_predict": LOCAL_TOKENS}})["response"]


class Google:
    def __init__(self, env: Mapping[str, str]):
        self.key, self.model = _key(env, "GOOGLE_API_KEY"), env.get("GOOGLE_MODEL", "gemini-pro")

    def __call__(self, prompt: str) -> str:
        url = f"https://generativelanguage.googleapis.com/v1beta/models/{self.model}:generateContent"
        return _post(url, {"contents": [{"parts": [{"text": prompt}]}]}, {"x-goog-api-key": self.key})["candidates"][0]["content"]["parts"][0]["text"]


class OpenAI:
    def __init__(self, env: Mapping[str, str]):
        self.key, self.model = _key(env, "OPENAI_API_KEY"), env.get("OPENAI_MODEL", "gpt-3.5-turbo")

    def __call__(self, prompt: str) -> str:
        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}]}
        return _post("https://api.openai.com/v1/chat/completions", body, {"Authorization": f"Bearer {self.key}"})["choices"][0]["message"]["content"]


def _key(env: Mapping[str, str], name: str) -> str:
    if not env.get(name):
        raise ValueError(f"{name} is not set")
    return env[name]


#: Names of both of the mapper's and the answerer's providers, in lower case.
PROVIDERS: dict[str, Callable[[Mapping[str, str]], Generator]] = {"local": Local, "ollama": Local, "google": Google, "gemini": Google, "googlegemini": Google, "openai": OpenAI}


def generator(name: str = "local", *, env: Mapping[str, str] | None = None, more: Mapping[str, Callable[[Mapping[str, str]], Generator]] | None = None) -> Generator:
    """The generator of that name, in any case; ``more`` adds makers of your own.

    An unknown name or a key that isn't set is a ValueError.
    """
    makers = PROVIDERS | {k.lower(): v for k, v in (more or {}).items()}
    if name.lower() not in makers:
        raise ValueError(f"unknown provider: {name}")
    return makers[name.lower()](os.environ if env is None else env)
