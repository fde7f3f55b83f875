"""A client for chat-completion services with the common JSON interface, and a bound on calls in flight."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

from .config import EnrichConfig

PROMPT = "Module: {{moduleName}}\nSignature: {{signature}}\nImplementation:\n{{implementation}}\n\nAnswer with JSON {\"brief\": \"one sentence\", \"tags\": [\"tag\"]}."


def completion(config: EnrichConfig, prompt: str, key: str = "") -> str:
    """The text that the model answers to one prompt."""
    body = {"model": config.model, "temperature": config.clamped_temperature(), "max_tokens": config.max_tokens, "messages": [{"role": "user", "content": prompt}]}
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    request = urllib.request.Request(f"{config.base_url.rstrip('/')}/chat/completions", json.dumps(body).encode(), headers)
    with urllib.request.urlopen(request, timeout=config.timeout) as answer:
        return json.load(answer)["choices"][0]["message"]["content"]


def http_client(config: EnrichConfig, key: str = "", template: str = PROMPT) -> Callable[[str, str, str], str]:
    """A client for `with_briefs`: asks the service at config.base_url about one symbol."""

    def ask(module: str, signature: str, implementation: str) -> str:
        prompt = template
        for name, value in (("moduleName", module), ("signature", signature), ("implementation", implementation)):
            prompt = prompt.replace("{{" + name + "}}", value or "")
        return completion(config, prompt, key)

    return ask


def retried(call: Callable[[], str], retries: int, pause: float) -> str | None:
    """The result of a call, tried again after growing pauses; None where all tries fail."""
    for k in range(retries + 1):
        try:
            return call()
        except Exception:  # whatever a client raises: a failed call must not fail the job
            if k < retries:
                time.sleep(pause * 2**k)
    return None


def in_flight(calls: Iterable[Callable[[], str]], most: int, retries: int = 2, pause: float = 0.5) -> Iterator[str | None]:
    """Results in the order of the calls, of which at most `most` run at once; no call starts before its turn is near."""
    with ThreadPoolExecutor(max(1, most)) as pool:
        waiting: deque = deque()
        for call in calls:
            waiting.append(pool.submit(retried, call, retries, pause))
            if len(waiting) >= max(1, most):
                yield waiting.popleft().result()
        while waiting:
            yield waiting.popleft().result()
