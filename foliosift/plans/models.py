"""A language model behind an adapter: retries, prices, usage as rows. None is built in."""

from __future__ import annotations

import time
from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass, field
from threading import BoundedSemaphore

ATTEMPTS, DELAY, TIMEOUT = 3, 2.0, 180.0


@dataclass(frozen=True)
class ModelConfig:
    name: str
    prompt_cost: float
    completion_cost: float
    max_tokens: int = 4096
    temperature: float = 0.0


@dataclass
class Adapter:
    """``call(config, prompt, timeout)`` returns (text, prompt tokens, completion tokens)."""

    call: Callable[[ModelConfig, str, float], tuple[str, int, int]]
    configs: dict[str, ModelConfig]
    attempts: int = ATTEMPTS
    delay: float = DELAY
    usage: list[tuple] = field(default_factory=list)
    #: ``stream_call(config, prompt, timeout)`` yields chunks and returns prompt and completion tokens.
    stream_call: Callable[[ModelConfig, str, float], Generator[str, None, tuple[int, int]]] | None = None
    #: Calls that may be open at once.
    at_once: int = 4

    def __post_init__(self):
        self._open = BoundedSemaphore(self.at_once)

    def complete(self, capability: str, prompt: str, stage: str, source: str = "") -> str:
        if capability not in self.configs:
            raise ValueError(f"no model for {capability}")
        config = self.configs[capability]
        for attempt in range(1, self.attempts + 1):
            try:
                with self._open:
                    text, n_in, n_out = self.call(config, prompt, TIMEOUT)
            except Exception:
                self.usage.append((len(self.usage), stage, source, 0, 0, config.prompt_cost, config.completion_cost, False))
                if attempt == self.attempts:
                    raise
                time.sleep(self.delay)
            else:
                self.usage.append((len(self.usage), stage, source, n_in, n_out, config.prompt_cost, config.completion_cost, True))
                return text
        raise AssertionError("unreachable")

    def stream(self, capability: str, prompt: str, stage: str, source: str = "") -> Iterator[str]:
        """Chunks as they come; the usage is known at the end, and noted also where the caller stops
        or the model fails before it. Without ``stream_call``, the lines of a finished text."""
        if self.stream_call is None:
            yield from self.complete(capability, prompt, stage, source).splitlines(keepends=True)
            return
        if capability not in self.configs:
            raise ValueError(f"no model for {capability}")
        config, n_in, n_out, ok = self.configs[capability], 0, 0, False
        try:
            with self._open:
                n_in, n_out = yield from self.stream_call(config, prompt, TIMEOUT)
            ok = True
        finally:
            self.usage.append((len(self.usage), stage, source, n_in, n_out, config.prompt_cost, config.completion_cost, ok))
