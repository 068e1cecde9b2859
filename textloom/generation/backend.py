"""Backends that answer prompts with JSON: the protocol, a deterministic stub, and one over HTTP."""

from __future__ import annotations

import hashlib
import json
import os
import random
import re
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from typing import Any, Protocol

from ..functions.model_json import extract

#: Attempts, tokens that each adds, and what each adds to the prompt.
ATTEMPTS, MORE_TOKENS = 3, 150
REMINDERS = ("", "\nYour last answer could not be read. Answer with one JSON object only.", "\nAnswer with minified JSON only, from { to }, all quotes in strings escaped.")
LEAST_CALLS, MOST_CALLS, TIMEOUT, RETRIES, LONGEST_WAIT = 1, 100, 180, 4, 30


class Backend(Protocol):
    model_name: str

    def generate_json(self, system: str, prompt: str, *, max_new_tokens: int, enable_thinking: bool = False) -> Any: ...


def ask(backend: Backend, system: str, prompt: str, max_new_tokens: int = 1024) -> Any:
    """An answer, with more tokens and a stricter reminder after each that could not be read. Other errors are not retried."""
    error: Exception | None = None
    for attempt in range(ATTEMPTS):
        try:
            return backend.generate_json(system, prompt + REMINDERS[attempt], max_new_tokens=max_new_tokens + MORE_TOKENS * attempt)
        except (ValueError, TypeError) as e:
            error = e
    raise ValueError(f"no valid JSON after {ATTEMPTS} attempts") from error


class Stub:
    """Answers from the prompt's last passage alone, always the same for the same prompt."""

    model_name = "stub"

    def generate_json(self, system: str, prompt: str, *, max_new_tokens: int = 0, enable_thinking: bool = False) -> Any:
        passage = prompt.rpartition("CONTEXT:\n")[2].strip()
        words = passage.split()
        subject = " ".join(words[:6]).strip(".,;:") or "nothing"
        mark = int(hashlib.sha1(prompt.encode()).hexdigest()[:8], 16)
        if "grounding" in system:
            return {"grounded": bool(words), "reason": ""}
        if "summary" in system:
            return {"summary": " ".join(words[:60])}
        if "profile" in system or "personas" in system:
            return self._analysis(system, words, mark)
        verbs = ("Explain", "Describe", "Outline", "State", "Clarify")
        return {"instruction": f"{verbs[mark % 5]} {subject} and {' '.join(words[6:9])}", "output": " ".join(words[:40]) or "-", "standalone": True}

    def _analysis(self, system: str, words: list[str], mark: int) -> dict:
        """A profile or personas of the longest words of a passage."""
        long = sorted({w for w in re.findall(r"[a-z]{5,}", " ".join(words).lower())}, key=lambda w: (-len(w), w))[:8] or ["text"]
        out: dict = {}
        if "profile" in system:
            out = {"domain": long[0], "source_kind": "other", "content_signals": long[:3], "extractable_assets": long[3:5], "preferred_task_types": ["define_term", "compare_terms", "apply_rule"],
                   "instruction_guidance": "Name the subject.", "answer_guidance": "Be brief.", "avoid": [], "recommended_chunk_level": "paragraph"}
        if "personas" in system:
            out["personas"] = [{"name": f"{w}-reader", "description": f"Wants to know about {w}.", "chunk_level": ("paragraph", "section")[(mark + i) % 2], "question_style": f"Asks about {w}."} for i, w in enumerate(long[:5])]
        return out


def _slots() -> threading.Semaphore:
    """The calls that a process (one Python worker) has at once, whatever tasks and threads it runs: TEXTLOOM_CALLS, within bounds."""
    global _GATE
    with _LOCK:
        if _GATE is None:
            _GATE = threading.Semaphore(calls(int(os.environ.get("TEXTLOOM_CALLS", "0") or 0)))
        return _GATE


_GATE: threading.Semaphore | None = None
_LOCK = threading.Lock()


class Http:
    """An OpenAI-like chat endpoint. Executors build it from its address and the name of the variable that holds the key; the key itself is never sent to them."""

    def __init__(self, url: str, model: str, key_variable: str):
        self.url, self.model_name, self.key_variable = url, model, key_variable

    def generate_json(self, system: str, prompt: str, *, max_new_tokens: int = 1024, enable_thinking: bool = False) -> Any:
        key = os.environ.get(self.key_variable)
        if not key:
            raise RuntimeError(f"{self.key_variable} is not set")
        body = {"model": self.model_name, "max_tokens": max_new_tokens, "messages": [{"role": "system", "content": system}, {"role": "user", "content": prompt}]}
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
        for attempt in range(RETRIES + 1):
            try:
                with _slots(), urllib.request.urlopen(request, timeout=TIMEOUT) as answer:
                    return extract(json.load(answer)["choices"][0]["message"]["content"])
            except urllib.error.HTTPError as e:
                if attempt == RETRIES or not (e.code == 429 or e.code >= 500):
                    raise
            except OSError:
                if attempt == RETRIES:
                    raise
            time.sleep(min(LONGEST_WAIT, 2**attempt + random.random()))
        raise AssertionError


def calls(wanted: int | None) -> int:
    """Calls at once, within bounds."""
    return max(LEAST_CALLS, min(MOST_CALLS, wanted or MOST_CALLS))


def factory(url: str | None = None, model: str | None = None, key_variable: str = "TEXTLOOM_API_KEY", names: dict[str, str] | None = None) -> Callable[[], Backend]:
    """What makes a job's backend on the executors: that of an address and a model (by the endpoint's own name, where `names` has one), which needs its key to be set; the stub without an address."""
    if url is None:
        return Stub
    if not model:
        raise ValueError("a model must be named")
    if not os.environ.get(key_variable):
        raise ValueError(f"{key_variable} is not set")
    own = (names or {}).get(model, model)
    return lambda: Http(url, own, key_variable)
