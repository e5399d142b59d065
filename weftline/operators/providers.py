"""Which generator a run uses, and what it falls back to.  Generators are callables that the caller registers; none is shipped."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from weftline.functions import vocabulary as V

Generate = Callable[[str], "str | None"]
DETERMINISTIC = "deterministic"
#: What an answer says where a login is missing.
AUTH_MARKERS = ("not logged in", "unauthorized", "authentication", "authorization", "auth failed", "401", "403", "please sign in", "login required", "gh auth login", "no valid credentials")


class GeneratorError(RuntimeError):
    """A generator gave no usable text."""


class UnavailableError(GeneratorError):
    """It can't be reached or isn't installed."""


class OutputError(GeneratorError):
    """It answered, and the answer is empty or breaks a rule."""


def is_true(value: str | None) -> bool:
    return (value or "").strip().lower() in V.TRUE_WORDS


def looks_like_auth_failure(message: str) -> bool:
    low = (message or "").lower()
    return any(m in low for m in AUTH_MARKERS)


@dataclass(frozen=True)
class Choice:
    """A generator by name; ``generate`` is None for the deterministic template, ``why_not`` says why there is none at all."""

    name: str | None
    generate: Generate | None = None
    why_not: str | None = None

    @property
    def deterministic(self) -> bool:
        return self.name == DETERMINISTIC


def choose(settings: Mapping[str, str], known: Mapping[str, Generate], name_key: str, default: str | None = DETERMINISTIC) -> Choice:
    """The generator that a setting names; without one, the default."""
    name = (settings.get(name_key) or "").strip().lower() or default
    if name is None:
        return Choice(None, None, "no provider is named")
    if name == DETERMINISTIC:
        return Choice(DETERMINISTIC)
    if name not in known:
        return Choice(None, None, f"unknown provider {name}")
    return Choice(name, known[name])


def for_preview(settings: Mapping[str, str], known: Mapping[str, Generate], name_key: str) -> Generate | None:
    """The generator that a preview may ask; none where nothing or the template is named, so that no run passes for one with a generator."""
    return choose(settings, known, name_key, DETERMINISTIC).generate


def for_initialisation(settings: Mapping[str, str], known: Mapping[str, Generate], enabled_key: str, name_key: str, injected: Generate | None = None) -> Choice:
    """The generator that may write a baseline.  One handed over is permission; else it must be enabled and named."""
    if injected is not None:
        return Choice("injected", injected)
    if not is_true(settings.get(enabled_key)):
        return Choice(None, None, "initialisation is not enabled")
    return choose(settings, known, name_key, None)


def with_fallback(choice: Choice, fallback: Generate, strict: bool = False) -> Generate:
    """A generator that uses ``fallback`` where the chosen one fails or says nothing; ``strict`` raises instead."""

    def generate(prompt: str) -> str:
        try:
            text = choice.generate(prompt) if choice.generate else fallback(prompt)
            if not (text or "").strip():
                raise OutputError(f"{choice.name} gave no text")
            return text
        except Exception as error:
            if strict:
                raise error if isinstance(error, GeneratorError) else UnavailableError(str(error)) from error
            return fallback(prompt) or ""

    return generate
