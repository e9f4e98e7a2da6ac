"""Settings of a live page extractor, read on the machine that calls it; keys are never columns."""

from __future__ import annotations

import os

KEY_VARIABLE, MODEL_VARIABLE = "TABLEWRIGHT_API_KEY", "TABLEWRIGHT_MODEL"
PLACEHOLDERS = ("", "your_api_key_here", "changeme")


def get_api_key(variable: str = KEY_VARIABLE) -> str:
    key = os.environ.get(variable, "").strip()
    if key in PLACEHOLDERS:
        raise ValueError(f"set {variable} to the key of your extraction service")
    return key


def get_model_name(default: str = "default", variable: str = MODEL_VARIABLE) -> str:
    return os.environ.get(variable) or default
