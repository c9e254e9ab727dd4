"""Settings: from a properties file, else the environment, else the name itself."""

from __future__ import annotations

import os


def setting(name: str, path: str = "config.properties") -> str:
    if os.path.exists(path):
        with open(path) as f:
            for line in f:
                key, sep, value = line.partition("=")
                if sep and not key.lstrip().startswith(("#", "!")) and key.strip() == name:
                    return value.strip()
    return os.environ.get(name, name)
