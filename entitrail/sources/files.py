"""Single texts in and single files out, for the command line."""

from __future__ import annotations

import os
import tempfile


def read_utf8(path: str) -> str:
    """The file's text as it is: strict UTF-8, line ends kept."""
    with open(path, "rb") as f:
        return f.read().decode("utf-8")


def write_utf8_atomic(path: str, text: str) -> None:
    """Writes beside the target and renames, so that no reader sees half a file; the text ends with a line feed."""
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), prefix=".writing-")
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
            f.write(text if text.endswith("\n") else text + "\n")
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def distinct_paths(inputs: list[str], outputs: list[str]) -> None:
    """An output must not be an input or another output."""
    real = [os.path.realpath(x) for x in outputs]
    if len(set(real)) < len(real) or set(real) & {os.path.realpath(x) for x in inputs}:
        raise ValueError("output files must differ from the inputs and from each other")
