"""Stop words per document language: one text file a language beside this
module, a word a line (fixed values: the public lists that Spark ML's
``StopWordsRemover`` ships).  Read as plain files, so neither a session nor
Spark's jars are needed."""

from __future__ import annotations

from pathlib import Path

# documents' language codes and the names of their lists.
STOP_LISTS = {"en": "english", "fr": "french", "de": "german", "es": "spanish"}


def stop_words(lists: dict[str, str] = STOP_LISTS, folder: Path = Path(__file__).parent) -> list[tuple[str, str]]:
    """(lang, word), sorted and distinct; under a thousand rows."""
    return sorted({(lang, w) for lang, name in lists.items()
                   for w in (folder / f"{name}.txt").read_text(encoding="utf-8").splitlines() if w})
